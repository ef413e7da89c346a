"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a midpoint within r bits of both. So every distinct fingerprint
emits all variants within r bits, and rows meet where their variants are equal. All that meet in one variant lie within
2r bits of each other; linking each of them to the first of them loses no connection and makes no pairs within groups.

The shuffle carries, for each fingerprint, only the leading bits of its variants; the variants with the same leading
bits are made in the task that gets them. This is the shuffle on variants, at 37 to a few hundred rows for each
fingerprint in place of 2081.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import checkpointed, filled, release, small_batches, table, without_estimates
from lectern.llm.components import components

#: Variants that a task holds at once.
AT_ONCE = 1 << 22


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, as rows of eight bytes; none without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes both treat ASCII alone
    if not found:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: max(0, len(found) - words)]]
    hashed = b"".join([xxhash.xxh64_digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[min(words, len(found)) - 1 :])])
    return np.frombuffer(hashed, np.uint8).reshape(-1, 8)


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(text, words, seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint", words: int = 4, seed: int = 42) -> DataFrame:
    """Add each whole text's SimHash as a long, replacing a column of this name. A null text counts as empty: 0."""
    small_batches(df.sparkSession)

    @arrow_udf("long")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), words, seed) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(into, hashed(filled(text)))


def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most so many ones."""
    return np.array([sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(bits), k)], np.uint64)


def lead_bits(distinct: int, radius: int, width: int = 64) -> int:
    """How many leading bits to shuffle on, so that a task's variants number about AT_ONCE."""
    half = radius // 2
    ball = sum(math.comb(width, k) for k in range(half + 1))
    return min(width // 2, max(6, math.ceil(math.log2(max(1, distinct * ball / AT_ONCE)))))


def links_in(prints: np.ndarray, lead: int, bits: int, radius: int, width: int = 64) -> np.ndarray:
    """Links, as pairs of fingerprints, that span what meets in the variants whose leading bits are `lead`.

    width: the bits of a fingerprint; what stands above them, such as a table's number, never varies. Where a task has more variants than fit, it takes them by their next bits in turn.
    """
    half = radius // 2
    prints = np.unique(prints)
    balls = [sum(math.comb(width - bits, j) for j in range(k + 1)) for k in range(half + 1)]
    left = half - np.bitwise_count((prints >> np.uint64(width - bits)) ^ np.uint64(lead)).astype(int)
    more = 0
    while sum(balls[r] for r in left.clip(0)) >> more > AT_ONCE and bits + more < width - 4:
        more += 1
    low = width - bits - more
    found = []
    for part in range(1 << more):
        left = half - np.bitwise_count((prints >> np.uint64(low)) ^ np.uint64(lead << more | part)).astype(int)
        variants, who = [], []
        for r in range(half + 1):
            mine = np.flatnonzero(left == r)
            if len(mine):
                flips = masks(low, r)
                variants.append((prints[mine, None] & np.uint64((1 << low) - 1) ^ flips).ravel())
                who.append(np.repeat(mine, len(flips)))
        if not variants:
            continue
        variants, who = np.concatenate(variants), np.concatenate(who)
        ordered = np.sort(variants)
        met = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(met):
            continue
        met = met[np.r_[True, met[1:] != met[:-1]]]
        at = np.searchsorted(met, variants).clip(max=len(met) - 1)
        there = met[at] == variants
        at, who = at[there], who[there]
        order = np.lexsort((who, at))
        at, who = at[order], who[order]
        begins = np.r_[True, at[1:] != at[:-1]]
        first = who[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        found.append(np.unique(first[~begins].astype(np.int64) * len(prints) + who[~begins]))
    if not found:
        return np.empty((0, 2), np.uint64)
    pairs = np.unique(np.concatenate(found))
    root = list(range(len(prints)))
    kept = []
    for a, b in zip((pairs // len(prints)).tolist(), (pairs % len(prints)).tolist()):
        ra, rb = a, b
        while root[ra] != ra:
            root[ra] = ra = root[root[ra]]
        while root[rb] != rb:
            root[rb] = rb = root[root[rb]]
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    kept = prints[np.array(kept, np.int64).reshape(-1, 2)]
    assert (np.bitwise_count(kept[:, 0] ^ kept[:, 1]) <= 2 * half).all()
    return kept


def fingerprint_links(prints: DataFrame, radius: int = 4, width: int = 64, tables: int = 1) -> DataFrame:
    """Distinct fingerprints (column fingerprint, long, not null) to verified links (a, b) that connect all that lie within an even radius.

    With several tables, a table's number stands above the bits of a fingerprint, and links stay within a table.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    bits = lead_bits(prints.count() // tables, radius, width)
    flips = F.array(*[F.lit(int(m) if m < 1 << 63 else int(m) - (1 << 64)) for m in masks(bits, radius // 2)])
    spread = prints.select("fingerprint", F.explode(flips).alias("flip")).select("fingerprint", F.shiftrightunsigned("fingerprint", width - bits).bitwiseXOR(F.col("flip")).alias("lead"))

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_in(rows["fingerprint"].to_numpy().view(np.uint64), int(key[0]) & (1 << 64) - 1, bits, radius, width).view(np.int64), columns=["a", "b"])

    return spread.groupBy("lead").applyInPandas(meet, "a long, b long")


def with_root(fingerprinted: DataFrame, radius: int = 4, id_col: str = "doc_id") -> DataFrame:
    """Rows with root added, a fingerprint that names the row's component, and component_id, the smallest id in it.

    Equal fingerprints are one node, however many rows share them.
    """
    prints = checkpointed(fingerprinted.groupBy("fingerprint").agg(F.min(id_col).alias("_lectern_least")))
    roots = components(fingerprint_links(prints.select("fingerprint"), radius))
    named = prints.join(roots, prints.fingerprint == roots.node, "left").withColumn("root", F.coalesce("root", "fingerprint")).select("fingerprint", "root", "_lectern_least")
    least = named.groupBy("root").agg(F.min("_lectern_least").alias("component_id"))
    return fingerprinted.join(named.join(least, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def similar_groups(fingerprinted: DataFrame, radius: int = 4, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, fingerprint) with component_id added: the smallest id that links of at most `radius` bits reach.

    Rows may repeat. A null id takes part without being a name; a component of null ids alone has a null component_id.
    An empty table stays empty.
    """
    return with_root(fingerprinted, radius, id_col).drop("root")


#: Near-copies by similarity: tables in which candidates meet, and words of 64 bits by which they are judged.
TABLES, ROUNDS = 4, 10
#: Sets from this size on are judged by their bits before they are compared, and by how many standard deviations more than on average their bits may differ: fewer than one pair in 10^11 of the similarity is turned away.
LARGE_SET, DEVIATIONS = 100, 7
#: Bits of the filter that tells which texts are wanted, at most: 32 MB.
MOST_BITS = 1 << 28
#: Documents in which common shingles are looked for, in how many of them one is common, and how many are kept.
COMMON_SAMPLE, COMMON_LEAST, COMMON_MOST = 10_000, 4, 200_000
#: How many times one pair is compared for each group before all pairs between groups are.
PICKS = 3
#: What rounding may do to a bound on the number of shared shingles.
SLACK = 1e-6


def shingle_set(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of a text's shingles, in order, without repeats."""
    return np.unique(shingle_hashes(text, words, seed).copy().view(">u8").astype(np.uint64))


def signature(text: str, words: int = 5, seed: int = 42) -> bytes:
    """64 * ROUNDS SimHash bits of the set of a text's shingles: each round mixes their hashes anew."""
    return signature_of(shingle_set(text, words, seed))


def signature_of(hashes: np.ndarray) -> bytes:
    bits = np.zeros((ROUNDS, 64), bool)
    for r in range(ROUNDS):
        ones, n = np.zeros(64, np.int64), len(hashes)
        for at in range(0, n, 1 << 16):
            x = hashes[at : at + (1 << 16)] + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            ones += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        bits[r] = 2 * ones > n
    return np.packbits(bits).tobytes()


def most_differing(similarity: float) -> int:
    """The bits in which signatures of two large sets of this Jaccard similarity differ at most. Sets of unlike sizes differ in fewer."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * ROUNDS * share + DEVIATIONS * math.sqrt(64 * ROUNDS * share * (1 - share)))


def rarest(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set, the rarest first, that each set of this similarity has one of them among its own: all but `similarity` of the set, and one.

    common: hashes in order, which come last, by their ranks. An empty set gets 0, so that empty ones meet.
    """
    if not len(hashes):
        return np.zeros(1, np.uint64)
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.searchsorted(common, hashes).clip(max=len(common) - 1)
        rank = np.where(common[at] == hashes, ranks[at], 0)
    return hashes[np.lexsort((hashes, rank))[: len(hashes) - math.ceil(similarity * len(hashes) - SLACK) + 1]]


def common_shingles(docs: DataFrame, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of shingles that several documents of a sample have, and their ranks from 1, the commonest last. They decide speed, never results."""
    small_batches(docs.sparkSession)

    @arrow_udf("array<long>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingle_set(t.as_py(), words).view(np.int64) for t in texts], pa.list_(pa.int64()))

    n = docs.count()
    part = docs.select("text") if n <= COMMON_SAMPLE else docs.select("text").sample(COMMON_SAMPLE / n, 7)
    counted = part.select(F.explode(hashed(filled())).alias("token")).groupBy("token").count().where(F.col("count") >= COMMON_LEAST)
    found = counted.orderBy(F.desc("count"), "token").limit(COMMON_MOST).toPandas()
    hashes = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


def with_sketch(df: DataFrame, words: int = 5, similarity: float = 0.8, into: str = "sketch") -> DataFrame:
    """Add each whole text's signature, the size of its set of shingles, and the rarest of them."""
    common, ranks = common_shingles(df, words)
    small_batches(df.sparkSession)

    @arrow_udf("struct<signature binary, n int, rare array<long>>")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = [shingle_set(t.as_py(), words) for t in texts]
            rare = pa.array([rarest(h, common, ranks, similarity).view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([pa.array([signature_of(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int32()), rare], ["signature", "n", "rare"])

    return df.withColumn(into, sketched(filled()))


def table_bits(nodes: int) -> int:
    """Bits of a table's words: one more each time that nodes double, so that false candidates grow as the nodes do, not as their square. Room is left for a table's number."""
    return min(60, max(40, 15 + math.ceil(math.log2(max(1, nodes)))))


def likely_pairs(nodes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Rows (node long, n, signature) to pairs (a, b) that may have this similarity, but not all of them.

    Ball hashing in several short tables finds candidates: pairs of 0.9 nearly always, those of 0.8 two times in three,
    unlike ones hardly ever. What lies in one bucket is linked to its first.
    """
    width = table_bits(nodes.count())
    word = lambda t: F.shiftrightunsigned(F.conv(F.hex(F.substring("signature", t * 8 + 1, 8)), 16, -10).cast("long"), 64 - width) + (t << width)
    placed = nodes.select("node", F.explode(F.array(*[word(t) for t in range(TABLES)])).alias("fingerprint"))
    first = checkpointed(placed.groupBy("fingerprint").agg(F.min("node").alias("first")))
    equal = placed.join(first, "fingerprint").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(first.select("fingerprint"), 4, width, TABLES)
    end = lambda name: first.select(F.col("fingerprint").alias(name), F.col("first").alias(f"{name}_node"))
    near = links.join(end("a"), "a").join(end("b"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return plausible(near.union(equal).where("a <> b").distinct(), nodes, similarity)


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) without those whose sizes or signatures show that they are less similar than this. nodes: rows (node, n, signature)."""
    signed = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("signature").alias(f"{x}_signature"))
    bits = lambda column: [F.conv(F.hex(F.substring(column, 8 * r + 1, 8)), 16, -10).cast("long") for r in range(ROUNDS)]
    differing = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits("a_signature"), bits("b_signature"))), F.lit(0))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    may_be = (small >= similarity * large - SLACK) & ((small < LARGE_SET) | (differing <= most_differing(similarity)))
    return pairs.join(signed("a"), "a").join(signed("b"), "b").where(may_be).select("a", "b")


def pairs_apart(nodes: DataFrame, linked: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Rows (node, n, signature, rare) to pairs (a, b) that aren't linked yet, among them all of this similarity. linked: rows (node, root).

    Two such sets share one of the rarest of both. The places at which they share them bound how many they share in all.
    Roots that share a token are paired first and their members then, so members of one root, however many, never meet.
    """
    spread = nodes.select("node", "n", F.posexplode("rare").alias("pos", "token"))
    several = spread.groupBy("token").count().where("count > 1")
    met = likely_among(spread, several, "token", 64 * nodes.count())
    rooted = met.join(linked, "node", "left").select("token", F.coalesce("root", "node").alias("root"), "node", "n", "pos")
    apart = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    live = checkpointed(rooted.join(apart, "token", "left_semi"))
    here = live.select("token", "root").distinct()
    two = here.withColumnRenamed("root", "a_root").join(here.withColumnRenamed("root", "b_root"), "token").where("a_root < b_root")
    end = lambda x: live.select("token", F.col("root").alias(f"{x}_root"), F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("pos").alias(f"{x}_pos"))
    alike = F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - SLACK
    least = F.expr("a_n + b_n") * (similarity / (1 + similarity)) - SLACK
    rest = lambda a, b: F.least(F.col("a_n") - a - 1, F.col("b_n") - b - 1)
    pairs = two.join(end("a"), ["token", "a_root"]).join(end("b"), ["token", "b_root"]).where(alike & (F.least("a_pos", "b_pos") + 1 + rest(F.col("a_pos"), F.col("b_pos")) >= least))
    shared = pairs.groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("shared"), F.max("a_pos").alias("a_pos"), F.max("b_pos").alias("b_pos"))
    return plausible(shared.where(F.col("shared") + rest(F.col("a_pos"), F.col("b_pos")) >= least).select("a", "b"), nodes, similarity)


def text_digest() -> Column:
    return F.unhex(F.substring(F.sha2(filled().cast("binary"), 256), 1, 32))


def likely_among(rows: DataFrame, wanted: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows whose key is among the wanted ones, and a few others: a join behind this moves hardly more rows than it gives.

    One bit for each wanted key goes to all tasks, among about `bits` and MOST_BITS at most. Where there are so many
    keys that most bits are set, rows merely move in vain.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << math.ceil(math.log2(max(1, bits)))))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    number, position = F.bitmap_bucket_number(place + 1), F.bitmap_bit_position(place + 1)
    placed = wanted.select(number.alias("_lectern_part"), position.alias("_lectern_at")).repartition("_lectern_part")
    made = placed.groupBy("_lectern_part").agg(F.bitmap_construct_agg("_lectern_at").alias("_lectern_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_lectern_bits"), (F.col("_lectern_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = rows.withColumns({"_lectern_part": number, "_lectern_at": position}).join(F.broadcast(made), "_lectern_part")  # of MOST_BITS at most
    return there.where(F.getbit(byte, (F.col("_lectern_at") % 8).cast("int")) == 1).select(rows.columns)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b; other columns stay) whose texts' sets of shingles have this Jaccard similarity. nodes: rows (node, digest).

    Texts move rather than their sets, which are several times larger.
    """
    pairs = checkpointed(pairs)
    if pairs.isEmpty():
        return pairs
    small_batches(docs.sparkSession)

    @arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            made = []
            for x, y in zip(left, right):
                x, y = shingle_set(x.as_py(), words), shingle_set(y.as_py(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                made.append(len(x) + len(y) == 0 or both / (len(x) + len(y) - both) >= similarity)
            yield pa.array(made, pa.bool_())

    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"))
    there = likely_among(docs.select(text_digest().alias("digest"), filled().alias("text")), wanted, "digest", 16 * wanted.count())
    texts = there.join(wanted, "digest").dropDuplicates(["digest"]).select("node", "text")  # for both ends one exchange, which is compressed; a checkpoint isn't
    end = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"))
    return checkpointed(pairs.join(end("a"), "a").join(end("b"), "b").where(alike("a_text", "b_text")).select(pairs.columns))


def root_links(pairs: DataFrame, linked: DataFrame | None, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between roots that connect all that pairs of this similarity connect. linked: rows (node, root); a node that isn't there is its own root.

    For each root one pair with a smaller root is compared, a few times over with the roots that this leaves, and then
    every pair whose roots aren't connected yet. So of many copies that all meet each other hardly more texts move than
    there are copies.
    """
    if linked is None:
        rooted = pairs.select("a", "b", F.col("a").alias("a_root"), F.col("b").alias("b_root"))
    else:
        root = lambda x: linked.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
        rooted = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root"))
    ends = F.least("a_root", "b_root").alias("lo"), F.greatest("a_root", "b_root").alias("hi")
    rooted = without_estimates(checkpointed(rooted.where("a_root <> b_root").select("a", "b", *ends)))
    as_links = lambda some: some.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    links = as_links(rooted.limit(0))
    for _ in range(PICKS):
        release(docs.sparkSession)
        if rooted.isEmpty():
            return links
        first = rooted.groupBy("hi").agg(F.min(F.struct("lo", "a", "b")).alias("pair")).select("pair.a", "pair.b", "pair.lo", "hi")
        found = as_links(verified(first, nodes, docs, words, similarity))
        links, above = links.union(found), components(found)
        top = lambda x: above.select(F.col("node").alias(x), F.col("root").alias(f"{x}_top"))
        ends = F.coalesce("lo_top", "lo").alias("x"), F.coalesce("hi_top", "hi").alias("y")
        rest = rooted.join(first.select("a", "b"), ["a", "b"], "left_anti").join(top("lo"), "lo", "left").join(top("hi"), "hi", "left").select("a", "b", *ends)
        rooted = without_estimates(checkpointed(rest.where("x <> y").select("a", "b", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))))
    release(docs.sparkSession)
    return links.union(as_links(verified(rooted, nodes, docs, words, similarity)))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents without near-copies: of each group linked at this similarity of word shingles the one with the smallest doc_id stays, null coming last.

    All pairs of this Jaccard similarity are linked and no others: what ball hashing finds is verified on the shingles,
    then all pairs that could still join two groups are. Equal texts are one node; of equal ids in a group the one whose
    text's digest is smaller stays, and of equal texts any one row. A null text counts as empty, and all empty texts are
    one group. Texts move with the pairs that are compared, about one for each text with candidates, and once at the end.
    """
    rows = with_sketch(docs.select("doc_id", "text"), words, similarity).select("doc_id", text_digest().alias("digest"), "sketch")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    nodes = checkpointed(rows.groupBy("digest").agg(least.alias("w"), F.first("sketch").alias("sketch")).select("w", "digest", "sketch.*", F.monotonically_increasing_id().alias("node")))
    named = nodes.select("node", "digest")
    sized = nodes.select("node", "n", "signature")
    linked = components(root_links(likely_pairs(sized, similarity), None, named, docs, words, similarity))
    between = root_links(pairs_apart(nodes.select("node", "n", "signature", "rare"), linked, similarity), linked, named, docs, words, similarity)
    above = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    release(docs.sparkSession)
    rooted = nodes.select("node", "w").join(linked, "node", "left").select("w", F.coalesce("root", "node").alias("root"))
    grouped = rooted.join(above, "root", "left").groupBy(F.coalesce("top", "root").alias("root")).agg(F.min("w").alias("w"))
    winners = checkpointed(grouped.select(F.col("w.doc_id").alias("_lectern_id"), F.col("w.digest").alias("_lectern_digest")))
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.join(winners.select(F.col("_lectern_id").alias("doc_id")), "doc_id", "left_semi").select(docs.columns)
    again = docs.withColumn("_lectern_own", text_digest())
    kept = again.join(winners, again.doc_id.eqNullSafe(winners._lectern_id) & (again._lectern_own == winners._lectern_digest), "left_semi")
    return kept.dropDuplicates(["doc_id", "_lectern_own"]).select(docs.columns)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def op10_simhash_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over four-word shingles and its component of links at 4 or fewer differing bits."""
    prints = checkpointed(with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint"))
    return similar_groups(prints).select("doc_id", hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")
