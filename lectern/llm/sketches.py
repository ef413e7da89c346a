"""Document fingerprints as invertible Bloom lookup sketches.

A text is the set of its paragraphs: its lines, of which long ones are cut each PARAGRAPH characters. A paragraph's
digest goes into one cell of each of four tables; a cell holds how many digests it has, their exclusive or, and that of
their checksums. The sketches of two versions subtract cell by cell, so what they share is gone. A cell that then holds
a single digest shows it (its checksum fits); taking it out of its other cells frees further ones. If this peeling stops
before all cells are empty, a larger sketch is tried; in the end the plain sets decide. The digests recovered are the
paragraphs that differ.

The fingerprints that are returned are small sketches of one size, so that equal texts have equal ones; `differing` and
`likeness` need nothing but two of these, and say nothing where the texts differ in too many paragraphs. The likeness
that `compare` gives comes from sketches as large as the two texts need, and is the same wherever both exist.

All is done with DataFrame functions. The texts are exchanged once, to neighbours in the order of ids; cells are made,
subtracted and peeled in the partitions that this exchange made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, filled, table

PARAGRAPH = 80
#: Tables of a sketch; cells of one table of a fingerprint.
TABLES, WIDTH = 4, 6
#: Cells that a first comparison has for each paragraph of the two texts, and more for each table.
ROOM, SPARE = 2.2, 32
#: Peeling goes over each table so often; a comparison that fails is tried again with twice the room, so often.
CYCLES, ATTEMPTS = 3, 5
#: Rows of a stretch of neighbouring ids, and most stretches. Their borders come from a sample of ids of a bounded size.
STRETCH, MOST_STRETCHES = 512, 16_384
EDITED, NEXT, FIRST_PRINT, SECOND_PRINT, CARRIED = range(5)


def paragraphs(text: Column) -> Column:
    """The digests of a text's paragraphs, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PARAGRAPH}}}\n*|\n+"), F.lit(0)), lambda p: F.xxhash64(p)))


def checksum(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-7))


def cell_of(digest: Column, part: int, width: Column) -> Column:
    return (F.lit(part) * width + F.pmod(F.xxhash64(digest, F.lit(part)), width)).cast("int")


def borders(df: DataFrame, key: str) -> list[tuple[int, int]]:
    """Keys that cut the table into stretches of about STRETCH rows; they decide balance only. As a key also has a hash of the text, rows with one id are cut too."""
    rows = df.count()
    count = min(MOST_STRETCHES, math.ceil(rows / STRETCH))
    if count < 2:
        return []
    some = sorted(tuple(r[0]) for r in df.where(F.rand(1) < 16 * count / rows).select(key).limit(32 * count).collect())
    return sorted({some[i * len(some) // count] for i in range(1, count)}) if some else []


def stretch_of(key: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many borders the key has reached; looked up in two steps, as there may be thousands.

    All borders are two literals, whatever their number: one literal each keeps the driver busy for minutes.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    longs = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")

    def reached(ids: Column, hashes: Column) -> Column:
        own, hash_ = key.getField("id"), key.getField("hash")
        return F.size(F.filter(ids, lambda b, i: (b < own) | ((b == own) & (F.get(hashes, i) <= hash_))))

    ids, hashes = ([c[part] for c in cuts] for part in (0, 1))
    before = (F.greatest(reached(longs(ids[::step]), longs(hashes[::step])), F.lit(1)) - 1) * step
    inside = lambda numbers: F.slice(longs(numbers), before + 1, F.lit(step))
    return before + reached(inside(ids), inside(hashes))


def with_next(df: DataFrame, key: str, ties: list[str], carried: list[str], cuts: list[tuple[int, int]], only: DataFrame | None = None) -> DataFrame:
    """Rows in ascending key, each with the carried columns of the row after it as next_<name>; after the last comes the first.

    The keys are as row_key makes them. Adds _stretch and _place, which together name a row. The first row of each stretch
    also goes, as a shadow, to the end of the stretch before it; so one exchange is enough. only: the stretches wanted.
    """
    placed = df.withColumn("_stretch", stretch_of(F.col(key), cuts).cast("int"))
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("_stretch").agg(F.min(key)).collect())
    shadows = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    there = F.broadcast(df.sparkSession.createDataFrame(shadows, "_first struct<id: long, hash: long>, _before int"))  # at most MOST_STRETCHES rows
    as_itself = F.struct(F.col("_stretch").alias("s"), F.lit(False).alias("shadow"))
    as_shadow = F.struct(F.col("_before").alias("s"), F.lit(True).alias("shadow"))
    both = placed.join(there, F.col(key) == F.col("_first"), "left").withColumn("_as", F.explode(F.when(F.col("_first").isNull(), F.array(as_itself)).otherwise(F.array(as_itself, as_shadow))))
    both = both.select(*df.columns, F.col("_as.s").alias("_stretch"), F.col("_as.shadow").alias("_shadow"))
    parts = len(firsts)
    if only is not None:
        both = both.join(F.broadcast(only), "_stretch", "left_semi")  # at most MOST_STRETCHES rows
        parts = only.count()
    order = Window.partitionBy("_stretch").orderBy("_shadow", key, *ties)
    return (
        both.repartition(max(1, parts), "_stretch")
        .withColumns({f"next_{c}": F.lead(c).over(order) for c in carried} | {"_place": F.row_number().over(order)})
        .where(~F.col("_shadow"))
        .drop("_shadow")
    )


def edited_pairs(docs: DataFrame, cuts: list[tuple[int, int]], only: DataFrame | None = None) -> DataFrame:
    """Each document with its edited text, and the paragraph digests of both and of the next document."""
    rows = docs.select("doc_id", filled().alias("text"), row_key().alias("_key"))
    chained = with_next(rows, "_key", ["text"], ["text"], cuts, only)
    n = F.length("text")
    kept = n - F.floor(n / 4)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), kept.cast("int")), F.substring(F.col("next_text"), F.lit(1), (n - kept).cast("int")))
    return chained.select(*ROW, "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), paragraphs(F.col("text")).alias("first"), paragraphs(F.col("next_text")).alias("next")).withColumn("second", paragraphs(F.col("edited")))


def row_key() -> Column:
    """Ids in ascending order, null first; rows of one id by a hash of their texts."""
    return F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(filled()).alias("hash"))


ROW = ("_stretch", "_place")
CELL = (*ROW, "tag", "cell", "found")


def _summed(rows: DataFrame) -> DataFrame:
    summed = rows.groupBy(*CELL).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("sum").alias("sum"))
    return summed.where((F.col("tag").bitwiseAND(7) > NEXT) | (F.col("cell") < 0) | (F.col("n") != 0) | (F.col("key") != 0) | (F.col("sum") != 0))


def _peel(cells: DataFrame, part: int, keep: bool) -> DataFrame:
    """Take out all digests that stand alone in a cell of this table: each has one cell there, so none is taken twice.

    A digest found is counted in cell -1 if the first text has it, in cell -2 if the second; with `keep` it has a row of its own there.
    """
    width, key, n = F.shiftright("tag", 3), F.col("key"), F.col("n")
    mine = (F.col("cell") >= width * part) & (F.col("cell") < width * (part + 1))
    alone = (F.col("tag").bitwiseAND(7) <= NEXT) & mine & n.isin(-1, 1) & (F.col("sum") == checksum(key))
    zero = F.lit(0).cast("long")

    def row(cell: Column, found: Column, n: Column, key: Column, sum_: Column) -> Column:
        return F.struct(cell.cast("int").alias("cell"), found.alias("found"), n.cast("long").alias("n"), key.alias("key"), sum_.alias("sum"))

    out = F.array(row(F.when(n == 1, -1).otherwise(-2), key if keep else zero, F.lit(1), zero, zero), *[row(cell_of(key, other, width), zero, -n, key, F.col("sum")) for other in range(TABLES) if other != part])
    same = F.array(row(F.col("cell"), F.col("found"), n, key, F.col("sum")))
    return _summed(cells.select(*ROW, "tag", F.explode(F.when(alone, out).otherwise(same)).alias("r")).select(*ROW, "tag", "r.cell", "r.found", "r.n", "r.key", "r.sum"))


def _printed(kind: int) -> Column:
    """A sketch as a string: for each cell in use its number, count, digests and checksums in hexadecimal."""
    own = F.array_sort(F.collect_list(F.when((F.col("tag") % 8 == kind) & (F.col("n") != 0), F.struct("cell", "n", "key", "sum"))))
    cell = lambda c: F.concat(F.lpad(F.hex(c.cell), 2, "0"), F.hex(c.n), F.lit(":"), F.lpad(F.hex(c.key), 16, "0"), F.lpad(F.hex(c.getField("sum")), 16, "0"))
    return F.lower(F.array_join(F.transform(own, cell), " "))


def _read(fingerprint: Column, sign: int) -> Column:
    """A printed sketch as all its cells, struct<n, key, sum>, its counts times `sign`."""
    number = lambda part, at, size: F.conv(F.substring(part, at, size), 16, -10).cast("long")
    cells = F.transform(F.filter(F.split(fingerprint, " "), lambda c: c != ""), lambda c: F.struct(F.conv(F.substring(c, 1, 2), 16, 10).cast("int").alias("cell"), F.substring_index(F.substring(c, 3, 40), ":", 1).alias("n"), F.substring_index(c, ":", -1).alias("rest")))
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("sum"))
    full = lambda c: F.struct((F.conv(c.n, 16, 10).cast("long") * sign).alias("n"), number(c.rest, 1, 16).alias("key"), number(c.rest, 17, 16).alias("sum"))
    return F.transform(F.sequence(F.lit(0), F.lit(TABLES * WIDTH - 1)), lambda i: F.coalesce(F.get(F.transform(F.filter(cells, lambda c: c.cell == i), full), F.lit(0)), empty))


def differing(first: Column, second: Column) -> Column:
    """Two fingerprints to the digests that only one of their texts has, as far as these small sketches tell them: null if the peeling stops before its end."""
    minus = F.zip_with(_read(first, 1), _read(second, -1), lambda a, b: F.struct((a.n + b.n).alias("n"), a.key.bitwiseXOR(b.key).alias("key"), a.getField("sum").bitwiseXOR(b.getField("sum")).alias("sum")))
    found = F.array().cast("array<struct<n:bigint,key:bigint,sum:bigint>>")

    def step(state: Column, part: Column) -> Column:
        mine = F.slice(state.cells, part * WIDTH + 1, F.lit(WIDTH))
        alone = F.filter(mine, lambda c: c.n.isin(-1, 1) & (c.getField("sum") == checksum(c.key)))
        places = lambda key: F.array(*[cell_of(key, other, F.lit(WIDTH)) for other in range(TABLES)])

        def less(cell: Column, at: Column) -> Column:
            mine = F.filter(alone, lambda c: F.array_contains(places(c.key), at))
            return F.aggregate(mine, cell, lambda x, c: F.struct((x.n - c.n).alias("n"), x.key.bitwiseXOR(c.key).alias("key"), x.getField("sum").bitwiseXOR(c.getField("sum")).alias("sum")))

        return F.struct(F.transform(state.cells, less).alias("cells"), F.concat(state.found, alone).alias("found"))

    parts = F.transform(F.sequence(F.lit(0), F.lit(TABLES * CYCLES - 1)), lambda i: i % TABLES)
    left = lambda s: F.exists(s.cells, lambda c: (c.n != 0) | (c.key != 0) | (c.getField("sum") != 0))
    return F.aggregate(parts, F.struct(minus.alias("cells"), found.alias("found")), step, lambda s: F.when(~left(s), s.found))


def likeness(first: Column, second: Column) -> Column:
    """Shared paragraphs by all paragraphs of either text, from two fingerprints alone; null where they differ too much for sketches of this size, and a larger one is needed."""
    size = lambda f: F.aggregate(F.slice(_read(f, 1), 1, WIDTH), F.lit(0).cast("long"), lambda a, c: a + c.n)
    both, apart = size(first) + size(second), F.size(differing(first, second))
    return F.when(both == 0, 1.0).when(apart >= 0, (both - apart) / (both + apart))


def compare(pairs: DataFrame, room: float, keep: bool = False) -> DataFrame:
    """Rows of edited_pairs to the contract's columns, and whether each comparison came to its end; with `keep` also the digests that differ."""
    sha = F.sha2(F.encode("edited", "UTF-8"), 256)
    as_long = lambda i: F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long")
    width = lambda other: F.ceil((F.size("first") + F.size(other)) * room / TABLES).cast("long") + SPARE
    zero, small = F.lit(0), F.lit(WIDTH).cast("long")

    def side(kind: int, width: Column, sign: int, digests: Column) -> Column:
        return F.struct((width * 8 + kind).alias("tag"), F.lit(sign).cast("long").alias("n"), digests.alias("digests"))

    carried_values = (F.coalesce("doc_id", zero), F.col("doc_id").isNull().cast("int"), F.col("n_chars"), *map(as_long, range(4)), F.size("first"), F.size("second"), F.size("next"))
    sides = F.array(
        side(EDITED, width("second"), 1, F.col("first")),
        side(EDITED, width("second"), -1, F.col("second")),
        side(NEXT, width("next"), 1, F.col("first")),
        side(NEXT, width("next"), -1, F.col("next")),
        side(FIRST_PRINT, small, 1, F.col("first")),
        side(SECOND_PRINT, small, 1, F.col("second")),
        side(CARRIED, small, 1, F.array(*[v.cast("long") for v in carried_values])),
    )
    digests = pairs.select(*ROW, F.explode(sides).alias("s")).select(*ROW, "s.tag", "s.n", F.posexplode("s.digests").alias("at", "key"))
    carries = F.col("tag").bitwiseAND(7) == CARRIED
    places = F.when(carries, F.array("at")).otherwise(F.array(*[cell_of(F.col("key"), part, F.shiftright("tag", 3)) for part in range(TABLES)]))
    sum_ = F.when(carries, zero.cast("long")).otherwise(checksum(F.col("key")))
    cells = _summed(digests.select(*ROW, "tag", F.explode(places).alias("cell"), zero.cast("long").alias("found"), "n", "key", sum_.alias("sum")))
    for step in range(TABLES * CYCLES):
        cells = _peel(cells, step % TABLES, keep)
    kind, cell, n = F.col("tag").bitwiseAND(7), F.col("cell"), F.col("n")
    carried = lambda at: F.max(F.when((kind == CARRIED) & (cell == at), F.col("key")))
    measures = {}
    for name, k in (("edited", EDITED), ("next", NEXT)):
        measures[f"_{name}_differ"] = F.coalesce(F.sum(F.when((kind == k) & (cell < 0), n)), zero)
        measures[f"_{name}_left"] = F.count_if((kind == k) & (cell >= 0))
        if keep:
            measures[f"only_first_{name}"] = F.collect_list(F.when((kind == k) & (cell == -1), F.col("found")))
            measures[f"only_second_{name}"] = F.collect_list(F.when((kind == k) & (cell == -2), F.col("found")))
    done = cells.groupBy(*ROW).agg(
        F.when(carried(1) == 0, carried(0)).alias("doc_id"),
        carried(2).alias("n_chars"),
        F.lower(F.concat(*[F.lpad(F.hex(carried(i)), 16, "0") for i in range(3, 7)])).alias("edited_sha256"),
        _printed(FIRST_PRINT).alias("fingerprint"),
        _printed(SECOND_PRINT).alias("edited_fingerprint"),
        *[carried(i).alias(name) for i, name in ((7, "_first"), (8, "_second"), (9, "_next"))],
        *[v.alias(k) for k, v in measures.items()],
    )
    both = lambda other: F.col("_first") + F.col(other)
    like = lambda other, differ: F.when(both(other) == 0, 1.0).otherwise((both(other) - F.col(differ)) / (both(other) + F.col(differ)))
    return done.withColumns({"near_edited": like("_second", "_edited_differ"), "near_next": like("_next", "_next_differ"), "_failed": (F.col("_edited_left") > 0) | (F.col("_next_left") > 0)})


RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness: shared paragraphs by all paragraphs of either (1 if there are none).

    A null text counts as empty, a null doc_id comes before all others, equal ids are ordered by a hash of their texts. The next
    document of a single one is itself.
    """
    return fingerprints(table(spark, sf_dir, "documents"))


def fingerprints(docs: DataFrame, room: float = ROOM) -> DataFrame:
    cuts = borders(docs.select(row_key().alias("_key")), "_key")
    done = checkpointed(compare(edited_pairs(docs, cuts), room).select(*ROW, *RESULT, "_failed"))
    good = done.where(~F.col("_failed")).select(*RESULT)
    for attempt in range(1, ATTEMPTS):
        failed = done.where("_failed").select(*ROW)
        if failed.isEmpty():
            return good
        again = compare(edited_pairs(docs, cuts, failed.select("_stretch").distinct()), room * 2**attempt)
        done = checkpointed(again.select(*ROW, *RESULT, "_failed").join(failed, list(ROW), "left_semi"))
        good = good.union(done.where(~F.col("_failed")).select(*RESULT))
    failed = done.where("_failed").select(*ROW, *[c for c in RESULT if c not in ("near_edited", "near_next")])
    like = lambda other: F.when(F.size(F.array_union("first", other)) == 0, 1.0).otherwise(F.size(F.array_intersect("first", other)) / F.size(F.array_union("first", other)))
    plain = edited_pairs(docs, cuts, failed.select("_stretch").distinct()).select(*ROW, like("second").alias("near_edited"), like("next").alias("near_next"))
    return good.union(failed.join(plain, list(ROW)).select(*RESULT))
