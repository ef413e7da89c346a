"""Exact top-k search by pivot-table elimination.

For any pivot p, |d(q, p) - d(c, p)| <= d(q, c); the maximum over many pivots is a good lower bound. As
2 q.c = |q|^2 + |c|^2 - d(q, c)^2, a lower bound on the distance is an upper bound on the inner product. Candidates are
evaluated in the order of their bounds, until no bound left can reach the k-th best score: the result is exact.

Queries come in blocks of a fixed size. A block is sent to all candidate partitions together with, for each query, the
k-th best score among a bounded set of candidates; what cannot reach it is never evaluated. A partition keeps the k best
of each query while it reads on, and returns them at its end. The work grows with queries times candidates, its memory
does not.

Vectors of different lengths have no inner product and never meet. Vectors whose products doubles can't hold exactly
are compared in whole numbers of any size; a score beyond a long is the nearest long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, table

#: Queries that are searched together, candidates among which pivots and first thresholds are found, and pivots.
BLOCK, SAMPLE, PIVOTS = 4096, 2048, 48
#: Vectors of larger components (times the root of their length) don't fit the exact arithmetic of doubles.
LARGEST = 1 << 24
#: Components that a task searches at once.
AT_ONCE = 1 << 20
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"


def to_integers(df: DataFrame, scale: int = 1024) -> DataFrame:
    """Rows (vec_id, v array<long>): each component x becomes floor(scale * x), x as double.

    Rows with a null id, without a vector, or with a null or non-finite component take no part. What is beyond a long
    becomes the nearest long.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select("vec_id", F.transform(doubles, lambda x: F.floor(x * scale)).alias("v"))


def split_by_size(vectors: list | np.ndarray) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length and whether they are large: their places, and a matrix, of objects for large ones."""
    if isinstance(vectors, np.ndarray):  # all of one length
        most = np.maximum(vectors.max(axis=1, initial=0).astype(np.float64), -vectors.min(axis=1, initial=0).astype(np.float64))
        large = most * max(1.0, vectors.shape[1] ** 0.5) > LARGEST
        parts = ((False, np.flatnonzero(~large), np.float64), (True, np.flatnonzero(large), object))
        return {(vectors.shape[1], kind): (places, vectors[places].astype(of)) for kind, places, of in parts if len(places)}
    groups = defaultdict(list)
    for i, v in enumerate(vectors):
        large = bool(len(v)) and max(max(v), -min(v)) * max(1.0, len(v) ** 0.5) > LARGEST
        groups[len(v), large].append(i)
    made = {}
    for (length, large), places in groups.items():
        matrix = np.empty((len(places), length), object if large else np.float64)
        if length:
            matrix[:] = [vectors[i] for i in places]
        made[length, large] = (np.array(places), matrix)
    return made


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each pivot is the vector of the sample that lies farthest from those before."""
    if not len(sample):
        return sample
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def pivot_table(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def search(queries: np.ndarray, query_ids: np.ndarray, query_table: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[list[list[tuple]], int]:
    """For each query its k best (-score, id) among these candidates, of those that reach its least score; and how many were evaluated."""
    found, evaluated = [], 0
    norms = (vectors**2).sum(axis=1)
    for i, query in enumerate(queries):
        nearer = np.zeros(len(vectors))
        for p in range(distances.shape[1]):
            np.maximum(nearer, np.abs(distances[:, p] - query_table[i, p]), out=nearer)
        both = query @ query + norms
        # Squares are exact, their roots are not: each is off by half a unit in its last place, and none exceeds what
        # the two norms give. The bound is raised by more than that does to it.
        nearer = np.maximum(nearer - np.sqrt(both) * 2.0**-48, 0)
        bound = np.floor((both - nearer**2) / 2 + both * 2.0**-50 + 1e-3)
        open_ = np.flatnonzero((bound >= least[i]) & (ids != query_ids[i]))
        order = open_[np.argsort(-bound[open_], kind="stable")]
        best, at = [], 0
        while at < len(order):
            if len(best) == k and bound[order[at]] < -best[-1][0]:
                break
            some = order[at : at + 64 if at else max(64, 2 * k)]
            at += len(some)
            evaluated += len(some)
            scores = vectors[some] @ query
            best = sorted([*best, *((-int(s), int(c)) for s, c in zip(scores, ids[some]) if s >= least[i])])[:k]
        found.append(best)
    return found, evaluated


def search_large(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple]]:
    """As `search`, in whole numbers of any size."""
    whole = lambda m: m if m.dtype == object else m.astype(np.int64).astype(object)
    queries, vectors, found = whole(queries), whole(vectors), []
    for query, own in zip(queries, query_ids):
        scores = (vectors * query).sum(axis=1) if len(vectors) else []
        found.append(sorted((-min(max(int(s), LEAST_LONG), MOST_LONG), int(c)) for s, c in zip(scores, ids) if c != own)[:k])
    return found


class Block:
    """A block of queries, with what decides quickly about candidates: pivots and, for each query, a score that its k best reach."""

    def __init__(self, query_ids: np.ndarray, queries: list, sample_ids: np.ndarray, sample: list, k: int, pivots: int):
        self.ids, self.k, self.groups = query_ids, k, {}
        sampled = split_by_size(sample)
        nothing = (np.empty(0, np.int64), None)
        for (length, large), (places, matrix) in split_by_size(queries).items():
            there, some = sampled.get((length, False), nothing)
            if large or some is None:
                self.groups[length, large] = (places, matrix, None, None, np.full(len(places), -np.inf))
                continue
            chosen, scores = choose_pivots(some, pivots), matrix @ some.T
            scores[query_ids[places][:, None] == sample_ids[there]] = -np.inf
            least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(places), -np.inf)
            self.groups[length, large] = (places, matrix, pivot_table(matrix, chosen), chosen, least)

    def best_of(self, batches: Iterator[tuple[np.ndarray, list | np.ndarray]]) -> dict[int, list[tuple]]:
        """The k best of each query, by its place in the block, among the candidates (ids, vectors) of all batches."""
        best: dict[int, list[tuple]] = {}
        least = {key: group[-1].copy() for key, group in self.groups.items()}
        for ids, vectors in batches:
            for (length, large), (own, them) in split_by_size(vectors).items():
                for key in ((length, False), (length, True)):
                    if key in self.groups:
                        self._take(best, key, least[key], ids[own], them, large)
        return best

    def _take(self, best: dict[int, list[tuple]], key: tuple[int, bool], least: np.ndarray, ids: np.ndarray, vectors: np.ndarray, large: bool) -> None:
        places, queries, query_table, pivots, _ = self.groups[key]
        if large or key[1]:
            found = search_large(queries, self.ids[places], vectors, ids, self.k)
        elif pivots is None:
            found, _ = search(queries, self.ids[places], np.empty((len(queries), 0)), least, vectors, ids, np.empty((len(vectors), 0)), self.k)
        else:
            found, _ = search(queries, self.ids[places], query_table, least, vectors, ids, pivot_table(vectors, pivots), self.k)
        for i, (place, some) in enumerate(zip(places.tolist(), found)):
            if some:
                kept = best[place] = sorted([*best.get(place, ()), *some])[: self.k]
                if len(kept) == self.k:
                    least[i] = max(least[i], -kept[-1][0])


def in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list | np.ndarray]]:
    """Candidates (ids, vectors) in runs of about AT_ONCE components, however small the batches are; as an array where all have one length."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += len(batch.column("v").flatten())
        if size >= AT_ONCE:
            yield _run(pa.Table.from_batches(some))
            some, size = [], 0
    if some:
        yield _run(pa.Table.from_batches(some))


def _run(rows: pa.Table) -> tuple[np.ndarray, list | np.ndarray]:
    ids, vectors = rows.column("vec_id").to_numpy(), rows.column("v").combine_chunks()
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) == 1:
        return ids, vectors.flatten().to_numpy().reshape(len(ids), lengths[0])
    return ids, vectors.to_pylist()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best inner products, ties to the smaller vec_id.

    vectors, queries: rows (vec_id, v), neither null. A row with the query's own id is no candidate. Repeated candidates
    count as they are. Several queries with one id share its k ranks: the best of what any of them scores. Without
    queries or candidates there are no rows.
    """
    spark = vectors.sparkSession
    vectors = checkpointed(vectors)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample_ids, sampled = np.array([r.vec_id for r in sample], np.int64), [r.v for r in sample]
    rows, done = checkpointed(queries).toLocalIterator(), []
    while some := list(islice(rows, block)):
        sent = Block(np.array([r.vec_id for r in some], np.int64), [r.v for r in some], sample_ids, sampled, k, pivots)
        done.append(checkpointed(_search_block(spark, vectors, sent, k)))
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(spark: SparkSession, vectors: DataFrame, block: Block, k: int) -> DataFrame:
    """The k best of each query of a block, over all partitions."""
    sent = spark.sparkContext.broadcast(block)  # at most `block` queries

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value.ids
        rows = [(place, int(ids[place]), c, -s) for place, some in sent.value.best_of(in_runs(batches)).items() for s, c in some]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4, ["query", "query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return vectors.mapInArrow(candidates, FOUND).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "score")


def op2_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for every vector whose id is divisible by 100; null ids and vectors with nulls or without numbers take no part."""
    vectors = to_integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP2_SQL = """
WITH vectors AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
