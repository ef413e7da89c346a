"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

In a uniformly random assignment with fixed shard sizes, the numbers of rows that go from each partition to each shard
follow a multivariate hypergeometric law. So: permute each partition's rows locally; draw the matrix of exact counts;
give consecutive stretches of a partition to the shards as the matrix says; exchange; permute again within each shard.
Every row moves once. The matrix has a row for each partition. Where the input has more than MOST_PARTITIONS, several of
them are read by one task without an exchange, and such a task's rows are permuted as one; so the law is the same at any
size, and what the driver holds is bounded.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, table

#: Rows of the matrix at most: the driver draws, and sends to all tasks, so many times the number of shards.
MOST_PARTITIONS = 8192
#: About so many rows of a shard are ordered in one task.
STRETCH = 1 << 19


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones are among so many draws without replacement: ratio of uniforms, exact for any size."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if high - low < 40:
        spread = range(low, high + 1)
        return rng.choices(spread, [math.exp(_log_ways(good, bad, draws, k) - _log_ways(good, bad, draws, (low + high) // 2)) for k in spread])[0]
    mode = (draws + 1) * (good + 1) // (total + 2)
    top = _log_ways(good, bad, draws, mode)
    mean = draws * good / total
    deviation = math.sqrt(draws * good / total * (bad / total) * (total - draws) / max(1, total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * deviation + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= _log_ways(good, bad, draws, k) - top:
            return k


def _log_ways(good: int, bad: int, draws: int, k: int) -> float:
    """Logarithm of the probability of k, but for a constant."""
    return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1) + math.lgamma(bad - draws + k + 1))


def communication_matrix(rows: Sequence[int], columns: Sequence[int], seed: int) -> list[list[int]]:
    """A random matrix with these sums, as the counts of a uniform assignment have it."""
    if sum(rows) != sum(columns):
        raise ValueError("the sums differ")
    rng, left, matrix = random.Random(seed), list(columns), []
    for n in rows:
        drawn, rest = [], sum(left)
        for there in left:
            k = hypergeometric(rng, there, rest - there, n)
            drawn.append(k)
            n, rest = n - k, rest - there
        left = [a - b for a, b in zip(left, drawn)]
        matrix.append(drawn)
    return matrix


def even_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 20_240_601, sizes: Sequence[int] | None = None) -> DataFrame:
    """Add shard (int, from 0) and slot (long, gapless from 0 in its shard), replacing columns of these names.

    sizes: the rows of each shard; without it, counts differ by one at most. The columns must be of types that can be
    ordered (no maps). The same rows in the same partitions get the same places, in whatever order they are read. Rows
    may repeat and hold nulls: each gets a place of its own, and equal rows part like all others. An empty table stays
    empty.
    """
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    mine, order, here, drawn = "_lectern_partition", "_lectern_place", "_lectern_here", "_lectern_key"
    permuted = (
        df.select(*columns)
        .coalesce(MOST_PARTITIONS)
        .sortWithinPartitions(*columns)
        .withColumn(here, F.monotonically_increasing_id())
        .withColumn(drawn, F.xxhash64(F.lit(seed), here))
        .sortWithinPartitions(drawn, here)
        .withColumn("_lectern_row", F.monotonically_increasing_id())
        .select(*columns, F.shiftright("_lectern_row", 33).cast("int").alias(mine), F.col("_lectern_row").bitwiseAND((1 << 33) - 1).alias(order))
    )
    permuted = checkpointed(permuted)
    counts = sorted((r[0], r[1]) for r in permuted.groupBy(mine).count().collect())
    total = sum(n for _, n in counts)
    sizes = even_sizes(total, shards) if sizes is None else list(sizes)
    if len(sizes) != shards or sum(sizes) != total:
        raise ValueError("the sizes must be one for each shard and add up to the rows")
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    bounds = [(partition, list(accumulate(row))) for (partition, _), row in zip(counts, matrix)]
    bounds_table = F.broadcast(df.sparkSession.createDataFrame(bounds, f"{mine} int, _lectern_bounds array<long>"))  # at most MOST_PARTITIONS rows
    placed = (
        permuted.join(bounds_table, mine)
        .withColumn("shard", F.size(F.filter("_lectern_bounds", lambda b: b <= F.col(order))))
        .withColumn(drawn, F.xxhash64(F.lit(seed + 1), mine, order))
        .select(*columns, "shard", mine, order, drawn)
    )
    if max(sizes) <= STRETCH:
        rank = F.row_number().over(Window.partitionBy("shard").orderBy("_lectern_key", mine, order))
        return placed.select(*columns, "shard", (rank - 1).cast("long").alias("slot"))
    return _long_slots(placed, math.ceil(math.log2(max(sizes) / STRETCH)), columns, mine, order)


def _long_slots(placed: DataFrame, bits: int, columns: list[str], *ties: str) -> DataFrame:
    """Long shards are cut by the leading bits of the random key; a row's slot is its rank in its cut plus the rows of the cuts before."""
    cut = placed.withColumn("_lectern_cut", F.shiftrightunsigned("_lectern_key", 64 - bits).cast("int"))
    counted = cut.groupBy("shard", "_lectern_cut").count()
    reached = F.sum("count").over(Window.partitionBy("shard").orderBy("_lectern_cut"))
    before = counted.select("shard", "_lectern_cut", (reached - F.col("count")).alias("_lectern_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_lectern_cut").orderBy("_lectern_key", *ties)) - 1
    return cut.withColumn("_lectern_rank", rank).join(before, ["shard", "_lectern_cut"]).select(*columns, "shard", (F.col("_lectern_rank") + F.col("_lectern_before")).cast("long").alias("slot"))


def op5_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law of rows: counts differ by one at most. Only sizes and checksums move; a null text has size 8."""
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    narrow = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shuffle_into_shards(narrow, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
