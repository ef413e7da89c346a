"""URL rules in a trie over reversed host labels and path segments.

A rule holds for its host and all subdomains where the path starts with the rule's path. Of the rules that fit a URL
the longest decides: the one whose host has most labels, then the one whose path is longest. The trie is broadcast
while there are at most MOST_RULES rules; beyond that each URL makes the few (host, path) keys that could fit it, and
an equi-join finds the rules among them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import small_batches, table

#: At some 200 bytes a rule, the broadcast trie stays under about 200 MB.
MOST_RULES = 1_000_000

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


class UrlTrie:
    """Rules (host, path, verdict); of two for one host and path a block holds."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"neither allow nor block: {verdict!r}")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(("host", label), {})
            node = node.setdefault("paths", {})
            *segments, rest = path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            begun = node.setdefault(None, {})
            if begun.get(rest, (None, "allow"))[1] == "allow":
                begun[rest] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that decides, and its verdict."""
        node, found = self.root, self._in_path(self.root.get("paths"), path)
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            found = self._in_path(node.get("paths"), path) or found
        return found

    @staticmethod
    def _in_path(node: dict | None, path: str) -> tuple[str, str] | None:
        """The deepest rule: whole segments lead down, and what a rule has after its last slash begins the next segment."""
        found, at = None, 0
        while node is not None:
            begun = node.get(None)
            if begun:
                best = max((rest for rest in begun if path.startswith(rest, at)), key=len, default=None)
                found = found if best is None else begun[best]
            cut = path.find("/", at)
            if cut < 0:
                break
            node, at = node.get(path[at:cut]), cut + 1
        return found


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; else empty."""
    raw = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(df: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], default: str = "allow", url: str = "url", most: int = MOST_RULES) -> DataFrame:
    """Add host, path, rule (null: none fits) and verdict (the rule's, else the default), replacing columns of these names.

    rules: rows (host, path, verdict). A null url, or one without ://, has an empty host and path, which only a rule
    with an empty host can fit. Rows may repeat; an empty table stays empty.
    """
    spark = df.sparkSession
    split = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(rules, DataFrame):
        head = rules.select("host", "path", "verdict").limit(most + 1).collect()
        if len(head) > most:
            return _by_join(split, rules, default)
        rules = [tuple(r) for r in head]
    shared = spark.sparkContext.broadcast(UrlTrie(rules))
    small_batches(spark, 4096)

    @arrow_udf("rule string, verdict string")
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = shared.value
        for hosts, paths in batches:
            found = [trie.find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([f and f[i] for f in found], pa.string()) for i in (0, 1)], ["rule", "verdict"])

    return _judged(split.withColumn("_lectern_found", find("host", "path")), df, default)


def _judged(found: DataFrame, df: DataFrame, default: str) -> DataFrame:
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    return found.select(*kept, "host", "path", F.col("_lectern_found.rule").alias("rule"), F.coalesce("_lectern_found.verdict", F.lit(default)).alias("verdict"))


def _by_join(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """As the trie does, for any number of rules. Each distinct host and path is judged once.

    The lengths that rule paths have are few; a URL takes prefixes of those lengths alone.
    """
    lengths = rules.select(F.length("path").alias("n")).distinct()
    sizes = F.lit(sorted(r.n for r in lengths.collect()))
    ordered = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    targets = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, -i, i))))
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n.cast("int")))
    keys = targets.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes))
    met = keys.join(ordered.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict"), ["h", "p"])
    depth = F.struct(F.when(F.col("h") == "", 0).otherwise(F.size(F.split("h", r"\."))), F.length("p"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), depth).alias("_lectern_found"))
    return _judged(split.join(best, ["host", "path"], "left"), split, default)


def op7_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the four rules; what no rule fits is allowed. Every row is judged by itself, so repeated and null page_ids stay."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT host AS own_host, path AS own_path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.host = f.own_host AND s.path = f.own_path AND f.place = 1
"""
