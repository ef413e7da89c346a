"""Sorting, paging, boost tables, normalised and explained scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.ast import QueryError


def sort_keys(spec: str) -> list[tuple[str, bool, bool]]:
    """Fields with (descending, empty first) from a list such as "title:descending -date:emptyFirst score".

    Empty values come last in either direction unless told otherwise. Conflicting modifiers are an error.
    """
    keys = []
    for part in re.split(r"[ \t\r\n,;]+", spec.strip()):
        if not part:
            continue
        name, *modifiers = part.split(":")
        sign = name[0] if name[0] in "+-" else ""
        name = name[len(sign) :]
        for pair in ({"ascending", "descending"}, {"emptyFirst", "emptyLast"}):
            if pair <= set(modifiers):
                raise QueryError(f"conflicting sort modifiers: {part}")
        if unknown := set(modifiers) - {"ascending", "descending", "emptyFirst", "emptyLast"}:
            raise QueryError(f"unknown sort modifiers: {sorted(unknown)}")
        if sign and {"ascending", "descending"} & set(modifiers):
            raise QueryError(f"conflicting sort modifiers: {part}")
        if name in ("score", "relevance"):
            if modifiers or sign:
                raise QueryError("sorting by score takes no modifiers")
            keys.append(("score", True, False))
            continue
        descending = sign == "-" or "descending" in modifiers
        keys.append(({"totalHits": "total_hits"}.get(name, name), descending, "emptyFirst" in modifiers))
    return keys


def order_by(df: DataFrame, spec: str) -> list[Column]:
    """Sort columns; ties end at the id. An empty string sorts as an empty value."""
    made = []
    for name, descending, empty_first in sort_keys(spec) or [("score", True, False)]:
        column = F.when(F.col(name).cast("string") == "", None).otherwise(F.col(name))
        made.append({(False, False): column.asc_nulls_last, (False, True): column.asc_nulls_first, (True, False): column.desc_nulls_last, (True, True): column.desc_nulls_first}[descending, empty_first]())
    return [*made, F.col("doc_id").asc()]


def page(hits: DataFrame, documents: DataFrame, sort: str = "", start: int = 0, most: int = 10, return_fields: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of a page with the fields asked for; sorting by score alone touches the documents of the page only."""
    named = [n for n, *_ in sort_keys(sort)]
    needs = [n for n in named if n not in ("score", "total_hits")]
    if needs:
        hits = hits.join(documents.select("doc_id", *needs), "doc_id", "left")
    rows = hits.orderBy(*order_by(hits, sort)).limit(start + most).offset(start).drop(*needs)
    fields = [c for c in documents.columns if c != "doc_id"] if return_fields is None else list(return_fields)
    return rows.join(documents.select("doc_id", *fields), "doc_id", "left")


def boosted(hits: DataFrame, keys: DataFrame, boosts: DataFrame, exponent: float = 1.0, default: float = 1.0) -> DataFrame:
    """Multiply scores by a table's boost to an exponent. keys: (doc_id, key); boosts: (key, boost). Documents that end at 0 or less go."""
    table = keys.select("doc_id", "key").join(boosts.select("key", "boost"), "key", "left").select("doc_id", "boost")
    return hits.join(table, "doc_id", "left").withColumn("score", F.col("score") * F.pow(F.coalesce("boost", F.lit(default)), F.lit(exponent))).drop("boost").where("score > 0")


def read_boosts(lines: list[str]) -> list[tuple[str, float]]:
    """Lines key|boost in strictly ascending order of keys; the first bad line ends the table."""
    made: list[tuple[str, float]] = []
    for line in lines:
        key, bar, value = line.strip().partition("|")
        try:
            boost = float(value)
        except ValueError:
            break
        if not bar or (made and key <= made[-1][0]):
            break
        made.append((key, boost))
    return made


def normalised(hits: DataFrame) -> DataFrame:
    """Scores divided by the best one, which a small aggregate brings."""
    return hits.crossJoin(F.broadcast(hits.agg(F.max("score").alias("_best")))).withColumn("score", F.col("score") / F.col("_best")).drop("_best")


def explained(spans: DataFrame) -> DataFrame:
    """Each document's score with what it is made of."""
    return spans.groupBy("doc_id").agg(
        F.struct(F.sqrt(F.sum("score")).alias("value"), F.sum("score").alias("sum_of_spans"), F.count("*").alias("spans"), F.max("score").alias("best_span"), F.min("score").alias("least_span")).alias("explanation")
    )
