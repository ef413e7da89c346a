"""Sub-documents and sections: parts of a source that are searched on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import words


def inherit(parts: DataFrame, parents: DataFrame, fields: list[str], inherits: str = "inherit") -> DataFrame:
    """Parts (parent_id, fields) take a parent's value where they have none, unless their flag says no."""
    theirs = parents.select(F.col("doc_id").alias("parent_id"), *[F.col(f).alias(f"_{f}") for f in fields])
    flag = F.coalesce(F.col(inherits), F.lit(True)) if inherits in parts.columns else F.lit(True)
    joined = parts.join(theirs, "parent_id", "left")
    return joined.withColumns({f: F.coalesce(F.col(f), F.when(flag, F.col(f"_{f}"))) for f in fields}).drop(*[f"_{f}" for f in fields])


def sectioned_postings(parts: DataFrame, doc: str, order: list[str], kind: str, text: str, overlap: int, sub_document: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings of the field text over all parts of a document, and its sections (doc_id, start, end, section_type).

    sub_document: a column that names the sub-document of a part; sections then carry it. Words count on through a document; where the kind of part changes, the overlap lies between, so nothing is near across the change.
    """
    tokens = words(F.col(text))
    own = Window.partitionBy("doc_id").orderBy(*order)
    named = [F.col(sub_document).cast("string").alias("sub_document")] if sub_document else []
    sized = parts.select(F.col(doc).cast("long").alias("doc_id"), *order, F.col(kind).alias("section_type"), *named, tokens.alias("_words"))
    gap = F.when(F.lag("section_type").over(own) != F.col("section_type"), overlap).otherwise(0)
    placed = sized.withColumn("_gap", gap).withColumn("_begin", F.sum(F.col("_gap") + F.size("_words")).over(own) - F.size("_words"))
    sections = placed.where(F.size("_words") > 0).select("doc_id", F.col("_begin").cast("int").alias("start"), (F.col("_begin") + F.size("_words")).cast("int").alias("end"), "section_type", *(["sub_document"] if sub_document else []))
    postings = placed.select("doc_id", "_begin", F.posexplode("_words").alias("_i", "term")).select(
        F.lit("text").alias("field"), "term", "doc_id", (F.col("_begin") + F.col("_i")).cast("int").alias("pos"), F.lit(False).alias("is_first"), F.lit(False).alias("is_last")
    )
    return postings, sections
