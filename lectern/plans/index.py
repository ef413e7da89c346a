"""The tables that queries run on, made from any document table or read back from storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import words

if TYPE_CHECKING:
    from lectern.sources.store import Kept

POSTINGS = "field string, term string, doc_id long, pos int, is_first boolean, is_last boolean"


@dataclass(frozen=True)
class Index:
    """documents: doc_id and what is returned; values: field, doc_id, ord, value; postings: see POSTINGS; sections: doc_id, start, end, section_type.

    Postings are written sorted by field and term, so a query's scan prunes to its terms.
    """

    documents: DataFrame
    values: DataFrame
    postings: DataFrame
    sections: DataFrame | None = None
    chunk_size: int = 200
    overlap: int = 20
    stop_words: frozenset[str] = frozenset()
    config: Mapping[str, str] = field(default_factory=dict)
    #: Fields whose postings are not stored: rows (doc_id, value) from which a query's own are made in one pass.
    texts: Mapping[str, DataFrame] = field(default_factory=dict)
    #: Rows (field, term, df, cf) of a stored index; without them they are counted.
    terms: DataFrame | None = None
    #: Where the postings of the terms that queries ask for stay from one query to the next; without it each scan finds them anew.
    kept: Kept | None = None

    @cached_property
    def doc_count(self) -> int:
        return self.documents.count()

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def term_postings(self, name: str, terms: Sequence[str]) -> DataFrame:
        """Rows (term, doc_id, pos) of these terms. Texts without any of them are told by a plain search before they are split."""
        if self.kept is not None and self.kept.has(name, terms):
            return self.kept.postings(name, terms).select("term", "doc_id", "pos")
        if name not in self.texts:
            return self.postings.where((F.col("field") == name) & F.col("term").isin(*terms)).select("term", "doc_id", "pos")
        return self._split(name, terms).select("term", "doc_id", "pos")

    def sized_postings(self, name: str, terms: Sequence[str]) -> DataFrame:
        """Rows (term, doc_id, pos, n) with the words n of the field."""
        if self.kept is not None and self.kept.has(name, terms):
            return self.kept.postings(name, terms)
        if "n" in self.postings.columns:
            return self.postings.where((F.col("field") == name) & F.col("term").isin(*terms)).select("term", "doc_id", "pos", "n")
        if name not in self.texts:
            return self.term_postings(name, terms).join(self.lengths([name]).select("doc_id", "n"), "doc_id")
        return self._split(name, terms).select("term", "doc_id", "pos", F.col("_n").alias("n"))

    def _split(self, name: str, terms: Sequence[str]) -> DataFrame:
        has = F.lit(False)
        for term in terms:
            has = has | F.contains(F.lower("value"), F.lit(term))
        tokens = words(F.col("value"))
        split = self.texts[name].where(has).select("doc_id", F.size(tokens).alias("_n"), tokens.alias("_words"))
        return split.select("doc_id", "_n", F.posexplode_outer("_words").alias("pos", "term")).where(F.col("term").isin(*terms))

    def with_lengths(self) -> DataFrame:
        """All postings with n, the words of their field in their document: of stored texts from the split itself, of others counted."""
        if "n" in self.postings.columns:
            return self.postings
        others = self.postings.where(~F.col("field").isin(*self.texts)) if self.texts else self.postings
        counted = others.groupBy("field", "doc_id").agg(F.count("*").cast("int").alias("n"))
        made = others.join(counted, ["field", "doc_id"])
        for name, rows in self.texts.items():
            made = made.unionByName(text_postings(rows, name, "value", sized=True))
        return made

    def lengths(self, fields: Sequence[str] | None = None) -> DataFrame:
        """Words of each field and document; of fields whose texts are there without a row for each word."""
        rest = self.postings.where(~F.col("field").isin(*self.texts)) if self.texts else self.postings
        sizes = rest.select("field", "doc_id", F.lit(1).alias("n"))
        for name, rows in self.texts.items():
            sizes = sizes.unionByName(rows.select(F.lit(name).alias("field"), "doc_id", F.size(words(F.col("value"))).alias("n")).where("n > 0"))
        own = sizes if fields is None else sizes.where(F.col("field").isin(*fields))
        return own.groupBy("field", "doc_id").agg(F.sum("n").alias("n"))

    @cached_property
    def once(self) -> bool:
        """Whether each document has one row, with an id."""
        return self.documents.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()

    def counted(self, fields: Sequence[str] | None = None) -> DataFrame:
        """Rows (field, term, df, cf). Where each document has one row, the words of a text are counted by term alone: no row for each word and document moves."""
        texts = {n: rows for n, rows in self.texts.items() if fields is None or n in fields}
        own = self.postings if fields is None else self.postings.where(F.col("field").isin(*fields))
        by_posting = lambda df: df.groupBy("field", "term").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("cf"))
        if not texts or not self.once:
            return by_posting(own)
        parts = [by_posting(own.where(~F.col("field").isin(*texts)))]
        for name, rows in texts.items():
            split = rows.select(words(F.col("value")).alias("_words"))
            marked = lambda array, first: F.transform(array, lambda w: F.struct(w.alias("term"), F.lit(first).alias("first")))
            each = split.select(F.explode_outer(F.concat(marked(F.col("_words"), 0), marked(F.array_distinct("_words"), 1))).alias("w")).where("w is not null")
            parts.append(each.groupBy(F.lit(name).alias("field"), "w.term").agg(F.sum("w.first").alias("df"), F.sum(1 - F.col("w.first")).alias("cf")))
        return reduce(DataFrame.unionByName, parts)

    def dictionary(self, field_name: str) -> DataFrame:
        if self.terms is not None:
            return self.terms.where(F.col("field") == field_name).select("term", "df", "cf")
        return self.postings.where(F.col("field") == field_name).groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("cf"))


def text_postings(df: DataFrame, field_name: str, text: str, id_col: str = "doc_id", sized: bool = False) -> DataFrame:
    """One row for each word of each text, by Spark's own functions; with `sized` also n, the words of the text. The words are counted below the generator: above it, each row would count them again. It is an outer one, as for others the planner asks first whether there are words, which splits each text twice."""
    tokens = words(F.col(text))
    split = df.select(F.col(id_col).cast("long").alias("doc_id"), F.size(tokens).alias("_n"), tokens.alias("_words"))
    return split.select("doc_id", "_n", F.posexplode_outer("_words").alias("pos", "term")).where("term is not null").select(
        F.lit(field_name).alias("field"), "term", "doc_id", "pos", (F.col("pos") == 0).alias("is_first"), (F.col("pos") == F.col("_n") - 1).alias("is_last"), *([F.col("_n").alias("n")] if sized else [])
    )


def keyword_postings(df: DataFrame, field_name: str, value: str, id_col: str = "doc_id") -> DataFrame:
    """An untokenised value is a single term."""
    return df.where(F.col(value).isNotNull()).select(
        F.lit(field_name).alias("field"), F.col(value).cast("string").alias("term"), F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("pos"), F.lit(True).alias("is_first"), F.lit(True).alias("is_last")
    )


def index_table(df: DataFrame, id_col: str, text: Sequence[str] = (), keywords: Sequence[str] = (), **options: object) -> Index:
    """An index over a table whose columns are fields; nothing is computed until a query runs."""
    parts = [text_postings(df, c, c, id_col) for c in text] + [keyword_postings(df, c, c, id_col) for c in keywords]
    postings = parts[0]
    for part in parts[1:]:
        postings = postings.unionByName(part)
    documents = df.withColumn("doc_id", F.col(id_col).cast("long"))
    values = None
    for c in (*text, *keywords):
        one = documents.where(F.col(c).isNotNull()).select(F.lit(c).alias("field"), "doc_id", F.lit(0).alias("ord"), F.col(c).cast("string").alias("value"))
        values = one if values is None else values.unionByName(one)
    texts = {c: documents.select("doc_id", F.col(c).alias("value")) for c in text}
    return Index(documents, values, postings, texts=texts, **options)
