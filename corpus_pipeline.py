"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir); the classifiers learn from the labels in sf_dir. Nulls count as empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, table
from lectern.llm.packing import pack, tokenize
from lectern.llm.pseudonyms import pseudonymise, session_key
from lectern.llm.quality import keep_good
from lectern.llm.simhash import keep_one_of_each
from lectern.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention-based classifier calls good."""
    return keep_good(spark, docs, sf_dir)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier doesn't call toxic."""
    return drop_toxic(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-copies."""
    return keep_one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for what is private, under the session's key; n_chars follows the text."""
    made = pseudonymise(docs, session_key(spark))
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two tokens, each from one document."""
    import public_tokenizers

    return pack(tokenize(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).drop("text"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("private_data", private_data), ("packing", packing)]

#: Trained classifiers and tokenizers are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; between stages the rows are written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
