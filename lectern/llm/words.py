"""What the two text classifiers share: words as rows of a table, labelled samples, and thresholds."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import filled, table

#: Labelled documents that a classifier is fitted on at most, and their longest text. Scores are of all whole texts.
SAMPLE, LONGEST_SAMPLED = 3000, 50_000
#: Words whose rows a worker keeps.
MOST_WORDS = 200_000
THRESHOLD = 0.7
EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»“”„‘’…¿¡–—"


class WordRows(dict):
    """Word to the number of its row; rows of new words are made together, when a batch has been numbered."""

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray]):
        super().__init__()
        self.rows_of, self.new, self.rows = rows_of, [], None

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row numbers of all words, one text after another, and how many words each text has."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.rows = None
        words = [t.split() for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int32, counts.sum())
        if self.new or self.rows is None:
            made = self.rows_of(self.new)
            self.rows = made if self.rows is None else np.concatenate([self.rows, made])
            self.new = []
        return numbers, counts


def in_portions(texts: list[str], characters: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in runs of about so many characters."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= characters:
            yield some
            some, size = [], 0
    if some:
        yield some


def bucket(feature: str, buckets: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cut_for(logits: np.ndarray, labels: np.ndarray, beta: float = 1.0) -> float:
    """The logit that parts the labels with the best F score, in the middle of the gap around it."""
    if not len(logits) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-logits, kind="stable")
    hits, taken = np.cumsum(labels[order]), np.arange(1, len(order) + 1)
    score = (1 + beta**2) * hits / (beta**2 * labels.sum() + taken)
    best = int(score.argmax())
    below = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 2
    return float((logits[order[best]] + below) / 2)


def score_of(logits: np.ndarray, cuts: np.ndarray | float) -> np.ndarray:
    """Scores from 0 to 1 in which the cut lies at the threshold."""
    return logistic(logits - cuts + np.log(THRESHOLD / (1 - THRESHOLD)))


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def take(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * m / (np.sqrt(v) + 1e-8)


def remainder(modulus: int) -> F.Column:
    """crc32 of the doc_id as text, by which rows are held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, modulus: int, held_out: int, most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """At most `most` labelled texts whose remainder isn't held out, in the order of a hash of their ids. Rows without a label or with a long text take no part in the fit."""
    chosen = (
        table(spark, sf_dir, "labels")
        .where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(modulus) != held_out))
        .select("doc_id", F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", filled().alias("_text")).where(F.length("_text") <= LONGEST_SAMPLED)
    found = documents.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "_text").limit(most).collect()  # the broadcast has `most` rows at most
    return [r._text for r in found], np.array([r._label for r in found], np.float64)


def scored_columns(df: DataFrame, score: F.Column, modulus: int, held_out: int) -> DataFrame:
    return df.select("doc_id", (remainder(modulus) == held_out).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
