"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, of which only the bag has a label. Every passage is encoded from the forms of its words
(case, signs, lengths, repetition: nothing that depends on a language); gated attention weighs the passages; the
weighted sum of their codes is scored. All is trained in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import filled, small_batches, table
from lectern.llm.words import Adam, WordRows, bucket, cut_for, in_portions, labelled_sample, logistic, score_of, scored_columns

#: Words of a passage, hashed word forms, and the sizes of a passage's code and of the attention's hidden layer.
PASSAGE, FORMS, CODE, ATTENTION = 64, 24, 16, 8
STEPS, RATE = 250, 0.02
OWN = 12
SIZE = OWN + FORMS + 4


def word_rows(words: list[str]) -> np.ndarray:
    """For each word what its characters are, and its hashed form: runs of lower, upper, digit and each other sign."""
    rows = np.zeros((len(words), OWN + FORMS), np.float32)
    for i, word in enumerate(words):
        n = len(word)
        upper = sum(map(str.isupper, word))
        digits = sum(map(str.isdigit, word))
        letters = sum(map(str.isalpha, word))
        signs = n - letters - digits
        rows[i, :OWN] = (n / 10, upper / n, digits / n, signs / n, signs > 1, upper > 1 and upper == letters, letters == 0, n > 20, word[-1] in ".!?", word[-1] in ",;:", n <= 3, word[0].isupper())
        form = []
        for c in word:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not form or form[-1] != kind:
                form.append(kind)
        rows[i, OWN + bucket("".join(form), FORMS)] = 1
    return rows


def passages(words: WordRows, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and how many passages each text has: one at least, all zero for a text without words."""
    numbers, counts = words.number(texts)
    each = np.maximum(1, -(-counts // PASSAGE))
    starts = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(each) - each
    passage = first[of] + (np.arange(len(of)) - starts[of]) // PASSAGE
    total = int(each.sum())
    rows = np.zeros((total, SIZE), np.float32)
    n = np.bincount(passage, minlength=total)
    if len(of):
        heads = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        rows[passage[heads], : OWN + FORMS] = np.add.reduceat(words.rows[numbers], heads, axis=0)
        pairs = np.unique(passage * (1 << 24) + numbers)  # a worker numbers fewer words than that
        rows[:, -4] = np.bincount(pairs >> 24, minlength=total)
        again = (numbers[1:] == numbers[:-1]) & (passage[1:] == passage[:-1])
        rows[:, -3] = np.bincount(passage[1:][again], minlength=total)
    rows[:, :-2] /= np.maximum(n, 1)[:, None]
    rows[:, -2] = n / PASSAGE
    rows[:, -1] = n == 0
    return rows, each


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        start = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(SIZE), np.ones(SIZE)
        self.code, self.code_bias = start(SIZE, CODE), np.zeros(CODE)
        self.tanh_gate, self.sigmoid_gate, self.attention = start(CODE, ATTENTION), start(CODE, ATTENTION), start(ATTENTION, 1)
        self.weights, self.bias = start(CODE, 1), np.zeros(1)
        self.cut = 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.code, self.code_bias, self.tanh_gate, self.sigmoid_gate, self.attention, self.weights, self.bias]

    def forward(self, rows: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = (rows - self.mean) / self.scale
        code = np.tanh(x @ self.code + self.code_bias)
        gate, open_ = np.tanh(code @ self.tanh_gate), logistic(code @ self.sigmoid_gate)
        raw = (gate * open_ @ self.attention)[:, 0]
        heads = np.cumsum(each) - each
        of = np.repeat(np.arange(len(each)), each)
        raw = np.exp(raw - np.maximum.reduceat(raw, heads)[of])
        share = raw / np.add.reduceat(raw, heads)[of]
        bag = np.add.reduceat(share[:, None] * code, heads, axis=0)
        return (bag @ self.weights)[:, 0] + self.bias, (x, code, gate, open_, share, bag, of, heads)

    def logits(self, rows: np.ndarray, each: np.ndarray) -> np.ndarray:
        return self.forward(rows, each)[0] if len(each) else np.empty(0)

    def fit(self, rows: np.ndarray, each: np.ndarray, labels: np.ndarray) -> None:
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 0.02
        weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
        adam = Adam(self.parameters(), RATE)
        for _ in range(STEPS):
            logits, (x, code, gate, open_, share, bag, of, heads) = self.forward(rows, each)
            error = (logistic(logits) - labels) * weight
            to_bag = error[:, None] * self.weights[:, 0]
            to_share = (to_bag[of] * code).sum(axis=1)
            to_raw = share * (to_share - np.add.reduceat(share * to_share, heads)[of])
            to_gated = to_raw[:, None] * self.attention[:, 0]
            to_gate, to_open = to_gated * open_ * (1 - gate**2), to_gated * gate * open_ * (1 - open_)
            to_code = (share[:, None] * to_bag[of] + to_gate @ self.tanh_gate.T + to_open @ self.sigmoid_gate.T) * (1 - code**2)
            adam.take(
                [
                    x.T @ to_code + 1e-4 * self.code,
                    to_code.sum(axis=0),
                    code.T @ to_gate,
                    code.T @ to_open,
                    ((gate * open_).T @ to_raw)[:, None],
                    (bag.T @ error)[:, None] + 1e-4 * self.weights,
                    np.array([error.sum()]),
                ]
            )


class Scorer:
    def __init__(self, network: Network):
        self.network, self.words = network, WordRows(word_rows)

    def scores(self, texts: list[str]) -> np.ndarray:
        made = [np.empty(0)]
        for some in in_portions(texts):
            made.append(score_of(self.network.logits(*passages(self.words, some)), self.network.cut))
        return np.concatenate(made)


def fit(texts: list[str], labels: np.ndarray) -> Network:
    """Train on the sample and put the threshold where bad documents are told apart best. With fewer than two of either label all documents are good."""
    network = Network()
    if labels.sum() < 2 or (1 - labels).sum() < 2:
        network.weights[:] = 0
        network.cut = -4.0
        return network
    known = WordRows(word_rows)
    rows, each = map(np.concatenate, zip(*[passages(known, some) for some in in_portions(texts)]))
    network.fit(rows, each, labels)
    network.cut = -cut_for(-network.logits(rows, each), 1 - labels)
    return network


def scorer(spark: SparkSession, network: Network) -> Column:
    small_batches(spark)
    sent = spark.sparkContext.broadcast(network)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = Scorer(sent.value)
        for texts in batches:
            yield pa.array(made.scores(texts.to_pylist()))

    return score(filled())


def fitted(spark: SparkSession, sf_dir: str) -> Network:
    return fit(*labelled_sample(spark, sf_dir, "quality", 4, 2))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier fitted on this folder's labels calls good. A null text counts as empty."""
    return docs.withColumn("_lectern_score", scorer(spark, fitted(spark, sf_dir))).where(F.col("_lectern_score") >= 0.7).select(docs.columns)


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learned from labels with crc32(doc_id) mod 4 other than 2.

    A null text counts as empty; a null doc_id as the empty text, for the remainder. Every row is scored by itself, so
    repeated rows get one score. Of an id with several labels each counts. An empty table stays empty.
    """
    return scored_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), scorer(spark, fitted(spark, sf_dir)), 4, 2)
