"""Toxicity by a convolutional text classifier.

Each word is the sum of the hashed embeddings of itself and of its beginnings. Filters over one, two and three words
are pooled by their maximum over the whole text, so length doesn't matter and a single passage is enough. All is trained
in numpy on a bounded sample. A threshold is calibrated for each language, which is told from a text's function words,
and scores are shifted so that it lies at 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import filled, small_batches, table
from lectern.llm.words import EDGES, Adam, WordRows, bucket, cut_for, in_portions, labelled_sample, logistic, score_of, scored_columns

BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
BEGINNINGS = (4, 5)
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Words whose filters are computed at once.
STRETCH = 1 << 16
#: Rows of either label that a threshold is calibrated on at least.
ENOUGH = 10
LANGUAGES = {
    "en": "the of and to in is that for it was with as by on at this from be are not",
    "fr": "le la les des et un une du dans est pour qui que sur pas au par avec ce ne",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "es": "el los las y del se por con una su para como al lo más pero sus entre era muy",
}
LANGUAGE_OF = {w: i for i, words in enumerate(LANGUAGES.values()) for w in words.split()}


def word_rows(words: list[str]) -> np.ndarray:
    """For each word the buckets of its features, and the language it tells, or -1."""
    rows = np.empty((len(words), 2 + len(BEGINNINGS)), np.int32)
    for i, word in enumerate(words):
        word = word.strip(EDGES).lower()
        rows[i, 0] = bucket(word, BUCKETS)
        for j, n in enumerate(BEGINNINGS, 1):
            rows[i, j] = bucket(f"{word[:n]}*", BUCKETS)
        rows[i, -1] = LANGUAGE_OF.get(word, -1)
    return rows


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3 / np.sqrt(k), (k * SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.weights = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.cuts = np.zeros(len(LANGUAGES) + 1)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.shift, self.weights, self.bias]

    def pooled(self, features: np.ndarray, counts: np.ndarray, positions: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The maximum of each filter over each text, 0 at least; and the words at which it is reached.

        features: the buckets of all words, text after text. Behind each text lie words of nothing, so that no
        filter sees two texts.
        """
        gap = max(WIDTHS) - 1
        texts, total = len(counts), int(counts.sum()) + gap * len(counts)
        starts = np.cumsum(counts + gap) - (counts + gap)
        of = np.repeat(np.arange(texts), counts)
        place = np.arange(len(of)) + gap * of
        best = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        where = np.full(best.shape, -1, np.int64)
        for at in range(0, total, STRETCH):
            end = min(total, at + STRETCH)
            a, b = np.searchsorted(place, [at, end + gap])
            if a == b:
                continue
            vectors = np.zeros((end + gap - at, SIZE), np.float32)
            vectors[place[a:b] - at] = self.embedding[features[a:b]].sum(axis=1)
            nothing = np.ones(end - at, bool)
            nothing[place[a:b][place[a:b] < end] - at] = False
            inside = np.searchsorted(starts, [at, end - 1], side="right") - 1
            heads = np.maximum(starts[inside[0] : inside[1] + 1] - at, 0)
            for f, k in enumerate(WIDTHS):
                windows = np.concatenate([vectors[j : end - at + j] for j in range(k)], axis=1)
                out = windows @ self.filters[f] + self.shift[f]
                out[nothing] = 0  # a window begins with a word; else it would see the next text
                columns = slice(f * FILTERS, (f + 1) * FILTERS)
                top = np.maximum.reduceat(out, heads, axis=0)
                mine = best[inside[0] : inside[1] + 1, columns]
                if positions:
                    for t, (h, e) in enumerate(zip(heads, [*heads[1:], len(out)])):
                        reached = out[h:e].argmax(axis=0)
                        better = top[t] > mine[t]
                        where[inside[0] + t, columns][better] = (at + h + reached)[better]
                np.maximum(mine, top, out=mine)
        best[counts == 0] = 0
        where[counts == 0] = -1
        return best, (where if positions else None)

    def logits(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.pooled(features, counts)[0] @ self.weights + self.bias

    def fit(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        ends = np.cumsum(counts)
        self._start(features, counts, labels)
        adam, rng, gap = Adam(self.parameters(), RATE), np.random.default_rng(seed), max(WIDTHS) - 1
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                words = np.concatenate([features[ends[i] - counts[i] : ends[i]] for i in chosen])
                n = counts[chosen]
                hidden, where = self.pooled(words, n, positions=True)
                error = ((logistic(hidden @ self.weights + self.bias) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
                slope = error[:, None] * self.weights * (where >= 0) * (hidden > 0)
                padded = np.full((int(n.sum()) + gap * len(n), features.shape[1]), -1, np.int32)
                padded[np.arange(len(words)) + gap * np.repeat(np.arange(len(n)), n)] = words
                change = [np.zeros_like(p) for p in self.parameters()]
                for f, k in enumerate(WIDTHS):
                    columns = slice(f * FILTERS, (f + 1) * FILTERS)
                    text, column = np.nonzero(slope[:, columns])
                    g, reached = slope[:, columns][text, column], where[:, columns][text, column]
                    np.add.at(change[1 + len(WIDTHS) + f], column, g)
                    for j in range(k):
                        rows = padded[reached + j]
                        real = rows[:, 0] >= 0
                        part = slice(j * SIZE, (j + 1) * SIZE)
                        np.add.at(change[1 + f][part].T, column[real], g[real, None] * self.embedding[rows[real]].sum(axis=1))
                        flow = g[real, None] * self.filters[f][part].T[column[real]]
                        for feature in range(rows.shape[1]):
                            np.add.at(change[0], rows[real, feature], flow)
                change[-2] += error @ hidden + 1e-4 * self.weights
                change[-1] += error.sum()
                adam.take(change)

    def _start(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> None:
        """Let the first component begin as how much more often a feature's texts have label 1, and half the filters see it."""
        of = np.repeat(np.arange(len(counts)), counts)
        pairs = np.unique((of[:, None] * BUCKETS + features).ravel())
        text, feature = pairs // BUCKETS, pairs % BUCKETS
        ones = np.bincount(feature, labels[text], BUCKETS)
        noughts = np.bincount(feature, 1 - labels[text], BUCKETS)
        p, n = labels.sum() + 1, (1 - labels).sum() + 1
        odds = np.log((ones + 0.5) / p) - np.log((noughts + 0.5) / n)
        self.embedding[:, 0] = np.where(ones + noughts >= 3, np.clip(odds, -3, 3), 0) / 2
        for filters in self.filters:
            filters[::SIZE, : FILTERS // 2] += 0.5
        self.weights.reshape(len(WIDTHS), -1)[:, : FILTERS // 2] = 0.3


class Scorer:
    def __init__(self, network: Network):
        self.network, self.words = network, WordRows(word_rows)

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words, words of each text, and each text's language: that of most of its function words, or the last number."""
        numbers, counts = self.words.number(texts)
        rows = self.words.rows[numbers]
        of = np.repeat(np.arange(len(counts)), counts)
        told = rows[:, -1]
        votes = np.bincount(of[told >= 0] * len(LANGUAGES) + told[told >= 0], minlength=len(counts) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
        return rows[:, :-1], counts, np.where(votes.any(axis=1), votes.argmax(axis=1), len(LANGUAGES))

    def scores(self, texts: list[str]) -> np.ndarray:
        made = [np.empty(0)]
        for some in in_portions(texts):
            features, counts, language = self.features(some)
            made.append(score_of(self.network.logits(features, counts), self.network.cuts[language]))
        return np.concatenate(made)


def fit(texts: list[str], labels: np.ndarray) -> Network:
    """Train on four fifths of the sample and calibrate on the last fifth, each language against the overall threshold.

    Where the fifth has fewer than ENOUGH of either label, all of the sample calibrates. With fewer than two of either
    label in the sample every score says that nothing is toxic.
    """
    network = Network()
    if labels.sum() < 2 or (1 - labels).sum() < 2:
        network.weights[:] = 0
        network.cuts[:] = 4.0
        return network
    features, counts, language = Scorer(network).features(texts)
    trains = np.arange(len(texts)) % 5 != 0
    network.fit(features[np.repeat(trains, counts)], counts[trains], labels[trains])
    logits = network.logits(features, counts)
    enough = lambda rows: labels[rows].sum() >= ENOUGH and (1 - labels[rows]).sum() >= ENOUGH
    own = ~trains if enough(~trains) else np.ones(len(texts), bool)
    network.cuts[:] = cut_for(logits[own], labels[own])
    for i in range(len(LANGUAGES)):
        mine = own & (language == i)
        if enough(mine):
            network.cuts[i] = cut_for(logits[mine], labels[mine])
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
    return fit(*labelled_sample(spark, sf_dir, "toxic", 3, 1))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier fitted on this folder's labels doesn't call toxic. A null text counts as empty."""
    return docs.withColumn("_lectern_score", scorer(spark, fitted(spark, sf_dir))).where(F.col("_lectern_score") < 0.7).select(docs.columns)


def op6_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, learned from labels with crc32(doc_id) mod 3 other than 1.

    A null text counts as empty; a null doc_id as the empty text, for the remainder. Every row is scored by itself, so
    repeated rows get one score. Of an id with several labels each counts. An empty table stays empty.
    """
    return scored_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), scorer(spark, fitted(spark, sf_dir)), 3, 1)
