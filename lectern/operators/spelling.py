"""Spelling suggestions from corpus statistics: words, neighbouring pairs, and keys under which similar words meet."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import accents_folded, edit_distance, fold_accents, sound_key, words as words_of

MIN_WORD, MIN_PAIR, MOST_DISTANCE = 2, 2, 4
KEY_LENGTH, KEY_CHARACTERS = 6, 4


def word_counts(postings: DataFrame, stop_words: Sequence[str] = (), least: int = MIN_WORD) -> DataFrame:
    """Rows (word, freq) of words that are no stop words."""
    return postings.where(~F.col("term").isin(*(stop_words or [""]))).groupBy(F.col("term").alias("word")).agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def pair_counts(postings: DataFrame, stop_words: Sequence[str] = (), least: int = MIN_PAIR) -> DataFrame:
    """Rows (first, second, freq) of neighbours, stop words between them left out; pairs don't reach from one field's value to the next."""
    own = postings.where(~F.col("term").isin(*(stop_words or [""])))
    after = F.lead("term").over(Window.partitionBy("field", "doc_id").orderBy("pos"))
    return own.select(F.col("term").alias("first"), after.alias("second")).where("second is not null").groupBy("first", "second").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def text_pair_counts(texts: DataFrame, stop_words: Sequence[str] = (), least: int = MIN_PAIR) -> DataFrame:
    """pair_counts of texts (column text), each a document of its own: neighbours are told within a row, so words are neither exchanged nor sorted."""
    after = F.slice("_words", F.lit(2), F.greatest(F.size("_words") - 1, F.lit(0)))
    pairs = texts.select(words_of(F.col("text"), stop_words).alias("_words")).select(F.explode_outer(F.arrays_zip(F.col("_words").alias("first"), after.alias("second"))).alias("p"))
    return pairs.select("p.first", "p.second").where("second is not null").groupBy("first", "second").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def spelling_keys(words: DataFrame) -> DataFrame:
    """Rows (key, word, freq): every four of a word's first six characters, in order, blanks filling up short words."""
    padded = F.rpad(F.substring(accents_folded(F.col("word")), 1, KEY_LENGTH), KEY_LENGTH, " ")
    keys = F.array_distinct(F.array(*[F.concat(*[F.substring(padded, i + 1, 1) for i in chosen]) for chosen in combinations(range(KEY_LENGTH), KEY_CHARACTERS)]))
    return words.select(F.explode(keys).alias("key"), "word", "freq")


def keys_of(word: str) -> list[str]:
    padded = fold_accents(word)[:KEY_LENGTH].ljust(KEY_LENGTH)
    return sorted({"".join(padded[i] for i in chosen) for chosen in combinations(range(KEY_LENGTH), KEY_CHARACTERS)})


def frequency_levels(words: DataFrame) -> list[int]:
    """The 99 %, 90 %, 50 %, 25 % and 0 % points of frequencies above the average; with fewer than 500 words all beyond reach."""
    total = words.agg(F.count("*").alias("n"), F.avg("freq").alias("mean")).first()
    if total.n < 500:
        return [2**31 - 1] * 5
    return [int(x) for x in words.where(F.col("freq") > total["mean"]).agg(F.percentile_approx("freq", [0.99, 0.9, 0.5, 0.25, 0.0], 10_000).alias("p")).first().p]


def frequency_boost(freq: int, levels: Sequence[int]) -> float:
    """From 0.25 at the top level down in steps of 0.05, within a level by whole-number division; -0.2 for an unknown word."""
    if freq <= 0:
        return -0.2
    for i, level in enumerate(levels):
        if freq >= level:
            above = levels[i - 1] if i else level
            return 0.25 - 0.05 * i + (0.05 * ((freq - level) // max(1, above - level)) if i else 0.0)
    return 0.0


def word_score(original: str, word: str, freq: int, levels: Sequence[int]) -> float:
    distance = edit_distance(original, word)
    score = 1 - distance / 2 / max(1, len(original))
    score += 0.1 * (sound_key(original) == sound_key(word)) + 0.1 * (original[:1] == word[:1] and original[-1:] == word[-1:])
    return score + frequency_boost(freq, levels)


def candidates(keys: DataFrame, words: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """For each word the similar ones: they share a key and lie within the distance. The scan prunes to the keys of these words."""
    wanted = sorted({k for w in words for k in keys_of(w)})
    found = keys.where(F.col("key").isin(*wanted)).select("key", "word", "freq").collect()
    by: dict[str, set[tuple[str, int]]] = {}
    for r in found:
        by.setdefault(r.key, set()).add((r.word, r.freq))
    return {w: sorted(c for c in set().union(*[by.get(k, set()) for k in keys_of(w)]) if edit_distance(w, c[0], MOST_DISTANCE) <= MOST_DISTANCE) for w in words}


def pair_score(new: int, old: int) -> float:
    return max(0.0, math.log((new + 1) / (old + 1)) / math.log(100) / 2) if new > old else 0.0


class Speller:
    """Suggestions for words and phrases over the tables of a corpus."""

    def __init__(self, words: DataFrame, pairs: DataFrame, keys: DataFrame | None = None, equivalent=fold_accents):
        self.words, self.pairs, self.equivalent = words, pairs, equivalent
        self.keys = spelling_keys(words) if keys is None else keys
        self.levels = frequency_levels(words)

    def frequencies(self, words: Sequence[str]) -> dict[str, int]:
        found = {r.word: r.freq for r in self.words.where(F.col("word").isin(*words)).collect()} if words else {}
        return {w: found.get(w, 0) for w in words}

    def pair_frequencies(self, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], int]:
        firsts, seconds = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
        rows = self.pairs.where(F.col("first").isin(*firsts) & F.col("second").isin(*seconds)).collect() if pairs else []
        found = {(r["first"], r["second"]): r.freq for r in rows}
        return {p: found.get(p, 0) for p in pairs}

    def similar(self, words: Sequence[str], most: int = 100) -> dict[str, list[tuple[float, str, int]]]:
        """Scored candidates, the best first. What folds to the same word is no suggestion."""
        return {
            w: sorted(((word_score(w, c, f, self.levels), c, f) for c, f in found if c != w and self.equivalent(c) != self.equivalent(w)), key=lambda x: (-x[0], x[1]))[:most]
            for w, found in candidates(self.keys, words).items()
        }

    def suggest_word(self, word: str) -> str | None:
        """The best of replacing the word and of splitting it in two known words of two characters at least; None if it is best as it is."""
        return self.suggest_words([word])[0]

    def suggest_words(self, words: Sequence[str]) -> list[str | None]:
        """suggest_word of each of several words, that are looked up together: the tables are read once for all."""
        words = [w.lower() for w in words]
        known, similar = self.frequencies(words), self.similar(words)
        splits = {w: [(w[:i], w[i:]) for i in range(2, len(w) - 1)] for w in words}
        pairs = self.pair_frequencies([p for of_word in splits.values() for p in of_word])
        made = []
        for w in words:
            own = 1.0 + frequency_boost(known[w], self.levels) + 0.2 * (known[w] > 0)
            options = [(score, text) for score, text, _ in similar[w][:1]]
            options += [(0.8 + pair_score(pairs[p], 0), " ".join(p)) for p in splits[w] if pairs[p]]
            best = max(options, key=lambda o: (o[0], o[1]), default=None)
            made.append(best[1] if best and (best[0] > own or not known[w]) else None)
        return made

    def suggest(self, text: Sequence[str]) -> list[str | None]:
        """For each word of a phrase the suggestion, None for as it is, the empty string for gone (joined to the one before)."""
        words = [w.lower() for w in text]
        if len(words) == 1:
            return [self.suggest_word(words[0])]
        known = self.frequencies(words)
        lists = self.similar(words)
        made: list[str | None] = [None] * len(words)
        for i in range(len(words) - 1):
            a, b = words[i], words[i + 1]
            left = [(1.0 if known[a] else 0.8, a, known[a]), *lists[a]]
            right = [(1.0 if known[b] else 0.8, b, known[b]), *lists[b]]
            freq = self.pair_frequencies([(x[1], y[1]) for x in left for y in right])
            old = freq[a, b]
            options = [((x[0] + y[0]) / 2 + pair_score(freq[x[1], y[1]], old), x[1], y[1]) for x in left for y in right if (x[1], y[1]) != (a, b) and freq[x[1], y[1]] > old]
            joined = self.frequencies([a + b])[a + b]
            if joined and not old:
                options.append((0.8 + pair_score(joined, min(known[a], known[b])), a + b, ""))
            best = max(options, default=None)
            if best and best[0] > (1.0 if known[a] and known[b] else 0.6):
                made[i] = best[1] if best[1] != a else made[i]
                made[i + 1] = best[2] if best[2] != b else None
                words[i], words[i + 1] = best[1], best[2] or best[1]
                known |= self.frequencies([words[i], words[i + 1]])
                lists |= self.similar([words[i], words[i + 1]])
        for i, w in enumerate(words):
            if made[i] is None and not known[w]:
                made[i] = self.suggest_word(w)
        return made
