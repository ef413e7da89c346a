"""Records of one work brought together by title, author, date and identifier."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fold_accents, year_of

LEAST = 150
WORKS = "doc_id long, work_id long, score int"


def plain(value: str | None) -> str:
    """A value without its sub-type tags, case, accents and punctuation other than : and (."""
    value = re.sub(r"\[[^\]]*\]", " ", value or "")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s:(]", " ", fold_accents(value.lower()))).strip()


def tag_of(value: str | None) -> str:
    found = re.search(r"\[([^\]]*)\]", value or "")
    return found[1] if found else ""


def _before(value: str, sign: str, least: int) -> str | None:
    head = value.split(sign)[0].strip()
    return head if len(head) >= least else None


def title_score(a: str, b: str) -> int:
    if not a and not b:
        return 0
    if a == b:
        return 100
    if a and b:
        heads = _before(a, ":", 10), _before(b, ":", 10)
        if heads[0] and heads[0] == heads[1]:
            return 80
        if set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split()):
            return 80
    return -100


def author_score(a: str, b: str) -> int:
    if not a and not b:
        return 75
    if a == b:
        return 100
    if a and b:
        one, other = sorted((set(a.split()), set(b.split())), key=len)
        long = {w for w in one if len(w) > 3}
        if (len(long) >= 2 and long <= other) or one <= other:
            return 80
    return -100


def date_score(a: str | None, b: str | None) -> int:
    first, second = year_of(a), year_of(b)
    if first is None or second is None:
        return 0
    if first == second:
        return 50 if tag_of(a) == tag_of(b) else -20
    return -40 if abs(first - second) <= 2 else -60


def id_score(a: str, b: str) -> int:
    if not a or not b:
        return 0
    if a == b:
        return 100
    heads = _before(a, "(", 6), _before(b, "(", 6)
    if (heads[0] and heads[0] == heads[1]) or set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split()):
        return 80
    return 0


def pair_score(a: dict, b: dict) -> int:
    return title_score(plain(a["title"]), plain(b["title"])) + author_score(plain(a["author"]), plain(b["author"])) + date_score(a["date"], b["date"]) + id_score(plain(a["id"]), plain(b["id"]))


class Block:
    """Plain records, in order of ids, and what finds for one of them all later ones that can score LEAST against it.

    Titles that don't fit cost 100, so the rest must then be equal: author, date and identifier, none empty.
    """

    def __init__(self, rows: list[dict]) -> None:
        self.rows = [{"doc_id": r["doc_id"], "date": r["date"], **{c: plain(r[c]) for c in ("title", "author", "id")}} for r in sorted(rows, key=lambda r: r["doc_id"])]
        self.words = [frozenset(r["title"].split()) for r in self.rows]
        self.count = Counter(w for words in self.words for w in words)
        self.having, self.rarest, self.headed, self.known, self.bare = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list), []
        for i, (r, words) in enumerate(zip(self.rows, self.words)):
            for w in words:
                self.having[w].append(i)
            if words:
                self.rarest[self._rarest(words)].append(i)
                self.headed[_before(r["title"], ":", 10)].append(i)
            else:
                self.bare.append(i)
            self.known[r["author"], r["id"]].append(i)

    def _rarest(self, words: frozenset) -> str:
        return min(words, key=lambda w: (self.count[w], w))

    def after(self, i: int) -> list[int]:
        r, words = self.rows[i], self.words[i]
        found = [self.having[self._rarest(words)], *(self.rarest.get(w, ()) for w in words)] if words else [self.bare]
        if words and (head := _before(r["title"], ":", 10)):
            found.append(self.headed[head])
        if r["author"] and r["id"]:
            found.append(self.known[r["author"], r["id"]])
        return sorted({j for js in found for j in js[bisect_right(js, i) :]})

    def score(self, i: int, j: int) -> int:
        a, b = self.rows[i], self.rows[j]
        return title_score(a["title"], b["title"]) + author_score(a["author"], b["author"]) + date_score(a["date"], b["date"]) + id_score(a["id"], b["id"])


def group_block(rows: list[dict]) -> list[tuple[int, int, int]]:
    """In order of ids, each record without a group opens one and takes in all others without one that score enough against it. Not transitive."""
    block = Block(rows)
    ids = [r["doc_id"] for r in block.rows]
    made: dict[int, tuple[int, int]] = {}
    for i, opener in enumerate(ids):
        if opener in made:
            continue
        made[opener] = (opener, 0)
        for j in block.after(i):
            if ids[j] not in made and (score := block.score(i, j)) >= LEAST:
                made[ids[j]] = (opener, score)
    return [(d, w, s) for d, (w, s) in made.items()]


def works(df: DataFrame) -> DataFrame:
    """Rows (doc_id, title, author, date, id) to (doc_id, work_id, score). Records meet where their titles begin with the same word; ones without a title meet by author.

    Equal records are judged once. A block is one group of pandas, whatever its size; in it only records are compared
    that can score enough.
    """
    same = ["title", "author", "date", "id"]
    head = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"\[[^\]]*\]", "")
    block = F.when(F.trim(head) == "", F.concat(F.lit("author "), F.lower(F.coalesce("author", F.lit(""))))).otherwise(F.regexp_extract(head, r"[\p{L}\p{N}]+", 0))
    distinct = df.groupBy(*same).agg(F.min("doc_id").alias("doc_id")).withColumn("block", block)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        records = rows.astype(object).where(rows.notna(), None).to_dict("records")
        return pd.DataFrame(group_block(records), columns=["first_id", "work_id", "score"])

    grouped = distinct.groupBy("block").applyInPandas(group, "first_id long, work_id long, score int")
    first = distinct.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("doc_id").alias("first_id"))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(first, equal).join(grouped, "first_id").select("doc_id", "work_id", "score")

