"""Marked passages around hits. Made for the documents of a page only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd

from pyspark.sql import DataFrame

from lectern.functions.analysis import TOKEN

SNIPPETS = "doc_id long, rank int, score int, snippet string"


@dataclass(frozen=True)
class Word:
    text: str
    start: int
    end: int


def word_places(text: str, pattern=TOKEN) -> list[Word]:
    return [Word(m.group(), *m.span()) for m in pattern.finditer(text)]


def best_spans(spans: Sequence[tuple[int, int, float]], most: int) -> tuple[list[tuple[int, int, float]], int]:
    """Of overlapping spans the best, ties to the first; at most so many of them, and how many there were before that cut."""
    kept: list[tuple[int, int, float]] = []
    for span in sorted(spans, key=lambda s: (-s[2], s[0], s[1])):
        if not any(span[0] < k[1] and k[0] < span[1] for k in kept):
            kept.append(span)
    return kept[:most], len(kept)


def contexts(places: Sequence[Word], spans: Sequence[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """For hits in their order in the text the words around each: both sides grow in turn, the shorter first, up to so many characters.

    A context stays behind the one before and on its own side of the middle to the next hit. A longer hit is kept whole.
    """
    made = []
    reached = 0
    for i, (start, end) in enumerate(spans):
        low, high = start, end
        limit = len(places) if i + 1 == len(spans) else (end + spans[i + 1][0] + 1) // 2
        size = places[end - 1].end - places[start].start
        open_left = open_right = True
        while open_left or open_right:
            left, right = places[start].start - places[low].start, places[high - 1].end - places[end - 1].end
            go_left = open_left and (left <= right or not open_right)
            if go_left:
                more = places[low].start - places[low - 1].start if low > reached else None
                if more is None or size + more > most:
                    open_left = False
                else:
                    low, size = low - 1, size + more
            else:
                more = places[high].end - places[high - 1].end if high < limit else None
                if more is None or size + more > most:
                    open_right = False
                else:
                    high, size = high + 1, size + more
        made.append((low, high))
        reached = high
    return made


def mark(text: str, places: Sequence[Word], context: tuple[int, int], hit: tuple[int, int], terms: set[str], stop_words: set[str], mode: str) -> str:
    """A context with <hit> around the hit and <term> around words: of the hit, of the context, or of neither. Stop words outside the hit stay plain."""
    out, at = [], places[context[0]].start
    for i in range(context[0], context[1]):
        word = places[i]
        out.append(text[at : word.start])
        if i == hit[0]:
            out.append("<hit>")
        inside = hit[0] <= i < hit[1]
        known = word.text.lower() in terms
        shown = known and mode != "none" and (inside or (mode in ("context", "all") and word.text.lower() not in stop_words))
        out.append(f"<term>{word.text}</term>" if shown else word.text)
        if i == hit[1] - 1:
            out.append("</hit>")
        at = word.end
    return "".join(out)


def snippets_of(text: str, spans: Sequence[tuple[int, int, float]], terms: set[str], most: int = 3, max_context: int = 80, stop_words: set[str] = frozenset(), mode: str = "hits", pattern=TOKEN) -> list[tuple[int, int, str]]:
    """(rank, score in percent of the best, marked text), the best first. Spans that reach beyond the text's words don't count."""
    places = word_places(text, pattern)
    kept, _ = best_spans([s for s in spans if 0 <= s[0] < s[1] <= len(places)], most)
    if not kept:
        return []
    best = max(s[2] for s in kept) or 1.0
    by_place = sorted(kept)
    around = dict(zip(by_place, contexts(places, [s[:2] for s in by_place], max_context)))
    return [(rank, int(100 * s[2] / best), mark(text, places, around[s], s[:2], terms, stop_words, mode)) for rank, s in enumerate(kept, 1)]


def snippets(page: DataFrame, terms: Sequence[str], most: int = 3, max_context: int = 80, stop_words: Sequence[str] = (), mode: str = "hits", text: str = "text") -> DataFrame:
    """Rows (doc_id, rank, score, snippet) for a page with text and spans (array of start, end, score); words as the index counts them."""
    import regex

    from lectern.functions.text import WORD

    pattern = regex.compile(WORD)
    known, stops = set(terms), set(stop_words)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, rank, score, marked)
                for doc, body, spans in zip(batch["doc_id"], batch["text"], batch["spans"])
                for rank, score, marked in snippets_of(body or "", [(s["start"], s["end"], s["score"]) for s in spans], known, most, max_context, stops, mode, pattern)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "score", "snippet"])

    return page.selectExpr("doc_id", f"`{text}` as text", "spans").mapInPandas(make, SNIPPETS)


def mark_document(text: str, spans: Sequence[tuple[int, int, float]], pattern=TOKEN) -> str:
    """The whole text with its hits marked and numbered in their order."""
    places = word_places(text, pattern)
    kept, _ = best_spans([s for s in spans if 0 <= s[0] < s[1] <= len(places)], len(spans))
    out, at = [], 0
    for number, (start, end, _) in enumerate(sorted(kept), 1):
        out += [text[at : places[start].start], f'<hit number="{number}">', text[places[start].start : places[end - 1].end], "</hit>"]
        at = places[end - 1].end
    return "".join([*out, text[at:]])
