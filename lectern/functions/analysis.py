"""From text to terms: the token grammar, folding, and the positions that proximity counts with."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from lectern.functions.text import fold_accents

#: Virtual words between values of one field, and after a sentence.
VALUE_GAP, SENTENCE_GAP = 1_000_000, 5

_CJK = r"⺀-⿟぀-ㇿ㐀-䶿一-鿿豈-﫿가-힯"
_L = rf"[^\W\d_{_CJK}]"
TOKEN = re.compile(
    rf"(?P<email>[\w.+-]+@\w+(?:[.-]\w+)+)"
    rf"|(?P<acronym>{_L}\.(?:{_L}\.)+)"
    rf"|(?P<company>{_L}+[&@]{_L}+)"
    rf"|(?P<number>\d+(?:[.,/-]\d+)+)"
    rf"|(?P<host>{_L}\w*(?:\.\w*{_L}\w*)+)"
    rf"|(?P<apostrophe>{_L}+(?:['’]{_L}+)+)"
    rf"|(?P<cjk>[{_CJK}])"
    rf"|(?P<basic>(?:(?![{_CJK}_])\w)+(?:{_L}|[̀-ͯ])*)"
    rf"|(?P<symbol>[$€£¥¢%+=<>±×÷¼½¾§©®°])"
)


@dataclass(frozen=True)
class Analyzer:
    """How one field's text becomes terms. Empty maps and sets switch a step off."""

    stop_words: frozenset[str] = frozenset()
    plurals: Mapping[str, str] = field(default_factory=dict)
    accents: bool = False
    sentence_gap: int = 0

    def terms(self, text: str) -> list[tuple[str, int]]:
        """Terms with their positions, stop words included."""
        return list(self._placed(text))

    def _placed(self, text: str) -> Iterator[tuple[str, int]]:
        position, last_end = -1, 0
        for match in TOKEN.finditer(unicodedata.normalize("NFC", text)):
            step = 1
            if position >= 0 and self.sentence_gap and ends_sentence(match.string[last_end : match.start() + 1]):
                step += self.sentence_gap
            position += step
            last_end = match.end()
            yield self.term(match.group(), match.lastgroup or "basic"), position

    def term(self, token: str, kind: str = "basic") -> str:
        if kind == "acronym":
            token = token.replace(".", "")
        elif kind == "apostrophe":
            token = re.sub("['’]s$", "", token, flags=re.IGNORECASE)
        token = unicodedata.normalize("NFC", token.lower())
        if self.accents:
            token = fold_accents(token)
        return self.plurals.get(token, token)

    def bigrams(self, text: str) -> list[tuple[str, int]]:
        """Terms with stop words only inside pairs: a stop word beside any word makes a pair, and alone it vanishes but leaves its place."""
        placed = self.terms(text)
        made = []
        for i, (term, position) in enumerate(placed):
            if term not in self.stop_words:
                made.append((term, position))
            after = placed[i + 1] if i + 1 < len(placed) else None
            if after and after[1] == position + 1 and (term in self.stop_words or after[0] in self.stop_words):
                made.append((f"{term}~{after[0]}", position))
        return made


def ends_sentence(between: str) -> bool:
    """Whether a full stop, question or exclamation mark in the text between two words ends a sentence. Dots in a row don't; of several marks the last counts."""
    found = re.search(r"[.!?](?=[\s\"'”’)\]])", between)
    return bool(found) and "..." not in between


def sections_with_gaps(rows: list[tuple[str, int, bool]], overlap: int) -> list[int]:
    """Positions of words given as (section type, gap before, break before): a change of type or a break adds the overlap."""
    positions, at, before = [], -1, None
    for kind, gap, breaks in rows:
        at += 1 + gap
        if before is not None and (breaks or kind != before):
            at += overlap
        positions.append(at)
        before = kind
    return positions
