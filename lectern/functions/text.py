"""Scalar functions on columns and, where Spark lacks them, on strings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters and digits; the grammar of analysis.tokens knows more.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column, without: Sequence[str] = ()) -> Column:
    """Lower-case words in their order; `without` are left out by the pattern itself, which is several times faster than a filter of the array."""
    pattern = WORD
    if without:
        inside = r"[\p{L}\p{N}]"
        pattern = rf"(?<!{inside})(?!(?:{'|'.join(map(re.escape, without))})(?!{inside})){WORD}"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def digits_as_number(value: Column) -> Column:
    """All digits of a value read as one number, whatever stands between them; 0 without digits, null beyond 64 bits."""
    only = F.regexp_replace(value, "[^0-9]", "")
    return F.when(value.isNull(), None).when(only == "", 0).otherwise(only.try_cast("long"))


def human_size(size: Column) -> Column:
    """Bytes as a short text with one decimal at most."""
    made = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        made = F.when(size >= 1024**power, F.concat(F.format_number(size / 1024**power, 1), F.lit(f" {unit}"))).otherwise(made)
    return made


def time_since(then: Column) -> Column:
    """Seconds from a time to now."""
    return F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(then)


def year_of(value: str | None) -> int | None:
    """The first run of digits that reads as a year between 1800 and 2100, both excluded."""
    for run in re.findall(r"\d+", value or ""):
        if 1800 < int(run) < 2100:
            return int(run)
    return None


def year(value: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0)), lambda r: r.try_cast("long"))
    return F.try_element_at(F.filter(runs, lambda y: (y > 1800) & (y < 2100)), F.lit(1)).cast("int")


def fold_accents(text: str) -> str:
    """Composed letters without their marks; a text of marks alone stays."""
    folded = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", folded) if folded else text


ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"


def accents_folded(text: Column) -> Column:
    """The accents of western European letters, folded in the JVM; fold_accents knows all others."""
    plain = "".join(fold_accents(c) if fold_accents(c) != c else {"ø": "o"}.get(c, c) for c in ACCENTED)
    return F.translate(text, ACCENTED + ACCENTED.upper(), plain + plain.upper())


def edit_distance(target: str, word: str, most: int | None = None) -> int:
    """Weighted distance: 2 for a replacement, insertion or deletion (1 of a doubled letter), 1 for a transposition.

    The borders are not alike: leading letters of the word cost 1 each, those of the target 2.
    """
    before2, before = None, list(range(len(word) + 1))
    for i in range(1, len(target) + 1):
        row = [2 * i]
        for j in range(1, len(word) + 1):
            a, b = target[i - 1], word[j - 1]
            best = before[j - 1] + (0 if a == b else 2)
            best = min(best, before[j] + (1 if i > 1 and target[i - 2] == a else 2), row[j - 1] + (1 if j > 1 and word[j - 2] == b else 2))
            if i > 1 and j > 1 and a == word[j - 2] and target[i - 2] == b and before2 is not None:
                best = min(best, before2[j - 2] + 1)
            row.append(best)
        before2, before = before, row
        if most is not None and min(row) > most:
            return most + 1
    return before[-1]


_SOUNDS = [
    (r"^(?:gn|kn|pn|wr|ps)", lambda m: m.group()[1]),
    (r"^x", "s"),
    (r"tch|ch", "x"),
    (r"sch", "sk"),
    (r"sh", "x"),
    (r"ph", "f"),
    (r"th", "0"),
    (r"gh(?![aeiou])", ""),
    (r"c(?=[iey])", "s"),
    (r"dg(?=[iey])", "j"),
    (r"g(?=[iey])", "j"),
    (r"ck|[cq]", "k"),
    (r"wh", "w"),
    (r"z", "s"),
    (r"v", "f"),
    (r"d", "t"),
    (r"g", "k"),
    (r"b", "p"),
    (r"w(?![aeiou])|h(?![aeiou])|(?<=[aeiou])h", ""),
]


def sound_key(word: str) -> str:
    """A short phonetic key: like-sounding consonants are one, vowels count only at the beginning."""
    key = re.sub("[^a-z]", "", fold_accents(word.lower()))
    for pattern, by in _SOUNDS:
        key = re.sub(pattern, by, key)
    key = key[:1] + re.sub("[aeiouy]", "", key[1:])
    key = re.sub("^[aeiouy]", "a", key)
    return re.sub(r"(.)\1+", r"\1", key)[:4]


def copy_case(model: str, word: str) -> str:
    """The word in the case of the model: all upper, first upper, or as it is."""
    if len(model) > 1 and model.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word
