"""Private data as format-preserving pseudonyms.

Numbers and dates that hold up when validated, addresses and secrets are replaced by values of the same format. Each
value is a row of digits to moduli; a keyed Feistel network adds to one half, digit by digit, what a hash of the other
half gives. So a format's values are permuted: equal ones stay equal in all documents, different ones stay different,
and who has the key can go back. Check digits are made anew, so card and account numbers stay valid.

All is done with DataFrame functions, each row by itself.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import filled, table

#: Rounds of the network, and digits that one hash moves.
ROUNDS, HASHED = 8, 10
#: The session's setting that holds the key.
KEY_SETTING = "spark.lectern.pseudonyms.key"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHER_LOWER, OTHER_UPPER = "àáâãäåæçèéêëìíîïñòóôõöøùúûüß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ"
#: Dates are permuted within so many days from 1900-01-01 on (250 * 292), all others of the years 1 to 9999 among themselves (1331 * 2689).
DAYS, OTHER_DAYS = (250, 292), (1331, 2689)
#: Calling codes that are in use, those of North America's plan (1) among them.
CALLING = r"1|7|2(?:0|1[12368]|[236]\d|4\d|5[0-8]|7|9[01789])|3(?:[0123469]|5\d|7\d|8[0-35-79])|4(?:[013-9]|2[013])|5(?:[1-8]|0\d|9\d)|6(?:[0-6]|7[02-9]|8[0-35-9]|9[0-2])|8(?:[1246]|0[08]|5[02356]|7[08]|8[0-36])|9(?:[0-58]|6\d|7[0-79]|9[2-68])"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,6}+\p{L}{2,24}+(?![\p{L}\p{N}])",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=(?i:token|secret|password|passwd|pwd|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?)[0-9A-Fa-f]{16,64}(?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+.-])(?:\([2-9]\d\d\) ?|[2-9]\d\d[.-])[2-9]\d\d[.-]\d{4}(?![\d.-]*\d)",
    "abroad": r"\+[1-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)",
    "ssn": r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\w/-]|\.\d)",
    "address": rf"(?<![\w.])(?<!(?i:version|release|build|section|firmware)[ :]{{1,2}})(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "card": r"(?<![\w.+-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![\w]|[.-]\d)",
}
#: What a text must have for any pattern to match: most need a digit or @.
SOME = r"[0-9@]|AKIA[A-Z]{16}|(?i:token|secret|password|passwd|pwd|api[_-]?key)[ \t]{0,3}[=:]"
ANY = "|".join(f"(?:{p})" for p in (*list(PATTERNS.values())[:-1], PATTERNS["card"]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(values: Column, key: str, kind: str) -> Column:
    """A keyed permutation of arrays of struct<v int, m int>, 0 <= v < m, with given moduli; `unfeistel` goes back."""

    def step(halves: Column, number: Column) -> Column:
        return let(_stream(key, kind, number, halves.right, F.size(halves.left)), lambda h: F.struct(halves.right.alias("left"), _moved(halves.left, h, 1).alias("right")))

    return _halved(values, F.sequence(F.lit(0), F.lit(ROUNDS - 1)), step)


def unfeistel(values: Column, key: str, kind: str) -> Column:
    def step(halves: Column, number: Column) -> Column:
        return let(_stream(key, kind, number, halves.left, F.size(halves.right)), lambda h: F.struct(_moved(halves.right, h, -1).alias("left"), halves.left.alias("right")))

    return _halved(values, F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), step)


def _halved(values: Column, numbers: Column, step: Callable[[Column, Column], Column]) -> Column:
    half = F.floor(F.size(values) / 2).cast("int")
    start = F.struct(F.slice(values, F.lit(1), half).alias("left"), F.slice(values, half + 1, F.size(values) - half).alias("right"))
    return F.aggregate(numbers, start, step, lambda s: F.concat(s.left, s.right))


def _stream(key: str, kind: str, number: Column, half: Column, length: Column) -> Column:
    """A hash of one half for each HASHED digits of the other: each digit of that has bits of its own."""
    shown = F.array_join(F.transform(half, lambda e: F.concat_ws("/", e.v.cast("string"), e.m.cast("string"))), ",")
    block = lambda s, i: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), i.cast("string"), s).cast("binary"), 256)
    last = F.floor(F.greatest(length - 1, F.lit(0)) / HASHED).cast("int")
    return let(shown, lambda s: F.transform(F.sequence(F.lit(0), last), lambda i: block(s, i)))


def _moved(half: Column, hashed: Column, sign: int) -> Column:
    def move(e: Column, i: Column) -> Column:
        block = F.get(hashed, F.floor(i / HASHED).cast("int"))
        by = F.conv(F.substring(block, (i % HASHED * 6 + 1).cast("int"), F.lit(6)), 16, 10).cast("int")
        return F.struct(F.pmod(e.v + sign * by, e.m).cast("int").alias("v"), e.m.alias("m"))

    return F.transform(half, move)


def _number(v: Column, m: int | Column) -> Column:
    return F.struct(v.cast("int").alias("v"), (F.lit(m) if isinstance(m, int) else m).cast("int").alias("m"))


def _characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _letters(c: Column, hexadecimal: bool = False) -> Column:
    """The characters of the same sort; none for signs, which stay."""
    last = 6 if hexadecimal else 26
    sorts = (DIGITS, LOWER[:last], UPPER[:last], *(() if hexadecimal else (OTHER_LOWER, OTHER_UPPER)))
    found = F.lit("")
    for sort in reversed(sorts):
        found = F.when(F.instr(F.lit(sort), c) > 0, F.lit(sort)).otherwise(found)
    return found


def permute_characters(text: Column, key: str, kind: str, sort_of: Callable[[Column, Column], Column]) -> Column:
    """Permute a string whose character at place i (from 0) may be any of sort_of(c, i), or stays if that is empty."""

    def spread(cs: Column) -> Column:
        values = F.transform(cs, lambda c, i: let(sort_of(c, i), lambda s: _number(F.greatest(F.instr(s, c) - 1, F.lit(0)), F.greatest(F.length(s), F.lit(1)))))
        back = lambda c, e, i: let(sort_of(c, i), lambda s: F.when(s == "", c).otherwise(F.substring(s, e.v + 1, F.lit(1))))
        both = F.arrays_zip(cs.alias("c"), feistel(values, key, kind).alias("e"))
        return F.array_join(F.transform(both, lambda b, i: back(b["c"], b["e"], i)), "")

    return let(_characters(text), spread)


def luhn_digit(digits: Column) -> Column:
    """The check digit that follows these digits."""
    value = lambda d, i: let(d.cast("int") * (2 - i % 2), lambda x: x - F.when(x > 9, 9).otherwise(0))
    total = F.aggregate(F.transform(F.reverse(_characters(digits)), value), F.lit(0), lambda a, x: (a + x).cast("int"))
    return F.pmod(-total, F.lit(10)).cast("string")


def mod97(account: Column) -> Column:
    """The remainder of an account number: its first four characters go to the end, letters count from 10."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account) - 4), F.substring(account, 1, 4))
    value = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(_characters(turned), F.lit(0), lambda a, c: let(value(c), lambda v: ((a * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int")))


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"[ -]", "")


def _spaced_like(model: Column, plain: Column) -> Column:
    """The characters of `plain` in the places of those of the model that are no blanks or hyphens."""
    place = lambda i: F.length(_plain(F.substring(model, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(model)), lambda i: let(F.substring(model, i, F.lit(1)), lambda c: F.when(c.isin(" ", "-"), c).otherwise(F.substring(plain, place(i), F.lit(1))))), "")


def _card(m: Column, key: str) -> Column:
    def valid(digits: Column) -> Column:
        body = F.substring(digits, F.lit(2), F.length(digits) - 2)
        made = F.concat(F.substring(digits, 1, 1), permute_characters(body, key, "card", lambda c, i: F.lit(DIGITS)))
        right = luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, F.length(digits), F.lit(1))
        return F.when(right & ~digits.rlike("^(.)\\1*$"), let(made, lambda d: _spaced_like(m, F.concat(d, luhn_digit(d)))))

    return let(_plain(m), valid)


def _account(m: Column, key: str) -> Column:
    def valid(plain: Column) -> Column:
        head = F.substring(plain, 1, 2)
        body = permute_characters(F.substring(plain, F.lit(5), F.length(plain) - 4), key, "account", lambda c, i: _letters(c))
        check = lambda b: F.lpad((98 - mod97(F.concat(head, F.lit("00"), b))).cast("string"), 2, "0")
        return F.when(F.length(plain).between(15, 34) & (mod97(plain) == 1), let(body, lambda b: _spaced_like(m, F.concat(head, check(b), b))))

    return let(_plain(m), valid)


def _address(m: Column, key: str) -> Column:
    values = F.transform(F.split(m, r"\."), lambda o: _number(o, 256))
    return F.array_join(F.transform(feistel(values, key, "address"), lambda e: e.v.cast("string")), ".")


def _ssn(m: Column, key: str) -> Column:
    area = F.substring(m, 1, 3).cast("int")
    values = F.array(_number(F.when(area > 666, area - 2).otherwise(area - 1), 898), _number(F.substring(m, 5, 2).cast("int") - 1, 99), _number(F.substring(m, 8, 4).cast("int") - 1, 9999))
    two = lambda n, w: F.lpad(n.cast("string"), w, "0")
    shown = lambda o: F.concat_ws("-", two(let(o[0].v, lambda a: a + F.when(a >= 665, 2).otherwise(1)), 3), two(o[1].v + 1, 2), two(o[2].v + 1, 4))
    return let(feistel(values, key, "ssn"), shown)


def _date(m: Column, key: str) -> Column:
    forms = (("-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), ("/", "MM/dd/yyyy"), (".", "dd.MM.yyyy"))
    made = F.lit(None).cast("string")
    for sign, form in reversed(forms):
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        moved = let(day, lambda d: F.date_format(_moved_day(d, key), form))  # noqa: B023
        made = F.when(F.contains(m, F.lit(sign)) & day.isNotNull(), moved).otherwise(made)
    return made


def _moved_day(day: Column, key: str) -> Column:
    first, begin, near = F.lit("1900-01-01").cast("date"), F.lit("0001-01-01").cast("date"), DAYS[0] * DAYS[1]
    before = F.datediff(first, begin)

    def moved(n: Column) -> Column:
        inside = n.between(0, near - 1)
        a, b = (F.when(inside, x).otherwise(y) for x, y in zip(DAYS, OTHER_DAYS))
        rank = F.when(inside, n).when(n < 0, n + before).otherwise(n + before - near)
        values = let(rank, lambda r: F.array(_number(F.floor(r / b), a), _number(r % b, b)))
        there = let(feistel(values, key, "date"), lambda o: (o[0].v * o[1].m + o[1].v).cast("int"))
        made = let(there, lambda o: F.date_add(first, o + F.when(inside, 0).when(o < before, -before).otherwise(near - before)))
        return F.when(n >= -before, made)  # the calendar has no year 0

    return let(F.datediff(day, first), moved)


def _phone(m: Column, key: str) -> Column:
    """Area and exchange keep beginning with 2 to 9, or with 0 or 1; the country's 1 stays."""
    rest = F.regexp_replace(m, r"^\+1", "")
    before = lambda i: F.length(F.regexp_replace(F.substring(rest, F.lit(1), i.cast("int")), r"\D", ""))
    sort_of = lambda c, i: F.when(~c.rlike(r"\d"), F.lit("")).otherwise(F.when(~before(i).isin(0, 3), F.lit(DIGITS)).otherwise(F.when(c.isin("0", "1"), F.lit(DIGITS[:2])).otherwise(F.lit(DIGITS[2:]))))
    return F.concat(F.when(m.startswith("+1"), F.lit("+1")).otherwise(F.lit("")), permute_characters(rest, key, "phone", sort_of))


def _abroad(m: Column, key: str) -> Column:
    """A number that begins with a calling code in use and has 8 to 15 digits, with code 1 eleven. The first group, with the country's digits, stays."""
    head = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    made = F.concat(head, permute_characters(F.substring(m, F.length(head) + 1, F.length(m)), key, "abroad", lambda c, i: F.when(c.rlike(r"\d"), F.lit(DIGITS)).otherwise(F.lit(""))))
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return F.when(m.rlike(rf"^\+(?:{CALLING})") & F.when(m.startswith("+1"), digits == 11).otherwise(digits.between(8, 15)), made)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_characters(local, key, "email", lambda c, i: _letters(c)), F.substring(m, F.length(local) + 1, F.length(m)))


MAKERS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email,
    "key": lambda m, key: F.concat(F.lit("AKIA"), permute_characters(F.substring(m, 5, 16), key, "key", lambda c, i: _letters(c))),
    "secret": lambda m, key: permute_characters(m, key, "secret", lambda c, i: _letters(c, hexadecimal=True)),
    "account": _account,
    "phone": _phone,
    "abroad": _abroad,
    "ssn": _ssn,
    "date": _date,
    "address": _address,
    "card": _card,
}
#: What a match must look like as a whole to be of a kind; the first that fits counts.
SHAPES = {
    "email": "@",
    "key": "^AKIA[0-9A-Z]{16}$",
    "phone": r"^(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(?[2-9]\d\d\)?[ .-]?[2-9]\d\d[ .-]?\d{4})$",
    "abroad": r"^\+",
    "ssn": r"^\d{3}-\d\d-\d{4}$",
    "date": r"^(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})$",
    "address": r"^\d+\.\d+\.\d+\.\d+$",
    "account": r"^[A-Z]{2}\d\d[A-Z0-9 ]+$",
    "card": r"^\d(?:[ -]?\d)+$",
}


def _replacement(m: Column, key: str) -> Column:
    """A match to struct<kind, text>; kind is null if it isn't valid, and then it stays."""
    same = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    found = let(MAKERS["secret"](m, key), lambda t: F.struct(F.lit("secret").alias("kind"), t.alias("text")))
    card = lambda m: let(MAKERS["card"](m, key), lambda t: F.when(t.isNotNull(), F.struct(F.lit("card").alias("kind"), t.alias("text"))))
    for kind, shape in reversed(SHAPES.items()):
        if kind == "card":  # sixteen and more digits after the word password are a secret, if no card
            one = F.coalesce(card(m), F.when(F.length(m) > 30, found).otherwise(same))
        else:
            one = let(MAKERS[kind](m, key), lambda t: F.when(t.isNull(), same).otherwise(F.struct(F.lit(kind).alias("kind"), t.alias("text"))))  # noqa: B023
        found = F.when(m.rlike(shape), one).otherwise(found)
    return found


def session_key(spark: SparkSession) -> str:
    """The key that the session's KEY_SETTING holds. Without one, a key is drawn for this session, and stays with it: pseudonyms of another session then differ."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(df: DataFrame, key: str, text: str = "text", kinds: str | None = None) -> DataFrame:
    """Replace what is private in each whole text; kinds: a column to add, an array with the kind of each replacement in its order.

    A null text stays null and has no kinds. What doesn't validate (check digits, octets, calling codes, the calendar)
    stays as it is, and so do the domains of e-mail addresses. Rows count by themselves, so repeated ones get the same
    text and null ids don't matter; all other columns stay, but one named as `kinds` is replaced. An empty table stays
    empty.
    """
    has = F.col(text).rlike(SOME)
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _replacement(m, key))
    there = df.withColumn("_lectern_found", F.when(has, found))
    gaps = F.split(text, ANY, -1)
    whole = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), F.col("_lectern_found").getField("text").alias("text")), lambda p: F.concat(p["gap"], F.coalesce(p["text"], F.lit("")))), "")
    made = there.withColumn(text, F.when(F.size("_lectern_found") > 0, whole).otherwise(F.col(text)))
    if kinds:
        made = made.withColumn(kinds, F.coalesce(F.filter(F.col("_lectern_found").getField("kind"), F.isnotnull), F.array().cast("array<string>")))
    return made.drop("_lectern_found")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, how many it has, and their kinds. A null text counts as empty, a null doc_id stays; repeated rows stay."""
    documents = table(spark, sf_dir, "documents").select("doc_id", filled().alias("text"))
    return pseudonymise(documents, session_key(spark), kinds="kinds").select("doc_id", "text", F.size("kinds").alias("n_private"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))
