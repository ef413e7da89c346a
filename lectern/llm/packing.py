"""Packing by power-of-two decomposition.

A document of n tokens becomes n div 2048 pieces of 2048 and one piece for each binary digit of the rest, the longest
first. Every piece is a sequence of its own: none crosses documents, each length is a power of two, and nothing is
padded. Sequences of equal length form a bucket, from which batches are drawn. The pieces of a document follow from
its token count alone, so packing needs no exchange of rows.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.bpe import TextEncoder
from lectern.llm.common import filled, small_batches, table

LONGEST = 2048
END = 1


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer_encoder(path: str) -> TextEncoder:
    """The ids that the tokenizers library gives with this byte-level BPE file, without special tokens added.

    Such a file whose ids follow the order of its merges says the same as a rank file; the rank library is several
    times faster. Its pattern is the fixed one of byte-level pre-tokenizers. A special token's own string in a text is
    that token, as in the library.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    vocabulary, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [vocabulary["".join(m)] for m in merges]
    if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or made != sorted(made):
        raise ValueError(f"{path} is no plain byte-level BPE whose ids follow its merges")
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    ordinary = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> bytes:
        return array("I", ordinary(text)).tobytes()

    plain = TextEncoder(encode)
    if not special:
        return plain
    [(name, number)] = special.items()
    between = array("I", [number]).tobytes()

    def whole(text: str) -> bytes:
        return between.join([plain(part) for part in text.split(name)]) if name in text else plain(text)

    return whole


def tokenize(df: DataFrame, path: str, text: str = "text", into: str = "ids", end: int = END) -> DataFrame:
    """Add a document's ids and the closing id, packed as little-endian 32-bit integers. A null text counts as empty."""
    small_batches(df.sparkSession)

    @arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, last = tokenizer_encoder(path), array("I", [end]).tobytes()
        for texts in batches:
            yield pa.array([encoder(t.as_py()) + last for t in texts], pa.binary())

    return df.withColumn(into, encode(filled(text)))


def pack(df: DataFrame, ids: str = "ids", longest: int = LONGEST) -> DataFrame:
    """Cut each row's packed ids into pieces and give each piece its sequence; all other columns stay.

    Adds start, length, doc_tokens, sequence_id, offset (always 0) and bucket (the binary logarithm of the length),
    replacing columns of these names; `ids` then holds the piece's. A row without ids or with null has no piece.
    Sequence ids are unique, with gaps. longest: a power of two.
    """
    bits = longest.bit_length() - 1
    if longest != 1 << bits:
        raise ValueError("longest must be a power of two")
    n = (F.octet_length(ids) / 4).cast("long")
    full, rest = F.floor(n / longest), n % longest
    whole = F.transform(F.array_repeat(F.lit(0), full.cast("int")), lambda _, i: F.struct((i * longest).cast("long").alias("start"), F.lit(longest).cast("long").alias("length")))
    digits = F.filter(
        F.array(
            *[
                F.when(rest.bitwiseAND(1 << b) != 0, F.struct((full * longest + F.shiftleft(F.shiftright(rest, b + 1), b + 1)).cast("long").alias("start"), F.lit(1 << b).cast("long").alias("length")))
                for b in reversed(range(bits))
            ]
        ),
        F.isnotnull,
    )
    cut = F.transform(F.concat(whole, digits), lambda p: F.struct(p.start.alias("start"), p.length.alias("length"), F.substring(ids, (p.start * 4 + 1).cast("int"), (p.length * 4).cast("int")).alias("ids")))
    made = ("start", "length", "doc_tokens", "sequence_id", "offset", "bucket")
    kept = [c for c in df.columns if c not in (ids, *made)]
    return (
        df.select(*kept, n.alias("doc_tokens"), F.explode(cut).alias("_piece"))
        .select(*kept, "doc_tokens", F.col("_piece.start").alias("start"), F.col("_piece.length").alias("length"), F.col("_piece.ids").alias(ids))
        .withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2(F.col("length")).cast("int")})
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store sequences in a folder for each bucket (12 at most), so that a reader makes batches of one length without padding."""
    packed.write.partitionBy("bucket").parquet(path)


def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences whose lengths are powers of two up to 2048, with the bucket of each; no padding.

    Null and empty texts have the closing id alone. Rows with one doc_id, or none, are packed each by itself. An empty
    table has no pieces.
    """
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack(tokenize(documents, public_tokenizers.path("byte_bpe_50k.json")).drop("text"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
