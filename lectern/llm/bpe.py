"""Byte-level BPE as a lazily determinised finite-state transducer, and the streaming decoder for it.

Encoding. A token sequence is the encoding of its bytes exactly if each two neighbours stay as they are when
their bytes are encoded alone. So the nondeterministic transducer is simple: its states are the last whole token
and a place in the trie of the vocabulary; reading the last byte of a token v after the token u is allowed if
u, v is such a pair. Each byte leads from a set of configurations to another one. A set is determinised when it is
first met: the tokens that all its configurations agree on are emitted, the rest wait. As no token is longer than
the longest of the vocabulary, the wait is bounded by it. Many words go side by side, a byte each at every step, through
one table of the moves met so far; a word of unusual length goes alone, from state to state.

Decoding. Ids become bytes; an incremental UTF-8 machine holds back the bytes of a character that has not ended.
"""

from __future__ import annotations

import base64
import gc
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import filled, small_batches, table

#: Most states that a transducer keeps (four endings count as one), and most words whose ids a worker remembers; beyond either it begins afresh.
MOST_STATES, MOST_WORDS = 280_000, 100_000
#: Under which key a state keeps what still waits if its bytes end with this one.
ENDING = tuple(range(256, 512))
#: Words beyond this length are encoded, but not remembered. Bytes after which the number of states is looked at.
LONGEST_REMEMBERED, STEP = 64, 1 << 14
#: Pre-tokens of more bytes go through the states alone; the others side by side, about so many bytes of them at a time.
LONGEST_ABREAST, ABREAST = 32, 1 << 16
#: Bytes of texts whose words are looked up together; a longer text is looked up as a whole.
TOGETHER = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rust_white_space(pattern: str) -> str:
    r"""The pattern for the regex module, where \s also takes U+001C to U+001F, unlike in the tokenizer libraries."""
    inside = pattern.replace(r"[^\s", r"[^\p{White_Space}")
    return inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class _State(dict):
    """A set of configurations; byte to the next state and the packed ids emitted, made when first asked for. Also a last byte, as in ENDING, to the packed ids behind it."""

    __slots__ = ("configurations", "number", "of")

    def __init__(self, of: Transducer, configurations: tuple):
        super().__init__()
        self.of, self.configurations, self.number = of, configurations, len(of.states)

    def __missing__(self, byte: int) -> tuple[_State, bytes]:
        move = self[byte] = self.of.move(self.configurations, byte)
        return move


class _Moves:
    """The moves of all states in one table with open addressing. Key: state << 9 | byte, with 256 more for a last byte; value: next state << 32 | number of what is emitted."""

    def __init__(self, bits: int = 12):
        self.shift, self.count = np.uint64(64 - bits), 0
        self.keys, self.values = np.full(1 << bits, -1), np.full(1 << bits, -1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for a key that isn't there."""
        slots = self._slots(keys)
        there = self.keys[slots]
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            slots[on] = (slots[on] + 1) % len(self.keys)
            there = self.keys[slots[on]]
            on = on[(there != keys[on]) & (there >= 0)]
        return self.values[slots]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that aren't there yet, each once."""
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__((4 * self.count).bit_length())
            self.count = len(keys)
        slots, on = self._slots(keys), np.arange(len(keys))
        while len(on):
            free = on[self.keys[slots[on]] < 0]
            self.keys[slots[free]] = keys[free]  # of keys that meet, one stays
            mine = self.keys[slots[on]] == keys[on]
            self.values[slots[on[mine]]] = values[on[mine]]
            on = on[~mine]
            slots[on] = (slots[on] + 1) % len(self.keys)


class Transducer:
    """Bytes of one pre-token in, packed little-endian 32-bit ids out; or the bytes of many."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                following = self.children[node].get(byte)
                if following is None:
                    following = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = following
            self.token_at[node] = rank
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._begin()

    def _begin(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.listed: list[_State] = []
        self.endings, self.moves = 0, _Moves()
        self.emissions, self.emitted, self.begins = {b"": 0}, bytearray(), array("q", [0, 0])
        self.start = self._state(((-1, 0, ()),))

    def _state(self, configurations: tuple) -> _State:
        state = self.states.get(configurations)
        if state is None:
            state = self.states[configurations] = _State(self, configurations)
            self.listed.append(state)
        return state

    def _full(self) -> bool:
        return len(self.states) + self.endings // 4 > MOST_STATES

    def _begin_again(self) -> None:
        self._begin()
        self._fits.clear()
        gc.collect()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; of a single byte the token itself, of an unreachable token None."""
        if token not in self._halves:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            last = (data, data)
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 62))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                last = (parts[best], parts[best + 1])
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self._halves[token] = None if len(parts) > 1 else (self.ranks[last[0]], self.ranks[last[1]])
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens.

        The merges that made the two are undone, latest first; if some merge across the border comes before the
        merge just undone, it would have been taken.
        """
        if left < 0:
            return self.halves(right) is not None
        known = self._fits.get(left << 20 | right)
        if known is None:
            known = self._fits[left << 20 | right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        if self.halves(left) is None or self.halves(right) is None:
            return False
        ranks, bytes_of, limit = self.ranks, self.bytes_of, 1 << 62
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], 1 << 62) < limit:
                return False
            whole_left, whole_right = len(bytes_of[left]) == 1, len(bytes_of[right]) == 1
            if whole_left and whole_right:
                return True
            # the later merge is undone first; of equal ranks the left one came first
            if whole_right or (not whole_left and left > right):
                limit, left = left, self.halves(left)[1]
            else:
                limit, right = right + 1, self.halves(right)[0]

    def move(self, configurations: tuple, byte: int) -> tuple[_State, bytes]:
        found, children, token_at, fits, whole, delayed = [], self.children, self.token_at, self._fits, None, True
        for last, node, waiting in configurations:
            following = children[node].get(byte)
            if following is None:
                continue
            if children[following]:
                found.append((last, following, waiting))
                delayed = delayed and bool(waiting)
            token = token_at[following]
            if token >= 0 and whole is None:  # what was read so far has one encoding, so one token alone can end here
                fit = fits.get(last << 20 | token)
                if self.fits(last, token) if fit is None else fit:
                    whole = (token, 0, (*waiting, token))
        if whole is None:
            raise ValueError("the vocabulary lacks single bytes")
        found.append(whole)
        if not delayed:
            return self._state(tuple(found)), b""
        agreed = 0
        for each in zip(*[waiting for *_, waiting in found]):
            if each.count(each[0]) < len(each):
                break
            agreed += 1
        if not agreed:
            return self._state(tuple(found)), b""
        emitted = struct.pack(f"<{agreed}I", *whole[2][:agreed])
        return self._state(tuple([(last, node, waiting[agreed:]) for last, node, waiting in found])), emitted

    def last(self, configurations: tuple, byte: int) -> bytes:
        """All that waits, if the bytes end with this one: the token that ends here is known without the state behind it."""
        for last, node, waiting in configurations:
            following = self.children[node].get(byte)
            if following is not None:
                token = self.token_at[following]
                if token < 0:
                    continue
                fit = self._fits.get(last << 20 | token)
                if self.fits(last, token) if fit is None else fit:
                    return struct.pack(f"<{len(waiting) + 1}I", *waiting, token)
        raise ValueError("the vocabulary lacks single bytes")

    def encode(self, data: bytes) -> bytes:
        if not data:
            return b""
        state, out = self.start, []
        for at in range(0, len(data), STEP):
            if self._full():
                configurations = state.configurations
                del state
                self._begin_again()
                state = self._state(configurations)  # as a new state, from which no old one is reached
            for byte in data[at : min(at + STEP, len(data) - 1)]:
                state, emitted = state[byte]
                if emitted:
                    out.append(emitted)
        ending = ENDING[data[-1]]
        ids = state.get(ending)
        if ids is None:
            ids = state[ending] = self.last(state.configurations, data[-1])
            self.endings += 1
        if not out:
            return ids
        out.append(ids)
        return b"".join(out)

    def encode_all(self, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens that lie in the data one after the other, and how many ids each has."""
        ends = np.cumsum(lengths)
        starts, counts, parts = ends - lengths, np.zeros(len(lengths), np.int64), []
        content = np.frombuffer(data, np.uint8)
        short = np.flatnonzero((lengths > 0) & (lengths <= LONGEST_ABREAST))
        for part in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // ABREAST)) + 1):
            ids, counts[part] = self._abreast(content, starts[part], lengths[part])
            parts.append((part, ids))
        long = np.flatnonzero(lengths > LONGEST_ABREAST)
        alone = [self.encode(data[start:end]) for start, end in zip(starts[long].tolist(), ends[long].tolist())]
        counts[long] = [len(ids) // 4 for ids in alone]
        parts.append((long, np.frombuffer(b"".join(alone), "<u4")))
        begins = np.cumsum(counts) - counts
        together = np.empty(counts.sum(), "<u4")
        for part, ids in parts:
            together[_spans(begins[part], counts[part])] = ids
        return together, counts

    def _abreast(self, content: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pre-tokens go one byte on at each step, the longest first in line, so that those not yet at their end lead it."""
        if not len(starts):
            return np.empty(0, "<u4"), lengths
        if self._full():
            self._begin_again()
        line = np.argsort(-lengths, kind="stable")
        at, left, bounds = starts[line], lengths[line], np.cumsum(lengths)
        places, emitted = (bounds - lengths)[line], np.zeros(bounds[-1], np.int64)
        states = np.full(len(line), self.start.number)
        for step, going in enumerate(np.searchsorted(-left, -np.arange(left[0])).tolist()):
            keys = states[:going] << 9 | content[at[:going] + step] | (left[:going] == step + 1) * 256
            values = self.moves.get(keys)
            new = np.flatnonzero(values < 0)
            if len(new):
                self._learn(np.unique(keys[new]))
                values[new] = self.moves.get(keys[new])
            emitted[places[:going] + step] = values & 0xFFFFFFFF
            states = values >> 32
        where = np.flatnonzero(emitted)
        numbers, begins = emitted[where], np.frombuffer(self.begins, np.int64)
        sizes = begins[numbers + 1] - begins[numbers]
        ids = np.frombuffer(self.emitted, "<u4")[_spans(begins[numbers], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(where, bounds)]
        return ids, np.diff(before, prepend=0)

    def _learn(self, keys: np.ndarray) -> None:
        values = []
        for key in keys.tolist():
            configurations, following = self.listed[key >> 9].configurations, 0
            if key & 256:
                ids = self.last(configurations, key & 255)
                self.endings += 1
            else:
                state, ids = self.move(configurations, key & 255)
                following = state.number
            number = self.emissions.get(ids)
            if number is None:
                number = self.emissions[ids] = len(self.emissions)
                self.emitted += ids
                self.begins.append(len(self.emitted) // 4)
            values.append(following << 32 | number)
        self.moves.add(keys, np.array(values))


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Remembered(dict):
    """Word to packed ids. A word that isn't there is encoded and kept; when there are too many, those not asked for since the last clearing go."""

    def __init__(self, encode: Callable[[str], bytes], before: str = ""):
        super().__init__()
        self.encode, self.before, self.older = encode, before, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(self.before + word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= MOST_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    """Whole texts to packed ids, by way of a function that encodes any short stretch of text.

    A single space between two other characters always begins a pre-token, so a text may be cut there; each part is
    looked up, and only unknown parts are encoded. Texts with other runs of white space go to that function whole.
    """

    _RUNS = re.compile(r" \s|\s ")

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode
        self.first, self.spaced = _Remembered(encode, ""), _Remembered(encode, " ")

    def __call__(self, text: str) -> bytes:
        if self._RUNS.search(text):
            return self.encode(text)
        words = iter(text.split(" "))
        return self.first[next(words)] + b"".join(map(self.spaced.__getitem__, words))


class TransducingEncoder:
    """Whole texts to packed ids by a transducer, many texts at once.

    They are cut as TextEncoder cuts them. Each word of a group is looked up once, and those not remembered go through
    the transducer together.
    """

    #: What TextEncoder looks for, as RE2 writes it.
    _RUNS = r" [\pZ\t-\r\x1c-\x1f\x{85}]|[\pZ\t-\r\x1c-\x1f\x{85}] "

    def __init__(self, transducer: Transducer, pieces: regex.Pattern):
        self.transducer, self.pieces = transducer, pieces
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        [ids] = self.many(pa.array([text], pa.string()))
        return ids

    def many(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // TOGETHER
        borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        return [ids for start, end in pairwise(borders) for ids in self._group(texts.slice(start, end - start))]

    def _group(self, texts: pa.Array) -> list[bytes]:
        whole = pc.match_substring_regex(texts, self._RUNS)
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        firsts = pc.if_else(whole, texts, pc.list_element(cut, 0)).to_pylist()
        flat, borders = cut.flatten(), cut.offsets.to_numpy()
        later = np.ones(len(flat), bool)
        later[borders[:-1]] = False
        places = flat.filter(pa.array(later)).dictionary_encode()
        words = places.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [self.known.get(word) or self.older.get(word) for word in words]
        new = [word for word, found in zip(words, ids) if not found]
        plain = [word for word in new if word and word == word.strip()]
        odd = [word for word in new if not word or word != word.strip()] if len(plain) < len(new) else []
        made = self._encode([*firsts, *[" " + word for word in odd]], plain)
        own = dict(zip(odd + plain, made[len(firsts) :], strict=True))
        ids = [found or own[word] for word, found in zip(words, ids)]
        self._remember(words, ids)
        ids = made[: len(firsts)] + ids
        which = np.empty(len(flat), np.int64)
        which[~later], which[later] = np.arange(len(firsts)), places.indices.to_numpy() + len(firsts)
        inside = np.array(ids, object)[which]
        return [b"".join(inside[start:end].tolist()) for start, end in pairwise(borders.tolist())]

    def _remember(self, words: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids))
        for word in words:
            if len(word) > LONGEST_REMEMBERED:
                del self.known[word]
        if len(self.known) > MOST_WORDS:
            self.known, self.older = {}, self.known

    def _encode(self, stretches: list[str], words: list[str]) -> list[bytes]:
        """The ids of each stretch, then of each word behind a space; the words don't begin or end with white space, so all are cut in one go."""
        found = list(map(self.pieces.findall, stretches))
        found.append(self.pieces.findall(" " + " ".join(words)) if words else [])
        pieces = list(chain.from_iterable(found))
        data = "".join(pieces).encode()
        content = np.frombuffer(data, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if len(pieces) and len(data) > ends[-1]:  # characters of several bytes: from ends by characters to ends by bytes
            ends = np.append(np.flatnonzero(content & 0xC0 != 0x80), len(data))[ends]
        lengths = np.diff(ends, prepend=0)
        ids, counts = self.transducer.encode_all(data, lengths)
        *begins, of_words, end = np.cumsum([0, *map(len, found)]).tolist()
        spaced = np.flatnonzero(content[(ends - lengths)[of_words:]] == 32) + of_words
        after = 4 * np.append(0, np.cumsum(counts))[np.concatenate([begins, spaced, [end]]).astype(np.int64)]
        packed = ids.tobytes()
        return [packed[start:end] for start, end in pairwise(after.tolist())]


@lru_cache(maxsize=2)
def transducing_encoder(ranks_path: str, pattern: str) -> TransducingEncoder:
    return TransducingEncoder(Transducer(read_ranks(ranks_path)), regex.compile(rust_white_space(pattern)))


class Utf8Machine:
    """Bytes in any cuts to text: the machine's state is how many bytes its last character still lacks."""

    #: Class of a byte: bytes that the character it begins has; 0 for a byte within one; -1 for none.
    LENGTHS = [1] * 128 + [0] * 64 + [-1] * 2 + [2] * 30 + [3] * 16 + [4] * 5 + [-1] * 11

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):
            length = self.LENGTHS[data[-back]]
            if length:
                if length > back and self._may_go_on(data[-back:]):
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _may_go_on(begun: bytes) -> bool:
        """Whether the begun character can still become a valid one: E0, ED, F0 and F4 narrow their second byte."""
        if len(begun) == 1:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(begun[0], (0x80, 0xBF))
        return low <= begun[1] <= high

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class TokenBytes:
    """The bytes of all tokens in one array, so that many ids become bytes at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def of(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.start[ids] - (ends - length), length) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> TokenBytes:
    return TokenBytes(read_ranks(ranks_path))


def decode_stream(packed: Iterable[bytes], tokens: TokenBytes) -> Iterator[str]:
    """Blocks of packed ids to text, each character as soon as it is whole."""
    machine = Utf8Machine()
    for block in packed:
        yield machine.feed(tokens.of(block))
    yield machine.close()


def _in_blocks(packed: bytes, ids: int = 16_384) -> Iterator[bytes]:
    for at in range(0, len(packed), 4 * ids):
        yield packed[at : at + 4 * ids]


@contextmanager
def _no_collection() -> Iterator[None]:
    """The states are many small objects that live long; when they go, they go together."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _decoded(packed: bytes, tokens: TokenBytes) -> str:
    return "".join(decode_stream(_in_blocks(packed), tokens))


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the ids of each whole text, packed as little-endian 32-bit integers. A null text counts as empty (no ids).

    Only the text goes to Python; all other columns stay, but one named as `into` is replaced.
    """
    small_batches(df.sparkSession)

    @arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = transducing_encoder(ranks_path, pattern)
        with _no_collection():
            for texts in batches:
                yield pa.array(encoder.many(texts), pa.binary())

    return df.withColumn(into, encode(filled(text)))


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that the packed ids stand for; invalid UTF-8 becomes U+FFFD. Null ids give the empty text."""
    small_batches(df.sparkSession)

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = token_bytes(ranks_path)
        for packed in batches:
            yield pa.array([_decoded(p.as_py() or b"", tokens) for p in packed], pa.string())

    return df.withColumn(into, decode(ids))


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids", decoded: str = "decoded") -> DataFrame:
    """As `encode_texts` and then `decode_ids`, but by the same Python worker.

    Two columns made one after the other take two workers a task, each of which is sometimes given the one part and
    sometimes the other, so that both come to hold a transducer.
    """
    small_batches(df.sparkSession)

    @arrow_udf("ids binary, decoded string")
    def encode_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, tokens = transducing_encoder(ranks_path, pattern), token_bytes(ranks_path)
        with _no_collection():
            for texts in batches:
                ids = encoder.many(texts)
                texts = pa.array([_decoded(packed, tokens) for packed in ids], pa.string())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), texts], ["ids", "decoded"])

    both = df.withColumn("_lectern_both", encode_decode(filled(text)))
    return both.withColumns({into: F.col("_lectern_both.ids"), decoded: F.col("_lectern_both.decoded")}).drop("_lectern_both")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded again, as digests.

    Null and empty texts have no ids. Every row counts by itself, so repeated and null doc_ids stay; an empty table stays empty.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_decode(documents, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


