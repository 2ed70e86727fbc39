"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string that has an encoding has exactly one, so its last token is
unique: the one token ending there that may follow the last token of the prefix before it. An
encoder that stores this token for each prefix can append bytes exactly, as no earlier entry
changes, and after an edit it goes on from the entry before the edit and stops as soon as the
rest must come out as it was.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from parcelry.llm.text import slices


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a line has the token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary with, for each token, the two tokens whose merge made it.

    ``parts[t]`` is ``(t, t)`` for a token that no merge makes. ``whole`` has the tokens that the
    merges never make from their own bytes; such a token only stands for a piece as a whole.
    """

    ranks: dict[bytes, int]
    pattern: str

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ranks))

    @cached_property
    def parts(self) -> dict[int, tuple[int, int]]:
        parts = {}
        for token, rank in self.ranks.items():
            merged = _merge(token, self.ranks, rank) if len(token) > 1 else [rank]
            parts[rank] = tuple(merged) if len(merged) == 2 else (rank, rank)
        return parts

    @cached_property
    def whole(self) -> set[int]:
        return {r for t, r in self.ranks.items() if len(t) > 1 and self.parts[r] == (r, r)}


def _merge(piece: bytes, ranks: dict[bytes, int], below: int) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, while that rank is under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        pairs = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
        least = min(pairs)
        if least >= below:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def _for_latin_1(pattern: str) -> re.Pattern | None:
    """The pattern for texts of Latin-1 only, with its classes spelled out, for the faster
    ``re``; none if it has classes other than letters, numbers and white space."""
    for name, wanted in (("L", "L"), ("N", "N"), ("s", " ")):
        own = "".join(
            c
            for c in map(chr, range(256))
            if (regex.match(r"\s", c) if wanted == " " else unicodedata.category(c)[0] == wanted)
        )
        own = "".join(f"\\x{ord(c):02x}" for c in own)
        escape = r"\s" if wanted == " " else rf"\p{{{name}}}"
        inside = re.compile(r"\[[^\]]*\]")
        pattern = inside.sub(lambda m: m[0].replace(escape, own), pattern)
        pattern = pattern.replace(escape, f"[{own}]")
        if wanted == " ":
            pattern = pattern.replace(r"\S", f"[^{own}]")
    return None if re.search(r"\\[pPwWdD]", pattern) else re.compile(pattern)


class Encoder:
    """Encodes pieces, one after another, keeping what it has found out about tokens.

    ``held`` bounds the number of pairs and pieces kept; they are forgotten together when the
    bound is reached, so memory stays the same however long the input.
    """

    def __init__(self, vocabulary: Vocabulary, held: int = 150_000):
        self.vocabulary = vocabulary
        self.held = held
        self._ranks = vocabulary.ranks
        self._parts = vocabulary.parts
        self._tokens = vocabulary.tokens
        self._bound = max(self._tokens) + 2
        self._by_id = [self._tokens.get(i, b"") for i in range(self._bound)]
        self._longest = vocabulary.longest
        self._follows: dict[int, bool] = {}
        self._ending = ahocorasick.Automaton()  # gives the tokens that end at a byte
        for token, rank in vocabulary.ranks.items():
            if rank not in vocabulary.whole:
                self._ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self._ending.make_automaton()
        self._split = regex.compile(vocabulary.pattern)
        self._latin = _for_latin_1(vocabulary.pattern)
        self._pieces = _Pieces(self)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode to just these two."""
        key = left << 32 | right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= self.held:
                self._follows.clear()
            known = self._follows[key] = self._no_earlier_merge(left, right)
        return known

    def _no_earlier_merge(self, left: int, right: int) -> bool:
        # Undo the later of the two last merges, again and again; at each stage a merge across
        # the border that comes before the one undone would have destroyed the border.
        tokens, ranks, parts = self._tokens, self._ranks, self._parts
        bound = self._bound
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < bound:
                return False
            if left > right:
                bound, inner = left, parts[left][1]
                if inner != left:
                    left = inner
                    continue
                bound, inner = right + 1, parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                bound, inner = right + 1, parts[right][0]
                if inner != right:
                    right = inner
                    continue
                bound, inner = left, parts[left][1]
                if inner == left:
                    return True
                left = inner

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` up to the length of the piece: the last token of each prefix."""
        known, follows = len(last), self._follows
        begin = max(0, known + 1 - self._longest)
        for end, (token, size) in self._ending.iter(piece.decode("latin-1"), begin):
            if end < known:
                continue
            start = end - size
            if start >= 0:
                follow = follows.get(last[start] << 32 | token)
                if follow is None:
                    follow = self.may_follow(last[start], token)
                if not follow:
                    continue
            last.append(token)
            known += 1
        if known != len(piece):
            raise ValueError("the vocabulary lacks a byte")
        return last

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes):
        """The piece with ``[start, end)`` replaced, and its last tokens.

        Entries before the edit stay. After it, once every position within the longest token's
        reach has a token as long as before and of the same rank, the rest is as it was.
        """
        changed = piece[:start] + new + piece[end:]
        entries, after = last[:start], start + len(new)
        shift, same = len(piece) - len(changed), 0
        while len(entries) < len(changed):
            self.extend(changed[: len(entries) + 1], entries)
            at = len(entries)
            reaches = at - len(self._tokens[entries[-1]]) >= after
            same = same + 1 if reaches and entries[-1] == last[at + shift - 1] else 0
            if same >= self.vocabulary.longest:
                entries += last[at + shift :]
        return changed, entries

    def tokens_of(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self._tokens[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        token = self._ranks.get(piece)  # a piece that is a token stays whole
        return [token] if token is not None else self.tokens_of(self.extend(piece, []))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._pieces.__getitem__, self._pieces_of(text)))

    def _pieces_of(self, text: str) -> list[str]:
        if self._latin is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self._latin.findall(text)
        return self._split.findall(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Ids by piece, made when first asked for."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.encoder.held:
            self.clear()
        ids = _pack(self.encoder.encode_piece(piece.encode()))
        if len(piece) <= 64:  # long runs hardly come again, and would need much memory
            self[piece] = ids
        return ids


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this worker; it stays for the worker's next tasks."""
    if id(vocabulary) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(vocabulary)] = Encoder(vocabulary)
    return _ENCODERS[id(vocabulary)]


def tokenized(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """Encode a text, decode the ids again, and give both as a struct.

    ``ids`` holds the ids as little-endian unsigned 32-bit integers, ``decoded`` the bytes that
    they stand for. NULL counts as the empty text, which has no ids. The vocabulary, whose size
    does not depend on the texts, is broadcast.
    """
    vocabulary.parts  # made once, here
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("n_tokens long, ids binary, decoded binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value)
        for batch in chain.from_iterable(map(slices, batches)):
            ids = [encoder.encode(t or "") for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([encoder.decode(x) for x in ids], pa.binary()),
                ],
                names=["n_tokens", "ids", "decoded"],
            )

    return encode(text)


def reference_ids(text: str, vocabulary: Vocabulary) -> list[int]:
    """The plain way, pair by pair, for tests."""
    bound = max(vocabulary.tokens) + 1
    ids = []
    for piece in regex.findall(vocabulary.pattern, text):
        data = piece.encode()
        ids += (
            [vocabulary.ranks[data]]
            if data in vocabulary.ranks
            else _merge(data, vocabulary.ranks, bound)
        )
    return ids

