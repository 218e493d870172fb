"""Byte-level BPE encoding and decoding (operator 9).

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary lists every
token at every place. A piece is then encoded from left to right with the longest token that may follow
the one before it; a dead end gives up the last token and goes on with its next shorter one. Two tokens may
follow each other when no merge of lower rank crosses their border, which is decided by walking back the
merges that made them; the answers are memoised, and a place found dead is never tried again, so the work
stays linear. The result is that of the merges themselves.

Nulls and empty texts give no ids and decode to no bytes. Texts of any length are encoded whole. Rows are
neither merged nor reordered; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import fresh, ship, small_batches
from pluvio.llm.pieces import splitter

# Entries each memory of an earlier answer may hold before it starts anew; results don't depend on it.
MEMO = 1 << 17
# Pieces up to this many characters are remembered with their ids.
MEMO_PIECE = 64


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Tokens and ids of a rank file, lowest id first."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return sorted(((base64.b64decode(token), int(rank)) for token, rank in pairs), key=lambda pair: pair[1])


def merge_parents(tokens: list[bytes]) -> list[tuple[int, int]]:
    """For each token the two that merge into it; its own place twice for one byte, (-1, -1) if merges never give it."""
    place = {token: k for k, token in enumerate(tokens)}
    parents = []
    for k, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            merged = [place.get(a + b, k) for a, b in zip(parts, parts[1:])]
            best = min(merged)
            if best >= k:
                break
            i = merged.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        known = all(part in place for part in parts)
        if len(parts) == 1:
            parents.append((k, k))
        else:
            parents.append((place[parts[0]], place[parts[1]]) if len(parts) == 2 and known else (-1, -1))
    return parents


class Encoder:
    """Encoder of one rank file."""

    def __init__(self, tokens: list[bytes], ids: list[int], parents: list[tuple[int, int]], pattern: str):
        self.place = {token: k for k, token in enumerate(tokens)}
        self.size = [len(token) for token in tokens]
        self.packed = [struct.pack("<I", i) for i in ids]
        self.left_of = [left for left, _ in parents]
        self.right_of = [right for _, right in parents]
        self.merged = {a * len(tokens) + b: k for k, (a, b) in enumerate(parents) if a >= 0 and a != k}
        self.split = splitter(pattern)
        self.automaton = ahocorasick.Automaton()
        for k, token in enumerate(tokens):
            if parents[k][0] >= 0:
                self.automaton.add_word(token.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.may_follow: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _border(self, left: int, right: int) -> bool:
        """Whether the merges leave a border between the two tokens."""
        merged, before, after, count = self.merged, self.left_of, self.right_of, len(self.size)
        below = count  # merges from here on came after the border was settled
        while True:
            if merged.get(left * count + right, below) < below:
                return False
            # undo the younger of the two; its inner part at the border was there before
            if left > right:
                below, inner = left, after[left]
                if inner == left:
                    below, inner = right + 1, before[right]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                below, inner = right + 1, before[right]
                if inner == right:
                    below, inner = left, after[left]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def piece(self, piece: bytes) -> list[int]:
        """Places in the vocabulary of the tokens of one piece."""
        if piece in self.place:
            return [self.place[piece]]
        size, memo, count, n = self.size, self.may_follow, len(self.size), len(piece)
        if len(memo) >= MEMO:
            memo.clear()
        starting: list[list[int]] = [[] for _ in range(n)]  # shortest first
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            starting[end + 1 - size[token]].append(token)
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        tried: list[int] = []
        at, last = 0, -1
        here = starting[0]
        k = len(here) - 1
        while True:
            while k >= 0:
                token = here[k]
                end = at + size[token]
                if alive[end]:
                    if last < 0:
                        break
                    pair = last * count + token
                    fits = memo.get(pair)
                    if fits is None:
                        fits = memo[pair] = self._border(last, token)
                    if fits:
                        break
                k -= 1
            if k >= 0:
                out.append(token)
                if end == n:
                    return out
                tried.append(k)
                at, last, here = end, token, starting[end]
                k = len(here) - 1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a token for a byte of the text")
                alive[at] = 0
                at -= size[out.pop()]
                here, k = starting[at], tried.pop() - 1
                last = out[-1] if out else -1

    def _packed_pieces(self, text: str) -> Iterator[bytes]:
        known, packed = self.known, self.packed
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = b"".join([packed[k] for k in self.piece(piece.encode())])
                if len(piece) <= MEMO_PIECE:
                    if len(known) >= MEMO:
                        known.clear()
                    known[piece] = ids
            yield ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self._packed_pieces(text)) if text else b""


class Decoder:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes], ids: list[int], *_):
        self.bytes_of = dict(zip(ids, tokens))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())) if ids else b""


_MADE: dict[tuple[str, str], Encoder | Decoder] = {}


class SharedCodec:
    """Tables of a rank file (bounded by it), made once and broadcast; each worker builds its part once.

    The session's batches to Python are small from here on.
    """

    def __init__(self, docs: DataFrame, path: str, pattern: str):
        ship(docs.sparkSession)
        small_batches(docs.sparkSession)
        pairs = read_ranks(path)
        tokens = [token for token, _ in pairs]
        tables = (tokens, [rank for _, rank in pairs], merge_parents(tokens), pattern)
        self.key = f"{path}|{pattern}"
        self.tables = docs.sparkSession.sparkContext.broadcast(tables)

    def get(self, kind: type) -> Encoder | Decoder:
        key = (self.key, kind.__name__)
        if key not in _MADE:
            for other in [made for made in _MADE if made[0] != self.key]:
                del _MADE[other]
            _MADE[key] = kind(*self.tables.value)
        return _MADE[key]


def _mapped(shared: SharedCodec, kind: type, method: str):
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apply = getattr(shared.get(kind), method)
        for batch in batches:
            yield pd.Series([apply(value) for value in batch], dtype=object)

    return run


def encode(docs: DataFrame, codec: SharedCodec, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of ``text`` as packed little-endian unsigned 32-bit integers."""
    return docs.withColumn(ids, _mapped(codec, Encoder, "encode")(F.col(text)))


def decode(tokens: DataFrame, codec: SharedCodec, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that the packed ids stand for."""
    return tokens.withColumn(decoded, _mapped(codec, Decoder, "decode")(F.col(ids)))


def round_trip(docs: DataFrame, codec: SharedCodec, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both columns of ``encode`` and ``decode`` from one worker, where two would hold the tables and pass the ids on."""

    @F.pandas_udf("ids binary, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = codec.get(Encoder), codec.get(Decoder)
        for batch in batches:
            packed = [encoder.encode(value) for value in batch]
            back = [decoder.decode(value) for value in packed]
            yield pd.DataFrame({"ids": pd.Series(packed, dtype=object), "decoded": pd.Series(back, dtype=object)})

    (both,) = fresh(docs, "both")
    done = docs.withColumn(both, run(F.col(text)))
    return done.withColumns({ids: F.col(f"`{both}`.ids"), decoded: F.col(f"`{both}`.decoded")}).drop(both)
