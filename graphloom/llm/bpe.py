"""Byte-level BPE encoding and decoding of whole texts, identical to the merges of the rank file.

A text is split by the tokenizer's pattern; each piece of bytes, read as Latin-1, runs once through
an Aho-Corasick automaton of all tokens, which gives the longest token at every position. The
encoder walks from longest match to longest match and steps back to a shorter one wherever two
neighbouring tokens could not stand side by side after the merges. That compatibility is decided on
the tokens' own merge trees and memoised, so a piece costs time linear in its length.

Defined results: a null or empty text has no ids; any string, however long, is encoded whole; ids
decode to exactly the text's UTF-8 bytes; an empty table gives an empty table with the same columns.
Repeated rows encode alike; extra columns pass through, but columns named like the results, in any case, are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import releasing, small_batches

#: Entries kept by each memo before it starts anew; this bounds a worker's memory, not its results.
MEMO = 150_000
#: Signs that the pattern splits from the letters before them.
ALONE = frozenset(".,;:!?)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Spans(Exception):
    """White space reaches over the blank that a text was cut at."""


class _Cut(dict):
    """Memo from what stands between two blanks to its packed ids; ``lead`` is the blank before it."""

    def __init__(self, bpe: Bpe, lead: str):
        self.bpe, self.lead = bpe, lead

    def __missing__(self, chunk: str) -> bytes:
        if self.lead and (not chunk or chunk[0].isspace()) or chunk and chunk[-1].isspace():
            raise _Spans
        if len(self) >= MEMO:
            self.clear()
        bpe = self.bpe
        if chunk.isalpha():  # one piece: isalpha is the pattern's \p{L}
            out = bpe.pack(self.lead + chunk)
        elif chunk[-1:] in ALONE and chunk[:-1].isalpha():
            out = self[chunk[:-1]] + bpe.pieces[chunk[-1]]
        else:
            out = b"".join([bpe.pieces[p] for p in bpe.split(self.lead + chunk)])
        self[chunk] = out
        return out


class _Pieces(dict):
    """Memo from a piece of the pattern to its packed ids."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = self[piece] = self.bpe.pack(piece)
        return out


class Bpe:
    """Encoder and decoder of one rank file, with its memos."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s of the tokenizer is Unicode's White_Space, which regex's \s equals but for four separators
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.bytes: list[bytes] = [b""] * size
        for k, v in ranks.items():
            self.bytes[v] = k
        self.size = [len(b) for b in self.bytes]
        self.lengths = np.array(self.size, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.laid = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for k, v in ranks.items():
            self.automaton.add_word(k.decode("latin-1"), v)
        self.automaton.make_automaton()
        self.parts: list[tuple[int, int] | None] = [None] * size  # the last merge of each token
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: list[int] = [-1] * size  # the longest token that is a proper prefix
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = self._merge(token, i)
                if len(halves) == 2:
                    self.parts[i] = (halves[0], halves[1])
                    self.joined[halves[0], halves[1]] = i
                self.shorter[i] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.fits: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        self.first, self.rest = _Cut(self, ""), _Cut(self, " ")

    def _merge(self, token: bytes, below: int) -> list[int]:
        """The ids left of ``token`` when every merge ranked under ``below`` is done, lowest first."""
        ids = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(ids) > 1:
            best, at = min((self.joined.get((ids[i], ids[i + 1]), below), i) for i in range(len(ids) - 1))
            if best >= below:
                break
            ids[at : at + 2] = [best]
        return ids

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges of left + right end in exactly these two tokens.

        Takes both tokens apart again, latest merge first, along the two spines that meet at the border.
        A merge across the border spoils the pair if it is due before the tokens it needs are merged away.
        """
        due = len(self.bytes)
        parts, joined = self.parts, self.joined
        while True:
            across = joined.get((left, right))
            if across is not None and across < due:
                return False
            # of two equal ranks the left one merges first, so the right token is taken apart first
            pl, pr = parts[left], parts[right]
            if pl is None and pr is None:
                return True
            if pr is None or pl is not None and left > right:
                due, left = left, pl[1]
            else:
                due, right = right + 1, pr[0]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        size, fits, shorter = self.size, self.fits, self.shorter
        for end, i in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[i]] = i  # ends only grow, so the longest of a start comes last
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            good = not dead[end]
            if good and out:
                pair = out[-1] << 32 | token
                good = fits.get(pair)
                if good is None:
                    if len(fits) >= MEMO:
                        fits.clear()
                    good = fits[pair] = self._compatible(out[-1], token)
            if good:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # nothing fits here: never come back, and shorten what led here
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def forget(self) -> None:
        """Empties the memos, so that a worker at rest holds the tables of the rank file only."""
        for memo in (self.fits, self.pieces, self.first, self.rest):
            memo.clear()

    def pack(self, piece: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.encode_piece(piece.encode())))

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        cut = text.split(" ")
        try:
            return self.first[cut[0]] + b"".join(map(self.rest.__getitem__, cut[1:]))
        except _Spans:
            return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode_packed(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for: a gather from the laid-out vocabulary."""
        if not ids:
            return b""
        i = np.frombuffer(ids, "<u4")
        n = self.lengths[i]
        first = np.cumsum(n) - n
        at = np.repeat(self.starts[i] - first, n)
        at += np.arange(len(at), dtype=np.int64)
        return self.laid[at].tobytes()


_MADE: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """The encoder of a rank file, made once in each Python worker; ``path`` must exist on every executor."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = Bpe(read_ranks(path), pattern)
    return _MADE[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with token_ids (packed), n_tokens and decoded (the bytes the ids stand for)."""
    return _mapped(docs, path, pattern, text, [("token_ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.BinaryType())], lambda ids, back: (ids, len(ids) >> 2, back))


def digest(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and the SHA-256 of the packed ids and of the decoded bytes."""
    return _mapped(docs, path, pattern, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], lambda ids, back: (len(ids) >> 2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))


def _mapped(docs: DataFrame, path: str, pattern: str, text: str, added: list[tuple[str, T.DataType]], of) -> DataFrame:
    new = [n for n, _ in added]
    fields = [f for f in docs.schema.fields if f.name.lower() not in new]
    names = [f.name for f in fields]
    arrow = {T.BinaryType(): pa.binary(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
    types = [arrow[t] for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 512):  # a few megabytes at a time
                part = b.slice(lo, 512)
                made = []
                for x in part.column(text):
                    ids = bpe.encode_packed(x.as_py())
                    made.append(of(ids, bpe.decode_packed(ids)))
                cols = [part.column(n) for n in names] + [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=names + new)
        bpe.forget()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(releasing(run), T.StructType([*fields, *[T.StructField(n, t) for n, t in added]]))
