"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

A text is cut by the tokenizer's pattern; each distinct piece is encoded once per Python worker and then looked up.
The merges of a piece run over a segment tree whose leaves are the byte positions: a leaf holds the rank of the pair
that begins there, an inner node the leftmost minimum below it.  A merge changes two live neighbours and retires one
position, so it costs three updates of logarithmic length, whatever the piece's length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.tables import spread

NONE = 1 << 62
#: Distinct pieces that a worker keeps; beyond it the table is begun again, which changes no result.
MAX_PIECES = 400_000
#: Characters encoded at a time, to bound a worker's memory.
CHUNK_CHARS = 2_000_000


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """The path of a rank file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeTree:
    """The merges of one piece of text."""

    def __init__(self, piece: bytes, ranks: dict[bytes, int]):
        n = len(piece)
        self.ranks, self.n = ranks, n
        self.parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        self.next, self.prev = list(range(1, n + 1)), list(range(-1, n - 1))
        self.width = 1 << max(0, (n - 1).bit_length())
        self.tree = [NONE] * (2 * self.width)
        for i in range(n - 1):
            self.tree[self.width + i] = self._key(i)
        for k in range(self.width - 1, 0, -1):
            a, b = self.tree[2 * k], self.tree[2 * k + 1]
            self.tree[k] = a if a <= b else b

    def _key(self, i: int) -> int:
        """Rank and position of the pair at i in one number: the smallest is the leftmost of the lowest rank."""
        j = self.next[i]
        if j >= self.n:
            return NONE
        rank = self.ranks.get(self.parts[i] + self.parts[j])
        return NONE if rank is None else rank * self.n + i

    def _set(self, i: int, key: int) -> None:
        tree, k = self.tree, self.width + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    def run(self) -> list[int]:
        n = self.n
        while (low := self.tree[1]) != NONE:
            i = low % n
            j = self.next[i]
            self.parts[i] += self.parts[j]
            self.parts[j] = None
            self.next[i] = after = self.next[j]
            if after < n:
                self.prev[after] = i
            self._set(j, NONE)
            self._set(i, self._key(i))
            if self.prev[i] >= 0:
                self._set(self.prev[i], self._key(self.prev[i]))
        return [self.ranks[p] for p in self.parts if p is not None]


class Chunks(dict):
    """From a stretch of text between two piece boundaries to its number.

    The ids of stretch k are ``flat[starts[k]:starts[k] + lengths[k]]``.  ``lead`` is put before a key that does not
    begin with a line end.
    """

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk: str) -> int:
        enc = self.encoder
        self[chunk] = k = len(enc.starts)
        enc.starts.append(len(enc.flat))
        for piece in enc.split(chunk if chunk[:1] in ("\n", "\r") else self.lead + chunk):
            enc.flat.extend(enc.piece(piece))
        enc.lengths.append(len(enc.flat) - enc.starts[k])
        return k


#: White space that a piece may begin or end with in ways that the fast cut does not handle; such texts go to the pattern.
ODD = [*"\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ue000", *map(chr, range(0x2000, 0x200B))]


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self._begin()

    def _begin(self) -> None:
        self.flat, self.starts, self.lengths, self.pieces = [], [], [], {}
        self.spaced, self.bare = Chunks(self, " "), Chunks(self, "")

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece of the pattern."""
        ids = self.pieces.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            self.pieces[piece] = ids = [whole] if whole is not None else MergeTree(raw, self.ranks).run()
        return ids

    def numbers(self, text: str) -> list[int]:
        """``text`` as numbers of its stretches.

        A piece always ends before white space that follows something else.  Where blanks stand alone and lines end in one
        way, cutting at the blanks and line ends thus cuts between pieces, and a stretch is a word with its marks.
        """
        if "\r" in text:
            ok = text.count("\r\n") == text.count("\n") == text.count("\r") and "\r\n\r\n\r" not in text and "\r " not in text and " \r" not in text
            cut = text.replace("\r\n\r\n", "\ue000").replace("\r\n", " \r\n").replace("\ue000", " \r\n\r\n") if ok else ""
        else:
            ok, cut = "\n\n\n" not in text and " \n" not in text and text[-2:] != "\n\n", text.replace("\n", " \n")
        if not ok or "  " in text or "\n " in text or text[0].isspace() or any(c in text for c in ODD if c != "\ue000" or "\r" in text):
            return [self.bare[p] for p in self.split(text)]
        first, *rest = cut.split(" ")
        return [self.bare[first], *map(self.spaced.__getitem__, rest)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each text."""
        if len(self.starts) > MAX_PIECES:
            self._begin()
        at, counts = [], []
        for t in texts:
            own = self.numbers(t) if t else []
            at.extend(own)
            counts.append(len(own))
        counts = np.asarray(counts, np.int64)
        if not at:
            return np.zeros(0, np.int32), counts
        flat, at = np.asarray(self.flat, np.int32), np.asarray(at, np.int64)
        starts, lengths = np.asarray(self.starts, np.int64)[at], np.asarray(self.lengths, np.int64)[at]
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
        upto = np.concatenate(([0], ends))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return flat[place], upto[bounds[1:]] - upto[bounds[:-1]]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def parts_of(texts: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """``texts`` as lists of together about ``most`` characters, with the place of each list's first."""
    first, held, size = 0, [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= most:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", vocab: str | None = None) -> DataFrame:
    """``key`` and the token ids of ``text`` for every row of ``docs``.

    Null and empty texts give an empty list; a blank text gives the tokens of its blanks.  Strings of special tokens are
    ordinary text.  A text of any length is encoded whole; repeated rows stay repeated; rows with a null key are kept;
    other columns are not read.  The vocabulary's path is a parameter and is read on each worker, not sent with the plan.
    """
    path = vocab or vocabulary()
    src = docs.select(docs[key], docs[text])
    schema = f"`{key}` {src.schema[0].dataType.simpleString()}, `{out}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for first, part in parts_of(texts):
                ids, counts = enc.encode(part)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(part)), lists], [key, out])

    return spread(src).mapInArrow(run, schema)


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of a list of ids."""
    raw = {v: k for k, v in encoder(path or vocabulary()).ranks.items()}
    return b"".join(raw[i] for i in ids).decode("utf-8", "replace")
