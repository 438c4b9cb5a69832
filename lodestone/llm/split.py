"""Problem 4: cutting oversized texts at natural boundaries, by agglomerative merging.

The atoms of a text are its paragraphs; a paragraph over the limit gives its sentences instead, such a sentence its words,
and such a word stretches of characters.  The boundary between two atoms is as weak as the cut that made it.  Adjacent
pairs wait in a heap, the weakest boundary first and under equal ones the smallest pair; a pair is merged while it and the
overlap fit the limit.  What remains are the pieces; each begins with the end of the piece before.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import parts_of
from lodestone.tables import once, spread

LEVELS = ("paragraph", "sentence", "word", "char")
SPACE = " \t\r\n"
BLANK_LINE = re.compile(r"(?:\r\n|\r(?!\n)|\n)[ \t]*(?:\r\n|\r|\n)[ \t\r\n]*")
SENTENCE_END = re.compile(r"(?<=[.!?])[ \t\r\n]+")
GAP = re.compile(r"[ \t\r\n]+")


def stripped(t: str, a: int, b: int) -> tuple[int, int]:
    while a < b and t[a] in SPACE:
        a += 1
    while b > a and t[b - 1] in SPACE:
        b -= 1
    return a, b


def cuts(t: str, a: int, b: int, at: re.Pattern) -> list[tuple[int, int]]:
    """The parts of t[a:b] between matches of ``at``, without white space at both ends and without empty ones."""
    out, last = [], a
    for m in at.finditer(t, a, b):
        out.append(stripped(t, last, m.start()))
        last = m.end()
    out.append(stripped(t, last, b))
    return [(x, y) for x, y in out if y > x]


def atoms(t: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Start, end and the level of the boundary before it, of each atom of a text."""
    out: list[tuple[int, int, int]] = []

    def add(a: int, b: int, before: int, level: int) -> None:
        if b - a <= limit:
            out.append((a, b, before))
        elif level == 3:
            step = max(1, limit - overlap)
            out.extend((x, min(b, x + step), before if x == a else 3) for x in range(a, b, step))
        else:
            for k, (x, y) in enumerate(cuts(t, a, b, (SENTENCE_END, GAP)[level - 1])):
                add(x, y, level if k else before, level + 1)

    for x, y in cuts(t, 0, len(t), BLANK_LINE):
        add(x, y, 0, 1)
    return out


def pieces(t: str, limit: int = 500, overlap: int = 50) -> tuple[str | None, list[tuple[int, int, int]]]:
    """The boundary that a text over the limit needs, and start, end and overlap of its pieces (of a shorter text, one piece)."""
    if len(t) <= limit:
        return None, [(0, len(t), 0)]
    parts = atoms(t, limit, overlap)
    level = max((p[2] for p in parts), default=0)
    n = len(parts)
    start, end = [p[0] for p in parts], [p[1] for p in parts]
    right, left, live = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap: list[tuple] = []

    def push(i: int) -> None:
        j = right[i]
        if j < n and (size := end[j] - start[i]) + overlap <= limit:
            heapq.heappush(heap, (-parts[j][2], size, i, j, live[i], live[j]))

    for i in range(n):
        push(i)
    while heap:
        _, _, i, j, vi, vj = heapq.heappop(heap)
        if live[i] != vi or live[j] != vj:
            continue
        end[i], right[i], live[i], live[j] = end[j], right[j], vi + 1, -1
        if right[i] < n:
            left[right[i]] = i
            push(i)
        if left[i] >= 0:
            push(left[i])
    out, i, before = [], 0, None
    while i < n:
        a = start[i]
        if before is not None:
            low = max(before - overlap, end[i] - limit, out[-1][0] + 1)
            fit = next((x for x in range(low, before) if t[x] not in SPACE and t[x - 1] in SPACE), None)
            a = fit if fit is not None else low if low < before and not any(c in SPACE for c in t[low:before]) else a
        out.append((a, end[i], max(0, (before or 0) - a)))
        before, i = end[i], right[i]
    return LEVELS[level], out


def split_texts(items: DataFrame, key: str, text: str, limit: int = 500, overlap: int = 50) -> DataFrame:
    """item_id, boundary, piece_no, from_char, to_char, overlap_chars and piece of every text.

    Texts up to the limit are one piece with a null boundary, an empty text is one empty piece, null texts have none; a
    blank text over the limit has boundary paragraph and no piece.  from_char counts from 1.  No piece has over ``limit`` characters.  Rows of
    one key are taken as copies, rows with a null key are left out, other columns are not read.
    """
    src = once(items.select(items[key].cast("string").alias("item_id"), items[text].alias("text")).where("text is not null"), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in parts_of(b.column(1), 1_000_000):
                rows = []
                for k, t in enumerate(texts):
                    key_ = b.column(0)[first + k].as_py()
                    boundary, found = pieces(t, limit, overlap)
                    rows += [(key_, boundary, n, a + 1, e, o, t[a:e]) for n, (a, e, o) in enumerate(found)] or [(key_, boundary, None, None, None, None, None)]
                cols = list(zip(*rows)) or [[] for _ in range(7)]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    names = ["item_id", "boundary", "piece_no", "from_char", "to_char", "overlap_chars", "piece"]
    return spread(src).mapInArrow(run, "item_id string, boundary string, piece_no int, from_char int, to_char int, overlap_chars int, piece string")


def boundaries(split: DataFrame) -> DataFrame:
    """item_id and boundary of the texts that had to be cut."""
    return split.where("boundary is not null and coalesce(piece_no, 0) = 0").select("item_id", "boundary")
