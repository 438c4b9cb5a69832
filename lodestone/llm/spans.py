"""Problem 10: long exact spans shared between records, by prefix-partitioned suffix trees.

A full suffix tree has a leaf for each character.  To find every common span of ``least`` characters a sparse tree is
enough: suffixes begin at *anchors*, the positions whose 16-character hash is the smallest in some window of ``WINDOW``
positions.  Two records with a common span choose the same anchors inside it, the first within ``WINDOW`` characters, so
that at least ``least - WINDOW + 1`` characters of the span follow.  Suffixes are split by their prefix of that length (its
64-bit hash), one prefix going to one task; prefixes of a single record are dropped.  For the others the text around the
anchors is read again, and each prefix becomes a subtree: its suffixes in order with the lengths that neighbours share.
An internal node of depth d together with ``least - d`` common characters on the left is a shared span.  A prefix with
more than ``SUBTREE`` suffixes is split further, by longer prefixes: each window of ``least`` characters whose first anchor
has the prefix is then a prefix of its own, which needs no subtree; windows are told apart by 128 bits of a cryptographic
hash.  Members of a prefix are counted by aggregates with a partial step and joined back, so that no prefix goes to one task
unless it is small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.tables import cut, spread

WINDOW = 100
GRAM = 16
SUBTREE = 2000
BLOCK = 400_000
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n modulo 2^64, and their inverses."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(2 * n + 1, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def slide(a: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) over each run of ``width`` neighbours of ``a``."""
    k, m = 1, a
    while 2 * k <= width:
        m, k = of(m[:-k], m[k:]), 2 * k
    return of(m[: len(m) - (width - k)], m[width - k :]) if k < width else m


def anchors(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: the number of its text, its place, and the hash of the prefix that follows.  All texts have at least ``least`` characters."""
    prefix = least - WINDOW + 1
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(a)
    p, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = slide(h, WINDOW, np.minimum)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    for e in ends[:-1]:  # windows that cross into the next text choose nothing
        low[max(0, e - WINDOW - GRAM + 2) : e] = 0
    padded = np.zeros(len(h) + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 : WINDOW - 1 + len(low)] = low
    at = np.flatnonzero(slide(padded, WINDOW, np.maximum) == h)
    doc = np.searchsorted(ends, at, side="right")
    ok = at + prefix <= ends[doc]
    at, doc = at[ok], doc[ok]
    key = (sums[at + prefix] - sums[at]) * inverse[at]
    return doc, at - (ends - lengths)[doc], key.view(np.int64)


def shared_prefixes(docs: DataFrame, least: int) -> DataFrame:
    """doc, at, prefix and members of the anchors whose prefix occurs in more than one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: list, texts: list) -> pa.RecordBatch:
            doc, at, key = anchors(texts, least)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind).take(pa.array(doc)), pa.array(at, pa.int32()), pa.array(key)], ["doc", "at", "prefix"])

        for b in batches:
            kind, keys, texts, size = b.column(0).type, [], [], 0
            for k, t in zip(b.column(0), b.column(1)):
                t = t.as_py()
                if len(t) >= least:
                    keys.append(k.as_py())
                    texts.append(t)
                    size += len(t)
                if size >= BLOCK:
                    yield flush(keys, texts)
                    keys, texts, size = [], [], 0
            if texts:
                yield flush(keys, texts)

    kind = docs.schema["doc"].dataType.simpleString()
    found = spread(docs).mapInArrow(run, f"doc {kind}, at int, prefix bigint")  # made twice: that is less than to keep it
    return found.join(of_several(found, "prefix"), "prefix").select("doc", "at", "prefix", "members")


def of_several(found: DataFrame, key: str) -> DataFrame:
    """The keys of rows of more than one record, and how many rows they have."""
    return found.groupBy(key).agg(F.min("doc").alias("lowest"), F.max("doc").alias("highest"), F.count("*").alias("members")).where("lowest < highest").select(key, "members")


def befores(rows: list[tuple], own: list[int]) -> list[int]:
    """For each of ``own``, the most characters before its anchor that it shares with one of them of another record."""
    back = sorted((rows[k][1][::-1], rows[k][0], n) for n, k in enumerate(own))
    most = [0] * len(own)
    for step in (back, back[::-1]):
        last: list[tuple] = []  # the nearest of two records
        for text, doc, n in step:
            near = next((x for x in reversed(last) if x[1] != doc), None)
            if near:
                most[n] = max(most[n], shared(text, near[0]))
            last = [*[x for x in last[-1:] if x[1] != doc], (text, doc, n)] if last and last[-1][1] != doc else [*last[:-1], (text, doc, n)]
    return most


def nodes(rows: list[tuple], least: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """The shared spans of one subtree.

    ``rows`` are (record, text before the anchor, text from the anchor).  Gives, for each internal node and each group of
    its suffixes with enough in common on the left: the characters after the anchor, the places in ``rows``, and the
    characters before it, for each place.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i][2])
    common = [shared(rows[a][2], rows[b][2]) for a, b in zip(order, order[1:])]
    stack: list[tuple[int, int]] = []  # depth and first place of the nodes that are still open
    for i, d in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            if depth < least - WINDOW + 1:
                continue
            groups: dict[str, list[int]] = {}
            need = max(0, least - depth)
            for k in order[first : i + 1]:
                before = rows[k][1]
                if len(before) >= need:
                    groups.setdefault(before[len(before) - need :], []).append(k)
            for own in groups.values():
                if len({rows[k][0] for k in own}) > 1:
                    yield depth, own, befores(rows, own)
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, first))


def shared(a: str, b: str) -> int:
    """How many first characters ``a`` and ``b`` have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 300) -> DataFrame:
    """span, doc, from_char, to_char: all stretches (from 0, the end left out) that a record shares with others, by span.

    Records that have a row of the same ``span`` share at least ``least`` characters, equal character for character; every
    pair of records with such a stretch meets in some span.  A span is a node of a subtree, so one stretch may have
    several, and long stretches come as overlapping rows.  Null and shorter texts share nothing; rows of one key are taken
    as copies and count once; a stretch that occurs twice in one record only is not shared; null keys are left out.
    """
    if least < WINDOW + 2 * GRAM:
        raise ValueError(f"least is at least {WINDOW + 2 * GRAM}")
    src = docs.select(docs[key].alias("doc"), docs[text].alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= least))
    kind = src.schema["doc"].dataType.simpleString()
    marked = cut(shared_prefixes(src, least))
    hot = F.col("members") > SUBTREE

    def texts_with(places: DataFrame) -> DataFrame:
        return src.join(places.groupBy("doc").agg(F.collect_list(F.struct("at", "prefix")).alias("places")), "doc").select("doc", "text", "places")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text around each anchor."""
        for b in batches:
            docs_, ats, spans, befores, afters = [], [], [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(docs_, b.column(0).type), pa.array(ats, pa.int32()), pa.array(spans, pa.int64()), pa.array(befores, pa.string()), pa.array(afters, pa.string())], ["doc", "at", "prefix", "before", "after"])

            for k, t, ps in zip(b.column(0), b.column(1), b.column(2)):
                k, t = k.as_py(), t.as_py()
                for at, prefix in {(p["at"], p["prefix"]) for p in ps.as_py()}:
                    docs_.append(k), ats.append(at), spans.append(prefix), befores.append(t[max(0, at - WINDOW + 1) : at]), afters.append(t[at : at + least])
                if len(docs_) > 5000:
                    yield out()
                    docs_, ats, spans, befores, afters = [], [], [], [], []
            if docs_:
                yield out()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of ``least`` characters of which an anchor is the first."""
        for b in batches:
            docs_, spans, firsts = [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(spans, pa.binary()), pa.array(docs_, b.column(0).type), pa.array(firsts, pa.int32()), pa.array([f + least for f in firsts], pa.int32())], ["span", "doc", "from_char", "to_char"])

            for k, t, ps in zip(b.column(0), b.column(1), b.column(2)):
                k, t, done = k.as_py(), t.as_py(), -1
                for at in sorted({p["at"] for p in ps.as_py()}):
                    for first in range(max(0, at - WINDOW + 1, done + 1), min(at, len(t) - least) + 1):
                        docs_.append(k), spans.append(digest(t[first : first + least])), firsts.append(first)
                    done = at
                    if len(docs_) > 20_000:
                        yield out()
                        docs_, spans, firsts = [], [], []
            if docs_:
                yield out()

    near = texts_with(marked.where(~hot)).mapInArrow(around, f"doc {kind}, at int, prefix bigint, before string, after string")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        prefix = None
        out: list[tuple] = []
        kind_ = None

        def close() -> None:
            for depth, own, before in nodes(held, least):
                k = own[0]
                span = digest(f"{prefix}|{depth}|{held[k][2][:depth]}|{held[k][1][len(held[k][1]) - max(0, least - depth):]}")
                for k, left in zip(own, before):
                    out.append((span, held[k][0], held[k][3] - left, held[k][3] + depth))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], kind_), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["span", "doc", "from_char", "to_char"])

        for b in batches:
            kind_ = b.column(0).type
            for doc, at, p, before, after in zip(*(c.to_pylist() for c in b.columns)):
                if p != prefix:
                    if len(held) > 1:
                        close()
                    held, prefix = [], p
                    if len(out) > 20_000:
                        yield batch()
                        out = []
                held.append((doc, before, after, at))
        if len(held) > 1:
            close()
        if kind_ is not None:
            yield batch()

    schema = f"span binary, doc {kind}, from_char int, to_char int"
    small = near.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(trees, schema)
    if marked.where(hot).isEmpty():
        return small
    large = cut(texts_with(marked.where(hot)).mapInArrow(windows, schema))
    return small.unionByName(large.join(of_several(large, "span").select("span"), "span").select("span", "doc", "from_char", "to_char"))


def sharing_pairs(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The distinct pairs of records that meet in a span, the smaller key first."""
    own = spans.select("span", "doc").distinct()
    pairs = own.withColumnRenamed("doc", "a").join(own.withColumnRenamed("doc", "b"), "span").where("a < b")
    return pairs.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b")).distinct()


def shared_share(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each record with a shared span: its length, the characters that lie in shared spans, and their share."""
    order = Window.partitionBy("doc").orderBy("from_char", "to_char")
    seen = F.max("to_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("to_char") - F.greatest(F.col("from_char"), F.coalesce(seen, F.lit(0))), F.lit(0))
    per = spans.select("doc", "from_char", "to_char").distinct().withColumn("new", new).groupBy("doc").agg(F.sum("new").alias("shared_chars"))
    sizes = docs.select(F.col(key).alias("doc"), F.length(text).cast("bigint").alias("n_chars")).dropDuplicates(["doc"])
    return per.join(sizes, "doc").select(F.col("doc").alias(key), "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 4).alias("shared_part"))
