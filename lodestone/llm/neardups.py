"""Problem 1: records that share most of their content, by prefixes under several global token orders.

A record is the set of its distinct runs of ``SHINGLE`` words.  Two sets x and y with a Jaccard similarity of t or more
share a token among the first ``|x| - ceil(t |x|) + 1`` of x and the first so many of y, under *any* order of all tokens.
The first order puts rare tokens first, by a table of counts of hashed tokens over all records, of a size that is known;
equal prefix tokens there give the candidates.  Candidates whose bitmaps of hashed tokens differ in more bits than similar
sets have tokens apart are dropped, then those without a common prefix token under two more orders, by independent hashes;
what passes is compared in full.  Only prefixes, bitmaps and the texts of the last candidates are shuffled, never whole
sets.  Records of equal sets are one class from the start, known by its smallest key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import parts_of
from lodestone.llm.words import grams, hashed_words
from lodestone.tables import cut, once, spread

SHINGLE = 3
ORDERS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
#: Counters of hashed tokens for each class of records, and how many there are at least and at most (powers of two).
COUNTERS, FEWEST_COUNTERS, MOST_COUNTERS = 64, 20, 24
BLOCK = 16  # bits of a counter's place within a block of counters


def joined(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffles: tables made in Arrow batches look far smaller to the optimizer than they are, and a broadcast would pass whole through the driver."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def prefix_length(size: int, least: float) -> int:
    return size - math.ceil(round(least * size, 9)) + 1


def token_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct tokens of each text, in order."""
    h, bounds = hashed_words(texts)
    g = grams(h, SHINGLE)
    for i, j in pairwise(bounds.tolist()):
        yield np.unique(g[i : max(i, j - SHINGLE + 1)])


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, four to eight times as many bits as tokens; of two bitmaps the larger can be folded to the smaller."""
    bits = 1 << max(6, int(4 * len(tokens) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(tokens >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the rows of two tables of bitmaps differ: so many tokens, or more, are in one of two sets only."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] | a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] | b[:, b.shape[1] // 2 :]
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def described(docs: DataFrame, fewest: int) -> DataFrame:
    """key, text, class (of equal sets), size and bitmap of records with at least ``fewest`` tokens."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in parts_of(b.column(1), 1_000_000):
                at, classes, sizes, bitmaps = [], [], [], []
                for k, own in enumerate(token_sets(texts)):
                    if len(own) >= fewest:
                        at.append(first + k)
                        classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                        sizes.append(len(own))
                        bitmaps.append(bitmap(own))
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bitmaps, pa.binary())], ["key", "text", "class", "size", "bitmap"])

    return spread(docs).mapInArrow(run, f"key {kind}, text string, class binary, size int, bitmap binary")


def rarity(texts: DataFrame, bits: int) -> np.ndarray:
    """For each of 2^bits places of hashed tokens how frequent its tokens are together, on a scale of 255 steps; 1 is a single one.

    Tasks count all their tokens and give what isn't zero, by block of counters; blocks are added up as streams.
    """
    mask, block = np.uint64((1 << bits) - 1), 1 << BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.uint16)
        for b in batches:
            for _, part in parts_of(b.column(0), 1_000_000):
                own = [t & mask for t in token_sets(part)]
                at, k = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                n[at] = np.minimum(n[at] + k, 65535)
        for first in range(0, 1 << bits, block):
            at = np.flatnonzero(n[first : first + block])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([first >> BLOCK], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([n[first + at].tobytes()], pa.binary())], ["block", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(block, np.int64)

        def out() -> pa.RecordBatch:
            steps = np.minimum(255, np.where(total > 1, 1 + 8 * np.log2(np.maximum(total, 1)), total)).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([steps.tobytes()], pa.binary())], ["block", "steps"])

        for b in batches:
            for which, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if which != now:
                    if now is not None:
                        yield out()
                    now, total = which, np.zeros(block, np.int64)
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
        if now is not None:
            yield out()

    parts = texts.mapInArrow(count, "block int, at binary, n binary").repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, steps binary").toArrow()
    steps = np.zeros(1 << bits, np.uint8)
    for which, s in zip(parts.column("block").to_pylist(), parts.column("steps").to_pylist()):
        steps[which << BLOCK : (which + 1) << BLOCK] = np.frombuffer(s, np.uint8)
    return steps


def prefixes(classes: DataFrame, steps: np.ndarray, least: float) -> DataFrame:
    """token, key, size: the prefix of each class under the order by rarity, without tokens that no other class has."""
    kind = classes.schema["key"].dataType.simpleString()
    shared = classes.sparkSession.sparkContext.broadcast(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, mask = shared.value, np.uint64(len(shared.value) - 1)
        for b in batches:
            for first, texts in parts_of(b.column(1), 1_000_000):
                at, sizes, tokens = [], [], []
                for k, own in enumerate(token_sets(texts)):
                    rank = step[own & mask]
                    n = prefix_length(len(own), least)
                    order = np.argsort(rank, kind="stable")[:n]  # of equal steps the smaller token
                    chosen = own[order[rank[order] > 1]]
                    at.append(np.full(len(chosen), first + k))
                    sizes.append(np.full(len(chosen), len(own), np.int32))
                    tokens.append(chosen.view(np.int64))
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), b.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(sizes))], ["token", "key", "size"])

    return classes.select("key", "text").mapInArrow(run, f"token bigint, key {kind}, size int")


def alike_bitmaps(pairs: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs (a, b, size_a, size_b, bitmap_a, bitmap_b) whose bitmaps allow a similarity of ``least``."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
            left, right = b.column(4).to_pylist(), b.column(5).to_pylist()
            groups: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(left, right)):
                groups.setdefault((len(x), len(y)), []).append(i)
            keep = np.zeros(b.num_rows, bool)
            for (m, n), at in groups.items():
                x, y = np.frombuffer(b"".join(left[i] for i in at), np.uint8).reshape(-1, m), np.frombuffer(b"".join(right[i] for i in at), np.uint8).reshape(-1, n)
                keep[at] = apart(x, y) <= sizes[at] * ((1 - least) / (1 + least)) + 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "size_a", "size_b", "bitmap_a", "bitmap_b").mapInArrow(run, f"a {kind}, b {kind}")


def compared(pairs: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of the pairs (a, b, text_a, text_b) that share prefixes under the other orders and are similar."""
    kind = pairs.schema["a"].dataType.simpleString()

    def prefix(tokens: np.ndarray, order: int) -> np.ndarray:
        mixed = tokens * np.uint64(order)
        mixed ^= mixed >> np.uint64(31)
        n = prefix_length(len(tokens), least)
        return np.partition(mixed, n - 1)[:n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                b = batch.slice(first, 500)
                left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
                texts = list(dict.fromkeys(left + right))
                sets = {}
                at = 0
                while at < len(texts):  # in parts of a size that is known
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
                        size += len(texts[end])
                        end += 1
                    sets |= zip(texts[at:end], token_sets(texts[at:end]))
                    at = end
                found = np.zeros(b.num_rows)
                for i, (x, y) in enumerate(zip(left, right)):
                    x, y = sets[x], sets[y]
                    if all(len(np.intersect1d(prefix(x, o), prefix(y, o), assume_unique=True)) for o in ORDERS):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        found[i] = common / (len(x) + len(y) - common)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], ["a", "b", "similarity"]).filter(pa.array(found >= least - 1e-12))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def similar_classes(classes: DataFrame, least: float) -> DataFrame:
    """a, b, similarity: the pairs of classes (key, text, size, bitmap; a < b) whose sets have a similarity of ``least`` or more."""
    bits = min(max((COUNTERS * max(1, classes.count()) - 1).bit_length(), FEWEST_COUNTERS), MOST_COUNTERS)
    prefix = prefixes(classes, rarity(classes.select("text"), bits), least)
    a, b = (prefix.select("token", F.col("key").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
    near = (F.least("size_a", "size_b") >= F.lit(least) * F.greatest("size_a", "size_b") - 1e-9) & (F.col("a") < F.col("b"))
    candidates = joined(a, b, "token").where(near).select("a", "b", "size_a", "size_b").distinct()
    # each step joins only what is needed to drop candidates, the texts last
    of = lambda column: [classes.select(F.col("key").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "ab"]
    maps, texts = of("bitmap"), of("text")
    passed = alike_bitmaps(joined(joined(candidates, maps[0], "a"), maps[1], "b"), least)
    return compared(joined(joined(passed, texts[0], "a"), texts[1], "b"), least)


def near_duplicates(docs: DataFrame, key: str, text: str, least: float = 0.7, fewest: int = 50) -> tuple[DataFrame, DataFrame]:
    """The classes of equal token sets (key, class) and the pairs of similar classes (a, b, similarity).

    Every record with at least ``fewest`` distinct runs of three words has a class, called by its smallest key; null,
    empty and shorter texts have none.  Rows of one key are taken as copies; null keys are left out; other columns are not
    read.  Copies are not expanded into pairs: two records are similar if they are of one class or their classes are a pair.
    """
    src = once(docs.select(docs[key].alias("key"), docs[text].alias("text") if isinstance(text, str) else text.alias("text")).where("text is not null"), "key")
    found = cut(described(src, fewest))
    classes = cut(found.groupBy("class").agg(F.min("key").alias("key"), F.min_by("text", "key").alias("text"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap")))
    members = joined(found.select("key", "class"), classes.select("class", F.col("key").alias("first")), "class").select("key", F.col("first").alias("class"))
    return members, similar_classes(classes, least)


def similar_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """All pairs of different records that are similar, the smaller key first."""
    a, b = members.select(F.col("key").alias("x"), F.col("class").alias("a")), members.select(F.col("key").alias("y"), F.col("class").alias("b"))
    own = joined(a, b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    across = joined(joined(links.select("a", "b"), a, "a"), b, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return own.unionByName(across).select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for the nodes of ``edges`` (a, b): the smallest node that is connected with each.

    Large-star and small-star rounds: every round each node links its larger neighbours, then its smaller ones, to the
    smallest it knows.  The number of rounds grows with the logarithm of the longest path.  Each round is checkpointed.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = joined(both.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = joined(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            break
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def groups(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One row for each record: its class, its group (the smallest class that similar pairs lead to), and how many other records it is similar to."""
    links = cut(links.select("a", "b"))  # read by the links and in the first round of the components
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    ends = links.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("class"), F.col("a").alias("other")))
    more = joined(ends, sizes.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("n").alias("more"))
    roots = components(links.select("a", "b")).withColumnRenamed("node", "class")
    out = joined(joined(joined(members, sizes, "class"), more, "class", "left"), roots, "class", "left")
    return out.select(F.col("key").alias(key), F.col("class").alias("class_id"), F.coalesce("root", "class").alias("group_id"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
