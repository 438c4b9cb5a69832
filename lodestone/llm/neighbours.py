"""Problem 2: the most similar vectors for every vector, by learned partitions.

On a bounded sample a graph of nearest neighbours is cut into parts of equal size with few edges between them.  A small
classifier (softmax regression) learns, for each sampled vector, how its neighbours spread over the parts.  It then gives
every vector of the collection its part and the parts that hold its neighbours with a probability of ``MASS`` together.
Where more parts are needed than one classifier can tell apart, each of its parts is cut again in the same way, on a sample
of its own, and probabilities multiply.  A vector is compared with all vectors of its own part first; the fifth best
similarity found there is a bound, and from the other parts only better ones come back.  Parts that are close together lie
in one shard, so that a vector is sent once to several of its parts.  Every vector is indexed; only the partition is fitted
on a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.tables import cut, once, spread

#: Vectors in the sample on which a partition is fitted, in one part on average, and parts of one classifier at most.
SAMPLE, PART, MOST_PARTS = 16_384, 1024, 512
#: Probability of holding the neighbours that the searched parts have together.
MASS = 0.998
#: Parts in one shard on average.
SHARD = 8
#: Edges of the graph for each sampled vector.
EDGES = 10
#: Vectors of one shard that one task holds, and queries that it answers; larger shards are split into blocks.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 65_536
SCALE = 8.0


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` at length 1; scaled by their largest entry first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the numbers of its ``k`` most similar other rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def fill(score: np.ndarray, most: int) -> np.ndarray:
    """A part for each row: the best by score that still has room, the highest scores first."""
    n, m = score.shape
    part, load, left = np.full(n, -1), np.zeros(m, int), np.arange(n)
    order = np.argsort(-score, axis=1, kind="stable")
    for c in range(m):
        want = order[left, c]
        o = np.lexsort((-score[left, want], want))
        w = want[o]
        ok = np.arange(len(w)) - np.searchsorted(w, w) < (most - load)[w]
        part[left[o[ok]]] = w[ok]
        load += np.bincount(w[ok], minlength=m)
        left = np.sort(left[o[~ok]])
        if not len(left):
            break
    return part


def balanced_parts(x: np.ndarray, near: np.ndarray, m: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """A part for each row, none with over 1.1 times the mean: grown from balanced centres, then moved along the graph's edges."""
    n = len(x)
    most = int(np.ceil(1.1 * n / m))
    centres = x[rng.choice(n, m, replace=False)].copy()
    for _ in range(8):
        part = fill(x @ centres.T, most)
        for c in range(m):
            if len(own := x[part == c]):
                centres[c] = own.mean(0) / max(1e-9, np.linalg.norm(own.mean(0)))
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    for _ in range(rounds):
        edges = np.zeros((n, m), np.float32)
        np.add.at(edges, (a, part[b]), 1)
        np.add.at(edges, (b, part[a]), 1)
        edges[np.arange(n), part] += 0.5
        edges += 0.1 * (x @ centres.T)
        part = fill(edges, most)
    return part


def fit(x: np.ndarray, seed: int = 7, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of the classifier that sends vectors of length 1 to ``parts`` parts."""
    n, dim = x.shape
    if parts <= 1 or n <= parts:
        return np.zeros((dim, 1), np.float32), np.zeros(1, np.float32)
    rng = np.random.default_rng(seed)
    near = graph(x, EDGES)
    part = balanced_parts(x, near, parts, rng)
    target = np.zeros((n, parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 0.8 / near.shape[1])
    target[np.arange(n), part] += 0.2
    w = [np.zeros((dim, parts), np.float32), np.zeros(parts, np.float32)]
    mean, var = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step, epochs, size = 0, 15, 256
    for epoch in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, size):
            own = order[i : i + size]
            z = SCALE * x[own]
            p = np.exp((s := z @ w[0] + w[1]) - s.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[own]) / len(own)
            step += 1
            for k, d in enumerate((z.T @ g, g.sum(0))):  # Adam
                mean[k] = 0.9 * mean[k] + 0.1 * d
                var[k] = 0.999 * var[k] + 0.001 * d * d
                w[k] -= 0.01 * (1 - epoch / epochs) * mean[k] / (1 - 0.9**step) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return w[0], w[1]


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)


def best(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The similarity of pairs of vectors of length 1, in double precision and to 12 digits, so that equal vectors tie."""
    return np.round(np.einsum("ij,ij->i", x[rows], y[cols]), 12)


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key, vec (binary, float32, as given) of the vectors with ``dim`` finite values that aren't all zero; one row a key."""
    v = F.col("v")
    fine = (F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    src = once(vectors.select(vectors[key].alias("key"), vectors[vector].alias("v")).where(v.isNotNull()).where(F.coalesce(fine, F.lit(False))), "key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column(1).flatten(), np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in unit(flat.astype(np.float64)).astype(np.float32)], pa.binary()), pa.array([r.tobytes() for r in flat], pa.binary())], ["key", "same", "vec"])

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(pack, f"key {kind}, same binary, vec binary")


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Router:
    """Which parts hold the neighbours of a vector, and how probably."""

    def __init__(self, top: tuple[np.ndarray, np.ndarray], below: dict[int, tuple[np.ndarray, np.ndarray]], shard: np.ndarray, width: int):
        #: ``below`` has the classifiers of the second level; ``width`` is the number of parts of each, ``shard`` that of each part.
        self.top, self.below, self.shard, self.width = top, below, shard, width

    def route(self, x: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For vectors of length 1: the home part of each; and rows and parts to be searched, most probable first in each row."""
        p = softmax(SCALE * x @ self.top[0] + self.top[1])
        rows, parts, own = _until(p, mass)
        if not self.below:
            return parts[np.searchsorted(rows, np.arange(len(x)))], rows, parts
        r_, c_, p_ = [], [], []
        home = np.zeros(len(x), np.int64)
        first = np.searchsorted(rows, np.arange(len(x)))
        for t in np.unique(parts):
            at = np.flatnonzero(parts == t)
            q = softmax(SCALE * x[rows[at]] @ self.below[t][0] + self.below[t][1]) if t in self.below else np.eye(1, self.width)[[0] * len(at)]
            lead = first[rows[at]] == at
            home[rows[at][lead]] = t * self.width + q[lead].argmax(1)
            r_.append(np.repeat(rows[at], q.shape[1]))
            c_.append(np.tile(t * self.width + np.arange(q.shape[1]), len(at)))
            p_.append((q * own[at][:, None]).ravel())
        r, c, v = np.concatenate(r_), np.concatenate(c_), np.concatenate(p_)
        o = np.lexsort((-v, r))
        r, c, v = r[o], c[o], v[o]
        before = np.cumsum(v) - v
        before -= before[np.searchsorted(r, np.arange(len(x)))][r]
        keep = (before < mass * mass) | (c == home[r])
        return home, r[keep], c[keep]


def _until(p: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the largest entries of each row, until they make up ``mass``."""
    order = np.argsort(-p, axis=1, kind="stable")
    v = np.take_along_axis(p, order, 1)
    rows, cols = np.nonzero(np.cumsum(v, 1) - v < mass)
    return rows, order[rows, cols], v[rows, cols]


def learn(index: DataFrame, n: int, dim: int, part_size: int) -> Router:
    """The router of ``n`` vectors (key, vec), fitted on samples of at most SAMPLE."""
    sample = [r.vec for r in index.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").collect()]
    parts = max(1, -(-n // part_size))
    tops = min(MOST_PARTS, parts)
    if not sample or parts == 1:
        return Router((np.zeros((dim, 1), np.float32), np.zeros(1, np.float32)), {}, np.zeros(1, np.int64), 1)
    x = unit(matrix(sample, dim).astype(np.float64)).astype(np.float32)
    top = fit(x, parts=tops)
    tops = top[0].shape[1]
    width = -(-parts // tops) if parts > MOST_PARTS else 1
    if width == 1:
        # parts whose vectors are close go into one shard
        home = (SCALE * x @ top[0] + top[1]).argmax(1)
        centres = np.stack([x[home == c].mean(0) if (home == c).any() else top[0][:, c] for c in range(tops)])
        centres = unit(centres.astype(np.float64) + 1e-12).astype(np.float32)
        shards = -(-tops // SHARD)
        shard = balanced_parts(centres, graph(centres, EDGES), shards, np.random.default_rng(5)) if shards > 1 else np.zeros(tops, np.int64)
        return Router(top, {}, shard, 1)
    shared = index.sparkSession.sparkContext.broadcast(top)

    def home_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, offset = shared.value
        for b in batches:
            if len(b):
                own = unit(matrix(b.column(1).to_pylist(), dim).astype(np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array((SCALE * own @ w + offset).argmax(1).astype(np.int32))], ["vec", "h", "top"])

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        own = unit(matrix(pdf["vec"].tolist(), dim).astype(np.float64)).astype(np.float32)
        w, offset = fit(own, parts=width)
        return pd.DataFrame({"top": [int(pdf["top"].iloc[0])], "w": [w.astype(np.float32).tobytes()], "b": [offset.astype(np.float32).tobytes()]})

    few = max(EDGES + 1, min(SAMPLE, 64 * width))
    homes = index.select("key", "vec", F.xxhash64("key").alias("h")).mapInArrow(home_of, "vec binary, h bigint, top int")
    homes = homes.withColumn("r", F.row_number().over(Window.partitionBy("top").orderBy("h", "vec"))).where(F.col("r") <= few).drop("r")
    rows = homes.groupBy("top").applyInPandas(second, "top int, w binary, b binary").toArrow().to_pylist()
    below = {r["top"]: (np.frombuffer(r["w"], np.float32).reshape(dim, -1), np.frombuffer(r["b"], np.float32)) for r in rows}
    per = -(-width // (2 * SHARD))  # shards of a part of the first level
    leaf = np.arange(tops * width)
    return Router(top, below, leaf // width * per + leaf % width * per // width, width)


def nearest(vectors: DataFrame, key: str = "chunk_id", vector: str = "embedding", k: int = 5, dim: int = 64, part_size: int = PART, mass: float = MASS) -> DataFrame:
    """key, neighbour, similarity, place: the ``k`` most similar other vectors of every usable vector, by cosine.

    Usable vectors have ``dim`` finite values, not all zero; others neither ask nor answer.  Ties go to the smaller key.
    Rows of one key are taken as copies and count once.  Vectors of equal direction are searched once: as only the k + 1
    smallest keys of a direction can be among anybody's neighbours, those stand for it in the index, and its members share
    the answer.  With fewer than k other vectors there are fewer rows; an empty table gives none.
    """
    kind = vectors.schema[key].dataType.simpleString()
    all_ = cut(usable(spread(vectors), key, vector, dim))
    # the limit of the rank lets each task drop all but k + 1 rows of a direction before the shuffle
    rank = F.row_number().over(Window.partitionBy("same").orderBy("key"))
    index = cut(all_.withColumn("rank", rank).where(F.col("rank") <= k + 1))
    shared = vectors.sparkSession.sparkContext.broadcast(learn(index.select("key", "vec"), index.count(), dim, part_size))
    shard_of = shared.value.shard

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for b in batches:
            if len(b):
                home, rows, parts = router.route(unit(matrix(b.column(1).to_pylist(), dim).astype(np.float64)).astype(np.float32), mass)
                ends = np.searchsorted(rows, np.arange(len(b) + 1))
                parts = parts.astype(np.int32)
                asks = [parts[ends[i] : ends[i + 1]].tobytes() for i in range(len(b))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(router.shard[home].astype(np.int32)), pa.array(asks, pa.binary())], ["key", "vec", "h", "part", "shard", "asks"])

    routed = cut(index.select("key", "vec", F.xxhash64("key").alias("h")).mapInArrow(route, f"key {kind}, vec binary, h bigint, part int, shard int, asks binary"))

    def demand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = np.zeros(shard_of.max() + 1, np.int64), np.zeros(shard_of.max() + 1, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).to_numpy(), minlength=len(held))
            for a in b.column(1).to_pylist():
                asked[np.unique(shard_of[np.frombuffer(a, np.int32)])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(held), pa.array(asked)], ["shard", "held", "asked"])

    loads = routed.select("shard", "asks").mapInArrow(demand, "shard int, held bigint, asked bigint").groupBy("shard").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).toArrow()
    blocks, turns = np.ones(len(shard_of), np.int64), np.ones(len(shard_of), np.int64)
    blocks[loads.column("shard").to_numpy()] = np.maximum(1, -(-loads.column("held").to_numpy() // INDEX_BLOCK))
    turns[loads.column("shard").to_numpy()] = np.maximum(1, -(-loads.column("asked").to_numpy() // QUERY_BLOCK))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(2).to_numpy() % blocks[b.column(4).to_numpy()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block.astype(np.int32))], [*b.schema.names, "block"])

    home = routed.mapInArrow(settle, f"key {kind}, vec binary, h bigint, part int, shard int, asks binary, block int")
    schema = f"key {kind}, vec binary, h bigint, part int, asks binary, bound double, keys array<{kind}>, scores array<double>"

    def top(keys: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.lexsort((keys, -scores))[:k]

    def within(keys: np.ndarray, x: np.ndarray) -> tuple[list, list, list]:
        """Bound, keys and scores of each of the vectors of a part among themselves."""
        y = x.astype(np.float32)
        bound, names, scores = [], [], []
        m = min(k + 3, len(x) - 1)
        for i in range(0, len(x), 512):
            s = y[i : i + 512] @ y.T
            r = np.arange(len(s))
            s[r, i + r] = -2
            if m < 1:
                for _ in r:
                    bound.append(-2.0), names.append([]), scores.append([])
                continue
            kth = np.partition(s, len(x) - min(k, m), axis=1)[:, len(x) - min(k, m)]
            rows, cols = np.nonzero(s >= kth[:, None] - 1e-6)
            exact = best(x, x, i + rows, cols)
            ends = np.searchsorted(rows, np.arange(len(s) + 1))
            for q in r.tolist():
                a, b = ends[q], ends[q + 1]
                o = a + top(keys[cols[a:b]], exact[a:b])
                names.append(keys[cols[o]].tolist())
                scores.append(exact[o].tolist())
                bound.append(float(exact[o[-1]]) if len(o) == k else -2.0)
        return bound, names, scores

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, p in pdf.groupby("part", sort=False):
            bound, names, scores = within(p["key"].to_numpy(), unit(matrix(p["vec"].tolist(), dim).astype(np.float64)))
            out.append(p[["key", "vec", "h", "part", "asks"]].assign(bound=bound, keys=names, scores=scores))
        return pd.concat(out)

    first = cut(home.groupBy("shard", "block").applyInPandas(lambda key_, pdf: own(pdf), schema))

    def dispatch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each shard and block that a vector asks, with the parts there that it asks; what it met at home is left out."""
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                who, shards, blocks_, turns_, asks = [], [], [], [], []
                for i, (h, own_part, a) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist())):
                    a = np.frombuffer(a, np.int32)
                    of = shard_of[a]
                    for s in np.unique(of).tolist():
                        there = a[of == s]
                        for block in range(blocks[s]):
                            met = s == shard_of[own_part] and block == h % blocks[s]
                            wanted = there[there != own_part] if met else there
                            if len(wanted):
                                who.append(i), shards.append(s), blocks_.append(block), turns_.append(h // 7 % turns[s]), asks.append(wanted.tobytes())
                take = pa.array(who, pa.int64())
                ints = (pa.array(v, pa.int32()) for v in (shards, blocks_, turns_))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(5).take(take), *ints, pa.array(asks, pa.binary())], ["key", "vec", "bound", "shard", "block", "turn", "asks"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = turns[b.column(3).to_numpy()]
            take = pa.array(np.repeat(np.arange(len(b)), n))
            turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(turn.astype(np.int32))], [*b.schema.names, "turn"])

    def others(_: tuple, queries: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, tuple[list, list]] = {}
        if len(queries) and len(pdf):
            asking, low = queries["key"].to_numpy(), queries["bound"].to_numpy()
            asks = [np.frombuffer(a, np.int32) for a in queries["asks"]]
            who, what = np.repeat(np.arange(len(asks)), list(map(len, asks))), np.concatenate(asks)
            x = unit(matrix(queries["vec"].tolist(), dim).astype(np.float64))
            x32 = x.astype(np.float32)
            for part, p in pdf.groupby("part", sort=False):
                mine = who[what == part]
                keys = p["key"].to_numpy()
                y = unit(matrix(p["vec"].tolist(), dim).astype(np.float64))
                y32 = y.astype(np.float32)
                for i in range(0, len(mine), 512):
                    own_ = mine[i : i + 512]
                    rows, cols = np.nonzero(x32[own_] @ y32.T >= low[own_, None] - 1e-6)
                    ok = asking[own_[rows]] != keys[cols]
                    rows, cols = rows[ok], cols[ok]
                    exact = best(x, y, own_[rows], cols)
                    ends = np.searchsorted(rows, np.arange(len(own_) + 1))
                    for q in np.unique(rows).tolist():
                        a, b = ends[q], ends[q + 1]
                        o = a + top(keys[cols[a:b]], exact[a:b])
                        names, scores = out.setdefault(int(own_[q]), ([], []))
                        names += keys[cols[o]].tolist()
                        scores += exact[o].tolist()
            done = []
            for q, (names, scores) in out.items():
                o = top(np.array(names), np.array(scores)) if len(names) > k else range(len(names))
                done.append((asking[q], [names[j] for j in o], [scores[j] for j in o]))
            return pd.DataFrame(done, columns=["key", "keys", "scores"])
        return pd.DataFrame([], columns=["key", "keys", "scores"])

    asks = first.select("key", "vec", "h", "part", "asks", "bound").mapInArrow(dispatch, f"key {kind}, vec binary, bound double, shard int, block int, turn int, asks binary")
    held = home.select("key", "vec", "part", "shard", "block").mapInArrow(hold, f"key {kind}, vec binary, part int, shard int, block int, turn int")
    more = asks.groupBy("shard", "block", "turn").cogroup(held.groupBy("shard", "block", "turn")).applyInPandas(others, f"key {kind}, keys array<{kind}>, scores array<double>")
    cand = first.select("key", "keys", "scores").unionByName(more).select("key", F.explode(F.arrays_zip("keys", "scores")).alias("c")).select("key", F.col("c.keys").alias("neighbour"), F.col("c.scores").alias("similarity"))
    order = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    found = cand.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    # members of a direction beyond the first k + 1: the answer is that of all its members but the asker
    full = index.where(F.col("rank") == k + 1).select("same")
    late = all_.select("key", "same").join(full, "same", "left_semi").join(index.select("key"), "key", "left_anti")
    lead = index.where(F.col("rank") <= k).join(full, "same", "left_semi").select("same", F.col("key").alias("neighbour"), F.col("rank").alias("place"))
    late = late.join(lead, "same").select("key", "neighbour", F.lit(1.0).alias("similarity"), "place")
    out = found.select("key", "neighbour", "similarity", "place").unionByName(late)
    return out.withColumnRenamed("key", key)


def neighbour_pairs(found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The distinct pairs of which one is a neighbour of the other, the smaller key first."""
    return found.select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b")).distinct()
