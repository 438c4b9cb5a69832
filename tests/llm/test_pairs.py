import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import leaks, neardups, neighbours, spans

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def shingles(t):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return frozenset(zip(w, w[1:], w[2:]))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    base = [text(rng, 120) for _ in range(25)]
    rows = [(f"{i:03d}", t) for i, t in enumerate(base)]
    for i in range(60):
        rows.append((f"e{i:03d}", edited(rng, base[i % 25], rng.randrange(0, 9))))
    return [*rows, ("c1", base[0]), ("c2", base[0].upper()), ("short", "one two three"), ("null", None), ("empty", "")]


def test_near_duplicates_equal_brute_force(spark, corpus):
    df = spark.createDataFrame([*corpus, corpus[0], corpus[0], (None, corpus[0][1])], "k string, text string").withColumns({"class": F.lit("x"), "key": F.lit(1), "size": F.lit(2)})
    members, links = neardups.near_duplicates(df, "k", "text")
    got = [tuple(r) for r in neardups.similar_pairs(members, links, "k").collect()]
    sets = {k: s for k, t in corpus if len(s := shingles(t)) >= 50}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert len(got) == len(set(got)) and set(got) == want
    groups = neardups.groups(members, links, "k").collect()
    assert {r.k for r in groups} == set(sets)
    n = defaultdict(int)
    for a, b in want:
        n[a] += 1
        n[b] += 1
    assert all(r.n_links == n[r.k] for r in groups)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[find(a)] = find(b)
    by = defaultdict(set)
    for r in groups:
        by[r.group_id].add(find(r.k))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({find(k) for k in sets})


def test_near_duplicates_of_nothing(spark):
    members, links = neardups.near_duplicates(spark.createDataFrame([], "k string, text string"), "k", "text")
    assert neardups.similar_pairs(members, links, "k").count() == 0 and neardups.groups(members, links, "k").count() == 0


def test_near_duplicates_broadcast_no_table(spark, tmp_path):
    spark.createDataFrame([(f"{i:03d}", " ".join(f"w{i // 2}x{j}" for j in range(60 + i % 2))) for i in range(40)], "k string, text string").write.parquet(f"{tmp_path}/t")
    members, links = neardups.near_duplicates(spark.read.parquet(f"{tmp_path}/t"), "k", "text")
    for out in (neardups.similar_pairs(members, links, "k"), neardups.groups(members, links, "k")):
        assert out.count() > 0 and "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r.node: r.root for r in neardups.components(e).collect()}
    assert set(got.values()) == {"000", "x"} and len(got) == 63


def vectors(rng, n, dim=64):
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim))
    return x.astype(np.float32)


def exact(ids, x, k=5):
    x = x.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    out = {}
    for i in range(len(ids)):
        o = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in o]
    return out


def test_neighbours_with_unusable_vectors_and_repeats(spark):
    rng = np.random.default_rng(2)
    x = vectors(rng, 60)
    x[40:52] = x[0] * np.arange(1, 13)[:, None].astype(np.float32) ** 2  # one direction
    ids = [f"c{i:03d}" for i in range(60)]
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x)]
    bad = [("n", None), ("e", []), ("s", [1.0]), ("z", [0.0] * 64), ("i", [float("inf")] * 64), ("q", [float("nan")] * 64), ("h", [None, *[1.0] * 63]), (None, rows[0][1])]
    df = spark.createDataFrame([*rows, rows[0], *bad], "chunk_id string, embedding array<float>").withColumns({"part": F.lit(1), "vec": F.lit("x"), "key": F.lit(0)})
    found = neighbours.nearest(df).collect()
    got = defaultdict(dict)
    for r in found:
        got[r.chunk_id][r.place] = r.neighbour
    want = exact(ids, x)
    for i in ids:
        if i == "c000" or "c040" <= i < "c052":  # rounding decides between equal directions only
            assert {got[i][p] for p in got[i]} <= {"c000", *(f"c{j:03d}" for j in range(40, 52))}
        else:
            assert [got[i][p] for p in sorted(got[i])] == want[i]
    assert set(got) == set(ids)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(str(i), [float(i + 1), *[1.0] * 63]) for i in range(n)]
    assert neighbours.nearest(spark.createDataFrame(rows, "chunk_id string, embedding array<float>")).count() == n * max(0, n - 1)


@pytest.mark.parametrize("most", [512, 4])
def test_recall_with_many_parts(spark, monkeypatch, most):
    """Of a search that leaves out most parts, with one level of parts and with two."""
    monkeypatch.setattr(neighbours, "MOST_PARTS", most)
    x = vectors(np.random.default_rng(3), 4000)
    ids = [f"{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "chunk_id string, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest(df, part_size=100).collect():
        got[r.chunk_id].add(r.neighbour)
    want = exact(ids[:], x)
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in ids[::20]]) >= 0.95
    index = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in zip(ids, x)], "key string, vec binary")
    router = neighbours.learn(index, len(ids), 64, 100)
    _, rows, parts = router.route(neighbours.unit(x.astype(float)).astype(np.float32), neighbours.MASS)
    assert len(np.unique(parts)) >= 30 and len(rows) / len(x) < 0.5 * len(router.shard)


def test_recall_at_the_defaults(spark, folder):
    """More parts than are searched, over the largest table that is there."""
    big = "/root/testdata/check_l/chunks.parquet"
    if not os.path.exists(big):
        pytest.skip("no test tables here")
    df = spark.read.parquet(big)
    got = defaultdict(set)
    for r in neighbours.nearest(df).collect():
        got[r.chunk_id].add(r.neighbour)
    all_ = neighbours.usable(df, "chunk_id", "embedding", 64).collect()
    x = neighbours.unit(np.frombuffer(b"".join(bytes(r.vec) for r in all_), np.float32).reshape(-1, 64).astype(np.float64))
    ids = np.array([r.key for r in all_])
    hits = []
    for i in range(0, len(x), 997):
        s = np.round(x @ x[i], 12)
        s[i] = -2
        fifth = np.sort(s)[-5]
        hits.append(sum(s[j] >= fifth for j in np.flatnonzero(np.isin(ids, list(got[ids[i]])))) / 5)
    assert np.mean(hits) >= 0.97


def test_hot_parts_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 50)
    x = vectors(np.random.default_rng(4), 300)
    ids = [f"{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "chunk_id string, embedding array<float>")
    got = defaultdict(dict)
    for r in neighbours.nearest(df, part_size=100, mass=1.1).collect():
        got[r.chunk_id][r.place] = r.neighbour
    want = exact(ids, x)
    assert all([got[i][p] for p in sorted(got[i])] == want[i] for i in ids)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, text(rng, n), rng.choice([None, "w1 w2", ""])) for i, n in enumerate([30, 12, 11, 25, 40, 12])] + [(90, None, "x"), (91, "", None), (92, items_text := text(rng, 20), None), (93, items_text, "q")]
    docs = []
    for d in range(60):
        w = text(rng, 150).split()
        for _ in range(2):
            src = rng.choice([t for _, t, _ in items if t]).split()
            n = rng.randrange(9, 16)
            a = rng.randrange(0, max(1, len(src) - n + 1))
            at = rng.randrange(len(w))
            w[at:at] = src[a : a + n]
        docs.append((d, " ".join(w).upper() if d % 2 else ", ".join(w)))
    docs += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1])]
    grams = defaultdict(set)
    for i, t, _ in items:
        w = (t or "").split()
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(i)
    want = {(d, i) for d, t in docs if t for w in [re.findall("[a-z0-9]+", t.lower())] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "answer": F.lit("x"), "run_words": F.lit(2)})
    it = spark.createDataFrame(items, "item_id long, text string, answer string").withColumn("doc_id", F.lit(7))
    out = leaks.find_leaks(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want) and len(want) > 20
    assert all(r.run_words >= 12 for r in out)
    assert leaks.find_leaks(df.limit(0), it).count() == 0 and leaks.find_leaks(df, it.limit(0)).count() == 0


def covered(t, other, least=300):
    m = bytearray(len(t))
    have = {other[i : i + least] for i in range(len(other) - least + 1)}
    for i in range(len(t) - least + 1):
        if t[i : i + least] in have:
            m[i : i + least] = b"\x01" * least
    return m


@pytest.mark.parametrize("subtree", [2000, 3])
def test_spans_equal_brute_force(spark, monkeypatch, subtree):
    monkeypatch.setattr(spans, "SUBTREE", subtree)
    rng = random.Random(6)
    parts = ["".join(rng.choice("abé 中") for _ in range(n)) for n in (299, 300, 301, 450, 900)]
    docs = {}
    for d in range(24):
        t = "".join(rng.choice("xyz ") for _ in range(rng.randrange(0, 500)))
        for _ in range(rng.randrange(0, 3)):
            t += rng.choice(parts) + "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 80)))
        docs[d] = t
    docs[50], docs[51], docs[52] = "-" * 800, "-" * 400, parts[1] + parts[1]
    rows = [*docs.items(), (24, None), (25, ""), (0, docs[0]), (None, parts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "span": F.lit(2), "prefix": F.lit(3)})
    sp = spans.shared_spans(df)
    got = {tuple(r) for r in spans.sharing_pairs(sp).collect()}
    keys = sorted(docs)
    have = {k: {docs[k][i : i + 300] for i in range(len(docs[k]) - 299)} for k in keys}
    want = {(a, b) for a in keys for b in keys if a < b and not have[a].isdisjoint(have[b])}
    assert got == want and len(want) > 10
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(df, sp).collect()}
    for k in keys:
        m = bytearray(len(docs[k]))
        for o in keys:
            if o != k:
                m = bytearray(x | y for x, y in zip(m, covered(docs[k], docs[o])))
        assert share.get(k, 0) == sum(m), k


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.sharing_pairs(spans.shared_spans(df)).count() == 0
