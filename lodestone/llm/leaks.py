"""Problem 9: evaluation texts in a corpus, by a BM25 index of the test items and block-max WAND.

The terms of the index are runs of three words.  A run of ``run`` words that stands in an item has ``run - 2`` terms of
it, so its BM25 score is at least the lowest that any window of ``run`` words of that item gets.  Each item's weights are
divided by that lowest score: a passage that holds a whole run scores 1 or more, and WAND with the threshold 1 loses none.
Every text is cut into passages of ``PASSAGE`` words that overlap by ``run - 1``, so each run lies whole in one passage.
Passages without a run whose terms' upper bounds together reach 1 have no pivot and are dropped for a whole batch at
once; the others are searched one by one.  What is retrieved is then verified word by word against question and answer.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import parts_of
from lodestone.llm.words import grams, hashed_words
from lodestone.tables import spread

TERM = 3
PASSAGE = 64
BLOCK = 32
K1, B = 1.2, 0.75
#: Test items of one index; more items are searched in several passes, so what is sent to the tasks has a bound.
ITEMS = 20_000


class Index:
    """Postings of each term, by item, in blocks with their highest weight."""

    def __init__(self, items: list[tuple[int, str, str | None]], run: int):
        self.run = run
        texts = [t for _, t, _ in items]
        h, bounds = hashed_words(texts)
        self.ids, self.answers = [i for i, _, _ in items], [a for _, _, a in items]
        self.words = [h[a:b] for a, b in pairwise(bounds.tolist())]
        terms = [grams(w, TERM).tolist() for w in self.words]
        df = Counter(t for own in terms for t in set(own))
        n, mean = len(items), sum(map(len, terms)) / max(1, len(items))
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for d, own in enumerate(terms):
            if len(own) < run - TERM + 1:
                continue
            weight = {}
            for t, tf in Counter(own).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                weight[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))
            width = run - TERM + 1
            least = min(sum(weight[t] for t in set(own[i : i + width])) for i in range(len(own) - width + 1))
            for t, w in weight.items():
                postings[t].append((d, w / least + 1e-9))
        self.items = {t: [d for d, _ in p] for t, p in postings.items()}
        self.weights = {t: [w for _, w in p] for t, p in postings.items()}
        self.blocks = {t: [max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for t, w in self.weights.items()}
        order = sorted(postings)
        self.terms = np.array(order, np.uint64)
        self.bounds = np.array([max(self.weights[t]) for t in order], np.float64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms >> np.uint64(44)).astype(np.int64)] = True
        self.runs = {d: set(grams(w, run).tolist()) for d, w in enumerate(self.words)}

    def upper(self, g: np.ndarray) -> np.ndarray:
        """The highest weight of each term in ``g``, 0 where the index doesn't have it."""
        u = np.zeros(len(g))
        near = np.flatnonzero(self.filter[(g >> np.uint64(44)).astype(np.int64)])
        if len(near) and len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, g[near]), len(self.terms) - 1)
            hit = self.terms[at] == g[near]
            u[near[hit]] = self.bounds[at[hit]]
        return u

    def search(self, terms: list[int]) -> list[int]:
        """The items whose score for a passage with these (distinct) terms is 1 or more: block-max WAND."""
        lists = [[self.items[t], self.weights[t], self.blocks[t], 0, max(self.blocks[t])] for t in terms]
        found = []
        while True:
            lists = [x for x in lists if x[3] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[3]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[4]
                if total >= 1:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0][lists[pivot][3]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][3]] == item:
                pivot += 1
            here = lists[: pivot + 1]
            block, upto = 0.0, None
            for x in here:
                at = bisect_left(x[0], item, x[3])
                if at < len(x[0]):
                    k = at // BLOCK
                    block += x[2][k]
                    last = x[0][min(len(x[0]), (k + 1) * BLOCK) - 1]
                    upto = last if upto is None else min(upto, last)
            if block < 1:  # no item up to the nearest end of a block can reach 1
                step = max(item, upto if upto is not None else item) + 1
                if pivot + 1 < len(lists):
                    step = max(item + 1, min(step, lists[pivot + 1][0][lists[pivot + 1][3]]))
                for x in here:
                    x[3] = bisect_left(x[0], step, x[3])
                continue
            score = 0.0
            for x in here:
                x[3] = at = bisect_left(x[0], item, x[3])
                if at < len(x[0]) and x[0][at] == item:
                    score += x[1][at]
                    x[3] += 1
            if score >= 1:
                found.append(item)

    def longest(self, h: np.ndarray, item: int) -> int:
        """The most consecutive words of ``h`` that also stand consecutively in the item."""
        where = defaultdict(list)
        for i, w in enumerate(self.words[item].tolist()):
            where[w].append(i)
        best, last = 0, {}
        for w in h.tolist():
            last = {i: last.get(i - 1, 0) + 1 for i in where.get(w, ())}
            best = max(best, *last.values()) if last else best
        return best

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """Of each text and item that share a run: the text's number, the item's number, and the longest run."""
        h, bounds = hashed_words(texts)
        g = grams(h, TERM)
        sums = np.concatenate(([0.0], np.cumsum(u := self.upper(g))))
        size = np.diff(bounds)
        long = np.flatnonzero(size >= self.run)
        step = PASSAGE - self.run + 1
        count = np.maximum(1, -(-(size[long] - self.run + 1) // step))
        text = np.repeat(long, count)
        start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
        end = np.minimum(start + PASSAGE, bounds[text + 1])
        width = self.run - TERM + 1
        able = np.concatenate(([0], np.cumsum(sums[width:] - sums[:-width] >= 1 - 1e-6))) if len(g) >= width else np.zeros(1, np.int64)
        pivots = able[np.clip(end - self.run + 1, 0, len(able) - 1)] - able[np.minimum(start, len(able) - 1)]
        seen = set()
        for k in np.flatnonzero(pivots > 0).tolist():
            a, b, t = int(start[k]), int(end[k]), int(text[k])
            own = g[a : b - TERM + 1][u[a : b - TERM + 1] > 0]
            for item in self.search(list(dict.fromkeys(own.tolist()))):
                if (t, item) not in seen and not self.runs[item].isdisjoint(grams(h[a:b], self.run).tolist()):
                    seen.add((t, item))
                    yield t, item, self.longest(h[bounds[t] : bounds[t + 1]], item)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", run: int = 12) -> DataFrame:
    """doc_id, item_id, run_words, item_part and answer_found for each document and test item with ``run`` words in a row in common.

    ``items`` has item_id, text and answer.  item_part is the longest run against the item's words; answer_found says
    whether the answer's words stand in the document in a row (null without an answer).  Null, empty and shorter texts of
    either side match nothing; items of equal text are all reported; rows of one key are taken as copies.
    """
    src = docs.select(docs[key], docs[text]).where(F.col(text).isNotNull())
    kind = src.schema[0].dataType.simpleString()
    listed = items.select("item_id", "text", "answer").where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    passes = max(1, -(-listed.count() // ITEMS))
    out = None
    for n in range(passes):
        part = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n)
        rows = sorted(tuple(r) for r in part.collect())
        index = docs.sparkSession.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = Index(index.value, run)
            for b in batches:
                keys, ids, runs, parts, found = [], [], [], [], []
                for first, texts in parts_of(b.column(1), 1_000_000):
                    for t, d, longest in own.leaks(texts):
                        keys.append(b.column(0)[first + t].as_py())
                        ids.append(own.ids[d])
                        runs.append(longest)
                        parts.append(round(longest / len(own.words[d]), 4))
                        answer = hashed_words([own.answers[d]])[0]
                        h = hashed_words([texts[t]])[0]
                        found.append(bool(np.isin(grams(answer, len(answer)), grams(h, len(answer)))[0]) if len(answer) else None)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(ids, pa.int64()), pa.array(runs, pa.int32()), pa.array(parts, pa.float64()), pa.array(found, pa.bool_())], [key, "item_id", "run_words", "item_part", "answer_found"])

        got = spread(src).mapInArrow(scan, f"`{key}` {kind}, item_id bigint, run_words int, item_part double, answer_found boolean")
        out = got if out is None else out.unionByName(got)
    return out.dropDuplicates([key, "item_id"])
