"""Deterministic text vectors and cosine search (VEC-01 to VEC-03, JN-13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.tables import cut

#: Queries compared with the collection at a time: every task gets no more than these.
MOST_QUERIES = 1000


def text_vector(text: Column) -> Column:
    """VEC-01: the 16 bytes of the MD5 digest as shares of 255, four times over: 64 numbers; the same text, the same vector."""
    digest = F.md5(F.encode(F.coalesce(text, F.lit("")), "utf-8"))
    # bound by a lambda of its own, so that the text is digested once and not for each number
    shares = F.transform(F.array(digest), lambda d: F.transform(F.sequence(F.lit(1), F.lit(31), F.lit(2)), lambda i: F.conv(F.substr(d, i, F.lit(2)), 16, 10).cast("double") / 255))
    return F.flatten(F.array_repeat(F.element_at(shares, 1), 4))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """VEC-02: cosine; 0 where a vector has no length, null where lengths differ or a side is null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).otherwise(0.0))


def _rows(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``length`` numbers, none of them null, and their vectors in double precision."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == length)
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(len(at), length)
    if flat.null_count:
        full = ~np.asarray(flat.is_null()).reshape(len(at), length).any(1)
        at, x = at[full], x[full]
    return at, x


def search(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """VEC-03, TK-01: query_id, ``key``, similarity and rank of the ``k`` most similar rows of each query, with the columns ``keep``.

    ``queries`` has query_id and query_vector and is checked to have at most MOST_QUERIES rows, so that sending it to all
    tasks has a bound; each batch of the index is one product of matrices, of which the best rows per query are shuffled.
    Vectors of another length than the query's, and null ones, are no answer; a vector without length has a similarity of 0.
    Ties go to the smaller key.
    """
    asked = queries.select("query_id", "query_vector").limit(MOST_QUERIES + 1).toArrow()
    if asked.num_rows > MOST_QUERIES:
        raise ValueError(f"over {MOST_QUERIES} queries: search them in several calls")
    ids, vectors = asked.column("query_id"), asked.column("query_vector").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.chunk(0) if vectors.num_chunks else pa.array([], vectors.type)
    lengths = sorted({n for n in pc.list_value_length(vectors).to_pylist() if n})
    groups = []
    for n in lengths:
        at, x = _rows(vectors, n)
        norm = np.sqrt((x * x).sum(1))
        groups.append((n, at, np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)))
    shared = index.sparkSession.sparkContext.broadcast((ids.combine_chunks(), groups))
    src = index.select(vector, key, *keep)
    names = ["query_id", key, *keep, "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = shared.value
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                b = batch.slice(first, 2048)
                for n, which, q in groups:
                    at, x = _rows(b.column(0), n)
                    if not len(at):
                        continue
                    norm = np.sqrt((x * x).sum(1))
                    s = np.round(np.divide(x @ q.T, norm[:, None], out=np.zeros((len(x), len(q))), where=norm[:, None] > 0), 9)
                    low = np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.full(len(q), -np.inf)
                    rows, cols = np.nonzero(~(s < low))
                    take = pa.array(at[rows])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(which[cols])), *(c.take(take) for c in b.columns[1:]), pa.array(s[rows, cols])], names)

    types = {f.name: f.dataType.simpleString() for f in [*src.schema, *queries.select("query_id").schema]}
    scored = src.mapInArrow(run, ", ".join([*(f"`{n}` {types[n]}" for n in names[:-1]), "similarity double"]))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_all(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """``search`` for any number of queries, in blocks of MOST_QUERIES at most.

    Blocks are numbered within the partitions of the queries, which are written first so that the numbers stay; of more
    than one block, each block's rows are written before the next is searched.
    """
    if queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        return search(index, queries, key, vector, k, keep)
    return reduce(DataFrame.unionByName, (cut(search(index, q, key, vector, k, keep)) for q in blocks(queries.select("query_id", "query_vector"))))


def blocks(queries: DataFrame) -> list[DataFrame]:
    """``queries`` in blocks of at most MOST_QUERIES rows; a block may be sent to every task."""
    if queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        return [queries]
    wide = cut(queries)
    few = cut(wide.coalesce(max(1, min(wide.rdd.getNumPartitions(), wide.count() // MOST_QUERIES))).withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    few = few.withColumns({"part_": part, "block_": F.floor(row / MOST_QUERIES)})
    names = sorted((r["part_"], r["block_"]) for r in few.select("part_", "block_").distinct().collect())
    return [few.where((F.col("part_") == p) & (F.col("block_") == b)).select(*queries.columns) for p, b in names]


def mean_similarity(index: DataFrame, queries: DataFrame, by: str, vector: str) -> DataFrame:
    """AG-17: query_id, ``by``, avg_similarity and hits: the mean cosine of a group's vectors with each query's, by blocks of queries."""
    one = lambda q: index.join(F.broadcast(q)).groupBy("query_id", by).agg(F.round(F.avg(cosine(F.col(vector), F.col("query_vector"))), 6).alias("avg_similarity"), F.count("*").alias("hits"))
    return reduce(DataFrame.unionByName, map(one, blocks(queries.select("query_id", "query_vector"))))


def embed(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], vector: str = "embedding") -> DataFrame:
    """VEC-05: ``df`` with the vectors that ``model`` gives for batches of texts; null texts have none.  The model is sent to the tasks once."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            found = model([texts[i] for i in at]) if at else []
            out: list = [None] * len(texts)
            for i, v in zip(at, found):
                out[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], [*b.schema.names, vector])

    return df.mapInArrow(run, f"{kinds}, `{vector}` array<float>")
