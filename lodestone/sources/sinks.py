"""Tables and files that results are written to (SNK-01 to SNK-20).

A keyed table is a Parquet folder partitioned into buckets of its key's hash.  Changing rows rewrites only the buckets of
the changed keys: what stays is written to the checkpoint folder first and then replaces them by dynamic partition overwrite,
so a failing job leaves whole files behind and can be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import cut


class KeyedTable:
    """A table with one row a key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return bool(fs.exists(p)) and any(s.getPath().getName().startswith("_bucket=") for s in fs.listStatus(p))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("_bucket")

    def create(self, schema: str) -> None:
        """SNK-01: an empty table if there is none yet."""
        if not self.exists():
            self.spark.createDataFrame([], schema).withColumn("_bucket", F.lit(0)).write.mode("ignore").parquet(f"{self.path}/_bucket=0")

    def _replace(self, df: DataFrame) -> None:
        self._bucketed(df).repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in self._bucketed(keys).select("_bucket").distinct().collect()]  # at most as many as there are buckets

    def append(self, df: DataFrame) -> None:
        """SNK-02, SNK-05: rows are added as they are."""
        self._bucketed(df).write.mode("append").partitionBy("_bucket").parquet(self.path)

    def upsert(self, df: DataFrame) -> None:
        """SNK-03, SNK-06, SNK-07, SNK-10: rows of a known key are replaced, others added; of one key twice in ``df`` any one row stays."""
        new = cut(df.dropDuplicates(self.keys))
        if not self.exists():
            self._replace(new)
            return
        touched = self._touched(new)
        if touched:
            old = self.spark.read.parquet(self.path).where(F.col("_bucket").isin(touched)).drop("_bucket")
            kept = old.join(new.select(*self.keys), self.keys, "left_anti")
            self._replace(cut(kept.unionByName(new, allowMissingColumns=True)))

    def replace_groups(self, df: DataFrame, by: str) -> None:
        """SNK-04, STR-07: all rows of the groups in ``df`` are replaced by those of ``df``; the table's key must begin with ``by``."""
        if self.keys[0] != by or len(self.keys) != 1:
            raise ValueError("a table whose groups are replaced is bucketed by the group alone")
        new = cut(df)
        if not self.exists():
            self._replace(new)
            return
        touched = self._touched(new)
        if touched:
            old = self.spark.read.parquet(self.path).where(F.col("_bucket").isin(touched)).drop("_bucket")
            self._replace(cut(old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)))

    def delete(self, keys: DataFrame) -> None:
        """SNK-08: rows of the given keys go; a bucket that loses its last row stays as an empty file."""
        gone = cut(keys.select(*self.keys).distinct())
        touched = self._touched(gone)
        if not touched:
            return
        old = self.spark.read.parquet(self.path).where(F.col("_bucket").isin(touched)).drop("_bucket")
        kept = cut(old.join(gone, self.keys, "left_anti"))
        left = set(self._touched(kept))
        self._replace(kept)
        for b in touched:
            if b not in left:
                self.spark.createDataFrame([], kept.schema).write.mode("overwrite").parquet(f"{self.path}/_bucket={b}")


def log_events(spark: SparkSession, path: str, docs: DataFrame, event_type: str) -> None:
    """SNK-05: one event a document, appended; the id is a hash, so the same event twice has one id."""
    e = docs.select(
        F.sha2(F.concat_ws("|", F.col("doc_id"), F.lit(event_type), F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")), 256).alias("event_id"), "doc_id",
        F.lit(event_type).alias("event_type"), F.current_timestamp().alias("event_timestamp"), F.to_json(F.struct(F.lit("ok").alias("status"))).alias("event_data"),
    )
    e.write.mode("append").parquet(path)


def save_results(df: DataFrame, path: str, *by: str, format: str = "json") -> None:
    """SNK-14 to SNK-17, SNK-20: files in folders by the given columns."""
    df.write.mode("overwrite").partitionBy(*by).format(format).save(path)


def save_by_outcome(df: DataFrame, path: str, category: str, ok: str) -> None:
    """SNK-15: by category, failures apart."""
    save_results(df.withColumn("status", F.when(F.col(ok), "ok").otherwise("failed")), path, category, "status")


def store_everywhere(docs: DataFrame, chunks: DataFrame, edges: DataFrame, root: str, spark: SparkSession) -> dict[str, int]:
    """SNK-12, SNK-13, AG-34: documents, chunks and edges into their tables; gives how many of each were written."""
    docs, chunks, edges = cut(docs), cut(chunks), cut(edges)
    KeyedTable(spark, f"{root}/documents", ["doc_id"]).upsert(docs)
    KeyedTable(spark, f"{root}/chunks", ["doc_id"]).replace_groups(chunks, "doc_id")
    KeyedTable(spark, f"{root}/edges", ["src_label", "src", "type", "dst_label", "dst"]).upsert(edges)
    return {"documents": docs.count(), "chunks": chunks.count(), "relationships": edges.count()}


def merge_maps(old: str, new: str):
    """SNK-19, PRJ-02: two maps as one; where both have a key the new value counts."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, F.col(new))


def log_query(path: str, hits: DataFrame, question: str) -> None:
    """SNK-18, AG-17: one row for a search: how many hits, their documents in order, and their mean similarity (0 without hits)."""
    docs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]), ",")
    row = hits.agg(F.lit(question).alias("query_text"), F.count("*").alias("result_count"), docs.alias("result_docs"), F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 6).alias("avg_similarity"))
    row.withColumn("query_time", F.current_timestamp()).write.mode("append").parquet(path)
