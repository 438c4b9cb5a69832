"""Filters, projections and joins over documents, chunks and pairs (FLT, PRJ, JN, TK, set operations).

Joins leave the choice of strategy to Catalyst and its adaptive plans: nothing is broadcast by hint, so sides that
fit are broadcast by their measured size and all others are shuffled, with skewed partitions split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- filters --------------------------------------------------------------------------------------------------------
def search_documents(docs: DataFrame, content_type: str | None = None, author: str | None = None, since: str | None = None, until: str | None = None, text: str | None = None) -> DataFrame:
    """FLT-03: all given predicates hold; none given is all rows.  % and _ in author and text are wildcards; nulls never match."""
    out = docs
    if content_type is not None:
        out = out.where(F.array_contains("content_type", content_type))
    if author is not None:
        out = out.where(F.col("author").like(f"%{author}%"))
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out.where(F.col("created_at") <= F.lit(until).cast("timestamp_ntz"))
    if text is not None:
        out = out.where(F.col("text_content").like(f"%{text}%"))
    return out.select("doc_id", "file_name", "file_extension", "content_type", "created_at", "author")


def metadata_equals(df: DataFrame, raw: str, wanted: Mapping[str, str]) -> DataFrame:
    """FLT-04, FLT-05: every key of ``wanted`` stands in the JSON and is equal; a missing key or null doesn't match."""
    for k, v in wanted.items():
        df = df.where(F.get_json_object(raw, f"$.{k}") == v)
    return df


def extension_of(path: Column) -> Column:
    """The extension in lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def supported(df: DataFrame, path: str, extensions: Sequence[str], size: str, most: int) -> DataFrame:
    """FLT-06, FLT-07: adds error, null where the extension is known and the size within ``most`` bytes."""
    known = extension_of(F.col(path)).isin(*extensions)
    return df.withColumn("error", F.when(~F.coalesce(known, F.lit(False)), F.lit("unsupported")).when(F.col(size) > most, F.lit("too_large")))


def with_fallback(df: DataFrame, seconds: Column, confidence: Column, most: float = 30.0, least: float = 0.5) -> DataFrame:
    """FLT-11, RT-09: results that took too long or are too unsure become fallback results of confidence .5, counted as successes."""
    bad = F.coalesce(seconds > most, F.lit(False)) | F.coalesce(confidence < least, F.lit(True))
    return df.withColumns({"used_fallback": bad, "final_confidence": F.when(bad, 0.5).otherwise(confidence)})


# --- joins ----------------------------------------------------------------------------------------------------------
def with_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """FLT-01, JN-01: documents with their chunks nested in order of their ids; an empty list without chunks."""
    listed = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "text_chunk", "tag_context"))).alias("chunks"))
    none = F.array().cast(listed.schema["chunks"].dataType)
    return docs.join(listed, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", none))


def pair_by_stem(files: DataFrame, group: str, name: str, ignore_case: bool = False) -> DataFrame:
    """JN-02, JN-03: content files with the info file of their stem (first by name); without one, null; orphan info files drop."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]+$", "")
    stem = F.lower(stem) if ignore_case else stem
    info = F.lower(F.col(name)).rlike(r"-info\.[^.]+$")
    left = files.where(~info).select(group, F.col(name).alias("content_name"), stem.alias("stem"))
    right = files.where(info).select(group, F.regexp_replace(stem, r"(?i)-info$", "").alias("stem"), name).groupBy(group, "stem").agg(F.min(name).alias("info_name"))
    return left.join(right, [group, "stem"], "left").select(group, "content_name", "info_name")


def enrich_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """JN-04, PRJ-01: chunks with attributes of their document, and the number of the first slide tag."""
    slide = F.try_element_at(F.filter("tag_context", lambda t: t.startswith("slide_")), F.lit(1))
    return chunks.join(docs.select("doc_id", "file_name", "file_extension", "content_type"), "doc_id").withColumn("slide_number", F.substring(slide, 7, 10).try_cast("int"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """TK: the first ``k`` rows; the last order keys make it total."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def expand(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """JN-08: node and hops of all nodes within ``depth`` steps of each seed over undirected edges (src, dst), by the shortest way.

    Each step joins only the nodes that the step before reached first, and takes nodes already reached out again.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    last = reached
    for step in range(1, depth + 1):
        new = last.join(both, last["node"] == both["src"]).select("seed", F.col("dst").alias("node")).distinct()
        last = new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(step))
        reached = reached.unionByName(last)
    return reached
