"""Queries through sources, sinks and streams."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources import archives as Z
from lodestone.sources import formats, sinks
from lodestone.streaming import streams
from lodestone.tables import checkpoint_dir, load, once


def _docs(spark, folder):
    return once(load(spark, folder, "store_documents"), "doc_id")


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text as an archive with a text file and an archive within that holds an information sheet."""
    for pdf in batches:
        out = []
        for doc, text in zip(pdf["doc_id"], pdf["text_content"]):
            inner, outer = io.BytesIO(), io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr(f"{doc}-info.txt", f"ID: {doc}")
            with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"{doc}.txt", text or "")
                z.writestr("more.zip", inner.getvalue())
            out.append((doc, outer.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@query("select doc_id as path, doc_id || '.txt' as member, length(coalesce(text_content, ''))::bigint as n, 'text_utf-8' as method from {docs} union all select doc_id, 'more.zip/' || doc_id || '-info.txt', length(doc_id) + 4, 'text_utf-8' from {docs}")
def src09_unzip_and_extract(spark, folder):
    zips = _docs(spark, folder).select("doc_id", "text_content").mapInPandas(_zipped, "path string, content binary")
    x = formats.extract(Z.content_members(Z.unzip(zips, depth=1)))
    return x.select("path", "member", F.length("text").cast("bigint").alias("n"), "method")


@query("select doc_id as path, 2::bigint as members, 0::bigint as pdfs, 0::bigint as zips, 2::bigint as others from {docs}")
def src41_inspect_archives(spark, folder):
    zips = _docs(spark, folder).select("doc_id", "text_content").mapInPandas(_zipped, "path string, content binary")
    return Z.inspect_members(Z.unzip(zips, depth=3)).drop("bytes")


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/out-{uuid.uuid4().hex}"


@query("select document_id, lower(trim(coalesce(category, 'none'))) as category, case when coalesce(overall_success, false) then 'ok' else 'failed' end as status, coalesce(length(content_file.extracted_text), 0)::bigint as n from {pairs}")
def snk15_results_by_outcome(spark, folder):
    p = once(load(spark, folder, "pair_records"), "document_id")
    p = p.select("document_id", F.lower(F.trim(F.coalesce("category", F.lit("none")))).alias("category"), F.coalesce("overall_success", F.lit(False)).alias("ok"), F.coalesce(F.length("content_file.extracted_text"), F.lit(0)).cast("bigint").alias("n"))
    path = _scratch(spark)
    sinks.save_by_outcome(p, path, "category", "ok")
    return spark.read.schema("document_id string, n bigint, category string, status string").json(path)


@query("select doc_id, case when doc_id < '8' then 'new' else 'old' end as version from {docs} where doc_id < 'e'")
def snk03_upsert_and_delete(spark, folder):
    d = _docs(spark, folder).select("doc_id", F.lit("old").alias("version"))
    t = sinks.KeyedTable(spark, _scratch(spark), ["doc_id"], buckets=16)
    t.upsert(d)
    t.upsert(d.where("doc_id < '8'").withColumn("version", F.lit("new")))
    t.delete(d.where("doc_id >= 'e'"))
    return t.read()


@query("select doc_id, count(*) as n from {chunks} where doc_id is not null group by doc_id")
def snk04_replace_chunks(spark, folder):
    c = once(load(spark, folder, "chunks"), "chunk_id").where("doc_id is not null").select("doc_id", "chunk_id", "text_chunk")
    t = sinks.KeyedTable(spark, _scratch(spark), ["doc_id"], buckets=16)
    t.replace_groups(c.unionByName(c.withColumn("chunk_id", F.concat("chunk_id", F.lit("x")))), "doc_id")
    t.replace_groups(c, "doc_id")
    return t.read().groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as from_time, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def str03_tumbling_counts(spark, folder):
    e = streams.read_events(spark, folder)
    out = streams.run_available(streams.tumbling_counts(e, "ts", "event_type", "value"), "complete")
    return out.withColumn("from_time", F.date_format("from_time", "yyyy-MM-dd HH:mm"))


@query("""with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval 6 hours, true) as new from events),
g as (select user_id, ts, sum(new::int) over (partition by user_id order by ts) as k from e), s as (select user_id, min(ts) as from_time, max(ts) + interval 6 hours as to_time, count(*) as n from g group by user_id, k)
select * from s where to_time <= (select max(ts) - interval 1 day from events)""")
def str06_sessions(spark, folder):
    e = streams.read_events(spark, folder)
    return streams.run_available(streams.sessions(e, "ts", "user_id"), "append")


@query("select distinct event_id from pipeline_events where event_id is not null")
def str07_once_each(spark, folder):
    e = streams.read_events(spark, folder, "pipeline_events", "event_timestamp")
    return streams.run_available(streams.once_each(e, "event_timestamp", "event_id").select("event_id"), "append")


@query("select user_id, round(sum(0.1::double * pow(0.9::double, k) * value), 6) as ema, count(*) as n from (select user_id, value, row_number() over (partition by user_id order by ts desc, value desc) - 1 as k from events) group by user_id")
def str04_running_means(spark, folder):
    out = streams.run_available(streams.running_means(streams.read_events(spark, folder), "user_id", "ts", "value"), "update")
    # of each group the state after its last batch
    return out.groupBy("user_id").agg(F.round(F.max_by("ema", "n"), 6).alias("ema"), F.max("n").alias("n"))
