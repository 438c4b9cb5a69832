"""Further queries: pages, projections of pairs, counters, hooks and user-defined aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions.text import mail_date, strip
from lodestone.operators import aggregates as A
from lodestone.operators import classify as C
from lodestone.operators import graph as G
from lodestone.operators import relational as R
from lodestone.operators import windows as W
from lodestone.plans import sqltext as S
from lodestone.plans.registry import query
from lodestone.plans.text_queries import MAIL
from lodestone.sources import formats
from lodestone.sources import pages as P
from lodestone.tables import load, once

_PAGES = "(select doc_id, unnest(string_split(coalesce(text_content, ''), chr(12))) as text, generate_subscripts(string_split(coalesce(text_content, ''), chr(12)), 1) as page, coalesce(structured_content.visual_element_count, 0) as visuals, vlm_confidence, coalesce(success, false) as ok from {vlm})"
_BLANK = f"length({S.strip('text')}) = 0"


def _vlm(spark, folder):
    return once(load(spark, folder, "vlm_results"), "doc_id")


def _pages(spark, folder):
    v = _vlm(spark, folder)
    p = v.select("doc_id", F.posexplode(F.split(F.coalesce("text_content", F.lit("")), "\f")).alias("page", "text"), F.coalesce("structured_content.visual_element_count", F.lit(0)).alias("visuals"), "vlm_confidence", F.coalesce("success", F.lit(False)).alias("ok"))
    return p.withColumn("page", F.col("page") + 1)


def _pairs(spark, folder):
    return once(load(spark, folder, "pair_records"), "document_id")


def _docs(spark, folder):
    return once(load(spark, folder, "store_documents"), "doc_id")


@query(f"select doc_id, page::bigint as page from {_PAGES} where ok")
def flt09_success_pages(spark, folder):
    return _pages(spark, folder).where("ok").select("doc_id", F.col("page").cast("bigint").alias("page"))


@query(f"select doc_id, page::bigint as page, length(text)::bigint as n from {_PAGES} where page <= 3")
def flt15_first_pages(spark, folder):
    return P.first_pages(_pages(spark, folder), "page", 3).select("doc_id", F.col("page").cast("bigint").alias("page"), F.length("text").cast("bigint").alias("n"))


@query("select distinct doc_id from {docs} where content_type is not null and len(content_type) > 0")
def gr_edges_of_types(spark, folder):
    d = _docs(spark, folder)
    e = G.document_edges(d, W.topics(d, "doc_id", "text_content")).where("dst_label <> 'Topic'")
    return e.where("type = 'HAS_TYPE'").select(F.col("src").alias("doc_id")).distinct()


@query(f"""select doc_id, count(*) as pages, md5(coalesce(string_agg(case when not {_BLANK} then '=== Page ' || page || ' ===' || chr(10) || text end, chr(10) || chr(10) order by page), '')) as text_md5 from {_PAGES} group by doc_id""")
def src18_joined_pages(spark, folder):
    return P.joined_pages(_pages(spark, folder), "doc_id", "page", "text").select("doc_id", "pages", F.md5("text").alias("text_md5"))


@query(f"""select doc_id, md5(coalesce(string_agg(case when not {_BLANK} then text end, chr(10) || chr(10) order by page), '')) as text_md5 from {_PAGES} group by doc_id""")
def src17_pages_by_blank_lines(spark, folder):
    return P.joined_pages(_pages(spark, folder), "doc_id", "page", "text", mark=None).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"""select document_id, md5(case when length({S.strip("c")}) < 100 and length({S.strip("m")}) > 0 then m else c end) as text_md5 from (select document_id, coalesce(content_file.extracted_text, '') as c, coalesce(metadata_file.extracted_text, '') as m from {{pairs}})""")
def src20_recognition_of_short_texts(spark, folder):
    text = P.with_recognition(F.col("content_file.extracted_text"), F.col("metadata_file.extracted_text"), P.SIMPLE_PAGE)
    return _pairs(spark, folder).select("document_id", F.md5(text).alias("text_md5"))


@query("select doc_id, contains(text_content, '<') and contains(text_content, '>') as has_tags from {docs} where text_content is not null")
def src34_markup(spark, folder):
    m = formats.extract(_docs(spark, folder).where("text_content is not null").select("doc_id", F.lit("x.html").alias("member"), F.encode("text_content", "utf-8").alias("data")))
    return m.select("doc_id", (F.col("method") == "markup_tags").alias("has_tags"))


@query(f"select doc_id, coalesce(sum(length(text)), 0)::bigint as chars, sum(visuals)::bigint as visuals, count(*) as pages from {_PAGES} where page <= 3 group by doc_id")
def ag28_page_features(spark, folder):
    return P.page_features(_pages(spark, folder), "doc_id", "page", "text", "visuals")


@query(f"select doc_id, bool_or(regexp_matches(text, 'From:.*@')::bigint + regexp_matches(text, 'To:.*@')::bigint + regexp_matches(text, 'Sent:.*[0-9][:/][0-9][:/][0-9]')::bigint + contains(text, 'Subject:')::bigint + contains(text, 'CC:')::bigint + contains(text, 'BCC:')::bigint + contains(text, 'Reply-To:')::bigint >= 2) as is_email from {_PAGES} group by doc_id")
def ag29_header_pages(spark, folder):
    return P.header_pages(_pages(spark, folder), "doc_id", C.email_pattern_count(F.col("text")))


@query(f"select doc_id, sum((coalesce(len({S.words('text')}), 0) < 100)::bigint + (length(text) - length(replace(text, '•', '')) > 3 or length(text) - length(replace(text, '-', '')) > 3)::bigint) >= 2 as is_presentation from {_PAGES} group by doc_id")
def ag30_presentation_pages(spark, folder):
    return P.presentation_pages(_pages(spark, folder), "doc_id", C.presentation_signs(F.col("text")))


@query(f"select doc_id, sum(visuals > 5)::bigint as charts from {_PAGES} group by doc_id")
def rt16_detected_charts(spark, folder):
    return _pages(spark, folder).groupBy("doc_id").agg(F.sum(P.detected_charts(F.col("visuals"))).cast("bigint").alias("charts"))


@query("""select document_id, zip_file, coalesce(content_file.file_name, 'not_found') as content_name, coalesce(metadata_file.extraction_method, 'not_found') as metadata_method, coalesce(content_file.success, false) and coalesce(metadata_file.success, false) as both_ok from {pairs}""")
def prj04_pair_records(spark, folder):
    c, m = F.col("content_file"), F.col("metadata_file")
    return _pairs(spark, folder).select("document_id", "zip_file", F.coalesce(c["file_name"], F.lit("not_found")).alias("content_name"), F.coalesce(m["extraction_method"], F.lit("not_found")).alias("metadata_method"), (F.coalesce(c["success"], F.lit(False)) & F.coalesce(m["success"], F.lit(False))).alias("both_ok"))


@query("""select doc_id, array_to_string(list_concat(coalesce(content_type, []), case when list_contains(coalesce(content_type, []), 'paired') then [] else ['paired'] end), '|') as types from {docs}""")
def prj06_linked_pairs(spark, folder):
    have = F.coalesce("content_type", F.array().cast("array<string>"))
    return _docs(spark, folder).select("doc_id", F.array_join(F.when(F.array_contains(have, "paired"), have).otherwise(F.concat(have, F.array(F.lit("paired")))), "|").alias("types"))


@query("""select category, count(*) as n from {pairs} where content_file.file_name in
(select content_file.file_name from {pairs} where metadata_file.file_name is not null and coalesce(metadata_file.extraction_method, '') <> 'not_found') group by category""")
def jn16_described_pairs(spark, folder):
    """Pairs whose content file some metadata file that was found describes."""
    p = _pairs(spark, folder)
    e = G.describes(p.where(F.coalesce("metadata_file.extraction_method", F.lit("")) != "not_found"), F.col("metadata_file.file_name"), F.col("content_file.file_name"))
    known = p.join(e.select(F.col("dst").alias("d")), F.col("content_file.file_name") == F.col("d"), "left_semi")
    return known.groupBy("category").agg(F.count("*").alias("n"))


@query("""select d.doc_id, md5(case when length(v.t) > 1.2 * length(d.t) then v.t when length(v.t) > 100 then v.t || chr(10) || chr(10) || '--- Traditional Fallback ---' || chr(10) || chr(10) || d.t else d.t end) as text_md5,
case when length(v.t) > 1.2 * length(d.t) then 'vlm_enhanced' when length(v.t) > 100 then 'hybrid' else 'traditional' end as text_source,
array_to_string(case when coalesce(v.c, 0) > 0.7 then [coalesce(v.k, 'mixed')] else list_sort(list_distinct([coalesce(v.k, 'mixed')] || coalesce(d.types, []))) end, '|') as types
from (select doc_id, file_name, coalesce(text_content, '') as t, content_type as types from {docs}) d left join (select file_name as f, max(coalesce(text_content, '')) as t, max(vlm_confidence) as c, max(vlm_content_type) as k from {vlm} group by 1
union all select file_name, '', null, null from {docs} where file_name is null or file_name not in (select file_name from {vlm} where file_name is not null)) v on v.f is not distinct from d.file_name""".replace("union all select file_name, '', null, null from {docs}", "union all select distinct file_name, '', null::double, null from {docs}"))
def jn17_merged_extractions(spark, folder):
    v = _vlm(spark, folder).where("file_name is not null").groupBy("file_name").agg(F.max("text_content").alias("vision"), F.max("vlm_confidence").alias("sure"), F.max("vlm_content_type").alias("seen"))
    d = _docs(spark, folder).join(v, "file_name", "left")
    m = C.merge_extractions(F.col("text_content"), F.col("vision"), F.col("sure"), F.col("content_type"), F.col("seen"))
    return d.select("doc_id", F.md5(m["text"]).alias("text_md5"), m["text_source"].alias("text_source"), F.array_join(m["types"], "|").alias("types"))


@query("select count(*) as total, round(count_if(coalesce(success, false)) / count(*), 6) as success_rate, round(avg(processing_time), 6) as mean_time, count(distinct content_format) as formats, round(sum(processing_cost), 6) as cost from {vlm}")
def ag04_statistics(spark, folder):
    ok = F.coalesce("success", F.lit(False))
    return _vlm(spark, folder).agg(F.count("*").alias("total"), F.round(F.count_if(ok) / F.count("*"), 6).alias("success_rate"), F.round(F.avg("processing_time"), 6).alias("mean_time"), F.countDistinct("content_format").alias("formats"), F.round(F.sum("processing_cost"), 6).alias("cost"))


@query("select lower(trim(category)) as category, count_if(len(coalesce(content_file.errors, [])) = 0 and len(coalesce(metadata_file.errors, [])) = 0) as clean, count_if(len(coalesce(content_file.errors, [])) > 0 or len(coalesce(metadata_file.errors, [])) > 0) as with_errors from {pairs} group by 1")
def ag08_error_counts(spark, folder):
    none = F.array().cast("array<string>")
    bad = (F.size(F.coalesce("content_file.errors", none)) > 0) | (F.size(F.coalesce("metadata_file.errors", none)) > 0)
    return _pairs(spark, folder).groupBy(F.lower(F.trim("category")).alias("category")).agg(F.count_if(~bad).alias("clean"), F.count_if(bad).alias("with_errors"))


@query("select doc_id, count(distinct event_type) as kinds, string_agg(distinct event_type, '|' order by event_type) as event_types from {events} where doc_id is not null group by doc_id")
def ag13_distinct_events(spark, folder):
    e = once(load(spark, folder, "pipeline_events"), "event_id").where("doc_id is not null")
    return e.groupBy("doc_id").agg(F.countDistinct("event_type").alias("kinds"), F.when(F.count("event_type") > 0, F.array_join(F.sort_array(F.collect_set("event_type")), "|")).alias("event_types"))


@query("select category, array_to_string(list_sort(list_distinct(flatten(list(coalesce(warnings, []))))), '|') as warnings from {vlm} group by category")
def ag20_flattened_lists(spark, folder):
    v = _vlm(spark, folder)
    lists = v.select("category", F.explode_outer("warnings").alias("w")).groupBy("category").agg(F.array_join(F.sort_array(F.collect_set("w")), "|").alias("warnings"))
    return lists


@query("select primary_model, doc_id, round(n_ok / (n_ok + case when ok then 0 else 1 end), 6) as success_rate from (select primary_model, doc_id, coalesce(success, false) as ok, sum(coalesce(success, false)::int) over (partition by primary_model order by doc_id) as n_ok from {vlm}) where n_ok + case when ok then 0 else 1 end > 0")
def ag24_running_success_rate(spark, folder):
    from pyspark.sql import Window

    ok = F.coalesce("success", F.lit(False))
    n = F.sum(ok.cast("int")).over(Window.partitionBy("primary_model").orderBy("doc_id"))
    v = _vlm(spark, folder).select("primary_model", "doc_id", ok.alias("ok"), n.alias("n_ok")).withColumn("all", F.col("n_ok") + F.when(F.col("ok"), 0).otherwise(1))
    return v.where("all > 0").select("primary_model", "doc_id", F.round(F.col("n_ok") / F.col("all"), 6).alias("success_rate"))


@query("select box_folder, category, count(*) as n from documents group by grouping sets ((box_folder), (category))")
def ag_grouping_sets(spark, folder):
    d = load(spark, folder, "documents")
    return d.groupingSets([[F.col("box_folder")], [F.col("category")]], "box_folder", "category").agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n, count(distinct doc_id) as docs from {events} where doc_id in (select doc_id from store_documents) group by event_type")
def ag34_storage_counters(spark, folder):
    e = once(load(spark, folder, "pipeline_events"), "event_id").join(load(spark, folder, "store_documents").select("doc_id"), "doc_id", "left_semi")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(r"""with p as (select doc_id, string_split_regex(text, '--- SLIDE [0-9]+ ---') as parts, regexp_extract_all(text, '--- SLIDE [0-9]+ ---') as marks, length(text) + 1 as n from documents where contains(text, '--- SLIDE ')),
k as (select doc_id, n, marks, parts, unnest(range(1, len(marks) + 1)) as slide from p),
s as (select doc_id, slide, n, 1 + list_sum(list_transform(parts[:slide], lambda x: length(x))) + coalesce(list_sum(list_transform(marks[:slide - 1], lambda x: length(x))), 0) as start from k)
select doc_id, slide::bigint as slide, start::bigint as start, coalesce(lead(start) over (partition by doc_id order by slide), n)::bigint as stop from s""")
def wn05_slide_spans(spark, folder):
    mark = F.lit("--- SLIDE [0-9]+ ---")
    d = load(spark, folder, "documents").where(F.col("text").contains("--- SLIDE ")).select("doc_id", "text", F.split("text", "--- SLIDE [0-9]+ ---").alias("parts"), F.regexp_extract_all("text", mark, F.lit(0)).alias("marks"))
    # a mark stands behind all parts and marks before it
    before = F.transform(F.arrays_zip("parts", "marks"), lambda x: F.struct(F.length(x["parts"]).alias("part"), F.coalesce(F.length(x["marks"]), F.lit(0)).alias("mark")))
    starts = F.aggregate(before, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct((s["at"] + x["part"] + x["mark"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["part"])).alias("out")), lambda s: s["out"])
    one = d.select("doc_id", (F.length("text") + 1).cast("bigint").alias("n"), F.posexplode(F.slice(starts, F.lit(1), F.size("marks"))).alias("k", "start"))
    one = one.select("doc_id", (F.col("k") + 1).cast("bigint").alias("slide"), F.col("start").cast("bigint").alias("start"), "n")
    return W.slide_spans(one, "doc_id", "start", "n", "slide").select("doc_id", "slide", "start", F.col("end").alias("stop"))


@query("select zip_file, min(name) as info_name from (select zip_file, content_file.file_name as name from {pairs} union all select zip_file, metadata_file.file_name from {pairs}) where contains(lower(name), 'info') group by zip_file")
def wn11_first_info_file(spark, folder):
    p = _pairs(spark, folder)
    f = p.select("zip_file", F.explode(F.array("content_file.file_name", "metadata_file.file_name")).alias("name")).where(F.lower("name").contains("info"))
    return f.groupBy("zip_file").agg(F.min("name").alias("info_name"))


@query(f"select doc_id, list_filter(list_transform(string_split(text_content, chr(10)), lambda x: {S.strip('x')}), lambda x: length(x) > 10)[1] as title from {{docs}}")
def wn13_first_title_line(spark, folder):
    lines = F.filter(F.transform(F.split("text_content", "\n"), strip), lambda x: F.length(x) > 10)
    return _docs(spark, folder).select("doc_id", F.try_element_at(lines, F.lit(1)).alias("title"))


@query("select category, file_name, file_size, rank::bigint as rank from (select category, file_name, file_size, doc_id, row_number() over (partition by category order by file_size, doc_id) as rank from {vlm} where file_size is not null) where rank <= 5")
def tk06_smallest_files(spark, folder):
    v = _vlm(spark, folder).where("file_size is not null")
    return R.top_k_per(v, ["category"], 5, F.col("file_size"), F.col("doc_id")).select("category", "file_name", "file_size", F.col("rank").cast("bigint").alias("rank"))


@query("select category, zip_file, rank::bigint as rank from (select category, zip_file, row_number() over (partition by category order by zip_file) as rank from (select distinct lower(trim(category)) as category, zip_file from {pairs} where zip_file is not null))")
def tk05_sorted_zips(spark, folder):
    from pyspark.sql import Window

    z = _pairs(spark, folder).where("zip_file is not null").select(F.lower(F.trim("category")).alias("category"), "zip_file").distinct()
    return z.select("category", "zip_file", F.row_number().over(Window.partitionBy("category").orderBy("zip_file")).cast("bigint").alias("rank"))


@query("select doc_id, substr(text_content, 1, 500) as head, array_to_string(list_slice(string_split(text_content, chr(10)), 1, 10), chr(10)) as first_lines from {docs} where text_content is not null")
def tk08_heads(spark, folder):
    return _docs(spark, folder).where("text_content is not null").select("doc_id", F.substring("text_content", 1, 500).alias("head"), F.array_join(F.slice(F.split("text_content", "\n"), 1, 10), "\n").alias("first_lines"))


@query("select m.document_id, coalesce(m.author, nullif(trim(regexp_extract(coalesce(p.metadata_file.extracted_text, ''), '(?:^|\\n)Author:[ \\t]*([^\\n]*)', 1)), '')) as author, try_strptime(m.date, '%m/%d/%Y %H:%M')::varchar as created_at from (" + MAIL + ") m join {pairs} p on p.document_id = m.document_id")
def txt17_promoted_authors(spark, folder):
    """The sender of a mail, if that is an address, else the author that its information sheet names; and when it was sent."""
    p = once(load(spark, folder, "pair_records").where(F.lower(F.trim("category")) == "emails"), "document_id")
    f = C.email_fields(F.col("content_file.extracted_text"))
    named = C.info_sheet(F.col("metadata_file.extracted_text"), "Author")["Author"]
    return p.select("document_id", C.promoted_author(f["from"], named).alias("author"), F.date_format(mail_date(f["date"]), "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("select category, min_by(doc_id, (processing_time, doc_id)) as fastest, max_by(doc_id, (processing_time, doc_id)) as slowest from {vlm} where processing_time is not null group by category")
def rt05_extremes(spark, folder):
    at = F.struct("processing_time", "doc_id")
    return _vlm(spark, folder).where("processing_time is not null").groupBy("category").agg(F.min_by("doc_id", at).alias("fastest"), F.max_by("doc_id", at).alias("slowest"))


@query("select user_id, round(avg(value), 4) as mean from events group by user_id")
def udf06_grouped_aggregate(spark, folder):
    @F.pandas_udf("double")
    def mean(v: pd.Series) -> float:
        return float(v.mean())

    return load(spark, folder, "events").groupBy("user_id").agg(F.round(mean("value"), 4).alias("mean"))


@query("select doc_id, upper(file_name) as file_name from {docs} where author is not null")
def udf04_hooks(spark, folder):
    reg = formats.Registry()
    reg.register_hook("post_extract", lambda d: d.where("author is not null"), 1)
    reg.register_hook("post_extract", lambda d: d.withColumn("file_name", F.upper("file_name")), 2)
    return reg.execute_hooks("post_extract", _docs(spark, folder)).select("doc_id", "file_name")


@query("select query_id, doc_id, round(avg(similarity), 6) as avg_similarity, count(*) as hits from (select q.vec_id as query_id, c.doc_id, list_cosine_similarity(c.embedding::double[], q.embedding::double[]) as similarity from {chunks} c, (select vec_id, embedding from embeddings where vec_id % 100 = 0) q where len(c.embedding) = 64 and len(list_filter(c.embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(c.embedding, lambda x: x <> 0)) > 0) group by query_id, doc_id")
def ag17_mean_similarity(spark, folder):
    from lodestone.operators.vectors import mean_similarity

    fine = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    c = once(load(spark, folder, "chunks").where(fine), "chunk_id")
    q = load(spark, folder, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return mean_similarity(c, q, "doc_id", "embedding")


@query("select primary_model, mode, n from (select *, row_number() over (partition by primary_model order by n desc, mode) as r from (select primary_model, vlm_content_type as mode, count(*) as n from {vlm} where vlm_content_type is not null group by 1, 2)) where r = 1")
def ag22_type_by_model(spark, folder):
    return A.mode_of(_vlm(spark, folder), ["primary_model"], "vlm_content_type")


@query("select doc_id, tag, n from (select doc_id, unnest(tag_context) as tag, count(*) as n from {chunks} group by 1, 2)")
def ag36_tag_counts(spark, folder):
    return once(load(spark, folder, "chunks"), "chunk_id").select("doc_id", F.explode("tag_context").alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query("select distinct 'Document' as src_label, document_id as src, 'IN_ZIP' as type, 'Zip' as dst_label, zip_file as dst from {pairs} where zip_file is not null")
def gr_zip_edges(spark, folder):
    return G.edges(_pairs(spark, folder), "Document", F.col("document_id"), "IN_ZIP", "Zip", F.col("zip_file"))


