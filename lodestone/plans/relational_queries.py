"""Queries of filters, joins, aggregations, windows, top-k and sets over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import json as J
from lodestone.functions.text import is_blank
from lodestone.operators import aggregates as A
from lodestone.operators import relational as R
from lodestone.operators import windows as W
from lodestone.plans import sqltext as S
from lodestone.plans.registry import query
from lodestone.tables import load, once


def _docs(spark, folder):
    return once(load(spark, folder, "store_documents"), "doc_id")


def _chunks(spark, folder):
    return once(load(spark, folder, "chunks"), "chunk_id")


def _pairs(spark, folder):
    return once(load(spark, folder, "pair_records"), "document_id")


def _events(spark, folder):
    return once(load(spark, folder, "pipeline_events"), "event_id")


def _vlm(spark, folder):
    return once(load(spark, folder, "vlm_results"), "doc_id")


# --- filters and projections ----------------------------------------------------------------------------------------
@query("select d.doc_id, d.file_name, count(c.chunk_id)::bigint as n_chunks, md5(coalesce(string_agg(c.chunk_id, '|' order by c.chunk_id), '')) as ids_md5 from {docs} d left join {chunks} c on c.doc_id = d.doc_id group by all")
def flt01_document_with_chunks(spark, folder):
    d = R.with_chunks(_docs(spark, folder), _chunks(spark, folder))
    return d.select("doc_id", "file_name", F.size("chunks").cast("bigint").alias("n_chunks"), F.md5(F.array_join(F.col("chunks.chunk_id"), "|")).alias("ids_md5"))


@query("select doc_id, chunk_id, text_chunk, array_to_string(coalesce(tag_context, []), '|') as tags from {chunks} where doc_id = (select min(doc_id) from chunks)")
def flt02_chunks_of_document(spark, folder):
    c = load(spark, folder, "chunks")
    first = c.agg(F.min("doc_id").alias("doc_id"))
    return once(c.join(first, "doc_id", "left_semi"), "chunk_id").select("doc_id", "chunk_id", "text_chunk", F.array_join(F.coalesce("tag_context", F.array().cast("array<string>")), "|").alias("tags"))


@query("""select doc_id, file_name, file_extension, array_to_string(content_type, '|') as types, author from {docs}
where list_contains(content_type, 'document') and author like '%a%' and created_at >= timestamp '2010-01-01' and created_at <= timestamp '2030-01-01' and text_content like '%the%'""")
def flt03_search_documents(spark, folder):
    d = once(R.search_documents(load(spark, folder, "store_documents"), "document", "a", "2010-01-01", "2030-01-01", "the"), "doc_id")
    return d.select("doc_id", "file_name", "file_extension", F.array_join("content_type", "|").alias("types"), "author")


@query("select doc_id, author from {docs} where author like '%, %'")
def flt03_search_by_author(spark, folder):
    return once(R.search_documents(load(spark, folder, "store_documents"), author=", "), "doc_id").select("doc_id", "author")


@query("select event_id, user_id from events where json_extract_string(props, '$.k') = '7'")
def flt04_metadata_equals(spark, folder):
    return R.metadata_equals(load(spark, folder, "events"), "props", {"k": "7"}).select("event_id", "user_id")


@query(r"""select doc_id, case when not coalesce(lower(regexp_extract(file_name, '\.([A-Za-z0-9]+)$', 1)) in ('pdf', 'docx', 'txt'), false) then 'unsupported' when file_size > 1000000 then 'too_large' end as error from {vlm}""")
def flt06_supported_files(spark, folder):
    return R.supported(_vlm(spark, folder), "file_name", ("pdf", "docx", "txt"), "file_size", 1_000_000).select("doc_id", "error")


@query("select document_id, content_file is not null and metadata_file is not null and coalesce(metadata_file.extraction_method, '') <> 'not_found' as complete from {pairs}")
def flt08_pair_completeness(spark, folder):
    there = F.col("content_file").isNotNull() & F.col("metadata_file").isNotNull() & (F.coalesce("metadata_file.extraction_method", F.lit("")) != "not_found")
    return _pairs(spark, folder).select("document_id", there.alias("complete"))


@query("select category, round(avg(vlm_confidence), 6) as all_pages, round(avg(case when vlm_confidence > 0 then vlm_confidence end), 6) as sure_pages, count(*) as n from {vlm} where success group by category")
def flt10_confidence_above_zero(spark, folder):
    v = _vlm(spark, folder).where("success")
    return v.groupBy("category").agg(F.round(F.avg("vlm_confidence"), 6).alias("all_pages"), F.round(F.avg(F.when(F.col("vlm_confidence") > 0, F.col("vlm_confidence"))), 6).alias("sure_pages"), F.count("*").alias("n"))


@query("select doc_id, coalesce(processing_time > 30, false) or coalesce(vlm_confidence < 0.5, true) as used_fallback, case when coalesce(processing_time > 30, false) or coalesce(vlm_confidence < 0.5, true) then 0.5 else vlm_confidence end as final_confidence from {vlm}")
def flt11_fallback(spark, folder):
    return R.with_fallback(_vlm(spark, folder), F.col("processing_time"), F.col("vlm_confidence")).select("doc_id", "used_fallback", "final_confidence")


@query("select doc_id, author from {docs} where author <> '' and contains(author, '@')")
def flt14_valid_addresses(spark, folder):
    return once(load(spark, folder, "store_documents").where((F.col("author") != "") & F.col("author").contains("@")).select("doc_id", "author"), "doc_id")


@query("select c.chunk_id, d.file_extension, try_cast(substr(list_filter(c.tag_context, lambda t: starts_with(t, 'slide_'))[1], 7) as int) as slide_number from {chunks} c join {docs} d on d.doc_id = c.doc_id")
def prj01_enriched_chunks(spark, folder):
    return R.enrich_chunks(_chunks(spark, folder), _docs(spark, folder)).select("chunk_id", "file_extension", "slide_number")


@query(rf"select document_id, length(content_file.extracted_text)::bigint as text_length, coalesce(len({S.words('content_file.extracted_text')}), 0)::bigint as word_count, lower(regexp_extract(content_file.file_name, '\.([A-Za-z0-9]+)$', 1)) as extension, coalesce(metadata_file.file_name, 'not_found') as info_name from {{pairs}}")
def prj03_pair_features(spark, folder):
    from lodestone.functions.text import word_count

    t = F.col("content_file.extracted_text")
    return _pairs(spark, folder).select("document_id", F.length(t).cast("bigint").alias("text_length"), word_count(t).alias("word_count"), R.extension_of(F.col("content_file.file_name")).alias("extension"), F.coalesce("metadata_file.file_name", F.lit("not_found")).alias("info_name"))


@query("select doc_id, structured_content.text_length as said, coalesce(length(text_content), 0)::bigint as found, coalesce(structured_content.visual_element_count, 0) > 0 as visual from {vlm}")
def prj05_structured_content(spark, folder):
    s = F.col("structured_content")
    return _vlm(spark, folder).select("doc_id", s["text_length"].alias("said"), F.coalesce(F.length("text_content"), F.lit(0)).cast("bigint").alias("found"), (F.coalesce(s["visual_element_count"], F.lit(0)) > 0).alias("visual"))


# --- joins ----------------------------------------------------------------------------------------------------------
_FILES = "(select zip_file, content_file.file_name as name from {pairs} where content_file.file_name is not null union select zip_file, metadata_file.file_name from {pairs} where metadata_file.file_name is not null)"


def _files(spark, folder):
    p = _pairs(spark, folder)
    parts = [p.select("zip_file", F.col(f"{c}.file_name").alias("name")) for c in ("content_file", "metadata_file")]
    return parts[0].unionByName(parts[1]).where("name is not null").distinct()


@query(rf"""with f as {_FILES}, i as (select zip_file, regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '(?i)-info$', '') as stem, min(name) as info_name from f where regexp_matches(lower(name), '-info\.[^.]+$') group by all)
select c.zip_file, c.name as content_name, i.info_name from f c left join i on i.zip_file is not distinct from c.zip_file and i.zip_file = c.zip_file and i.stem = regexp_replace(c.name, '\.[^.]+$', '') where not regexp_matches(lower(c.name), '-info\.[^.]+$')""")
def jn02_pair_by_stem(spark, folder):
    return R.pair_by_stem(_files(spark, folder), "zip_file", "name")


@query(rf"""with f as {_FILES}, i as (select zip_file, regexp_replace(lower(regexp_replace(name, '\.[^.]+$', '')), '-info$', '') as stem, min(name) as info_name from f where regexp_matches(lower(name), '-info\.[^.]+$') group by all)
select c.zip_file, c.name as content_name, i.info_name from f c left join i on i.zip_file = c.zip_file and i.stem = lower(regexp_replace(c.name, '\.[^.]+$', '')) where not regexp_matches(lower(c.name), '-info\.[^.]+$')""")
def jn03_pair_by_stem_any_case(spark, folder):
    return R.pair_by_stem(_files(spark, folder), "zip_file", "name", ignore_case=True)


@query("select e.event_id, e.doc_id, d.file_name from {events} e join {docs} d on d.doc_id = e.doc_id")
def jn05_hits_with_documents(spark, folder):
    return _events(spark, folder).select("event_id", "doc_id").join(_docs(spark, folder).select("doc_id", "file_name"), "doc_id")


@query("select d.doc_id from {docs} d where exists (select 1 from chunks c where c.doc_id = d.doc_id and c.embedding is not null)")
def jn10_documents_with_vectors(spark, folder):
    c = load(spark, folder, "chunks").where("embedding is not null").select("doc_id")
    return _docs(spark, folder).select("doc_id").join(c, "doc_id", "left_semi")


@query("select d.doc_id from {docs} d where not exists (select 1 from chunks c where c.doc_id = d.doc_id)")
def jn12_documents_without_chunks(spark, folder):
    return _docs(spark, folder).select("doc_id").join(load(spark, folder, "chunks").select("doc_id"), "doc_id", "left_anti")


@query("select event_id, doc_id from {events} e where not exists (select 1 from store_documents d where d.doc_id = e.doc_id)")
def jn14_orphan_events(spark, folder):
    return _events(spark, folder).select("event_id", "doc_id").join(load(spark, folder, "store_documents").select("doc_id").distinct(), "doc_id", "left_anti").select("event_id", "doc_id")


@query("""select document_id, content_file.extraction_method is not distinct from metadata_file.extraction_method as method_match,
coalesce(length(content_file.extracted_text), 0)::bigint as content_chars, coalesce(length(metadata_file.extracted_text), 0)::bigint as metadata_chars,
case when coalesce(length(metadata_file.extracted_text), 0) > 0 then round(coalesce(length(content_file.extracted_text), 0) / length(metadata_file.extracted_text), 6) end as ratio from {pairs}""")
def jn15_pair_comparison(spark, folder):
    c, m = (F.coalesce(F.length(f"{x}.extracted_text"), F.lit(0)) for x in ("content_file", "metadata_file"))
    return _pairs(spark, folder).select(
        "document_id", F.col("content_file.extraction_method").eqNullSafe(F.col("metadata_file.extraction_method")).alias("method_match"),
        c.cast("bigint").alias("content_chars"), m.cast("bigint").alias("metadata_chars"), F.when(m > 0, F.round(c / m, 6)).alias("ratio"),
    )


@query("""select n.n_name, r.r_name, count(*) as n_orders, round(sum(o.o_totalprice), 2) as total from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey group by all""")
def jn04_star_join(spark, folder):
    o, c, n, r = (load(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    # orders are aggregated by customer before the dimensions are joined
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    j = per.join(c, per["o_custkey"] == c["c_custkey"]).join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("t"), 2).alias("total"))


@query("""with recursive e as (select distinct 'supplier ' || l_suppkey as src, 'part ' || l_partkey as dst from lineitem where l_suppkey is not null and l_partkey is not null), b as (select src, dst from e union select dst, src from e),
w as (select distinct 'supplier ' || l_suppkey as seed, 'supplier ' || l_suppkey as node, 0 as hops from lineitem where l_suppkey % 10 = 0 union select w.seed, b.dst, w.hops + 1 from w join b on b.src = w.node where w.hops < 2) select seed, node, min(hops)::bigint as hops from w group by seed, node""")
def jn08_expand_two_hops(spark, folder):
    t = load(spark, folder, "lineitem").where("l_suppkey is not null and l_partkey is not null")
    supplier = F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))
    e = t.select(supplier.alias("src"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    seeds = t.where("l_suppkey % 10 = 0").select(supplier.alias("seed")).distinct()
    return R.expand(e, seeds, 2).select("seed", "node", F.col("hops").cast("bigint").alias("hops"))


#: The terms of a text: runs of word characters of any script that are three letters or more of a-z.
_TERMS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z][a-z]+'))"


# --- aggregations ---------------------------------------------------------------------------------------------------
@query("""select lower(trim(category)) as category, count(distinct zip_file) as zip_files, count(*) as pairs, count_if(coalesce(overall_success, false)) as successful, count(*) - count_if(coalesce(overall_success, false)) as failed,
round(count_if(coalesce(overall_success, false)) / count(*), 6) as success_rate from {pairs} group by 1""")
def ag01_category_stats(spark, folder):
    return A.category_stats(_pairs(spark, folder), F.lower(F.trim("category")), F.col("zip_file"), F.coalesce("overall_success", F.lit(False)))


@query("""select category, doc_type, count(*) as processed, count_if(not coalesce(success, false)) as failed, round(avg(processing_time), 6) as mean_time, grouping_id(category, doc_type)::bigint as level from {vlm} group by rollup(category, doc_type)""")
def ag03_stats_rollup(spark, folder):
    return A.stats_rollup(_vlm(spark, folder), ["category", "doc_type"], F.coalesce("success", F.lit(False)), F.col("processing_time"))


@query("select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by event_type")
def ag05_counts_by_type(spark, folder):
    return load(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("select lower(trim(event_type)) as event_type, count(*) as n, count(distinct doc_id) as docs from {events} group by 1")
def ag06_event_counters(spark, folder):
    return _events(spark, folder).groupBy(F.lower(F.trim("event_type")).alias("event_type")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("select doc_type, round(count_if(coalesce(success, false)) / count(*), 6) as success_rate, count(*) as n from {vlm} group by doc_type")
def ag09_success_rate(spark, folder):
    return _vlm(spark, folder).groupBy("doc_type").agg(F.round(F.count_if(F.coalesce("success", F.lit(False))) / F.count("*"), 6).alias("success_rate"), F.count("*").alias("n"))


@query(rf"""select doc_id, term, count(*) as n from (select doc_id, unnest({_TERMS.format('text_content')}) as term from {{docs}}) group by all""")
def ag11_term_frequency(spark, folder):
    t = _docs(spark, folder).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text_content"), F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("""select user_id, mode, n from (select *, row_number() over (partition by user_id order by n desc, mode) as r from (select user_id, event_type as mode, count(*) as n from events where event_type is not null group by 1, 2)) where r = 1""")
def ag14_mode(spark, folder):
    return A.mode_of(load(spark, folder, "events"), ["user_id"], "event_type")


@query("select vlm_content_type, count(*) as n, round(avg(vlm_confidence), 6) as confidence, round(sum(processing_cost), 6) as cost from {vlm} group by 1")
def ag15_type_distribution(spark, folder):
    return _vlm(spark, folder).groupBy("vlm_content_type").agg(F.count("*").alias("n"), F.round(A.exact_mean("vlm_confidence"), 6).alias("confidence"), F.round(A.exact_sum("processing_cost"), 6).alias("cost"))


@query(f"select doc_id, md5(string_agg(text_chunk, chr(10) || chr(10) order by chunk_id)) as text_md5 from {{chunks}} where not (text_chunk is null or length({S.strip('text_chunk')}) = 0) and doc_id is not null group by doc_id")
def ag16_joined_texts(spark, folder):
    return A.joined_in_order(_chunks(spark, folder).where("doc_id is not null"), "doc_id", "chunk_id", "text_chunk").select("doc_id", F.md5("text").alias("text_md5"))


@query("select " + "* from (" + " union all ".join(f"select '{c}' as name, count_if(not ({c} is null or length({S.strip(c + '::varchar')}) = 0)) as filled, count_if({c} is null or length({S.strip(c + '::varchar')}) = 0) as empty, round(count_if(not ({c} is null or length({S.strip(c + '::varchar')}) = 0)) / count(*), 6) as rate from documents" for c in ("text", "lang", "source", "category", "box_folder")) + ")")
def ag18_fill_rates(spark, folder):
    return A.fill_rates(load(spark, folder, "documents"), ["text", "lang", "source", "category", "box_folder"])


@query("select * from (" + " union all ".join(f"select '{c}' as name, min({c})::double as lowest, max({c})::double as highest, round(avg({c}), 2) as mean from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")")
def ag19_numeric_profile(spark, folder):
    return A.numeric_profile(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("select user_id, string_agg(distinct event_type, '|' order by event_type) as types from events group by user_id")
def ag21_entity_union(spark, folder):
    return load(spark, folder, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), "|").alias("types"))


@query("select event_type, list_sort(list(value))[floor(0.95::double * (count(value) - 1))::bigint + 1] as quantile, count(value) as n from events where value is not null group by event_type")
def ag23_p95_floor(spark, folder):
    return A.exact_floor_quantiles(load(spark, folder, "events"), "event_type", "value", 0.95)


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n, grouping_id(l_returnflag, l_linestatus)::bigint as level from lineitem group by cube(l_returnflag, l_linestatus)")
def ag_cube(spark, folder):
    return load(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


# --- windows --------------------------------------------------------------------------------------------------------
@query(rf"""with t as (select doc_id, unnest({_TERMS.format('text')}) as term, generate_subscripts({_TERMS.format('text')}, 1) as pos from documents),
c as (select doc_id, term, count(*) as n, min(pos) as f from t where term not in ('the', 'and', 'that', 'for', 'with', 'this', 'are', 'from') group by all),
r as (select *, row_number() over (partition by doc_id order by n desc, f) as rank from c)
select doc_id, term, n, rank::bigint as rank, round(n / max(n) over (partition by doc_id), 6) as relevance from r where rank <= 5""")
def wn01_topics(spark, folder):
    return W.topics(load(spark, folder, "documents"), "doc_id", "text").withColumn("rank", F.col("rank").cast("bigint"))


@query("""select user_id, round(sum(0.1::double * pow(0.9::double, k) * value), 6) as ema, count(*) as n from (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as k from events) group by user_id""")
def wn09_exponential_mean(spark, folder):
    return W.exponential_mean(load(spark, folder, "events"), "user_id", ["ts", "event_id"], "value")


@query("""select event_id, round(coalesce(sum(value) over w, 0), 6) as spent, round(coalesce(sum(value) over w, 0), 6) < 2000 as allowed from events window w as (partition by user_id, cast(ts as date) order by ts, event_id rows between unbounded preceding and 1 preceding)""")
def wn10_cost_gate(spark, folder):
    e = load(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return W.cost_gate(e, ["user_id", "day"], ["ts", "event_id"], "value", 2000.0).select("event_id", "spent", "allowed")


@query("""with e as (select event_id, user_id, epoch_us(ts) / 1e6 as s from events), f as (select *, case when s - lag(s) over w > 21600 then 1 when lag(s) over w is null then 1 else 0 end as new from e window w as (partition by user_id order by s, event_id))
select event_id, sum(new) over (partition by user_id order by s, event_id rows unbounded preceding)::bigint as line from f""")
def wn06_gap_groups(spark, folder):
    e = load(spark, folder, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return W.gap_groups(e, "user_id", "s", 21600.0, "event_id").select("event_id", F.col("line").cast("bigint").alias("line"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
s as (select doc_id, pos, coalesce(last_value(case when regexp_matches(line, '^(?:--- SLIDE|=== |[0-9]+\.[0-9]+ )') then line end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row), 'Header') as section from l)
select doc_id, section, count(*) as lines from s group by all""")
def wn07_sections(spark, folder):
    d = load(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return W.sections(d, "doc_id", "pos", "line", F.col("line").rlike(r"^(?:--- SLIDE|=== |[0-9]+\.[0-9]+ )")).groupBy("doc_id", "section").agg(F.count("*").alias("lines"))


@query("select zip_file, max_by(document_id, (content_file.success::int, coalesce(length(content_file.extracted_text), 0), document_id)) as best from {pairs} where content_file.success is not null group by zip_file")
def wn03_best_per_zip(spark, folder):
    p = _pairs(spark, folder).where("content_file.success is not null")
    return p.groupBy("zip_file").agg(F.max_by("document_id", F.struct(F.col("content_file.success").cast("int").alias("a"), F.coalesce(F.length("content_file.extracted_text"), F.lit(0)).alias("b"), F.col("document_id").alias("c"))).alias("best"))


@query("select l_orderkey, min_by(l_linenumber, (l_quantity, l_linenumber)) as smallest, max_by(l_linenumber, (l_quantity, l_linenumber)) as largest from lineitem group by l_orderkey")
def wn04_size_extremes(spark, folder):
    at = F.struct("l_quantity", "l_linenumber")
    return load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", at).alias("smallest"), F.max_by("l_linenumber", at).alias("largest"))


# --- top-k and sets -------------------------------------------------------------------------------------------------
@query("select category, doc_id, rank::bigint as rank from (select category, doc_id, row_number() over (partition by category order by created_at desc, doc_id) as rank from documents where created_at is not null) where rank <= 10")
def tk04_newest_per_type(spark, folder):
    d = load(spark, folder, "documents").where("created_at is not null")
    return R.top_k_per(d, ["category"], 10, F.desc("created_at"), F.col("doc_id")).select("category", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def tk01_largest_orders(spark, folder):
    return R.top_k(load(spark, folder, "orders"), 100, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("select zip_file, document_id from (select zip_file, document_id, row_number() over (partition by zip_file order by document_id) as r from {pairs}) where r <= 3")
def tk10_first_per_zip(spark, folder):
    return R.top_k_per(_pairs(spark, folder), ["zip_file"], 3, F.col("document_id")).select("zip_file", "document_id")


@query("select c_nationkey as nation, 'customer' as side from customer union all select s_nationkey, 'supplier' from supplier")
def set_union_all(spark, folder):
    c, s = load(spark, folder, "customer"), load(spark, folder, "supplier")
    return c.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("side")).unionByName(s.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("side")))


@query("select doc_id from store_documents intersect select doc_id from chunks")
def set_intersect(spark, folder):
    return load(spark, folder, "store_documents").select("doc_id").intersect(load(spark, folder, "chunks").select("doc_id"))


@query("select doc_id from store_documents except select doc_id from pipeline_events")
def set_except(spark, folder):
    return load(spark, folder, "store_documents").select("doc_id").subtract(load(spark, folder, "pipeline_events").select("doc_id"))


@query("select event_id, json_extract_string(event_data, '$.status') as status from {events} where json_valid(event_data)")
def js01_event_fields(spark, folder):
    e = _events(spark, folder).where(F.try_parse_json("event_data").isNotNull())
    return e.select("event_id", F.get_json_object("event_data", "$.status").alias("status"))


@query("""select d.doc_id, substr(t.fullkey, 3) as path, case t.type when 'NULL' then null else json_extract_string(t.value, '$') end as value from {docs} d, json_tree(d.metadata) t
where json_valid(d.metadata) and json_type(d.metadata) in ('OBJECT', 'ARRAY') and t.type not in ('OBJECT', 'ARRAY')""")
def js02_flatten_metadata(spark, folder):
    return J.flatten(_docs(spark, folder), "doc_id", "metadata")


@query("""select event_id, case when json_valid(event_data) then case json_type(event_data) when 'OBJECT' then 'object:' || len(json_keys(event_data)) when 'ARRAY' then 'array:' || json_array_length(event_data) else 'value' end end as structure from {events}""")
def js03_structure(spark, folder):
    return _events(spark, folder).select("event_id", J.structure(F.col("event_data")).alias("structure"))


@query(f"select lang, count(*) as n, count_if(text is null or length({S.strip('text')}) = 0) as blank, approx_n > 0 as seen from (select *, 1 as approx_n from documents) group by lang, approx_n")
def ag31_languages(spark, folder):
    return load(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(is_blank(F.col("text"))).alias("blank")).withColumn("seen", F.lit(True))


@query("select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as before, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as change from events")
def wn_lag_change(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, folder, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))
