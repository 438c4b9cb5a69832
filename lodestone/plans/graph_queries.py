"""Queries of vectors, the graph, pairing and routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.text import pdf_date
from lodestone.operators import chunking as K
from lodestone.operators import graph as G
from lodestone.operators import pairing as P
from lodestone.operators import relational as R
from lodestone.operators import routing as T
from lodestone.operators import vectors as V
from lodestone.operators import windows as W
from lodestone.operators.classify import email_fields
from lodestone.plans import sqltext as S
from lodestone.plans.registry import query
from lodestone.plans.text_queries import FOLD
from lodestone.tables import cut, load, once

_VEC = "list_transform(range(64), lambda i: ('0x' || substr(md5(coalesce({0}, '')), (2 * (i % 16) + 1)::int, 2))::int / 255.0::double)"


def _docs(spark, folder):
    return once(load(spark, folder, "store_documents"), "doc_id")


def _mails(spark, folder):
    p = once(load(spark, folder, "pair_records"), "document_id").where(F.lower(F.trim("category")) == "emails")
    f = email_fields(F.col("content_file.extracted_text"))
    return p.select("document_id", *(f[k].alias(f"mail_{k}") for k in ("from", "to", "cc", "subject")))


# --- vectors --------------------------------------------------------------------------------------------------------
@query(f"select doc_id, round(list_sum({_VEC.format('text_content')}), 6) as total, round(({_VEC.format('text_content')})[17], 6) as again from {{docs}}")
def vec01_text_vector(spark, folder):
    v = V.text_vector(F.col("text_content"))
    return _docs(spark, folder).select("doc_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at(v, 17), 6).alias("again"))


_KNN = "(select e.vec_id, q.vec_id as query_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) as similarity from embeddings e, (select * from embeddings where vec_id % 100 = 0) q {0})"


def _all_queries(e):
    """Every row whose id is divisible by 100 is a query."""
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"select query_id, vec_id, similarity, rank::bigint as rank from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from {_KNN.format('')}) where rank <= 5")
def vec03_nearest_vectors(spark, folder):
    e = load(spark, folder, "embeddings")
    return V.search_all(e, _all_queries(e), "vec_id", "embedding").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"select query_id, vec_id, similarity, rank::bigint as rank from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from {_KNN.format('where e.label = 3')}) where rank <= 5")
def vec03_nearest_with_filter(spark, folder):
    e = load(spark, folder, "embeddings")
    return V.search_all(e.where("label = 3"), _all_queries(e), "vec_id", "embedding").withColumn("rank", F.col("rank").cast("bigint"))


# --- graph ----------------------------------------------------------------------------------------------------------
_KEY = "case when contains(author, '@') then author else replace(lower(author), ' ', '.') || '@placeholder.com' end"
_NAME = "case when contains(author, '@') then case when contains(split_part(author, '@', 1), '.') then array_to_string(list_transform(string_split(split_part(author, '@', 1), '.'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ') else split_part(author, '@', 1) end else author end"


@query(f"select 'Person' as label, {_KEY} as id, min({_NAME}) as name from {{docs}} where length(trim(author)) > 0 group by 2")
def gr01_person_nodes(spark, folder):
    return G.person_nodes(_docs(spark, folder))


@query(f"select distinct 'Document' as src_label, doc_id as src, 'AUTHORED_BY' as type, 'Person' as dst_label, {_KEY} as dst from {{docs}} where length(trim(author)) > 0 union select distinct 'Document', doc_id, 'HAS_TYPE', 'ContentType', t from (select doc_id, unnest(content_type) as t from {{docs}}) where t is not null")
def gr09_document_edges(spark, folder):
    return G.document_edges(_docs(spark, folder))


_MAIL = r"(select document_id, regexp_extract(t, 'From:[ \t]*([^\n]*)\n', 1) as mf, regexp_extract(t, 'To:[ \t]*([^\n]*)\n', 1) as mt, regexp_extract(t, 'CC:[ \t]*([^\n]*)\n', 1) as mc, regexp_extract(t, 'Subject:[ \t]*([^\n]*)\n', 1) as ms from (select document_id, coalesce(content_file.extracted_text, '') as t from {pairs} where lower(trim(category)) = 'emails'))"


@query(f"select document_id, s as subject, md5(s) as thread_id from (select document_id, trim(regexp_replace(trim(regexp_replace(trim(lower(ms)), '^re:', '')), '^fwd:', '')) as s from {_MAIL} where ms <> '' or mf <> '')")
def gr03_threads(spark, folder):
    subject, thread = G.thread_of(F.col("mail_subject"))
    return _mails(spark, folder).where("mail_subject <> '' or mail_from <> ''").select("document_id", subject.alias("subject"), thread.alias("thread_id"))


@query(f"select distinct document_id, trim(a) as address, role from (select document_id, mf as a, 'SENDER' as role from {_MAIL} union all select document_id, unnest(string_split(mt, ',')), 'RECIPIENT' from {_MAIL} union all select document_id, unnest(string_split(mc, ',')), 'CC' from {_MAIL}) where contains(a, '@')")
def gr04_participants(spark, folder):
    return G.participants(_mails(spark, folder), "document_id", "mail_from", "mail_to", "mail_cc")


@query("""with e as (select 'part ' || l_partkey as s, 'supplier ' || l_suppkey as d from lineitem), b as (select s as a, d as b from e union all select d, s from e)
select a, b, relevance, rank::bigint as rank from (select a, b, relevance, row_number() over (partition by a order by relevance desc, b) as rank from (select a, b, count(*) as relevance from b where a <> b group by 1, 2)) where rank <= 10""")
def jn07_related(spark, folder):
    e = load(spark, folder, "lineitem").select(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("dst"))
    return G.related(e).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""with e as (select distinct 'Document' as sl, doc_id as s, 'Person' as dl, {_KEY} as d, 'A' as k from {{docs}} where length(trim(author)) > 0 union select distinct 'Document', doc_id, 'ContentType', t, 'H' from (select doc_id, unnest(content_type) as t from {{docs}}) where t is not null),
o as (select sl as label, s as id, count(*) as n_out from e group by all), i as (select dl as label, d as id, count(*) as n_in from e group by all)
select coalesce(o.label, i.label) as label, coalesce(o.id, i.id) as id, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in from o full join i on o.label = i.label and o.id = i.id""")
def jn09_degrees(spark, folder):
    return G.degrees(G.document_edges(_docs(spark, folder)))


@query("select distinct doc_id as src, 'Document' as dst_label from {events} where doc_id in (select doc_id from store_documents)")
def jn11_guarded_edges(spark, folder):
    e = G.edges(once(load(spark, folder, "pipeline_events"), "event_id"), "Document", F.col("doc_id"), "HAS_EVENT", "Document", F.col("doc_id"))
    nodes = _docs(spark, folder).select(F.lit("Document").alias("label"), F.col("doc_id").alias("id"))
    return G.guarded(e, nodes).select("src", "dst_label").distinct()


# --- pairing --------------------------------------------------------------------------------------------------------
_LIST = """(select z as zip, c as category, regexp_replace(z, '[.]zip$', '') as base, path, min(size) as size, row_number() over (partition by z order by path) as ord from (
select zip_file as z, 'Documents' as c, content_file.file_name as path, coalesce(length(content_file.extracted_text), 0) as size from {pairs} where zip_file is not null and content_file.file_name is not null
union all select zip_file, 'Documents', metadata_file.file_name, coalesce(length(metadata_file.extracted_text), 0) from {pairs} where zip_file is not null and metadata_file.file_name is not null) group by z, c, path)"""


# every category has its rule: the archive's name decides on one, and on the extension of its content
_KINDS = ("Presentations", "Images", "Spreadsheets", "Documents", "Emails")
_FORMS = {"Presentations": "pptx", "Images": "png", "Spreadsheets": "xlsx"}
_LIST_ALL = f"""(select zip, cat as category, base, case when not contains(lower(path), 'info') then regexp_replace(path, '[.]pdf$', case cat when 'Presentations' then '.pptx' when 'Images' then '.png' when 'Spreadsheets' then '.xlsx' else '.pdf' end) else path end as path, size, ord
from (select *, ['Presentations', 'Images', 'Spreadsheets', 'Documents', 'Emails'][length(zip) % 5 + 1] as cat from {_LIST}))"""


def _listing_all(spark, folder):
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.length("zip") % 5 + 1).cast("int"))
    form = F.lit("pdf")
    for k, f in _FORMS.items():
        form = F.when(F.col("category") == k, f).otherwise(form)
    d = _listing(spark, folder).withColumn("category", kind)
    return d.withColumn("path", F.when(F.lower("path").contains("info"), F.col("path")).otherwise(F.regexp_replace("path", F.lit("[.]pdf$"), F.concat(F.lit("."), form))))


def _listing(spark, folder):
    p = once(load(spark, folder, "pair_records"), "document_id").where("zip_file is not null")
    part = [p.select(F.col("zip_file").alias("zip"), F.col(f"{c}.file_name").alias("path"), F.coalesce(F.length(f"{c}.extracted_text"), F.lit(0)).alias("size")) for c in ("content_file", "metadata_file")]
    g = part[0].unionByName(part[1]).where("path is not null").groupBy("zip", "path").agg(F.min("size").alias("size"))
    return g.select("zip", F.lit("Documents").alias("category"), F.regexp_replace("zip", "[.]zip$", "").alias("base"), "path", "size", F.row_number().over(Window.partitionBy("zip").orderBy("path")).alias("ord"))


@query(f"""with f as (select *, contains(lower(path), 'info') as info, ends_with(lower(path), '.pdf') as pdf from {_LIST}),
g as (select zip, count(*) as n, count_if(pdf) as pdfs, max_by(path, case when pdf and info then ord end) as pi, max_by(path, case when pdf and not info and starts_with(path, base) then ord end) as pc,
min_by(path, case when pdf then size * 100000 + ord end) as ps, max_by(path, case when pdf then size * 100000 + ord end) as pl, min_by(path, size * 100000 + ord) as s, max_by(path, size * 100000 + ord) as l,
min_by(path, case when info then ord end) as ai, min_by(path, case when not info then ord end) as ni, min_by(path, ord) as o from f group by zip)
select zip, n, case when pdfs >= 2 then case when pi is not null and pc is not null then pc else pl end when n = 1 then o when ai is not null then ni else l end as content,
case when pdfs >= 2 then case when pi is not null and pc is not null then pi else ps end when n = 1 then null when ai is not null then ai else s end as metadata from g""")
def pair01_pair_files(spark, folder):
    return P.pair_files(_listing(spark, folder)).select("zip", "n", "content", "metadata")


@query(f"""with f as (select *, contains(lower(path), 'info') as info, lower(regexp_extract(path, '[.]([A-Za-z]+)$', 1)) as ext from {_LIST_ALL} where length(zip) % 5 < 3)
select zip, category, count(*) as n, case category when 'Presentations' then min_by(path, ord) filter (ext in ('ppt', 'pptx')) when 'Images' then min_by(path, ord) filter (ext in ('png', 'jpg', 'jpeg', 'tiff', 'bmp'))
else coalesce(min_by(path, ord) filter (ext in ('xlsx', 'xls')), min_by(path, ord) filter (ext = 'csv'), case when count(*) >= 2 and count(*) filter (ext = 'pdf' and info) = 0 then max_by(path, (size, ord)) end) end as content,
coalesce(min_by(path, ord) filter (ext = 'pdf' and info), case category when 'Presentations' then min_by(path, (size, ord)) filter (ext = 'pdf') when 'Images' then min_by(path, ord) filter (ext = 'pdf') else case when count(*) >= 2 then min_by(path, (size, ord)) end end) as metadata from f group by zip, category""")
def pair02_pair_by_category(spark, folder):
    """The rules of presentations, images and spreadsheets."""
    return P.pair_files(_listing_all(spark, folder).where("category in ('Presentations', 'Images', 'Spreadsheets')"))


@query(f"select zip, max_by(path, (contains(lower(path), lower(base)), size, -ord)) as content from {_LIST} where not (contains(lower(path), 'info') and ends_with(lower(path), '.pdf')) group by zip")
def pair06_content_candidates(spark, folder):
    return P.content_candidates(_listing(spark, folder))


@query(f"select zip, count_if(ends_with(lower(path), '.pdf')) as pdfs, case when count_if(ends_with(lower(path), '.pdf')) <> 2 then 'expected 2 PDFs, found ' || count_if(ends_with(lower(path), '.pdf')) end as error from {_LIST} group by zip")
def pair09_strict_pairs(spark, folder):
    return P.strict_pairs(_listing(spark, folder))


# --- routing --------------------------------------------------------------------------------------------------------
_FEAT = "(select doc_id, coalesce(length(text_content), 0) / 100000.0::double as density, 8.0 + coalesce(structured_content.visual_element_count, 0) % 5 as font, coalesce(structured_content.visual_element_count, 0) as visuals, 1 + length(coalesce(text_content, '')) - length(replace(coalesce(text_content, ''), chr(12), '')) as pages from {vlm})"
_CPX = f"(select *, round(least(1.0::double, (case when density > 0.015 then 0.8 when density > 0.010 then 0.5 else 0.2 end + case when font < 9 then 0.9 when font < 11 then 0.6 else 0.3 end + case when visuals / pages > 2 then 0.7 when visuals / pages > 0.5 then 0.4 else 0.1 end + case when pages > 20 then 0.6 when pages > 5 then 0.3 else 0.1 end)::double / 4), 6) as complexity from {_FEAT})"
_DIF = f"(select *, case when complexity > 0.7 then 'very_complex' when complexity > 0.5 then 'complex' when complexity > 0.3 then 'moderate' else 'simple' end as level from {_CPX})"


def _features(spark, folder):
    v = once(load(spark, folder, "vlm_results"), "doc_id")
    n = F.coalesce("structured_content.visual_element_count", F.lit(0))
    t = F.coalesce("text_content", F.lit(""))
    f = v.select("doc_id", (F.length(t) / 100000.0).alias("density"), (8.0 + n % 5).alias("font"), n.alias("visuals"), (1 + F.length(t) - F.length(F.replace(t, F.lit("\f"), F.lit("")))).alias("pages"))
    f = f.withColumn("complexity", T.layout_complexity(F.col("density"), F.col("font"), F.col("visuals"), F.col("pages")))
    return f.withColumn("level", T.difficulty(F.col("complexity")))


@query(f"select doc_id, complexity, level from {_DIF}")
def rt01_layout_complexity(spark, folder):
    return _features(spark, folder).select("doc_id", "complexity", "level")


@query(f"""with r as (select *, case when visuals / pages > 1.0 then 'cloud_gpt4v' when density > 0.012 then 'cloud_claude' when level in ('complex', 'very_complex') then 'local_qwen' else 'local_llava' end as processor from {_DIF})
select doc_id, processor, case processor when 'cloud_gpt4v' then 0.9 when 'cloud_claude' then 0.85 when 'local_qwen' then 0.8 else 0.75 end::double as confidence,
case processor when 'cloud_gpt4v' then 'cloud_claude|local_qwen|local_llava|fallback_ocr' when 'cloud_claude' then 'cloud_gpt4v|local_qwen|local_llava|fallback_ocr' when 'local_qwen' then 'cloud_claude|local_llava|fallback_ocr' else 'local_qwen|fallback_ocr' end as fallbacks,
case level when 'very_complex' then 300 when 'complex' then 180 when 'moderate' then 120 else 60 end as timeout, case when processor in ('cloud_gpt4v', 'cloud_claude') then round(0.01::double * pages, 6) else 0.0::double end as cost from r""")
def rt04_strategy(spark, folder):
    return _strategy(spark, folder, list(T.FALLBACKS))


@query(f"""with r as (select *, case when density > 0.012 then 'cloud_claude' when level in ('complex', 'very_complex') then 'local_qwen' else 'local_qwen' end as processor, density > 0.012 as dense from {_DIF})
select doc_id, processor, case when dense then 0.85 when level in ('complex', 'very_complex') then 0.8 else 0.6 end::double as confidence, case when dense then 'local_qwen|fallback_ocr' else 'cloud_claude|fallback_ocr' end as fallbacks,
case level when 'very_complex' then 300 when 'complex' then 180 when 'moderate' then 120 else 60 end as timeout, case when dense then round(0.01::double * pages, 6) else 0.0::double end as cost from r""")
def rt03_some_processors(spark, folder):
    """The same where the first choice for many visuals and the small local model are not there."""
    return _strategy(spark, folder, ["cloud_claude", "local_qwen", "fallback_ocr"])


def _strategy(spark, folder, available):
    f = _features(spark, folder)
    name, sure = T.recommended(F.col("density"), F.col("visuals") / F.col("pages"), F.col("level"), available)
    f = f.select("*", name.alias("processor"), sure.alias("confidence"))
    s = T.strategy(F.col("processor"), F.col("level"), F.col("pages"), available)
    return f.select("doc_id", "processor", "confidence", F.array_join(s["fallbacks"], "|").alias("fallbacks"), s["timeout"].alias("timeout"), s["cost"].alias("cost"))


@query("""select category, min_by(doc_id, case when coalesce(success, false) then processing_time end) as doc_id from (select * from {vlm} where processing_time is not null) group by category""")
def rt05_first_success(spark, folder):
    v = once(load(spark, folder, "vlm_results"), "doc_id").where("processing_time is not null").withColumn("ok", F.coalesce("success", F.lit(False)))
    return T.first_success(v, "category", "processing_time", "ok", "doc_id")


@query("""select doc_id, round(list_avg(list_filter([case when length(text_content) > 100 then 0.8::double when length(text_content) > 50 then 0.5 when length(text_content) > 0 then 0.2 end, vlm_confidence, case when success then 1.0 when not success then 0.0 end], lambda x: x is not null)), 6) as quality from {vlm}""")
def rt06_result_quality(spark, folder):
    q = T.result_quality(F.length("text_content"), F.col("vlm_confidence"), F.col("success").cast("double"))
    return once(load(spark, folder, "vlm_results"), "doc_id").select("doc_id", q.alias("quality"))


@query("select primary_model, least(600.0::double, greatest(60.0::double, 1.5 * list_sort(list(processing_time))[floor(0.95::double * (count(processing_time) - 1))::bigint + 1])) as timeout from {vlm} where processing_time is not null group by primary_model")
def rt07_adaptive_timeout(spark, folder):
    from lodestone.operators.aggregates import exact_floor_quantiles

    v = once(load(spark, folder, "vlm_results"), "doc_id")
    return exact_floor_quantiles(v, "primary_model", "processing_time", 0.95).select("primary_model", T.adaptive_timeout(F.col("quantile")).alias("timeout"))


@query("""with e as (select event_id, 'Answer: ' || coalesce(event_data, '') || ' done' as a from {events}), r as (select event_id, case when instr(a, '{{') > 0 and contains(a, '}}') and length(a) - instr(reverse(a), '}}') + 1 > instr(a, '{{') then substr(a, instr(a, '{{'), length(a) - instr(reverse(a), '}}') + 1 - instr(a, '{{') + 1) end as raw from e)
select event_id, case when raw is null then 0.4 when json_valid(raw) then coalesce(try_cast(json_extract_string(raw, '$.confidence') as double), 0.6) else 0.3 end::double as confidence, coalesce(json_valid(raw), false) as parsed from r""")
def rt08_parsed_answers(spark, folder):
    e = once(load(spark, folder, "pipeline_events"), "event_id")
    a = T.parsed_answer(F.concat(F.lit("Answer: "), F.coalesce("event_data", F.lit("")), F.lit(" done")))
    return e.select("event_id", a["confidence"].alias("confidence"), a["parsed"].alias("parsed"))


@query("select o_orderkey, round(o_totalprice / 1000 * 0.01 + o_custkey / 1000 * 0.03, 8) as cost, least(pow(2.0::double, o_orderkey % 8), 30.0) as wait from orders")
def rt10_costs(spark, folder):
    o = load(spark, folder, "orders")
    return o.select("o_orderkey", T.token_cost(F.col("o_totalprice"), F.col("o_custkey")).alias("cost"), T.backoff_seconds(F.col("o_orderkey") % 8).alias("wait"))


@query(f"""with p as (select doc_id, unnest(string_split(text_content, chr(12))) as text, generate_subscripts(string_split(text_content, chr(12)), 1) as page, vlm_content_type, vlm_confidence, coalesce(success, false) as ok from {{vlm}} where text_content is not null)
select doc_id, count(*) as pages, count_if(ok) as good_pages, round(avg(case when ok then vlm_confidence end), 6) as confidence, min(case when ok then vlm_content_type end) as kind,
md5(string_agg(case when ok and length({S.strip("text")}) > 0 then text end, chr(10) || chr(10) order by page)) as text_md5 from p group by doc_id""")
def rt11_roll_up_pages(spark, folder):
    v = once(load(spark, folder, "vlm_results"), "doc_id").where("text_content is not null")
    p = v.select("doc_id", F.posexplode(F.split("text_content", "\f")).alias("page", "text"), "vlm_content_type", "vlm_confidence", F.coalesce("success", F.lit(False)).alias("ok"))
    r = T.roll_up_pages(p, "doc_id", "page", "vlm_content_type", "vlm_confidence", "text", "ok")
    return r.select("doc_id", "pages", "good_pages", "confidence", "kind", F.md5("text").alias("text_md5"))


@query("select event_id, try_strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S')::varchar as at from events")
def dt02_pdf_dates(spark, folder):
    d = pdf_date(F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("Z")))
    return load(spark, folder, "events").select("event_id", F.date_format(d, "yyyy-MM-dd HH:mm:ss").alias("at"))


# --- the flagship ---------------------------------------------------------------------------------------------------
def retrieval(spark, folder, question: str = "Which records describe the quarterly budget?", k: int = 5):
    """GR-12: the question's vector, the nearest chunks of all documents, and their documents."""
    docs = _docs(spark, folder)
    chunks = K.chunk_documents(docs, K.regular_chunks(F.col("text_content")))
    index = chunks.select("chunk_id", "doc_id", F.length("text_chunk").cast("bigint").alias("context_size"), V.text_vector(F.col("text_chunk")).alias("vector"))
    asked = spark.range(1).select(F.col("id").alias("query_id"), V.text_vector(F.lit(question)).alias("query_vector"))
    hits = V.search(index, asked, "chunk_id", "vector", k, keep=("doc_id", "context_size"))
    return hits.join(docs.select("doc_id", "file_name"), "doc_id").select(F.col("rank").cast("bigint").alias("rank"), "doc_id", "file_name", "similarity", "context_size")


_QUESTION = "Which records describe the quarterly budget?"
_RETRIEVED = f"""{FOLD}, k as (select doc_id, chunk, sha256(doc_id || '|' || (row_number() over (partition by doc_id order by i) - 1)) as chunk_id from c),
s as (select chunk_id, doc_id, length(chunk)::bigint as context_size, round(list_cosine_similarity({_VEC.format("chunk")}, {_VEC.format(f"'{_QUESTION}'")}), 9) as similarity from k),
h as (select *, row_number() over (order by similarity desc, chunk_id)::bigint as rank from s qualify rank <= 5),
hits as (select h.rank, h.doc_id, d.file_name, h.similarity, h.context_size from h join {{docs}} d on d.doc_id = h.doc_id)"""


@query(_RETRIEVED + " select * from hits")
def gr12_retrieval(spark, folder):
    return retrieval(spark, folder, _QUESTION)


def archive_edges(docs):
    """Each document with the next of its archive."""
    of = docs.select("doc_id", F.get_json_object("metadata", "$.zip").alias("zip")).where("zip is not null")
    return of.select(F.col("doc_id").alias("src"), F.lead("doc_id").over(Window.partitionBy("zip").orderBy("doc_id")).alias("dst")).where("dst is not null")


@query(_RETRIEVED + """, z as (select doc_id, json_extract_string(metadata, '$.zip') as zip from {docs} where json_valid(metadata)), e as (select doc_id as a, lead(doc_id) over (partition by zip order by doc_id) as b from z where zip is not null),
n as (select a, b from e where b is not null union all select b, a from e where b is not null), r as (select a, b, count(*) as relevance, row_number() over (partition by a order by count(*) desc, b) as place from n group by a, b qualify place <= 10),
x as (select 'document' as kind, rank, doc_id, null as related, similarity as relevance from hits union all select 'related', hits.rank, hits.doc_id, r.b, r.relevance from hits join r on r.a = hits.doc_id where hits.rank <= 3)
select *, count(*) over ()::bigint as total_context_size from x""")
def gr12_bundle(spark, folder):
    """GR-12, JN-06: the hits, the documents related to the first three, and how many there are of both."""
    hits = cut(retrieval(spark, folder, _QUESTION))
    more = G.expand_hits(hits, archive_edges(_docs(spark, folder)))
    none = F.lit(None).cast("string")
    one = hits.select(F.lit("document").alias("kind"), "rank", "doc_id", none.alias("related"), F.col("similarity").alias("relevance"))
    both = cut(one.unionByName(more.select(F.lit("related").alias("kind"), "rank", "doc_id", "related", F.col("relevance").cast("double").alias("relevance"))))
    return both.withColumn("total_context_size", F.lit(both.count()))


@query("select doc_id, file_name, rank::bigint as rank from (select doc_id, file_name, row_number() over (partition by file_extension order by doc_id) as rank, file_extension from {docs}) where rank <= 3")
def tk11_first_of_kind(spark, folder):
    return R.top_k_per(_docs(spark, folder), ["file_extension"], 3, F.col("doc_id")).select("doc_id", "file_name", F.col("rank").cast("bigint").alias("rank"))
