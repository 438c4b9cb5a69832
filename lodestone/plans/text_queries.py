"""Queries over texts: classification, tags, quality, structure and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import is_blank, word_count
from lodestone.operators import chunking as K
from lodestone.operators import classify as C
from lodestone.plans import sqltext as S
from lodestone.plans.registry import query
from lodestone.tables import load, once


def _store(spark, folder):
    return once(load(spark, folder, "store_documents"), "doc_id")


def _join(c):
    return F.array_join(c, "|")


@query(f"""select doc_id, array_to_string(list_concat(ct, list_filter(l, lambda x: not list_contains(ct, x))), '|') as content_types
from (select doc_id, coalesce(content_type, []) as ct, {S.labels("text_content", C.TYPES_A)} as l from {{docs}})""")
def txt01_content_type_a(spark, folder):
    return _store(spark, folder).select("doc_id", _join(C.content_types(F.col("content_type"), F.col("text_content"))).alias("content_types"))


@query(f"""select doc_id, array_to_string(list_concat(ct, list_filter(l, lambda x: not list_contains(ct, x))), '|') as content_types
from (select doc_id, coalesce(content_type, []) as ct, {S.labels("text_content", C.TYPES_B)} as l from {{docs}})""")
def txt02_content_type_b(spark, folder):
    return _store(spark, folder).select("doc_id", _join(C.content_types(F.col("content_type"), F.col("text_content"), C.TYPES_B)).alias("content_types"))


@query(f"select doc_id, array_to_string(list_concat(coalesce(persuasion_tags, []), {S.labels('text_content', C.PERSUASION_A)}), '|') as tags from {{docs}}")
def txt03_persuasion_a(spark, folder):
    return _store(spark, folder).select("doc_id", _join(C.persuasion_a(F.col("persuasion_tags"), F.col("text_content"))).alias("tags"))


@query(f"""select doc_id, array_to_string(list_concat(ct, list_filter(l, lambda x: not list_contains(ct, x))), '|') as tags
from (select doc_id, coalesce(persuasion_tags, []) as ct, {S.labels("text_content", C.PERSUASION_B)} as l from {{docs}})""")
def txt04_persuasion_b(spark, folder):
    return _store(spark, folder).select("doc_id", _join(C.persuasion_b(F.col("persuasion_tags"), F.col("text_content"))).alias("tags"))


_BLANK = f"(text is null or length({S.strip('text')}) = 0)"
_PAIR_TEXT = "(select document_id, content_file.extracted_text as text, coalesce(not content_file.success, false) as failed from {pairs})"


def _pair_text(spark, folder):
    pairs = once(load(spark, folder, "pair_records"), "document_id")
    return pairs.select("document_id", F.col("content_file.extracted_text").alias("text"), F.coalesce(~F.col("content_file.success"), F.lit(False)).alias("failed"))


@query(f"""select document_id, round(greatest(0.0::double, 1.0::double - case when {_BLANK} then 0.5 when length(text) < 100 then 0.2 else 0 end - case when failed then 0.3 else 0 end), 6) as score,
concat_ws('|', case when {_BLANK} then 'no_text_content' end, case when not {_BLANK} and length(text) < 100 then 'very_short_content' end, case when failed then 'extraction_error' end) as issues from {_PAIR_TEXT}""")
def txt05_quality_a(spark, folder):
    score, issues = C.quality_a(F.col("text"), F.col("failed"))
    return _pair_text(spark, folder).select("document_id", score.alias("score"), _join(issues).alias("issues"))


@query("""select doc_id, round(least(1.0::double, greatest(0.0::double, 1.0::double - case when n = 0 then 0.5 when n < 100 then 0.3 else 0 end + case when n > 1000 then 0.2 else 0 end
+ case when coalesce(author <> '', false) then 0.1 else 0 end + case when created_at is not null then 0.1 else 0 end)), 6) as score
from (select *, length(coalesce(text_content, '')) as n from {docs})""")
def txt06_quality_b(spark, folder):
    return _store(spark, folder).select("doc_id", C.quality_b(F.col("text_content"), F.col("author"), F.col("created_at")).alias("score"))


@query(f"select document_id, round(greatest(0.0::double, 1.0::double - case when failed then 0.5 else 0 end - case when {_BLANK} then 0.3 when length(text) < 50 then 0.2 else 0 end), 6) as score from {_PAIR_TEXT}")
def txt07_quality_c(spark, folder):
    return _pair_text(spark, folder).select("document_id", C.quality_c(F.col("text"), F.col("failed")).alias("score"))


@query(f"select doc_id, n as words, case when n < 100 then 'short' when n < 1000 then 'medium' else 'long' end as size from (select doc_id, coalesce(len({S.words('text')}), 0)::bigint as n from documents)")
def txt08_size_category(spark, folder):
    d = load(spark, folder, "documents")
    return d.select("doc_id", word_count(F.col("text")).alias("words"), C.size_category(F.col("text")).alias("size"))


@query(r"""select doc_id, (regexp_matches(t, 'From:.*@')::bigint + regexp_matches(t, 'To:.*@')::bigint + regexp_matches(t, 'Sent:.*[0-9][:/][0-9][:/][0-9]')::bigint + contains(t, 'Subject:')::bigint
+ contains(t, 'CC:')::bigint + contains(t, 'BCC:')::bigint + contains(t, 'Reply-To:')::bigint) as patterns from (select doc_id, regexp_replace(coalesce(text, ''), '\r', '', 'g') as t from documents)""")
def txt10_email_patterns(spark, folder):
    d = load(spark, folder, "documents")
    return d.select("doc_id", C.email_pattern_count(F.regexp_replace("text", "\r", "")).alias("patterns"))


@query(f"""select doc_id, ((coalesce(len({S.words("t")}), 0) < 100)::bigint + (length(t) - length(replace(t, '•', '')) > 3 or length(t) - length(replace(t, '-', '')) > 3)::bigint) as signs
from (select doc_id, coalesce(text, '') as t from documents)""")
def txt11_presentation_signs(spark, folder):
    return load(spark, folder, "documents").select("doc_id", C.presentation_signs(F.col("text")).alias("signs"))


@query(r"""select doc_id, len(string_split_regex(t, '\n[ \t]*\n')) >= 2 and len(string_split(t, chr(10))) >= 5 as is_document from (select doc_id, coalesce(text, '') as t from documents)""")
def txt09_document_pages(spark, folder):
    return load(spark, folder, "documents").select("doc_id", C.has_document_pages(F.col("text")).alias("is_document"))


@query(r"""select doc_id, case when regexp_matches(t, '\breport\b') then 'report' when regexp_matches(t, '\b(?:article|abstract)\b') then 'article' when regexp_matches(t, '\bpaper\b') then 'paper'
when regexp_matches(t, '\b(?:manual|guide)\b') then 'manual' when regexp_matches(t, '\b(?:contract|agreement)\b') then 'contract' else 'generic' end as document_type
from (select doc_id, lower(coalesce(text_content, '')) as t from {docs})""")
def txt12_document_type(spark, folder):
    return _store(spark, folder).select("doc_id", C.document_type(F.col("text_content")).alias("document_type"))


@query(f"select doc_id, md5(coalesce({S.strip(chr(39).join(['regexp_replace(text_content, ', chr(92) + 'n' + chr(92) + 'n' + chr(92) + 'n+', ', chr(10) || chr(10), ', 'g', ')']))}, '')) as clean_md5 from {{docs}}")
def txt13_clean_text(spark, folder):
    return _store(spark, folder).select("doc_id", F.md5(F.coalesce(C.clean_text(F.col("text_content")), F.lit(""))).alias("clean_md5"))


@query(rf"""with s as (select doc_id, string_split(string_split_regex(coalesce(text, ''), '--- SLIDE [0-9]+ ---')[2], chr(10)) as l from documents where category = 'Presentations'),
t as (select doc_id, list_filter(list_transform(coalesce(l, []), lambda x: {S.strip("x")}), lambda x: x <> '') as l from s)
select doc_id, coalesce(case when length(l[1]) < 80 and length(l[2]) < 80 and not regexp_matches(l[2], '^[•\-*]') then l[1] || ' ' || l[2] when length(l[1]) < 80 then l[1] else '' end, '') as title from t""")
def txt14_slide_title(spark, folder):
    d = load(spark, folder, "documents").where(F.col("category") == "Presentations")
    first = F.try_element_at(F.split(F.coalesce("text", F.lit("")), "--- SLIDE [0-9]+ ---"), F.lit(2))
    return d.select("doc_id", C.slide_title(first)[0].alias("title"))


_HEADS = {"from": "From|From:", "to": "To|To:", "cc": "CC|Cc|CC:|Cc:", "subject": "Subject|Subject:", "date": "Date|Sent|Date:|Sent:"}
MAIL = (
    r"with d as (select document_id, coalesce(content_file.extracted_text, '') as t from {pairs} where lower(trim(category)) = 'emails'),"
    + " h as (select document_id, t, " + ", ".join(rf"""{S.strip(rf"regexp_extract(t, '(?:{f})\s+([^\n]*?)\r?\n', 1)")} as "{n}" """ for n, f in _HEADS.items())
    + ", greatest(" + ", ".join(rf"length(regexp_extract(t, '(?s)^.*?(?:{_HEADS[n]})\s+[^\n]*?\r?\n'))" for n in ("from", "to", "subject", "date")) + ") as e from d),"
    + r" r as (select *, substr(t, e + 1) as rest from h), b as (select *, length(regexp_extract(rest, '(?s)^.*?\n\s*\n')) as k from r),"
    + " c as (select *, " + S.strip("case when e = 0 then '' when k > 0 then substr(rest, k + 1) else rest end") + " as body from b),"
    + r" p as (select *, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '----+ ?Original Message ?----+', chr(57344), 'g'), '----+ ?Forwarded Message ?----+', chr(57344), 'g'), 'On [^\n\x{{E000}}]* wrote:', chr(57344), 'g'), 'From:[^\n\x{{E000}}]*Sent:[^\n\x{{E000}}]*To:[^\n\x{{E000}}]*Subject:', chr(57344), 'g'), chr(57344)) as parts from c)"
    + """ select document_id, "from", "to", cc, subject, date, md5(body) as body_md5, case when len(parts) > 1 then md5(array_to_string(parts, '|')) end as parts_md5, case when contains("from", '@') then "from" end as author from p"""
)


@query(MAIL)
def txt16_email_fields(spark, folder):
    p = once(load(spark, folder, "pair_records").where(F.lower(F.trim("category")) == "emails"), "document_id")
    f = C.email_fields(F.col("content_file.extracted_text"))
    return p.select("document_id", *(f[k].alias(k) for k in ("from", "to", "cc", "subject", "date")), F.md5(f["body"]).alias("body_md5"), F.md5(F.array_join(f["thread_parts"], "|")).alias("parts_md5"), C.promoted_author(f["from"], F.lit(None).cast("string")).alias("author"))


@query(f"""select doc_id, {"case " + " ".join(f"when {S.any_of('lower(coalesce(file_name, {q}))'.replace('{q}', chr(39) * 2), t)} then {S.lit(k)}" for k, t in C.IMAGE_NAMES.items())} else 'general_image' end as by_name,
case when {S.any_of("lower(coalesce(text_content, ''))", ("chart", "graph"))} then 'chart' when {S.any_of("lower(coalesce(text_content, ''))", ("diagram", "flow"))} then 'diagram' else 'general_image' end as by_text from {{docs}}""")
def txt18_image_type(spark, folder):
    return _store(spark, folder).select("doc_id", C.image_type_by_name(F.col("file_name")).alias("by_name"), C.image_type_by_text(F.col("text_content")).alias("by_text"))


@query(rf"""with d as (select doc_id, coalesce(text, '') as t from documents where category = 'Images'), l as (select *, list_transform(string_split(t, chr(10)), lambda x: {S.strip("x")}) as ls from d)
select doc_id, case when regexp_matches(lower(t), 'bar|column') then 'bar_chart' when regexp_matches(lower(t), 'pie|donut') then 'pie_chart' when regexp_matches(lower(t), 'line|trend') then 'line_chart' else 'unknown' end as chart_kind,
md5(array_to_string(list_filter(ls, lambda x: regexp_matches(lower(x), 'axis|x:|y:')), '|')) as axes_md5,
array_to_string(list_slice(regexp_extract_all(t, '[0-9]+\.?[0-9]*'), 1, 20), ' ') as numbers, coalesce(list_filter(ls, lambda x: length(x) > 10)[1], '') as title from l""")
def txt20_chart_facts(spark, folder):
    f = C.chart_facts(F.col("text"))
    return load(spark, folder, "documents").where("category = 'Images'").select("doc_id", f["chart_kind"].alias("chart_kind"), F.md5(F.array_join(f["axes"], "|")).alias("axes_md5"), F.array_join(f["numbers"], " ").alias("numbers"), f["title"].alias("title"))


@query(rf"""with d as (select doc_id, coalesce(text, '') as t from documents where category = 'Images')
select doc_id, case when regexp_matches(lower(t), 'flow|process|step') then 'flowchart' when regexp_matches(lower(t), 'architecture|system|component') then 'architecture_diagram' when regexp_matches(lower(t), 'network|node|connection') then 'network_diagram' else 'general_diagram' end as diagram_kind,
md5(array_to_string(list_slice(list_filter(list_transform(string_split(t, chr(10)), lambda x: {S.strip("x")}), lambda x: length(x) > 2), 1, 20), '|')) as components_md5, contains(t, '->') or contains(t, '→') as arrows from d""")
def txt21_diagram_facts(spark, folder):
    f = C.diagram_facts(F.col("text"))
    return load(spark, folder, "documents").where("category = 'Images'").select("doc_id", f["diagram_kind"].alias("diagram_kind"), F.md5(F.array_join(f["components"], "|")).alias("components_md5"), f["arrows"].alias("arrows"))


@query(r"""with d as (select doc_id, coalesce(text_content, '') as t from {docs})
select doc_id, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(lower(x), 'room|bedroom|bathroom|kitchen|living|dining|office|garage|hall|closet|patio|deck')))::bigint as rooms,
array_to_string(list_slice(regexp_extract_all(t, '[0-9]+\.?[0-9]*[''"\s]*x\s*[0-9]+\.?[0-9]*[''"\s]*'), 1, 10), '|') as measurements,
array_to_string(regexp_extract_all(lower(t), '[0-9]+\.?[0-9]*\s*(?:sq\.?\s*ft\.?|square feet)'), '|') as areas from d""")
def txt22_floor_plan_facts(spark, folder):
    f = C.floor_plan_facts(F.col("text_content"))
    return _store(spark, folder).select("doc_id", F.size(f["rooms"]).cast("bigint").alias("rooms"), F.array_join(f["measurements"], "|").alias("measurements"), F.array_join(f["areas"], "|").alias("areas"))


@query(rf"""with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, len(list_filter(list_slice(string_split(t, chr(10)), 1, 10), lambda x: contains(x, ':')))::bigint as header_lines,
len(list_filter(string_split(t, chr(10)), lambda x: length({S.strip("x")}) > 0 and length(x) < 100))::bigint as short_lines,
(length(t) - length(replace(t, '---', '')))::bigint // 3 + 1 as slides from d""")
def txt23_structure_counts(spark, folder):
    f = C.structure_counts(F.col("text"))
    return load(spark, folder, "documents").select("doc_id", *(c.alias(k) for k, c in f.items()))


_SPACE = r"\t-\r\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}"


@query(
    "with d as (select doc_id, coalesce(text, '') as t from documents), w as (select *, regexp_replace(t, '[" + _SPACE + r"]', '', 'g') as bare from d) select doc_id, length(" + S.strip("t")
    + r""") >= 10 and not contains(t, 'PK' || chr(3) || chr(4)) and not regexp_matches(t, '\\u[0-9a-fA-F]{{4}}') and not regexp_matches(t, '[^\x20-\x7E""" + _SPACE + r"""]{{20}}')
and length(t) - (length(bare) - length(regexp_replace(bare, '\p{{C}}', '', 'g'))) >= 0.7 * length(t) as valid from w"""
)
def txt30_valid_text(spark, folder):
    return load(spark, folder, "documents").select("doc_id", C.valid_text(F.col("text")).alias("valid"))


@query(r"""with d as (select document_id, coalesce(metadata_file.extracted_text, '') as t from {pairs})
select document_id, """ + ", ".join(rf"""nullif(trim(regexp_extract(t, '(?:^|\n){n}:[ \t]*([^\n]*)', 1)), '') as "{n.lower().replace(' ', '_')}" """ for n in ("Title", "Author", "Document Date", "Type", "Pages", "ID", "Collection", "Bates Number")) + " from d")
def txt40_info_sheet(spark, folder):
    p = once(load(spark, folder, "pair_records"), "document_id")
    f = C.info_sheet(F.col("metadata_file.extracted_text"), "Title", "Author", "Document Date", "Type", "Pages", "ID", "Collection", "Bates Number")
    return p.select("document_id", *(c.alias(n.lower().replace(" ", "_")) for n, c in f.items()))


@query("""with d as (select document_id, coalesce(content_file.extracted_text, '') as p, coalesce(metadata_file.extracted_text, '') as v, coalesce(length(metadata_file.extracted_text), 0) % 10 / 10.0::double as c, category as k from {pairs})
select document_id, length(case when length(v) > 1.2 * length(p) then v when length(v) > 100 then v || repeat(' ', 32) || p else p end)::bigint as n,
case when length(v) > 1.2 * length(p) then 'vlm_enhanced' when length(v) > 100 then 'hybrid' else 'traditional' end as text_source,
array_to_string(case when c > 0.7 then [coalesce(k, 'mixed')] else list_sort(list_distinct([coalesce(k, 'mixed'), 'document', 'pdf'])) end, '|') as types from d""")
def txt41_merge_extractions(spark, folder):
    p = once(load(spark, folder, "pair_records"), "document_id")
    sure = F.coalesce(F.length("metadata_file.extracted_text"), F.lit(0)) % 10 / 10.0
    m = C.merge_extractions(F.col("content_file.extracted_text"), F.col("metadata_file.extracted_text"), sure, F.array(F.lit("pdf"), F.lit("document")), F.col("category"))
    return p.select("document_id", F.length(m["text"]).cast("bigint").alias("n"), m["text_source"].alias("text_source"), F.array_join(m["types"], "|").alias("types"))


# --- chunks ---------------------------------------------------------------------------------------------------------
FOLD = rf"""with recursive p as (select doc_id, string_split_regex(text_content, '\n{S.SP}*\n') as ps from {{docs}} where length(text_content) > 0),
f as (select doc_id, ps, 0 as i, '' as cur, cast(null as varchar) as done from p
union all select doc_id, ps, i + 1,
case when length(cur) + length(ps[i + 1]) > 500 then case when length(cur) > 0 then array_to_string(list_slice({S.words("cur")}, -50, -1), ' ') || ' ' || ps[i + 1] else ps[i + 1] end
when length(cur) > 0 then cur || chr(10) || chr(10) || ps[i + 1] else ps[i + 1] end,
case when length(cur) + length(ps[i + 1]) > 500 and length(cur) > 0 then {S.strip("cur")} end from f where i < len(ps)),
c as (select doc_id, i, done as chunk from f where done is not null union all select doc_id, i + 1, {S.strip("cur")} from f where i = len(ps) and length(cur) > 0)
"""


@query(FOLD + "select doc_id, (row_number() over (partition by doc_id order by i) - 1)::bigint as ord, length(chunk)::bigint as n, md5(chunk) as chunk_md5 from c")
def chk02_regular_chunks(spark, folder):
    c = K.chunk_documents(_store(spark, folder), K.regular_chunks(F.col("text_content")))
    return c.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.length("text_chunk").cast("bigint").alias("n"), F.md5("text_chunk").alias("chunk_md5"))


@query(rf"""with d as (select document_id, content_file.extracted_text as t from {{pairs}} where lower(trim(category)) = 'emails' and regexp_matches(content_file.extracted_text, '{K.EMAIL_MARKS}')),
s as (select document_id, list_transform(string_split_regex(t, '{K.EMAIL_MARKS}'), lambda x, i: {{{{'ord': i - 1, 'chunk': {S.strip("x")}}}}}) as l from d)
select document_id, c.ord::bigint as ord, 'email_part_' || c.ord as tag, md5(c.chunk) as chunk_md5 from (select document_id, unnest(l) as c from s) where c.chunk <> ''""".replace("{{{{", "{{").replace("}}}}", "}}"))
def chk03_email_parts(spark, folder):
    p = once(load(spark, folder, "pair_records"), "document_id").where(F.lower(F.trim("category")) == "emails")
    p = p.select("document_id", F.col("content_file.extracted_text").alias("t")).where(F.col("t").rlike(K.EMAIL_MARKS))
    c = K.chunk_documents(p, K.email_chunks(F.col("t")), key="document_id")
    return c.select(F.col("doc_id").alias("document_id"), F.col("ord").cast("bigint").alias("ord"), F.col("tag_context")[0].alias("tag"), F.md5("text_chunk").alias("chunk_md5"))


@query(rf"""with d as (select doc_id, regexp_replace(text, '(---[ \t\n\r\f\x0B]*SLIDE[ \t\n\r\f\x0B]+[0-9]+[ \t\n\r\f\x0B]*---)', chr(57344) || '\1', 'g') as t from documents where regexp_matches(text, '---[ \t\n\r\f\x0B]*SLIDE[ \t\n\r\f\x0B]+[0-9]+[ \t\n\r\f\x0B]*---')),
s as (select doc_id, unnest((string_split(t, chr(57344)))[2:]) as x, generate_subscripts((string_split(t, chr(57344)))[2:], 1) - 1 as ord from d)
select doc_id::varchar as doc_id, ord::bigint as ord, 'slide_' || regexp_extract(x, '{K.SLIDE_NUMBER}', 1) as tag, md5({S.strip("x")}) as chunk_md5 from s""")
def chk04_slides(spark, folder):
    d = load(spark, folder, "documents").where(F.col("text").rlike(K.SLIDE_MARK))
    c = K.chunk_documents(d, K.presentation_chunks(F.col("text")))
    return c.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.col("tag_context")[0].alias("tag"), F.md5("text_chunk").alias("chunk_md5"))


@query(rf"""with d as (select doc_id, coalesce(text, '') as t from documents where category = 'Images'),
s as (select doc_id, contains(t, '[Visual Element') as v, unnest(case when contains(t, '[Visual Element') then string_split_regex(t, '{K.VISUAL_MARK}') else [t] end) as x,
generate_subscripts(case when contains(t, '[Visual Element') then string_split_regex(t, '{K.VISUAL_MARK}') else [t] end, 1) - 1 as ord from d)
select doc_id::varchar as doc_id, ord::bigint as ord, case when not v then null when ord = 0 then 'general' else 'visual_element_' || ord end as tag, md5({S.strip("x")}) as chunk_md5 from s where not v or {S.strip("x")} <> ''""")
def chk05_image_chunks(spark, folder):
    d = load(spark, folder, "documents").where("category = 'Images'")
    c = K.chunk_documents(d, K.image_chunks(F.col("text")))
    return c.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.try_element_at("tag_context", F.lit(1)).alias("tag"), F.md5("text_chunk").alias("chunk_md5"))


_EM = r"----+ ?Original Message ?----+|----+ ?Forwarded Message ?----+|On [^\n]* wrote:|From:[^\n]*Sent:[^\n]*To:[^\n]*Subject:"
_SL = r"---[ \t\n\r\f\x0B]*SLIDE[ \t\n\r\f\x0B]+[0-9]+[ \t\n\r\f\x0B]*---"
_DISPATCH = FOLD.replace("{docs}", f"(select doc_id, text as text_content from documents where not coalesce(category = 'Emails' and regexp_matches(text, '{_EM}') or category = 'Presentations' and regexp_matches(text, '{_SL}') or category = 'Images', false))").replace("{{", "{").replace("}}", "}") + rf""",
e as (select doc_id, unnest(string_split_regex(text, '{_EM}')) as x, generate_subscripts(string_split_regex(text, '{_EM}'), 1) - 1 as ord from documents where category = 'Emails' and regexp_matches(text, '{_EM}')),
w as (select doc_id, string_split(regexp_replace(text, '({_SL})', chr(57344) || '\1', 'g'), chr(57344))[2:] as l from documents where category = 'Presentations' and regexp_matches(text, '{_SL}')),
s as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as ord from w),
v as (select doc_id, coalesce(text, '') as t, contains(coalesce(text, ''), '[Visual Element') as v, string_split_regex(coalesce(text, ''), '\[Visual Element[^\]]*\]:') as l from documents where category = 'Images'),
g as (select doc_id, v, unnest(case when v then l else [t] end) as x, generate_subscripts(case when v then l else [t] end, 1) - 1 as ord from v),
every as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as ord, '' as tags, chunk as x from c
union all select doc_id, ord, 'email_part_' || ord, {S.strip("x")} from e where {S.strip("x")} <> ''
union all select doc_id, ord, 'slide_' || regexp_extract(x, '^---[ \t\n\r\f\x0B]*SLIDE[ \t\n\r\f\x0B]+([0-9]+)', 1), {S.strip("x")} from s
union all select doc_id, ord, case when not v then '' when ord = 0 then 'general' else 'visual_element_' || ord end, {S.strip("x")} from g where not v or {S.strip("x")} <> '')
select doc_id::varchar as doc_id, ord::bigint as ord, tags, length(x)::bigint as n from every"""


@query(_DISPATCH.replace("{", "{{").replace("}", "}}"))
def chk01_dispatch(spark, folder):
    d = load(spark, folder, "documents")
    kinds = F.create_map(*(F.lit(x) for kv in {"Emails": "email", "Presentations": "presentation", "Images": "image"}.items() for x in kv))
    types = F.when(kinds[F.col("category")].isNotNull(), F.array(kinds[F.col("category")])).otherwise(F.array().cast("array<string>"))
    c = K.chunk_documents(d, K.chunks_by_type(types, F.col("text")))
    return c.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.array_join("tag_context", "|").alias("tags"), F.length("text_chunk").cast("bigint").alias("n"))


@query(f"""select category, count(*) as n, count_if({_BLANK}) as n_blank, sum(length(text))::bigint as n_chars from documents group by category""")
def src32_text_profile(spark, folder):
    d = load(spark, folder, "documents")
    return d.groupBy("category").agg(F.count("*").alias("n"), F.count_if(is_blank(F.col("text"))).alias("n_blank"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))
