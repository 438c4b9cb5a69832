"""Queries through office files, directories, vector tables and the views of the graph."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions.json import item_types
from lodestone.operators import chunking as K
from lodestone.operators import classify as C
from lodestone.operators import graph as G
from lodestone.operators import pairing as P
from lodestone.operators import vectors as V
from lodestone.operators import windows as W
from lodestone.plans import sqltext as S
from lodestone.plans.graph_queries import _LIST, _docs, _listing
from lodestone.plans.registry import query
from lodestone.plans.text_queries import FOLD
from lodestone.sources import archives as Z
from lodestone.sources import formats
from lodestone.tables import checkpoint_dir, load, once


def _pairs(spark, folder):
    return once(load(spark, folder, "pair_records"), "document_id")


# --- chunks ---------------------------------------------------------------------------------------------------------
@query(FOLD.replace("> 500", "> 300").replace("-50, -1", "-30, -1") + "select doc_id, (row_number() over (partition by doc_id order by i) - 1)::bigint as ord, md5(chunk) as chunk_md5 from c")
def chk06_email_sizes(spark, folder):
    """Chunks with the limit and overlap of mails."""
    c = K.chunk_documents(_docs(spark, folder), K.sized_chunks("email", F.col("text_content")))
    return c.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.md5("text_chunk").alias("chunk_md5"))


@query(rf"""with d as (select doc_id, regexp_replace(text, '---[ \t\n\r\f\x0B]*(SLIDE[ \t\n\r\f\x0B]+[0-9]+)[ \t\n\r\f\x0B]*---', '=== \1 ===', 'g') as t from documents where regexp_matches(text, '--- SLIDE [0-9]+ ---')),
s as (select doc_id, string_split(regexp_replace(t, '===[ \t\n\r\f\x0B]*SLIDE[ \t\n\r\f\x0B]+([0-9]+)[ \t\n\r\f\x0B]*===', chr(57344) || '--- SLIDE \1 ---', 'g'), chr(57344))[2:] as l from d)
select doc_id::varchar as doc_id, len(l)::bigint as slides, md5(array_to_string(list_transform(l, lambda x: {S.strip("x")}), '|')) as chunks_md5 from s""")
def chk07_office_slides(spark, folder):
    """Slides under the mark of office files."""
    d = load(spark, folder, "documents").where(F.col("text").rlike("--- SLIDE [0-9]+ ---"))
    d = d.select("doc_id", F.regexp_replace("text", r"---[ \t\n\r\f\x0B]*(SLIDE[ \t\n\r\f\x0B]+[0-9]+)[ \t\n\r\f\x0B]*---", "=== $1 ===").alias("t"))
    chunks = F.transform(K.office_slide_chunks(F.col("t")), lambda c: F.regexp_replace(c["chunk"], r"^---[ \t\n\r\f\x0B]*SLIDE[ \t\n\r\f\x0B]+([0-9]+)[ \t\n\r\f\x0B]*---", "--- SLIDE $1 ---"))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.size(chunks).cast("bigint").alias("slides"), F.md5(F.array_join(chunks, "|")).alias("chunks_md5"))


# --- pairs and the graph --------------------------------------------------------------------------------------------
@query(f"""with f as (select *, regexp_matches(lower(regexp_replace(path, '[.][^.]*$', '')), 'info|metadata') as about, row_number() over (partition by zip order by size, ord) as place from {_LIST} where ends_with(lower(path), '.pdf')),
g as (select zip, count(*) as n, max_by(path, ord) filter (about) as m, max_by(path, ord) filter (not about and starts_with(path, base)) as c, max(path) filter (place = 1) as first, max(path) filter (place = 2) as second from f group by zip)
select zip, case when m is not null and c is not null then c else second end as content, case when m is not null and c is not null then m else first end as metadata from g where n >= 2""")
def pair07_vision_pairs(spark, folder):
    return P.vision_pairs(_listing(spark, folder))


@query("select distinct metadata_file.file_name as src, 'DESCRIBES' as type, content_file.file_name as dst from {pairs} where metadata_file.file_name is not null and content_file.file_name is not null")
def gr08_describes(spark, folder):
    return G.describes(_pairs(spark, folder), F.col("metadata_file.file_name"), F.col("content_file.file_name")).select("src", "type", "dst")


_EDGES = """(select distinct doc_id as src, 'AUTHORED_BY' as type, 'Person' as label, case when contains(author, '@') then author else replace(lower(author), ' ', '.') || '@placeholder.com' end as dst from {docs} where length(trim(author)) > 0
union all select distinct doc_id, 'HAS_TYPE', 'ContentType', t from (select doc_id, unnest(content_type) as t from {docs}) where t is not null)"""


def _topic_edges(spark, folder):
    d = _docs(spark, folder)
    return G.document_edges(d, W.topics(d, "doc_id", "text_content")), d


@query("select src as doc_id, 'out' as direction, type, label, dst as id from " + _EDGES)
def gr11_subgraph(spark, folder):
    """What is around every document; the edges have topics, which are left out (FLT-12)."""
    e, d = _topic_edges(spark, folder)
    return G.subgraph(e, d, include_topics=False)


_TERMS = r"list_filter(regexp_extract_all(lower(text_content), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z][a-z]+') and x not in ('the', 'and', 'that', 'for', 'with', 'this', 'are', 'from'))"
_TOPICS = rf"""(select doc_id, term from (select doc_id, term, row_number() over (partition by doc_id order by count(*) desc, min(pos)) as r from (select doc_id, unnest({_TERMS}) as term, generate_subscripts({_TERMS}, 1) as pos from {{docs}}) group by doc_id, term) where r <= 5)"""


@query(f"select src as doc_id, 'out' as direction, type, label, dst as id from {_EDGES} union all select doc_id, 'out', 'CONTAINS', 'Topic', term from {_TOPICS}")
def gr11_subgraph_with_topics(spark, folder):
    e, d = _topic_edges(spark, folder)
    return G.subgraph(e, d)


@query(f"select src, type, label as dst_label, dst from {_EDGES} union all select doc_id, 'CONTAINS', 'Topic', term from {_TOPICS}")
def gr06_topic_edges(spark, folder):
    return _topic_edges(spark, folder)[0].select("src", "type", "dst_label", "dst")


# --- office files, CSV and directories -------------------------------------------------------------------------------
def _lines(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").replace("\r", "\n").split("\n") if x.strip()]


def _escape(t: str) -> str:
    """A text as XML 1.0 holds it."""
    t = "".join(c for c in t if c in "\t\n" or c >= " " and c not in "￾￿" and not "\ud800" <= c <= "\udfff")
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _packed(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def _office(read, schema: str):
    """A pass that builds a file of each document's id, author and number of types, and reads it again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [x for doc, author, n in zip(pdf["doc_id"], pdf["author"], pdf["n"]) for x in read(doc, author or "", int(n))]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return lambda df: df.select("doc_id", "author", F.greatest(F.size("content_type"), F.lit(0)).alias("n")).mapInPandas(run, schema)


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _word(doc, author, n):
    p = lambda t: f"<w:p><w:r><w:t>{_escape(t)}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join(f"<w:tr><w:tc>{p(f'key {i}')}</w:tc><w:tc>{p('value')}</w:tc></w:tr>" for i in range(n)) + "</w:tbl>"
    raw = _packed({"word/document.xml": f"<w:document {_W}><w:body>{p(f'Record {doc}')}{p(' ')}{table}{p('The end')}</w:body></w:document>", "docProps/core.xml": f"<c><creator>{_escape(author)}</creator><created>2024-01-01</created></c>"})
    f = formats.word_facts(raw)
    yield doc, f["paragraphs"], f["tables"], f["word_count"], f["text"]


@query("select doc_id, 2::bigint as paragraphs, 1::bigint as tables, (4 + 4 * n)::bigint as words, 'Record ' || doc_id || chr(10) || 'The end' || chr(10) || array_to_string(list_transform(range(n), lambda i: 'key ' || i || ' | value'), chr(10)) as text from (select doc_id, coalesce(len(content_type), 0) as n from {docs})")
def src27_word_facts(spark, folder):
    return _office(_word, "doc_id string, paragraphs bigint, tables bigint, words bigint, text string")(_docs(spark, folder))


def _slides(doc, author, n):
    s = lambda i: f"<sld><sp><txBody><p><t>Slide {i} of {doc}</t></p></txBody></sp>" + ("<pic/>" if i % 2 else "<graphicFrame><chart/></graphicFrame>") + "</sld>"
    files = {f"ppt/slides/slide{i + 1}.xml": s(i) for i in range(n)} | {"ppt/notesSlides/notesSlide1.xml": "<n><p><t>Say it</t></p></n>"}
    for f in formats.slides_facts(_packed(files)):
        yield doc, f["slide_number"], f["shapes_count"], f["has_image"], f["has_chart"], f["text_length"], f["notes"]


@query("select doc_id, i + 1 as slide, 2::bigint as shapes, i % 2 = 1 as image, i % 2 = 0 as chart, length('Slide ' || i || ' of ' || doc_id) + case when i = 0 then 16 else 0 end as n_chars, case when i = 0 then 'Say it' else '' end as notes from (select doc_id, unnest(range(len(content_type))) as i from {docs})")
def src28_slide_facts(spark, folder):
    return _office(_slides, "doc_id string, slide bigint, shapes bigint, image boolean, chart boolean, n_chars bigint, notes string")(_docs(spark, folder))


@query("select doc_id, sum(length('Slide ' || i || ' of ' || doc_id) + case when i = 0 then 16 else 0 end)::bigint as n_chars, true as visual from (select doc_id, unnest(range(len(content_type))) as i from {docs}) group by doc_id")
def ag27_slide_totals(spark, folder):
    s = src28_slide_facts(spark, folder)
    return s.groupBy("doc_id").agg(F.sum("n_chars").cast("bigint").alias("n_chars"), F.bool_or(F.col("image") | F.col("chart")).alias("visual"))


def _sheets(doc, author, n):
    row = lambda cells: "<row>" + "".join(f'<c r="{chr(65 + k)}1" t="str"><v>{_escape(str(c))}</v></c>' for k, c in enumerate(cells)) + "</row>"
    sheets = {f"xl/worksheets/sheet{k + 1}.xml": "<s>" + row(["name", "value"]) + "".join(row([f"{doc} {i}", i * (k + 1)]) for i in range(n)) + "</s>" for k in range(2)}
    book = '<w><sheets><sheet name="First"/><sheet name="Second"/></sheets></w>'
    for f in formats.sheet_facts(_packed(sheets | {"xl/workbook.xml": book})):
        v = f["stats"].get("value", {"count": 0, "mean": None})
        yield doc, f["name"], f["rows"], f["columns"], v["count"], v["mean"], f["head"][0][0]


@query("select doc_id, s.name as sheet, n + 1 as rows, 2::bigint as columns, n as numbers, case when n > 0 then s.k * (n - 1) / 2.0::double end as mean, 'name' as head from (select doc_id, coalesce(len(content_type), 0)::bigint as n from {docs}), (select 'First' as name, 1 as k union all select 'Second', 2) s")
def src23_sheet_facts(spark, folder):
    return _office(_sheets, "doc_id string, sheet string, rows bigint, columns bigint, numbers bigint, mean double, head string")(_docs(spark, folder))


@query("select doc_id as src, 'CONTAINS_SHEET' as type, doc_id || '#' || s.name as dst from {docs}, (select 'First' as name union all select 'Second') s")
def gr10_sheet_edges(spark, folder):
    d = src23_sheet_facts(spark, folder).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("sheet").alias("name"))).alias("sheets"))
    return G.sheet_edges(d, "doc_id", "sheets").select("src", "type", "dst")


def _csv(doc, author, n):
    raw = ("id,kind,note\n" + "".join(f"{doc},{i},{'x' if i % 2 else ' '}\n" for i in range(60 * n))).encode()
    p, (text, rows, columns) = formats.csv_profile(raw, f"{doc}.csv"), formats.csv_first(raw)
    yield doc, p["row_count"], p["column_count"], p["filled"].get("note", 0), p["fill_rate"].get("note", 0.0), p["text"], rows, columns, text.count("\n") + 1


@query("""select doc_id, 60 * n as rows, 3::bigint as columns, 30 * n as noted, case when n > 0 then 0.5 else 0 end::double as rate,
'CSV File: ' || doc_id || '.csv' || chr(10) || 'Headers: id, kind, note' || chr(10) || 'Total Rows: ' || (60 * n) || chr(10) || chr(10) || '=== DATA PREVIEW ===' || chr(10) || 'id | kind | note' || chr(10) || repeat('-', 16)
|| coalesce(array_to_string(list_transform(range(least(60 * n, 100)), lambda i: chr(10) || doc_id || ' | ' || i || ' | ' || case when i % 2 = 1 then 'x' else ' ' end), ''), '') || case when n > 1 then chr(10) || chr(10) || '... (' || (60 * n - 100) || ' more rows)' else '' end as text,
60 * n + 1 as all_rows, 3::bigint as all_columns, least(60 * n + 1, 100) as shown_rows from (select doc_id, coalesce(len(content_type), 0)::bigint as n from {docs})""")
def src25_csv_profile(spark, folder):
    """SRC-25 and SRC-26: the profile of a CSV file, and its first 100 rows with the number of all."""
    return _office(_csv, "doc_id string, rows bigint, columns bigint, noted bigint, rate double, text string, all_rows bigint, all_columns bigint, shown_rows bigint")(_docs(spark, folder))


@query("select event_id, case when json_valid(event_data) then case when starts_with(trim(event_data), '{{') then 'boolean|null|number|object|string' end end as types from {events}")
def ag32_item_types(spark, folder):
    """Of an array of a number, a text, true, nothing and the event's object, whose types are known; null for broken data."""
    e = once(load(spark, folder, "pipeline_events"), "event_id")
    fine = F.json_object_keys("event_data").isNotNull() & F.try_parse_json("event_data").isNotNull()
    raw = F.when(fine, F.concat(F.lit('[1.5, "x", true, null, '), F.col("event_data"), F.lit(", 7, 8, 9, 10, 11, [1]]")))
    return e.select("event_id", F.array_join(item_types(raw), "|").alias("types"))


@query("select count(distinct zip_file) as zips, count(*) as pairs from {pairs}")
def ag33_total_zips(spark, folder):
    """The sum over the categories of what each archive counts for once."""
    p = _pairs(spark, folder)
    per = p.groupBy("zip_file").agg(F.count("*").alias("n"))
    return per.agg(F.count("zip_file").alias("zips"), F.sum("n").cast("bigint").alias("pairs"))


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/out-{uuid.uuid4().hex}"


@query("select lower(file_extension) as extension, count(*) as n, count(*) filter (lower(file_extension) = 'pdf') as pdfs from {docs} where lower(file_extension) in ('pdf', 'xlsx', 'xls', 'csv', 'docx', 'doc', 'pptx', 'ppt', 'png', 'jpg', 'jpeg', 'tiff', 'bmp', 'txt', 'md') group by 1")
def src12_content_files(spark, folder):
    """SRC-12 and SRC-13: which members of a listing count as content, and which are PDFs."""
    m = _docs(spark, folder).select(F.concat("doc_id", F.lit("."), "file_extension").alias("member"))
    c = Z.content_members(m).withColumn("extension", F.lower(F.regexp_extract("member", r"\.([A-Za-z0-9]+)$", 1)))
    pdfs = Z.content_members(m, ("pdf",)).agg(F.count("*").alias("pdfs")).withColumn("extension", F.lit("pdf"))
    return c.groupBy("extension").agg(F.count("*").alias("n")).join(pdfs, "extension", "left").select("extension", "n", F.coalesce("pdfs", F.lit(0)).alias("pdfs"))


# --- vector tables --------------------------------------------------------------------------------------------------
@query("select chunk_id, doc_id, array_to_string(tag_context, ', ') as tag_context, len(embedding)::bigint as dim from {chunks} where list_contains(tag_context, 'document') or len(tag_context) = 1")
def snk06_vector_table(spark, folder):
    """SNK-06, SRC-36, SRC-37: chunks with tags joined and vectors are written as a table, and read again with a filter."""
    c = once(load(spark, folder, "chunks"), "chunk_id")
    path = _scratch(spark)
    c.select(F.col("chunk_id").alias("id"), F.col("text_chunk").alias("document"), "doc_id", F.array_join("tag_context", ", ").alias("tag_context"), F.size("tag_context").alias("n_tags"), "embedding").write.parquet(path)
    t = spark.read.parquet(path).where((F.col("n_tags") == 1) | F.array_contains(F.split("tag_context", ", "), "document"))
    return t.select(F.col("id").alias("chunk_id"), "doc_id", "tag_context", F.when(F.size("embedding") >= 0, F.size("embedding")).cast("bigint").alias("dim"))


def _lengths(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], np.float32)


@query("select chunk_id, length(text_chunk)::double as n, (length(text_chunk) - length(replace(text_chunk, ' ', '')))::double as blanks from {chunks} where text_chunk is not null")
def vec05_other_embedding(spark, folder):
    """A model of one's own in place of the digest."""
    c = once(load(spark, folder, "chunks"), "chunk_id").select("chunk_id", "text_chunk").where("text_chunk is not null")
    return V.embed(c, "text_chunk", _lengths).select("chunk_id", F.col("embedding")[0].cast("double").alias("n"), F.col("embedding")[1].cast("double").alias("blanks"))


# --- presentations in pages -----------------------------------------------------------------------------------------
@query(rf"""with p as (select doc_id, unnest(string_split(text_content, chr(12))) as page, generate_subscripts(string_split(text_content, chr(12)), 1) as n from {{vlm}} where text_content is not null)
select doc_id, count(*) as slides, md5(string_agg(chr(10) || chr(10) || '--- SLIDE ' || n || ' ---' || chr(10) || chr(10) || page, '' order by n)) as text_md5 from p group by doc_id""")
def txt15_presentation_pages(spark, folder):
    """TXT-15: pages as slides under their marks."""
    v = once(load(spark, folder, "vlm_results").where("text_content is not null"), "doc_id")
    text, slides = C.slides_of_pages(F.split("text_content", "\f"))
    return v.select("doc_id", F.size(slides).cast("bigint").alias("slides"), F.md5(text).alias("text_md5"))
