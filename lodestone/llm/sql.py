"""The queries of the subpackage in DuckDB's SQL, where SQL can express them over whole tables."""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"

P1_FOUND = f"""with d as (select distinct on (document_id) document_id, {_WORDS.format("content_file.extracted_text")} as w from pair_records where document_id is not null and content_file.extracted_text is not null),
s as (select distinct document_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from d where len(w) >= 3),
n as (select document_id, count(*) as n from s group by document_id having count(*) >= 50),
t as (select s.* from s join n using (document_id)),
c as (select a.document_id as a, b.document_id as b, count(*) as c from t a join t b on a.g = b.g and a.document_id < b.document_id group by 1, 2)
select c.a as document_id_a, c.b as document_id_b from c join n x on x.document_id = c.a join n y on y.document_id = c.b where c.c / (x.n + y.n - c.c) >= 0.7 - 1e-12"""

P2_FOUND = """with u as (select distinct on (chunk_id) chunk_id, embedding::double[] as e from chunks where chunk_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
r as (select a.chunk_id as a, b.chunk_id as b, row_number() over (partition by a.chunk_id order by round(list_cosine_similarity(a.e, b.e), 12) desc, b.chunk_id) as k from u a join u b on a.chunk_id <> b.chunk_id)
select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from r where k <= 5"""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13)"
P4_FOUND = rf"""with i as (select distinct on (item_id) * from (select doc_id as item_id, text_content as t from store_documents union all select chunk_id, text_chunk from chunks) where item_id is not null and length(t) > 500),
p as (select item_id, list_transform(string_split_regex(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n[ \t]*\n'), lambda x: trim(x, {_BLANKS})) as ps, t from i),
s as (select *, flatten(list_transform(ps, lambda x: list_transform(string_split(regexp_replace(x, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, {_BLANKS})))) as ss from p)
select item_id, case when list_max(list_transform(ps, lambda x: length(x))) <= 500 then 'paragraph' when list_max(list_transform(ss, lambda x: length(x))) <= 500 then 'sentence'
when list_max(list_transform(string_split_regex(t, '[ \t\r\n]+'), lambda x: length(x))) <= 500 then 'word' else 'char' end as boundary from s"""

P9_FOUND = f"""with d as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null), e as (select item_id, {_WORDS.format("text")} as w from eval_items where text is not null),
g as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) as g from e where len(w) >= 12),
h as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) as g from d where len(w) >= 12)
select distinct doc_id, item_id from h join g using (g)"""

P10_FOUND = """with w as (select distinct doc_id, unnest(list_transform(range(1, length(text) - 298), lambda i: hash(substr(text, i, 300)))) as h from documents where length(text) >= 300 and text is not null),
k as (select h from w group by h having count(*) > 1), s as (select w.* from w join k using (h))
select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from s a join s b on a.h = b.h and a.doc_id < b.doc_id"""

SQL = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p9_found": P9_FOUND, "p10_found": P10_FOUND}
