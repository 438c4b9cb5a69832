import io
import json
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import json as J
from lodestone.functions.text import pdf_date, word_count
from lodestone.operators import aggregates as A
from lodestone.operators import chunking as K
from lodestone.operators import classify as C
from lodestone.operators import graph as G
from lodestone.operators import pairing as P
from lodestone.operators import relational as R
from lodestone.operators import routing as T
from lodestone.operators import vectors as V
from lodestone.operators import windows as W


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


@pytest.mark.parametrize(("text", "types"), [("An ABSTRACT of", ["academic"]), ("Dear Sir, the plaintiff made a profit", ["legal", "financial", "email"]), ("", []), (None, [])])
def test_content_types(spark, text, types):
    r = one(spark, "t string", (text,), C.content_types(F.array(F.lit("pdf")), F.col("t")).alias("x"))
    assert r.x == ["pdf", *types]


def test_keywords_count_within_words_and_bags_keep_doubles(spark):
    r = one(spark, "t string", ("It is commonly urgent",), C.persuasion_b(F.array(), F.col("t")).alias("b"), C.persuasion_a(F.array(F.lit("urgency")), F.col("t")).alias("a"))
    assert r.b == ["scarcity"] and r.a == ["urgency", "urgency"]


@pytest.mark.parametrize(("text", "failed", "score", "issues"), [("x" * 100, False, 1.0, []), ("x" * 99, False, 0.8, ["very_short_content"]), ("  ", True, 0.2, ["no_text_content", "extraction_error"]), (None, False, 0.5, ["no_text_content"])])
def test_quality(spark, text, failed, score, issues):
    s, i = C.quality_a(F.col("t"), F.col("f"))
    r = one(spark, "t string, f boolean", (text, failed), s.alias("s"), i.alias("i"))
    assert (r.s, r.i) == (score, issues)


def test_quality_b_edges(spark):
    rows = spark.createDataFrame([("x" * 1001, "A"), ("x" * 1000, None), ("", None)], "t string, a string").select(C.quality_b(F.col("t"), F.col("a"), F.lit(None)).alias("s")).collect()
    assert [r.s for r in rows] == [1.0, 1.0, 0.5]


def test_valid_text(spark):
    texts = ["short", "long enough text", "PK\x03\x04 and more text", "has \\u00e9 literally", "é" * 20 + " rest of it", None]
    assert [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.valid_text(F.col("t")).alias("v")).collect()] == [False, True, False, False, False, False]


def chunked(text, limit=500, overlap=50):
    import re

    out, cur = [], ""
    for par in re.split(r"\n[ \t\n\r\f\x0b]*\n", text):
        if len(cur) + len(par) > limit:
            if cur:
                out.append(cur)
            cur = " ".join(re.split(r"[ \t\n\r\f\x0b]+", cur.strip(" \t\n\r\f\x0b"))[-overlap:]) + " " + par if cur else par
        else:
            cur = cur + "\n\n" + par if cur else par
    out = [*out, cur] if cur else out
    return [x.strip(" \t\n\r\f\x0b") for x in out]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n", max_size=120), max_size=8))
def test_regular_chunks_follow_the_rule(spark, parts):
    text = "\n\n".join(parts)
    got = one(spark, "t string", (text,), F.transform(K.regular_chunks(F.col("t"), limit=60, overlap_words=5), lambda c: c["chunk"]).alias("x")).x
    assert got == (chunked(text, 60, 5) if text else [])


def test_chunks_of_nothing_and_of_blanks(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",)], "t string").select(F.transform(K.regular_chunks(F.col("t")), lambda c: c["chunk"]).alias("x")).collect()
    assert [r.x for r in rows] == [[], [], [""]]


def test_parts_keep_their_numbers(spark):
    mail = "  \n---- Original Message ----\none\n---- Forwarded Message ----\ntwo"
    r = one(spark, "t string", (mail,), K.email_chunks(F.col("t")).alias("x")).x
    assert [(c.ord, c.chunk, c.tag) for c in r] == [(1, "one", "email_part_1"), (2, "two", "email_part_2")]
    slides = "intro\n--- SLIDE 3 ---\na\n--- SLIDE 7 ---\nb"
    r = one(spark, "t string", (slides,), K.presentation_chunks(F.col("t")).alias("x")).x
    assert [c.tag for c in r] == ["slide_3", "slide_7"]
    image = "head [Visual Element 1]: [Visual Element 2]: tree"
    r = one(spark, "t string", (image,), K.image_chunks(F.col("t")).alias("x")).x
    assert [(c.chunk, c.tag) for c in r] == [("head", "general"), ("tree", "visual_element_2")]


def test_no_operator_moves_chunks_between_tasks(spark, folder):
    docs = spark.read.parquet(f"{folder}/store_documents.parquet")
    plan = K.chunk_documents(docs, K.regular_chunks(F.col("text_content")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "text_content" in plan and "author" not in plan


@pytest.mark.parametrize(
    ("category", "files", "content", "metadata"),
    [
        ("Documents", [("a1.pdf", 9), ("a1-info.pdf", 3)], "a1.pdf", "a1-info.pdf"),
        ("Documents", [("x.pdf", 3), ("y.pdf", 9)], "y.pdf", "x.pdf"),
        ("Documents", [("only.docx", 3)], "only.docx", None),
        ("Documents", [("a.docx", 3), ("info.txt", 9)], "a.docx", "info.txt"),
        ("Presentations", [("a.pptx", 9), ("b.pdf", 5), ("c.pdf", 4)], "a.pptx", "c.pdf"),
        ("Images", [("a.png", 9), ("b.pdf", 5)], "a.png", "b.pdf"),
        ("Spreadsheets", [("a.csv", 9), ("a-info.pdf", 5)], "a.csv", "a-info.pdf"),
        ("Spreadsheets", [("a.xls", 9), ("b.csv", 5)], "a.xls", "b.csv"),
    ],
)
def test_pairing(spark, category, files, content, metadata):
    rows = [("z", category, "a1", p, s, i) for i, (p, s) in enumerate(files)]
    r = P.pair_files(spark.createDataFrame(rows, "zip string, category string, base string, path string, size long, ord long")).first()
    assert (r.content, r.metadata) == (content, metadata)


def test_pairing_of_an_empty_listing(spark):
    assert P.pair_files(spark.createDataFrame([], "zip string, category string, base string, path string, size long, ord long")).count() == 0


def test_pair_by_stem_drops_orphans_and_keeps_the_unmatched(spark):
    f = spark.createDataFrame([("z", "A.pdf"), ("z", "a-info.pdf"), ("z", "b.pdf"), ("z", "c-info.pdf")], "zip string, name string")
    assert {(r.content_name, r.info_name) for r in R.pair_by_stem(f, "zip", "name").collect()} == {("A.pdf", None), ("b.pdf", None)}
    assert {(r.content_name, r.info_name) for r in R.pair_by_stem(f, "zip", "name", ignore_case=True).collect()} == {("A.pdf", "a-info.pdf"), ("b.pdf", None)}


@pytest.mark.parametrize("n", [1, 2, 10, 100])
def test_floor_quantile(spark, n):
    df = spark.range(1, n + 1).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    want = float(list(range(1, n + 1))[int(0.95 * (n - 1))])
    assert A.exact_floor_quantiles(df, "g", "v", 0.95).first().quantile == want


def test_timeout_without_data(spark):
    assert one(spark, "p double", (None,), T.adaptive_timeout(F.col("p")).alias("t")).t == 180.0


def test_mode_ties_go_to_the_smallest_and_nulls_do_not_count(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (1, None)], "k int, v string")
    assert A.mode_of(df, ["k"], "v").first().mode == "a"


def test_exponential_mean(spark):
    df = spark.createDataFrame([("p", i, float(x)) for i, x in enumerate([1, 0, 5])], "g string, at int, v double")
    h = 0.0
    for x in (1, 0, 5):
        h = 0.1 * x + 0.9 * h
    assert W.exponential_mean(df, "g", ["at"], "v").first().ema == round(h, 6)


@pytest.mark.parametrize(("tops", "lines"), [([0, 20, 41, 61], [1, 1, 2, 2]), ([5], [1])])
def test_gap_groups(spark, tops, lines):
    df = spark.createDataFrame([("p", t) for t in tops], "g string, top int")
    assert [r.line for r in W.gap_groups(df, "g", "top", 20).orderBy("top").collect()] == lines


def test_topics_keep_the_order_of_first_occurrence(spark):
    df = spark.createDataFrame([(1, "zeta alpha zeta beta the the the ab"), (2, None), (3, "")], "id int, t string")
    assert [(r.term, r.relevance) for r in W.topics(df, "id", "t").orderBy("rank").collect()] == [("zeta", 1.0), ("alpha", 0.5), ("beta", 0.5)]


def test_vectors(spark):
    r = one(spark, "t string", ("a",), V.text_vector(F.col("t")).alias("v"))
    import hashlib

    assert r.v == [b / 255 for b in hashlib.md5(b"a").digest()] * 4
    sims = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")).alias("s")).collect()
    assert [x.s for x in sims] == [1.0, 0.0, None, None]


def test_search_refuses_unbounded_query_sets(spark):
    q = spark.range(V.MOST_QUERIES + 1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("query_vector"))
    with pytest.raises(ValueError, match="queries"):
        V.search(q.select("query_id", "query_vector").toDF("k", "v"), q, "k", "v")


def test_search_all_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_QUERIES", 4)
    q = spark.range(0, 23, 1, 3).select(F.col("id").alias("query_id"), F.array(F.col("id") + 1.0, F.lit(5.0)).alias("query_vector"))
    rows = V.search_all(q.toDF("k", "v"), q, "k", "v", 1).collect()
    assert sorted((r.query_id, r.k, r.similarity) for r in rows) == [(i, i, 1.0) for i in range(23)]


def test_vector_queries_take_every_hundredth_row(spark, tmp_path):
    from lodestone.plans import catalog

    e = spark.range(1201).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("id") + 1)).cast("float")).alias("embedding"), F.lit(3).alias("label"))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    e.select(F.col("vec_id").alias("chunk_id"), F.lit("d").alias("doc_id"), "embedding").limit(3).write.parquet(f"{tmp_path}/chunks.parquet")
    for name in ("vec03_nearest_vectors", "vec03_nearest_with_filter", "ag17_mean_similarity"):
        assert {r.query_id for r in catalog.queries()[name](spark, str(tmp_path)).select("query_id").collect()} == {*range(0, 1201, 100)}, name


def test_graph(spark):
    docs = spark.createDataFrame([("d1", "mia.berg@x.org", ["pdf"], '{"references":[{"doc_id":"d2"},{"doc_id":"d3","type":"CITES"}]}'), ("d2", "Mia Berg", [], None), ("d3", " ", None, "{")], "doc_id string, author string, content_type array<string>, metadata string")
    assert {(r.id, r.name) for r in G.person_nodes(docs).collect()} == {("mia.berg@x.org", "Mia Berg"), ("mia.berg@placeholder.com", "Mia Berg")}
    assert {(r.src, r.type, r.dst) for r in G.references(docs, "doc_id", "metadata").collect()} == {("d1", "REFERENCES", "d2"), ("d1", "CITES", "d3")}
    r = one(spark, "s string", (" RE: FWD: Budget ",), G.thread_of(F.col("s"))[0].alias("x"))
    assert r.x == "budget"


def test_expand_takes_the_shortest_way(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    s = spark.createDataFrame([(1,)], "seed int")
    assert {(r.node, r.hops) for r in R.expand(e, s, 3).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}


def test_expansion_keeps_keys_of_equal_remainder_apart(spark, tmp_path):
    from lodestone.plans import catalog

    spark.createDataFrame([(10, 1), (60, 51), (10, 51), (20, 7)], "l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalog.queries()["jn08_expand_two_hops"](spark, str(tmp_path)).collect()
    assert {(r.node, r.hops) for r in rows if r.seed == "supplier 10"} == {("supplier 10", 0), ("part 1", 1), ("part 51", 1), ("supplier 60", 2)}
    assert {r.seed for r in rows} == {"supplier 10", "supplier 20", "supplier 60"}


@pytest.mark.parametrize(("answer", "confidence", "parsed"), [('ok {"confidence": 0.9} bye', 0.9, True), ('{"x": 1}', 0.6, True), ("no json", 0.4, False), ("{broken}", 0.3, False), (None, 0.4, False)])
def test_answers(spark, answer, confidence, parsed):
    a = T.parsed_answer(F.col("t"))
    r = one(spark, "t string", (answer,), a["confidence"].alias("c"), a["parsed"].alias("p"))
    assert (r.c, r.p) == (confidence, parsed)


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,"x"]},"c":null}'), (2, "[]"), (3, "no"), (4, None)], "id int, raw string")
    assert [(r.id, r.path, r.value) for r in J.flatten(df, "id", "raw").collect()] == [(1, "a.b[0]", "1"), (1, "a.b[1]", "x"), (1, "c", None), (2, "", "[]")]
    assert [r.s for r in df.select(J.structure(F.col("raw")).alias("s")).collect()] == ["object:2", "array:0", None, None]


def test_scalars(spark):
    r = one(spark, "d string, t string", ("D:20240131120000Z", " a  b\n"), pdf_date(F.col("d")).alias("d"), word_count(F.col("t")).alias("n"))
    assert (str(r.d), r.n) == ("2024-01-31 12:00:00", 2)
    assert one(spark, "d string", ("D:bad",), pdf_date(F.col("d")).alias("d")).d is None


def test_fill_rates_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert [(r["name"], r.filled, r.rate) for r in A.fill_rates(df, ["a", "b"]).collect()] == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_archives(spark, tmp_path):
    from lodestone.sources import archives as Z
    from lodestone.sources import formats

    def packed(files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, d in files.items():
                z.writestr(n, d)
        return b.getvalue()

    inner = packed({"deep.txt": "é".encode("latin-1")})
    sheet = packed({"xl/workbook.xml": '<workbook><sheets><sheet name="Q1"/></sheets></workbook>', "xl/worksheets/sheet1.xml": '<s><row><c r="A1"><v>1</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row></s>'})
    raw = packed({"a.txt": "hello", "b.json": json.dumps({"k": [1, 2]}), "n.zip": inner, "t.xlsx": sheet, "u.bin": "?", "d.docx": packed({"word/document.xml": "<d><p><t>one</t></p><p> </p></d>"}), "broken.docx": "no zip", "c.csv": "a;b\n1;2\n3;4\n"})
    (tmp_path / "Documents").mkdir()
    (tmp_path / "Documents" / "one.zip").write_bytes(raw)
    (tmp_path / "Documents" / "bad.zip").write_bytes(b"no zip")
    (tmp_path / ".hidden").mkdir()
    files = Z.discover_zips(Z.scan(spark, str(tmp_path), "*.zip"), str(tmp_path))
    assert {r.category for r in files.select("category").collect()} == {"Documents"}
    m = Z.unzip(files)
    x = {r.member: r for r in formats.extract(m.where("error is null")).collect()}
    assert x["a.txt"].text == "hello" and x["n.zip/deep.txt"].method == "text_latin-1" and x["b.json"].text == "k[0]: 1\nk[1]: 2"
    assert x["t.xlsx"].text == "=== Sheet: Q1 ===\n1\t\tx" and x["d.docx"].text == "one" and x["c.csv"].text == "a\tb\n1\t2\n3\t4"
    assert x["u.bin"].method == "unsupported" and x["broken.docx"].errors
    assert m.where("error is not null").count() == 1
    assert Z.inspect(files).first().zips == 2
    assert {r.path.rsplit("/", 1)[-1]: r.ok for r in Z.problems(Z.scan(spark, str(tmp_path), "*.zip")).collect()} == {"one.zip": True, "bad.zip": False}


def test_registry_and_hooks(spark):
    from lodestone.sources.formats import Registry, extract

    reg = Registry()
    reg.register_processor(".abc", lambda raw: (raw.decode().upper(), "abc", []))
    reg.register_validator("abc", lambda raw: len(raw) > 1)
    df = spark.createDataFrame([("x.ABC", b"hi"), ("y.abc", b"h"), ("z", None)], "member string, data binary")
    assert [(r.text, r.method) for r in extract(df, reg).collect()] == [("HI", "abc"), ("", "invalid"), ("", "none")]
    reg.register_hook("post_chunk", lambda d: d.withColumn("o", F.lit("low")), 1)
    reg.register_hook("post_chunk", lambda d: d.withColumn("o", F.lit("high")), 5)
    reg.register_hook("post_chunk", lambda d: d.select("nothing_like_it"))
    assert reg.execute_hooks("post_chunk", df).first().o == "low" and len(reg.failed) == 1
    with pytest.raises(ValueError):
        reg.register_hook("never", lambda d: d)


def test_keyed_table(spark, tmp_path):
    from lodestone.sources.sinks import KeyedTable, merge_maps, store_everywhere

    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    t.create("k string, v int")
    t.create("k string, v int")
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(str(i), i) for i in range(20)], "k string, v int"))
    t.upsert(spark.createDataFrame([("3", 33), ("99", 99), ("99", 99)], "k string, v int"))
    t.delete(spark.createDataFrame([("4",), ("none",)], "k string"))
    got = {r.k: r.v for r in t.read().collect()}
    assert got["3"] == 33 and got["99"] == 99 and "4" not in got and len(got) == 20
    m = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3})], "x map<string,int>, y map<string,int>").select(merge_maps("x", "y").alias("m")).first().m
    assert m == {"a": 1, "b": 3}
    docs = spark.createDataFrame([("d", "t")], "doc_id string, text string")
    edges = spark.createDataFrame([("Document", "d", "T", "Topic", "x")], "src_label string, src string, type string, dst_label string, dst string")
    assert store_everywhere(docs, docs.withColumn("chunk_id", F.lit("c")), edges, str(tmp_path / "s"), spark) == {"documents": 1, "chunks": 1, "relationships": 1}


def test_file_stream(spark, tmp_path):
    from lodestone.streaming import streams

    (tmp_path / "a.txt").write_bytes(b"x")
    out = streams.run_available(streams.read_files(spark, str(tmp_path)).select("length"), "append")
    assert [r.length for r in out.collect()] == [1]


def test_cost_gate(spark):
    df = spark.createDataFrame([("d", i, 6.0) for i in range(3)], "day string, at int, cost double")
    assert [(r.spent, r.allowed) for r in W.cost_gate(df, ["day"], ["at"], "cost", 10.0).orderBy("at").collect()] == [(0.0, True), (6.0, True), (12.0, False)]


def test_page_rules(spark):
    from lodestone.sources import pages as P

    r = P.chain(lambda raw: (" ", "first", ["blank"]), lambda raw: 1 / 0, lambda raw: (raw.decode(), "third", []))
    assert r(b" text ") == ("text", "third", ["blank", "ZeroDivisionError: division by zero"])
    assert P.chain(lambda raw: ("", "x", []))(b"") == ("", "none", [])
    df = spark.createDataFrame([("a", 2, "second page"), ("a", 1, " "), ("a", 3, None), ("b", 1, None)], "doc string, page int, text string")
    out = {x.doc: x for x in P.joined_pages(df, "doc", "page", "text").collect()}
    assert out["a"].text == "=== Page 2 ===\nsecond page" and out["a"].success and out["b"].text == "" and not out["b"].success
    short = spark.createDataFrame([("x" * 49, "seen"), ("x" * 50, "seen"), (None, " ")], "a string, b string")
    assert [x.t for x in short.select(P.with_recognition(F.col("a"), F.col("b"), 50).alias("t")).collect()] == ["seen", "x" * 50, ""]


@pytest.mark.parametrize(("name", "pushed"), [("flt14_valid_addresses", "author"), ("flt03_search_documents", "created_at"), ("flt03_search_by_author", "author")])
def test_filters_reach_the_scan(spark, folder, name, pushed):
    """A search filters where it reads, before copies of rows are dropped."""
    from lodestone.plans import catalog

    plan = catalog.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert scans and all(pushed in line.split("PushedFilters: ")[1] for line in scans)
    assert plan.rindex("Filter") > plan.rindex("Exchange")


def test_a_text_is_digested_once(spark):
    from lodestone.operators.vectors import text_vector

    df = spark.createDataFrame([("x",)], "t string").select(text_vector(F.col("t")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 1 and len(df.first().v) == 64


def test_large_archives_come_in_parts(spark, monkeypatch):
    import io
    import zipfile

    from lodestone.sources import archives

    monkeypatch.setattr(archives, "FRAME_BYTES", 5000)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(100):
            z.writestr(f"{i}.txt", "x" * 1000)
    got = archives.unzip(spark.createDataFrame([("a", bytearray(out.getvalue()))], "path string, content binary")).collect()
    assert [r.ord for r in got] == list(range(100)) and all(len(r.data) == 1000 for r in got)


def test_search_of_odd_vectors(spark):
    from lodestone.operators.vectors import search

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0]), (7, [None, 1.0]), (8, [-1.0, 0.0])]
    index = spark.createDataFrame(rows, "id int, v array<float>").withColumn("extra", F.lit("e"))
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("none", None)], "query_id string, query_vector array<float>")
    got = [(r.query_id, r.id, r.similarity, r.extra) for r in search(index, asked, "id", "v", 4, ("extra",)).orderBy("rank").collect()]
    assert got == [("q", 1, 1.0, "e"), ("q", 2, 1.0, "e"), ("q", 5, 0.0, "e"), ("q", 8, -1.0, "e")]
    assert search(index.limit(0), asked, "id", "v").count() == 0 and search(index, asked.limit(0), "id", "v").count() == 0


def test_dates_of_mails(spark):
    from lodestone.functions.text import mail_date

    rows = ["4/2/2019 18:05", "12/28/2020 1:05:09 PM", "December 28, 2020 17:07", "Mon, 28 Dec 2020 17:07:09 +0100 (CET)", "2020-12-28T17:07:09", "yesterday", "", None]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(F.date_format(mail_date(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("v")).collect()]
    assert got == ["2019-04-02 18:05:00", "2020-12-28 13:05:09", "2020-12-28 17:07:00", "2020-12-28 17:07:09", "2020-12-28 17:07:09", None, None, None]


def test_a_stream_without_rows(spark, tmp_path):
    from lodestone.streaming import streams

    spark.createDataFrame([], "ts timestamp, kind string, value double").write.parquet(f"{tmp_path}/none")
    s = spark.readStream.schema("ts timestamp, kind string, value double").parquet(f"{tmp_path}/none")
    assert streams.run_available(s.where("value > 0"), "append").count() == 0


def test_type_distribution_in_any_order(spark, tmp_path):
    """The mean of the first type is a tie in its seventh place, and sums of doubles fall below it; the others have odd values or none."""
    from lodestone.plans import catalog

    rows = [(f"a{i}", "a", 0.0499955, 0.1) for i in range(12)] + [("b1", "b", None, None), ("c1", "c", float("nan"), 1e300), ("c2", "c", 0.5, 1.0), ("d1", "d", 0.0, -0.25), ("d2", "d", 1.0, None)]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "doc_id string, vlm_content_type string, vlm_confidence double, processing_cost double")
        df.write.mode("overwrite").parquet(f"{tmp_path}/vlm_results.parquet")
        got = {r.vlm_content_type: (r.n, str(r.confidence), r.cost) for r in catalog.queries()["ag15_type_distribution"](spark, str(tmp_path)).collect()}
        assert got == {"a": (12, "0.049996", 1.2), "b": (1, "None", None), "c": (2, "nan", 1e300), "d": (2, "0.5", -0.25)}
