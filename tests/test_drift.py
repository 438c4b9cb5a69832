import json

from lodestone.operators import drift

SCHEMA = "feed_id string, file_id string, file_seq int, raw_id long, raw_json string"


def frame(spark, files):
    rows, n = [], 0
    for seq, (name, records) in enumerate(files, 1):
        for r in records:
            rows.append(("f", name, seq * 3, n, r if isinstance(r, str) or r is None else json.dumps(r)))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def test_changes(spark):
    files = [
        ("a", [{"document_id": "1", "x": {"n": 5}, "old": "v", "flag": True}, {"document_id": "2", "old": None}, '{"cut']),
        ("b", [{"document_id": "1", "x": {"n": 5.0}, "new": "v"}, {"document_id": "2"}, {"document_id": "2"}]),
        ("c", [{"document_id": "1", "x": {"n": "5"}, "new": "w", "more": [1]}, {"document_id": "9", "flag": None}]),
    ]
    got = {tuple(r) for r in drift.changes(frame(spark, files)).drop("feed_id").collect()}
    assert got == {
        ("b", "new", "old", "renamed"), ("b", "flag", "", "removed"), ("b", "x.n", "", "type_changed"),
        ("c", "x.n", "", "type_changed"), ("c", "more", "", "added"), ("c", "flag", "", "added"),
    }


def test_rename_needs_equal_values_in_every_common_document(spark):
    files = [("a", [{"document_id": "1", "p": 1}, {"document_id": "2", "p": 2}]), ("b", [{"document_id": "1", "q": 1}, {"document_id": "2", "q": 3}])]
    assert {r.change for r in drift.changes(frame(spark, files)).collect()} == {"added", "removed"}


def test_nothing(spark):
    out = drift.changes(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert drift.changes(frame(spark, [("a", [None, "", "[1]", "{}"])])).count() == 0


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    df = frame(spark, [("a", [{"document_id": "1", "p": 1}]), ("b", [{"document_id": "1"}])]).withColumns({"path": F.lit(1), "kind": F.lit(2), "value": F.lit(3), "no": F.lit(4)})
    assert [(r.field_path, r.change) for r in drift.changes(df).collect()] == [("p", "removed")]


def test_consistent_table(spark):
    files = [
        ("a", [{"document_id": "1", "vlm_confidence": 0.64, "pages": 3, "overall_success": True, "odd": [1]}]),
        ("b", [{"document_id": "1", "conf": 0.64, "pages": "3 pages", "overall_success": 1}]),
        ("c", [{"document_id": "1", "conf": "64.0%", "pages": 4, "overall_success": "no"}]),
        ("d", [{"document_id": "1", "conf": 64, "overall_success": False}]),
    ]
    rows = {r.file_id: r for r in drift.consistent_table(frame(spark, files)).collect()}
    assert [rows[k].f_vlm_confidence for k in "abcd"] == [0.64, 0.64, None, 64.0]
    assert [rows[k].f_pages for k in "abcd"] == [3, None, 4, None]
    assert [rows[k].f_overall_success for k in "abcd"] == [True, True, False, False]
    assert rows["a"].f_odd == "[1]"
    # what a column can't hold stays in the extras
    assert rows["b"].extras == {"pages": '"3 pages"'} and rows["c"].extras == {"conf": '"64.0%"'}


def test_two_feeds_rename_different_fields_to_one_name(spark):
    def feed(name, old, keep):
        first, second = {"document_id": "1", old: f"{name} old", keep: f"{name} keep"}, {"document_id": "1", "foo": f"{name} old", keep: f"{name} keep"}
        return [(name, f"{name}1", 1, 1, json.dumps(first)), (name, f"{name}2", 2, 2, json.dumps(second))]

    rows = [(f, file, seq, n, raw) for n, (f, file, seq, _, raw) in enumerate(feed("a", "zip_file", "category") + feed("b", "category", "zip_file"))]
    got = {r.file_id: r for r in drift.consistent_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[f].f_zip_file, got[f].f_category) for f in ("a1", "a2", "b1", "b2")] == [("a old", "a keep")] * 2 + [("b keep", "b old")] * 2
    assert all(not r.extras for r in got.values())


def test_no_value_is_lost(spark):
    records = [{"document_id": "1", "p": 1, "P": 2, "x.y": "dot", "x": {"y": "nested"}}, {"document_id": "2", "p": "one", "x": {"y": None}}, {"document_id": "3", "p": 1.5}]
    rows = drift.consistent_table(frame(spark, [("a", records)])).collect()
    cells = [v for r in rows for k, v in r.asDict().items() if k.startswith("f_") and v is not None]
    extras = [v for r in rows for v in r.extras.values()]
    assert len(rows) == 3 and len(cells) + len(extras) == 3 + 3 + 1 + 2
    assert len(set(c.lower() for c in rows[0].asDict())) == len(rows[0].asDict())


def test_chain_of_renames_and_a_field_that_comes_again(spark):
    files = [(f"f{i}", [{"document_id": "1", name: "v"}, {"document_id": "2", name: "w"}]) for i, name in enumerate("abcde")] + [("g", [{"document_id": "1", "a": "new", "e": "v"}])]
    rows = drift.consistent_table(frame(spark, files)).collect()
    assert sorted((r.file_id, r.f_a) for r in rows if r.f_document_id == "1") == [("f0", "v"), ("f1", "v"), ("f2", "v"), ("f3", "v"), ("f4", "v"), ("g", "new")]
    assert [r.extras for r in rows if r.file_id == "g"] == [{"e": '"v"'}]


def test_consistent_table_of_nothing(spark):
    assert drift.consistent_table(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drift.consistent_table(frame(spark, [("a", [None, "", "[1]"])])).count() == 0
