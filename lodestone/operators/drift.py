"""Problem 6: schemas that drift between files, by a catalogue of the lifespans of columns.

One pass over the records makes the metadata that the footer of a columnar file would have: for each producer (a feed) and
file, which paths it has and of which types; no values.  Files of a feed are numbered in order, so a run of consecutive
numbers is an island of a field; ``lag`` and ``lead`` find where islands begin and end and where the type changes within
one.  Only where a field ends in the same place as another of its type begins, the values of the two are read.  The
lifespans, linked by renames within their feed, make the alias table, and with the types of the catalogue that makes the
casts into one table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.tables import cut, spread

#: Part of the feeds that have a field from which on it is a column of the consistent table; rarer ones stay in ``extras``.
COMMON = 0.1
#: Columns of the consistent table: it grows with the schema, not with the records.
MOST_COLUMNS = 5000
TYPES = {"boolean": "boolean", "integer": "bigint", "decimal": "double", "string": "string", "array": "string"}


def kind(v: object) -> str | None:
    """The type of a JSON value; of null, none."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {int: "integer", float: "decimal", str: "string"}.get(type(v), "array")


def leaves(d: dict, path: str = "") -> Iterator[tuple[str, object]]:
    """Path and value of all that isn't an object."""
    stack = [(path, d)]
    while stack:
        p, x = stack.pop()
        for k, v in x.items():
            if isinstance(v, dict):
                stack.append((f"{p}{k}.", v))
            else:
                yield p + k, v


def parsed(text: str | None) -> dict | None:
    """The object that a record is, or none if it doesn't parse as one."""
    try:
        d = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    return d if isinstance(d, dict) else None


def document_of(d: dict, doc: str) -> str | None:
    own = d.get(doc)
    return own if own is None or isinstance(own, str) else json.dumps(own)


def catalogue(records: DataFrame, raw: str = "raw_json") -> DataFrame:
    """feed_id, file_id, path, kind, n, file_seq: how many records of a file have a path with a value of a type.

    The row without a path is the file itself.  A record that doesn't parse as an object counts for its file alone.
    """
    src = records.where("file_id is not null").select("feed_id", "file_id", "file_seq", F.col(raw).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met: dict[tuple, int] = {}
            first: dict[tuple, int] = {}
            for feed, file, seq, t in zip(*(c.to_pylist() for c in b.columns)):
                own = (feed, file)
                if own not in first or seq is not None and (first[own] is None or seq < first[own]):
                    first[own] = seq
                for p, v in leaves(parsed(t) or {}):
                    at = (feed, file, p, kind(v))
                    met[at] = met.get(at, 0) + 1
            rows = [(*k, n, None) for k, n in met.items()] + [(*k, None, None, 0, s) for k, s in first.items()]
            cols = list(zip(*rows)) or [[]] * 6
            types = [b.column(0).type, b.column(1).type, pa.string(), pa.string(), pa.int64(), b.column(2).type]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["feed_id", "file_id", "path", "kind", "n", "file_seq"])

    feed, file, seq = (f.dataType.simpleString() for f in src.schema[:3])
    found = spread(src).mapInArrow(run, f"feed_id {feed}, file_id {file}, path string, kind string, n bigint, file_seq {seq}")
    return found.groupBy("feed_id", "file_id", "path", "kind").agg(F.sum("n").alias("n"), F.min("file_seq").alias("file_seq"))


def numbered_files(found: DataFrame) -> DataFrame:
    """feed_id, file_id, no, last: the files of each feed in their order, and the number of its last file."""
    feed = Window.partitionBy("feed_id")
    return found.where("path is null").select("feed_id", "file_id", F.row_number().over(feed.orderBy("file_seq", "file_id")).alias("no"), F.count("*").over(feed).cast("int").alias("last"))


def lifespans(found: DataFrame, files: DataFrame) -> DataFrame:
    """The lifespans: feed_id, path, kind, from_no, to_no, last for each island of a field of one type, with prior_no and
    prior_from of the island of the path before and next_no of the one after."""
    # a file's values of one field are of one type; where they aren't, the most frequent counts, then the first by name
    of = found.where("path is not null").groupBy("feed_id", "file_id", "path").agg(F.max_by("kind", F.struct(F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(0).alias("n"), F.col("kind"))).alias("kind"))
    here = of.join(files, ["feed_id", "file_id"])
    own = Window.partitionBy("feed_id", "path").orderBy("no")
    here = here.withColumns({"before": F.lag("no").over(own), "was": F.last("kind", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))})
    starts = F.coalesce(F.col("before") != F.col("no") - 1, F.lit(True)) | F.coalesce(F.col("kind") != F.col("was"), F.lit(False))
    here = here.withColumn("island", F.sum(starts.cast("int")).over(own))
    spans = here.groupBy("feed_id", "path", "island").agg(F.max("kind").alias("kind"), F.min("no").alias("from_no"), F.max("no").alias("to_no"), F.max("last").alias("last")).drop("island")
    own = Window.partitionBy("feed_id", "path").orderBy("from_no")
    return spans.withColumns({"next_no": F.lead("from_no").over(own), "prior_no": F.lag("to_no").over(own), "prior_from": F.lag("from_no").over(own)})


def values_at(records: DataFrame, wanted: DataFrame, raw: str, doc: str) -> DataFrame:
    """feed_id, no, doc, path, new, digest: of the files of ``wanted`` (feed_id, file_id, paths) the values of its paths.

    ``no`` is the number of the file where a path begins; ``new`` tells its values from those of the path that ended.
    The value of a document is the largest digest of its rows, null if the path is null or missing in all.
    """
    src = records.select("feed_id", "file_id", F.col(raw).alias("raw")).join(wanted, ["feed_id", "file_id"]).select("feed_id", "raw", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, nos, docs, paths, new, digests = [], [], [], [], [], []
            for k, (t, asked) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                d = parsed(t)
                own = None if d is None else document_of(d, doc)
                if own is None:
                    continue
                has = dict(leaves(d))
                for a in asked:
                    v = has.get(a["path"])
                    at.append(k), nos.append(a["no"]), docs.append(own), paths.append(a["path"]), new.append(a["new"])
                    digests.append(None if v is None else hashlib.blake2b(json.dumps(v, ensure_ascii=False).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(nos, pa.int32()), pa.array(docs, pa.string()), pa.array(paths, pa.string()), pa.array(new, pa.bool_()), pa.array(digests, pa.binary())], ["feed_id", "no", "doc", "path", "new", "digest"])

    feed = src.schema["feed_id"].dataType.simpleString()
    found = src.mapInArrow(run, f"feed_id {feed}, no int, doc string, path string, new boolean, digest binary")
    return found.groupBy("feed_id", "no", "doc", "path", "new").agg(F.max("digest").alias("digest"))


def history(records: DataFrame, raw: str = "raw_json", doc: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The changes (feed_id, file_id, no, field_path, former_path, change), the lifespans and the numbered files.

    Each file is compared with the one before it in its feed; a feed's first file has no change.  A field of nothing but
    nulls has no type and changes none.  Records that don't parse count for nothing, so a file of such records alone has
    no fields.  Rows of one document in one file are taken as copies; rows without a file are left out.
    """
    found = cut(catalogue(records, raw))
    files = cut(numbered_files(found))
    spans = cut(lifespans(found, files))
    goes_on = F.coalesce(F.col("prior_no") == F.col("from_no") - 1, F.lit(False))
    come = spans.where((F.col("from_no") > 1) & ~goes_on).select("feed_id", F.col("from_no").alias("no"), "path", "kind")
    gone = spans.where((F.col("to_no") < F.col("last")) & F.coalesce(F.col("next_no") != F.col("to_no") + 1, F.lit(True))).select("feed_id", (F.col("to_no") + 1).alias("no"), "path", "kind")
    retyped = spans.where(goes_on).select("feed_id", F.col("from_no").alias("no"), "path")
    pairs = cut(come.join(gone.withColumnRenamed("path", "former"), ["feed_id", "no", "kind"]).select("feed_id", "no", "path", "former"))
    asked = pairs.select("feed_id", "no", "path", F.lit(True).alias("new"), F.col("no").alias("file_no"))
    asked = asked.unionByName(pairs.select("feed_id", "no", F.col("former").alias("path"), F.lit(False).alias("new"), (F.col("no") - 1).alias("file_no")))
    wanted = asked.groupBy("feed_id", "file_no").agg(F.collect_set(F.struct("no", "path", "new")).alias("paths")).join(files.select("feed_id", "file_id", F.col("no").alias("file_no")), ["feed_id", "file_no"]).drop("file_no")
    values = cut(values_at(records, wanted, raw, doc))  # read twice
    new = values.where("new").select("feed_id", "no", "doc", "path", F.col("digest").alias("new_value"))
    old = values.where("not new").select("feed_id", "no", "doc", F.col("path").alias("former"), F.col("digest").alias("old_value"))
    # one row a pair and document of both files; a path of an asked file has a row for each of its documents
    met = pairs.join(new, ["feed_id", "no", "path"]).join(old, ["feed_id", "no", "former", "doc"])
    equal = met.groupBy("feed_id", "no", "path", "former").agg(F.bool_and(F.col("new_value").eqNullSafe(F.col("old_value"))).alias("equal"), F.count("new_value").alias("n"))
    renamed = cut(equal.where("equal and n > 0").select("feed_id", "no", "path", "former"))
    come = come.join(renamed.select("feed_id", "no", "path").distinct(), ["feed_id", "no", "path"], "left_anti")
    gone = gone.join(renamed.select("feed_id", "no", F.col("former").alias("path")).distinct(), ["feed_id", "no", "path"], "left_anti")
    none = F.lit("").alias("former")
    every = renamed.select("feed_id", "no", "path", "former", F.lit("renamed").alias("change"))
    for part, name in ((come, "added"), (gone, "removed"), (retyped, "type_changed")):
        every = every.unionByName(part.select("feed_id", "no", "path", none, F.lit(name).alias("change")))
    out = every.join(files.drop("last"), ["feed_id", "no"]).select("feed_id", "file_id", "no", F.col("path").alias("field_path"), F.col("former").alias("former_path"), "change")
    return out, spans, files


def changes(records: DataFrame) -> DataFrame:
    """feed_id, file_id, field_path, former_path, change: see ``history``."""
    return history(records)[0].drop("no")


def alias_table(changed: DataFrame, spans: DataFrame) -> DataFrame:
    """feed_id, path, kind, from_no, to_no, target: what each lifespan of each feed is called in the consistent table.

    Lifespans of a feed are one chain if one goes on where the other ends, under its own path or by a rename; other feeds
    have no part in it, so two feeds may rename different fields to one path.  A chain is called by that of its paths with
    which most feeds begin, then by the one that most files have, then by the first by name.  A path that its feed never
    renamed is called as other feeds call it, if all that renamed it call it alike.
    """
    renamed = changed.where("change = 'renamed'").groupBy("feed_id", F.col("field_path").alias("path"), F.col("no").alias("from_no")).agg(F.min("former_path").alias("former"))
    ended = spans.select("feed_id", F.col("path").alias("former"), (F.col("to_no") + 1).alias("from_no"), F.col("from_no").alias("former_from"))
    renamed = renamed.join(ended, ["feed_id", "former", "from_no"])
    node, own = F.struct("path", "from_no"), F.struct("path", "from_no")
    goes_on = F.col("prior_no") == F.col("from_no") - 1
    up = F.when(goes_on, F.struct("path", F.col("prior_from").alias("from_no"))).when(F.col("former").isNotNull(), F.struct(F.col("former").alias("path"), F.col("former_from").alias("from_no"))).otherwise(own)
    chain = cut(spans.join(renamed, ["feed_id", "path", "from_no"], "left").select("feed_id", node.alias("node"), "kind", "to_no", up.alias("root")))
    while True:  # each round doubles how far back a lifespan sees: the rounds are the logarithm of the longest chain
        above = chain.select("feed_id", F.col("node").alias("root"), F.col("root").alias("further"))
        seen = cut(chain.join(above, ["feed_id", "root"]).select("feed_id", "node", "kind", "to_no", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
        chain = seen.drop("moved")
        if seen.where("moved").isEmpty():
            break
    names = chain.groupBy(F.col("node.path").alias("path")).agg(F.count_distinct(F.when(F.col("node.from_no") == 1, F.col("feed_id"))).alias("begins"), F.sum(F.col("to_no") - F.col("node.from_no") + 1).alias("files"))
    named = chain.withColumn("path", F.col("node.path")).join(names, "path")
    best = Window.partitionBy("feed_id", "root")
    ranked = best.orderBy(F.desc("begins"), F.desc("files"), "path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = named.withColumns({"target": F.first("path").over(ranked), "alone": F.min("path").over(best) == F.max("path").over(best)})
    others = named.where("not alone").groupBy("path").agg(F.min("target").alias("theirs"), F.max("target").alias("last")).where("theirs = last and theirs <> path").drop("last")
    target = F.when(F.col("alone"), F.coalesce("theirs", "target")).otherwise(F.col("target"))
    return named.join(others, "path", "left").select("feed_id", "path", "kind", F.col("node.from_no").alias("from_no"), "to_no", target.alias("target"))


def column_types(aliases: DataFrame, common: float = COMMON) -> dict[str, str]:
    """The columns of the consistent table and their types (boolean, integer, decimal, string, array), by name.

    A target is a column if at least ``common`` of the feeds have it.  Its type is the one of the most files, of ties the last by
    name; integers and decimals count as one, and are decimals if any file has some.
    """
    of = F.when(F.col("kind") == "decimal", "integer").otherwise(F.col("kind"))
    files = F.col("to_no") - F.col("from_no") + 1
    per = aliases.withColumn("group", of).groupBy("target", "group").agg(F.sum(files).alias("files"), F.collect_set("feed_id").alias("feeds"), F.bool_or(F.col("kind") == "decimal").alias("decimal"))
    one = per.groupBy("target").agg(F.size(F.array_distinct(F.flatten(F.collect_list("feeds")))).alias("feeds"), F.max_by(F.struct("group", "decimal"), F.struct(F.when(F.col("group").isNotNull(), F.col("files")).otherwise(0).alias("files"), F.col("group"))).alias("type"))
    least = common * aliases.select("feed_id").distinct().count()
    rows = one.where(F.col("feeds") >= least).orderBy("target").limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns; raise the part of the feeds that a column needs")
    return {r.target: "decimal" if r.type.group == "integer" and r.type.decimal else r.type.group or "string" for r in rows}


def cast_value(v: object, target: str) -> object:
    """A JSON value as the target type; none if it can't be read so without a loss."""
    if isinstance(v, str) and target != "string":
        t = v.strip()
        low = t.lower()
        try:
            if target == "boolean":
                return True if low in ("true", "t", "yes", "y", "1") else False if low in ("false", "f", "no", "n", "0") else None
            if target == "array" or "_" in t:
                return None
            number = float(t) if target == "decimal" or not t.lstrip("+-").isdigit() else int(t)
            return cast_value(number, target)
        except ValueError:
            return None
    match target:
        case "boolean":
            return bool(v) if isinstance(v, bool) or v in (0, 1) else None
        case "integer":
            if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or v in (float("inf"), float("-inf")) or int(v) != v:
                return None
            return int(v) if -(2**63) <= v < 2**63 else None
        case "decimal":
            try:
                return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
            except OverflowError:
                return None
        case "array":
            return json.dumps(v, ensure_ascii=False) if isinstance(v, list) else None
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def consistent_table(records: DataFrame, common: float = COMMON, raw: str = "raw_json") -> DataFrame:
    """One row for each record that parses, with the columns of ``column_types`` and all else in the map ``extras``.

    A column takes the value of that path of the record that the alias table calls so; where a record has several of
    them with a value, its own name comes first, then the first by name, and the others go to ``extras``, as does a value
    that its column's type can't hold.  ``extras`` maps paths to JSON.  No value but null is left out.  Fields named like
    raw columns don't clash: dots in a path become underscores behind ``f_``, and a name taken so gets a number.
    """
    changed, spans, files = history(records, raw)
    aliases = cut(alias_table(changed, spans))
    columns = column_types(aliases, common)
    names: dict[str, str] = {}
    for t in columns:
        name, n = "f_" + t.replace(".", "_"), 1
        while name.lower() in names:
            n += 1
            name = f"f_{t.replace('.', '_')}_{n}"
        names[name.lower()] = t
    shown = {t: n for n, t in names.items()}
    # the paths of a file that are called otherwise; for all others the path is the name
    here = aliases.where("path <> target").join(files, "feed_id").where("no between from_no and to_no")
    other = here.groupBy("feed_id", "file_id").agg(F.map_from_entries(F.collect_set(F.struct("path", "target"))).alias("called"))
    src = records.where("file_id is not null").select("feed_id", "file_id", "file_seq", "raw_id", F.col(raw).alias("raw"))
    src = spread(src).join(other, ["feed_id", "file_id"], "left").select("feed_id", "file_id", "file_seq", "raw_id", "raw", "called")
    types = {"boolean": pa.bool_(), "integer": pa.int64(), "decimal": pa.float64(), "string": pa.string(), "array": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, extras = [], []
            out: dict[str, list] = {t: [] for t in columns}
            for k, (t, called) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                d = parsed(t)
                if d is None:
                    continue
                called = dict(called or ())
                row, rest = {}, {}
                for p, v in sorted(((p, v) for p, v in leaves(d) if v is not None), key=lambda x: (called.get(x[0], x[0]) != x[0], x[0])):
                    target = called.get(p, p)
                    value = cast_value(v, columns[target]) if target in columns and target not in row else None
                    if value is None:
                        rest[p] = json.dumps(v, ensure_ascii=False)
                    else:
                        row[target] = value
                at.append(k)
                extras.append(list(rest.items()))
                for c, values in out.items():
                    values.append(row.get(c))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(take) for i in range(4)), *(pa.array(v, types[columns[c]]) for c, v in out.items()), pa.array(extras, pa.map_(pa.string(), pa.string()))], [*b.schema.names[:4], *(shown[c] for c in out), "extras"]
            )

    head = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema[:4]]
    return src.mapInArrow(run, ", ".join([*head, *(f"`{shown[c]}` {TYPES[k]}" for c, k in columns.items()), "extras map<string,string>"]))


def long_values(table: DataFrame) -> DataFrame:
    """raw_id, field, is_column, number, text: the consistent table as one row for each value.

    Booleans count as 1 and 0; ``field`` is the column, or the path of a value in ``extras``.
    """
    kept = [f for f in table.schema if f.name.startswith("f_")]
    none = F.lit(None)
    cells = [
        F.struct(
            F.lit(f.name).alias("field"), F.lit(True).alias("is_column"), (none if f.dataType.simpleString() == "string" else F.col(f.name)).cast("double").alias("number"),
            (F.col(f.name) if f.dataType.simpleString() == "string" else none).cast("string").alias("text"),
        )
        for f in kept
    ]
    bare = lambda v: F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    rest = F.transform(F.map_entries("extras"), lambda e: F.struct(e["key"].alias("field"), F.lit(False).alias("is_column"), none.cast("double").alias("number"), bare(e["value"]).alias("text")))
    one = table.select("raw_id", F.explode(F.concat(F.array(*cells), rest) if cells else rest).alias("x")).select("raw_id", "x.*")
    return one.where("number is not null or text is not null")
