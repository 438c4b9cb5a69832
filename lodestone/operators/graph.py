"""A property graph derived from documents (GR-01 to GR-12, JN-07, JN-09, JN-11).

Nodes are (label, id, name), edges (src_label, src, type, dst_label, dst).  Both are plain frames with distinct rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1000)))


def author_key(author: Column) -> tuple[Column, Column]:
    """GR-01: key and name of an author: of an address, the name its local part spells; else an address made of the name."""
    local = F.split(F.split(author, "@")[0], r"\.")
    spelled = F.when(F.size(local) > 1, F.array_join(F.transform(local, capitalised), " ")).otherwise(F.split(author, "@")[0])
    at = author.contains("@")
    return F.when(at, author).otherwise(F.concat(F.replace(F.lower(author), F.lit(" "), F.lit(".")), F.lit("@placeholder.com"))), F.when(at, spelled).otherwise(author)


def person_nodes(docs: DataFrame) -> DataFrame:
    """Distinct people of the author field; blank authors give none.  Of one key, the first name by order counts."""
    key, name = author_key(F.col("author"))
    one = docs.where(F.coalesce(F.length(F.trim("author")) > 0, F.lit(False))).select(key.alias("id"), name.alias("name"))
    return one.groupBy("id").agg(F.min("name").alias("name")).select(F.lit("Person").alias("label"), "id", "name")


def edges(df: DataFrame, src_label: str, src: Column, kind: str, dst_label: str, dst: Column) -> DataFrame:
    """The distinct edges of two columns; rows with a null end give none."""
    out = df.select(F.lit(src_label).alias("src_label"), src.cast("string").alias("src"), F.lit(kind).alias("type"), F.lit(dst_label).alias("dst_label"), dst.cast("string").alias("dst"))
    return out.where("src is not null and dst is not null").distinct()


def guarded(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN-11: only edges whose ends are both among the nodes."""
    n = nodes.select("label", "id")
    a = edge.join(n.toDF("src_label", "src"), ["src_label", "src"], "left_semi")
    return a.join(n.toDF("dst_label", "dst"), ["dst_label", "dst"], "left_semi").select("src_label", "src", "type", "dst_label", "dst")


def document_edges(docs: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """GR-06, GR-09, SNK-11: authors, types and, if given, topics of documents."""
    types = docs.select("doc_id", F.explode("content_type").alias("t"))
    out = edges(docs.where(F.length(F.trim("author")) > 0), "Document", F.col("doc_id"), "AUTHORED_BY", "Person", author_key(F.col("author"))[0])
    out = out.unionByName(edges(types, "Document", F.col("doc_id"), "HAS_TYPE", "ContentType", F.col("t")))
    return out if topics is None else out.unionByName(edges(topics, "Document", F.col("doc_id"), "CONTAINS", "Topic", F.col("term")))


def thread_of(subject: Column) -> tuple[Column, Column]:
    """GR-03: normalised subject and id of an e-mail thread: one re: then one fwd: is removed."""
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.lower(subject)), "^re:", "")), "^fwd:", ""))
    return s, F.md5(s)


def participants(mails: DataFrame, key: str, sender: str, to: str, cc: str) -> DataFrame:
    """GR-04: key, address and role of all who take part; only what has an at-sign counts."""
    out = None
    for column, role in ((sender, "SENDER"), (to, "RECIPIENT"), (cc, "CC")):
        part = mails.select(key, F.explode(F.split(F.coalesce(column, F.lit("")), "," if role != "SENDER" else "\x00")).alias("a"), F.lit(role).alias("role"))
        out = part if out is None else out.unionByName(part)
    return out.select(key, F.trim("a").alias("address"), "role").where(F.col("address").contains("@")).distinct()


def references(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """GR-07: edges of metadata.references, a list of objects with doc_id and type (REFERENCES if there is none)."""
    listed = F.from_json(F.get_json_object(raw, "$.references"), "array<struct<doc_id: string, type: string>>")
    one = docs.select(key, F.explode(listed).alias("r")).where("r.doc_id is not null")
    return one.select(F.lit("Document").alias("src_label"), F.col(key).cast("string").alias("src"), F.coalesce("r.type", F.lit("REFERENCES")).alias("type"), F.lit("Document").alias("dst_label"), F.col("r.doc_id").alias("dst")).distinct()


def related(edge: DataFrame, k: int = 10) -> DataFrame:
    """JN-07, TK-03, FLT-13: a, b and relevance (the number of edges between them, either way) of neighbours, the ``k`` best of each.

    Edges of a node with itself don't count; ties go to the smaller neighbour.  The counts are aggregated before the
    shuffle for the ranking, and the ranking keeps ``k`` rows a node in each task first.
    """
    both = edge.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edge.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    scored = both.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("relevance"))
    order = Window.partitionBy("a").orderBy(F.desc("relevance"), "b")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def degrees(edge: DataFrame) -> DataFrame:
    """JN-09, GR-11: label, id, and how many edges go out and come in."""
    out = edge.groupBy(F.col("src_label").alias("label"), F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    come = edge.groupBy(F.col("dst_label").alias("label"), F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    both = out.join(come, ["label", "id"], "full")
    return both.select("label", "id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def describes(pairs: DataFrame, metadata: Column, content: Column) -> DataFrame:
    """GR-08: an edge from each metadata document to the content document that it describes."""
    return edges(pairs, "Document", metadata, "DESCRIBES", "Document", content)


def sheet_edges(docs: DataFrame, key: str, sheets: str) -> DataFrame:
    """GR-10: an edge from each document to each of its sheets (an array of structs with a name); two runs give the same edges."""
    one = docs.select(key, F.explode(sheets).alias("s"))
    return edges(one, "Document", F.col(key), "CONTAINS_SHEET", "Sheet", F.concat_ws("#", F.col(key), F.col("s.name")))


def subgraph(edge: DataFrame, documents: DataFrame, key: str = "doc_id", include_topics: bool = True) -> DataFrame:
    """GR-11, FLT-12: what is around each of ``documents``: doc_id, direction, type, label and id of the node at the other end.

    Without topics, topic nodes and CONTAINS edges are left out.
    """
    kept = edge if include_topics else edge.where("src_label <> 'Topic' and dst_label <> 'Topic' and type <> 'CONTAINS'")
    own = documents.select(F.col(key).cast("string").alias("own")).distinct()
    out = kept.where("src_label = 'Document'").join(own, F.col("src") == F.col("own"), "left_semi").select(F.col("src").alias("doc_id"), F.lit("out").alias("direction"), "type", F.col("dst_label").alias("label"), F.col("dst").alias("id"))
    come = kept.where("dst_label = 'Document'").join(own, F.col("dst") == F.col("own"), "left_semi").select(F.col("dst").alias("doc_id"), F.lit("in").alias("direction"), "type", F.col("src_label").alias("label"), F.col("src").alias("id"))
    return out.unionByName(come).distinct()


def expand_hits(hits: DataFrame, edge: DataFrame, top: int = 3, k: int = 10) -> DataFrame:
    """JN-06: the related documents of the first ``top`` hits (rank, doc_id): rank, doc_id, related, relevance and place.

    A document that is related to several hits, or that hits twice, comes once for each of them.
    """
    first = hits.where(F.col("rank") <= top).select("rank", "doc_id")
    near = edge.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edge.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    own = near.join(first.select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi")
    ranked = related(own.select(F.col("a").alias("src"), F.col("b").alias("dst")), k).where(F.col("rank") <= k)
    one = ranked.select(F.col("a").alias("doc_id"), F.col("b").alias("related"), "relevance", F.col("rank").alias("place"))
    return first.join(one, "doc_id").select("rank", "doc_id", "related", "relevance", "place")
