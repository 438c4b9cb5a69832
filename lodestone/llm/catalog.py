"""The queries of the subpackage by name, and their SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import bpe, leaks, mail, neardups, neighbours, personal, scans, spans, split, sql
from lodestone.tables import load, once


def _near(spark, folder):
    pairs = load(spark, folder, "pair_records").select("document_id", F.col("content_file.extracted_text").alias("text"))
    return neardups.near_duplicates(pairs, "document_id", "text")


def p1_found(spark, folder):
    """Problem 1: the pairs of records whose texts share 0.7 of their runs of three words."""
    return neardups.similar_pairs(*_near(spark, folder), "document_id")


def p1_groups(spark, folder):
    """Problem 1: the class, the group and the number of similar records of each record."""
    return neardups.groups(*_near(spark, folder), "document_id")


def p2_found(spark, folder):
    """Problem 2: the pairs of chunks of which one is among the five most similar of the other."""
    return neighbours.neighbour_pairs(neighbours.nearest(load(spark, folder, "chunks")))


def _scans(spark, folder):
    pairs = scans.records(load(spark, folder, "pair_records"), "document_id", "content_file.extracted_text")
    return scans.repair(pairs.unionByName(scans.records(load(spark, folder, "vlm_results"), "doc_id", "text_content")))


def p3_found(spark, folder):
    """Problem 3: what is wrong on which page."""
    return scans.findings(_scans(spark, folder))


def p3_repaired(spark, folder):
    """Problem 3: the records as continuous paragraphs."""
    return _scans(spark, folder).select("record_id", "text")


def p4_pieces(spark, folder):
    """Problem 4: the pieces of all texts of the store and of all chunks."""
    texts = split.split_texts(load(spark, folder, "store_documents"), "doc_id", "text_content")
    return texts.unionByName(split.split_texts(load(spark, folder, "chunks"), "chunk_id", "text_chunk"))


def p4_found(spark, folder):
    """Problem 4: the items that had to be cut, and at which boundary."""
    return split.boundaries(p4_pieces(spark, folder))


def _mail(spark, folder):
    pairs = load(spark, folder, "pair_records").where(F.lower(F.trim("category")) == "emails")
    return mail.label_lines(pairs.select("document_id", F.col("content_file.extracted_text").alias("text")))


def p5_found(spark, folder):
    """Problem 5: the lines of e-mails that their senders did not newly write."""
    return mail.not_new(_mail(spark, folder))


def p5_new_text(spark, folder):
    """Problem 5: what the senders of e-mails newly wrote."""
    return _mail(spark, folder).select("document_id", "new_text")


def _personal(spark, folder):
    pairs = once(load(spark, folder, "pair_records"), "document_id")
    store = once(load(spark, folder, "store_documents"), "doc_id")
    meta = F.col("metadata_file.extracted_text")
    listed = F.regexp_extract_all(meta, F.lit(r"(?m)^(?:Author|Recipient):[ \t]*(.*)$"), F.lit(1))
    names = personal.learn_names(personal.people_segments((store, F.col("author")), (pairs, F.array_join(listed, ";"))))
    texts = pairs.select(F.col("document_id").alias("record_id"), F.explode(F.create_map(F.lit("content_file.extracted_text"), F.col("content_file.extracted_text"), F.lit("metadata_file.extracted_text"), meta)).alias("field", "text"))
    texts = texts.unionByName(store.select(F.col("doc_id").alias("record_id"), F.lit("author").alias("field"), F.col("author").alias("text")))
    return personal.scan(texts, names)


def p7_found(spark, folder):
    """Problem 7: where personal data stand in the texts."""
    return personal.items(_personal(spark, folder))


def p7_redacted(spark, folder):
    """Problem 7: the texts with typed placeholders for personal data."""
    return _personal(spark, folder).select("record_id", "field", "redacted")


def p8_ids(spark, folder):
    """Problem 8: the token ids of every document."""
    return bpe.encode_corpus(load(spark, folder, "documents"))


def p9_leaks(spark, folder):
    """Problem 9: documents with test items, how much of the item they hold, and whether they hold its answer."""
    return leaks.find_leaks(load(spark, folder, "documents"), load(spark, folder, "eval_items"))


def p9_found(spark, folder):
    """Problem 9: documents and the test items of which they have 12 words in a row."""
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p10_found(spark, folder):
    """Problem 10: the pairs of documents with a common span of 300 characters or more."""
    return spans.sharing_pairs(spans.shared_spans(load(spark, folder, "documents")))


def p10_shares(spark, folder):
    """Problem 10: how much of each document lies in spans that other documents have too."""
    docs = load(spark, folder, "documents")
    return spans.shared_share(docs, spans.shared_spans(docs))


def queries():
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p3_found, p3_repaired, p4_found, p4_pieces, p5_found, p5_new_text, p7_found, p7_redacted, p8_ids, p9_found, p9_leaks, p10_found, p10_shares)}


def oracle_sql():
    return dict(sql.SQL)
