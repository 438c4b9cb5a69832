"""Content-aware chunking (CHK-01 to CHK-07).

Each chunker gives the chunks of one text as an array of structs (ord, chunk, tag), built of column expressions alone;
``chunk_documents`` explodes them.  Texts of any length stay one row until the end and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import SPACE, strip

# The markers of parts.
EMAIL_MARKS = r"----+ ?Original Message ?----+|----+ ?Forwarded Message ?----+|On [^\n]* wrote:|From:[^\n]*Sent:[^\n]*To:[^\n]*Subject:"
SLIDE_MARK = rf"---{SPACE}*SLIDE{SPACE}+[0-9]+{SPACE}*---"
SLIDE_NUMBER = rf"^---{SPACE}*SLIDE{SPACE}+([0-9]+)"
VISUAL_MARK = r"\[Visual Element[^\]]*\]:"
#: CHK-06: limit and overlap by kind of content.
SIZES = {"regular": (500, 50), "email": (300, 30), "presentation": (250, 25), "image": (400, 40)}


def _items(parts: Column, tag: Column | None = None, prefix: str | None = None, first: int = 0) -> Column:
    """(ord, chunk, tag) of the parts that aren't blank; ord counts blank ones too."""
    numbered = F.transform(
        parts,
        lambda x, i: F.struct((i + first).cast("int").alias("ord"), strip(x).alias("chunk"), (F.concat(F.lit(prefix), (i + first).cast("string")) if prefix else F.lit(None).cast("string") if tag is None else tag).alias("tag")),
    )
    return F.filter(numbered, lambda s: F.length(s["chunk"]) > 0)


def regular_chunks(text: Column, limit: int = 500, overlap_words: int = 50, paragraph: str = rf"\n{SPACE}*\n") -> Column:
    """CHK-02: paragraphs are added while the chunk stays within ``limit`` characters, the separator not counted.

    A chunk that would grow beyond it is emitted, and the next begins with its last words.  A paragraph over the limit is
    never split.  An empty or null text has no chunk, a blank one has one empty chunk.
    """
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, par: Column) -> Column:
        cur, out = state["cur"], state["out"]
        tail = F.filter(F.split(cur, rf"{SPACE}+"), lambda w: w != "")
        keep = F.slice(tail, F.greatest(F.size(tail) - overlap_words + 1, F.lit(1)), F.lit(overlap_words))
        full = F.length(cur) + F.length(par) > limit
        emitted = F.when(full & (F.length(cur) > 0), F.concat(out, F.array(strip(cur)))).otherwise(out)
        again = F.when(F.length(cur) > 0, F.concat(F.array_join(keep, " "), F.lit(" "), par)).otherwise(par)
        longer = F.when(F.length(cur) > 0, F.concat(cur, F.lit("\n\n"), par)).otherwise(par)
        return F.struct(F.when(full, again).otherwise(longer).alias("cur"), emitted.alias("out"))

    folded = F.aggregate(F.split(text, paragraph), start, step, lambda s: F.concat(s["out"], F.when(F.length(s["cur"]) > 0, F.array(strip(s["cur"]))).otherwise(F.array().cast("array<string>"))))
    done = F.when(F.coalesce(F.length(text), F.lit(0)) > 0, folded).otherwise(F.array().cast("array<string>"))
    return F.transform(done, lambda x, i: F.struct(i.cast("int").alias("ord"), x.alias("chunk"), F.lit(None).cast("string").alias("tag")))


def email_chunks(text: Column) -> Column:
    """CHK-03: parts between the marks of quoted messages; without a mark, regular chunks."""
    return F.when(text.rlike(EMAIL_MARKS), _items(F.split(text, EMAIL_MARKS), prefix="email_part_")).otherwise(regular_chunks(text))


def presentation_chunks(text: Column) -> Column:
    """CHK-04: slides from mark to mark, tagged with their numbers; text before the first is dropped; without a mark, regular chunks."""
    slides = F.filter(F.split(text, f"(?={SLIDE_MARK})"), lambda s: s.rlike(f"^{SLIDE_MARK}"))
    numbered = F.transform(slides, lambda s, i: F.struct(i.cast("int").alias("ord"), strip(s).alias("chunk"), F.concat(F.lit("slide_"), F.regexp_extract(s, SLIDE_NUMBER, 1)).alias("tag")))
    return F.when(text.rlike(SLIDE_MARK), numbered).otherwise(regular_chunks(text))


def image_chunks(text: Column) -> Column:
    """CHK-05: head and visual elements; a text without elements is one chunk, a blank one an empty chunk."""
    t = F.coalesce(text, F.lit(""))
    split = F.split(t, VISUAL_MARK)
    parts = F.transform(split, lambda x, i: F.struct(i.cast("int").alias("ord"), strip(x).alias("chunk"), F.when(i == 0, F.lit("general")).otherwise(F.concat(F.lit("visual_element_"), i.cast("string"))).alias("tag")))
    whole = F.array(F.struct(F.lit(0).alias("ord"), strip(t).alias("chunk"), F.lit(None).cast("string").alias("tag")))
    return F.when(t.contains("[Visual Element"), F.filter(parts, lambda s: F.length(s["chunk"]) > 0)).otherwise(whole)


def chunks_by_type(types: Column, text: Column) -> Column:
    """CHK-01: the first of email, presentation and image among the types decides, else regular."""
    have = F.coalesce(types, F.array().cast("array<string>"))
    return F.when(F.array_contains(have, "email"), email_chunks(text)).when(F.array_contains(have, "presentation"), presentation_chunks(text)).when(F.array_contains(have, "image"), image_chunks(text)).otherwise(regular_chunks(text))


def chunk_documents(docs: DataFrame, chunks: Column, key: str = "doc_id", tags: Column | None = None) -> DataFrame:
    """chunk_id, doc_id, ord, text_chunk and tag_context of ``chunks``; the id is a hash of document and place."""
    base = F.coalesce(tags, F.array().cast("array<string>")) if tags is not None else F.array().cast("array<string>")
    one = docs.select(F.col(key).cast("string").alias("doc_id"), base.alias("tags"), F.explode(chunks).alias("c"))
    return one.select(
        F.sha2(F.concat_ws("|", "doc_id", F.col("c.ord")), 256).alias("chunk_id"), "doc_id", F.col("c.ord").alias("ord"), F.col("c.chunk").alias("text_chunk"),
        F.when(F.col("c.tag").isNull(), F.col("tags")).otherwise(F.concat("tags", F.array("c.tag"))).alias("tag_context"),
    )


def sized_chunks(kind: str, text: Column) -> Column:
    """CHK-06: regular chunks with the limit and overlap of a kind of content."""
    limit, overlap = SIZES[kind]
    return regular_chunks(text, limit, overlap)


def office_slide_chunks(text: Column) -> Column:
    """CHK-07: slides under the mark that office files give them (=== SLIDE n ===), by the rule of CHK-04."""
    return presentation_chunks(F.regexp_replace(text, rf"==={SPACE}*(SLIDE{SPACE}+[0-9]+){SPACE}*===", "--- $1 ---"))
