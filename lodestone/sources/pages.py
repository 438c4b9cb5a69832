"""Texts of documents put together from their pages (SRC-16 to SRC-21, FLT-09, FLT-15, AG-20, AG-27 to AG-30, RT-16).

Readers of PDFs and images are plug-ins; what they give is a frame of pages (document, page number from 1, text, perhaps a
recognised text), and the rules by which a document comes of it are here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import is_blank, strip
from lodestone.operators.classify import valid_text
from lodestone.sources.formats import Extractor

#: Texts of a page or document that are shorter call for recognition, by kind of run.
PAIR_PAGE, SIMPLE_PAGE, WHOLE = 50, 100, 100


def chain(*readers: Extractor) -> Extractor:
    """SRC-16: the first reader that gives a text; the errors of all before it are kept; none without any."""

    def read(raw: bytes) -> tuple[str, str, list[str]]:
        errors: list[str] = []
        for r in readers:
            try:
                text, method, own = r(raw)
            except Exception as e:  # noqa: BLE001
                errors.append(f"{type(e).__name__}: {e}")
                continue
            errors += own
            if text.strip():
                return text.strip(), method, errors
        return "", "none", errors

    return read


def first_pages(pages: DataFrame, page: str, n: int) -> DataFrame:
    """FLT-15: the sample of the first pages."""
    return pages.where(F.col(page) <= n)


def with_recognition(text: Column, recognised: Column, least: int) -> Column:
    """SRC-18, SRC-20: the recognised text where the page's own is too short, if there is one."""
    own, other = F.coalesce(text, F.lit("")), F.coalesce(recognised, F.lit(""))
    return F.when((F.length(strip(own)) < least) & (F.length(strip(other)) > 0), other).otherwise(own)


def joined_pages(pages: DataFrame, key: str, page: str, text: str, mark: str | None = "=== Page {} ===", between: str = "\n\n") -> DataFrame:
    """SRC-17, SRC-18, SRC-21: the pages that aren't blank in their order, each under its mark, and whether the text is valid."""
    shown = F.col(text) if mark is None else F.concat(F.lit(mark.split("{}")[0]), F.col(page).cast("string"), F.lit(mark.split("{}")[1] + "\n"), F.col(text))
    listed = F.sort_array(F.collect_list(F.when(~is_blank(F.col(text)), F.struct(F.col(page).alias("p"), shown.alias("t")))))
    out = pages.groupBy(key).agg(F.count("*").alias("pages"), F.array_join(F.transform(listed, lambda x: x["t"]), between).alias("text"))
    return out.withColumn("success", valid_text(F.col("text")))


def with_whole_recognition(docs: DataFrame, text: str, recognised: str, least: int = WHOLE) -> DataFrame:
    """SRC-19: a document whose text stays too short gets that of its recognised pages."""
    return docs.withColumn(text, with_recognition(F.col(text), F.col(recognised), least))


def detected_charts(drawings: Column) -> Column:
    """RT-16: more than five drawings on a page count as one chart."""
    return F.when(drawings > 5, 1).otherwise(0)


def page_features(pages: DataFrame, key: str, page: str, text: str, visuals: str, sample: int = 3) -> DataFrame:
    """AG-28: characters, visuals and pages of the first pages of each document."""
    return first_pages(pages, page, sample).groupBy(key).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("bigint").alias("chars"), F.coalesce(F.sum(visuals), F.lit(0)).cast("bigint").alias("visuals"), F.count("*").alias("pages"))


def header_pages(pages: DataFrame, key: str, patterns: Column, least: int = 2) -> DataFrame:
    """AG-29: whether a page of the document has so many header patterns."""
    return pages.groupBy(key).agg(F.bool_or(patterns >= least).alias("is_email"))


def presentation_pages(pages: DataFrame, key: str, signs: Column, least: int = 2) -> DataFrame:
    """AG-30: whether the signs of all pages together reach so many."""
    return pages.groupBy(key).agg((F.sum(signs) >= least).alias("is_presentation"))
