"""Which file of an archive is the content and which its metadata (PAIR-01 to PAIR-09).

``files`` has zip (the group), category, base, path, size and ord (the order of listing).  Every rule is a grouped
aggregate of conditional extremes: one pass, one row per archive, with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Formats of images.
IMAGES = ("png", "jpg", "jpeg", "tiff", "bmp")


def _first(when: Column) -> Column:
    return F.min_by("path", F.when(when, F.col("ord")))


def _last(when: Column) -> Column:
    return F.max_by("path", F.when(when, F.col("ord")))


def _by_size(when: Column, largest: bool) -> Column:
    """The smallest or largest file; among equal sizes the first listed is smaller."""
    at = F.when(when, F.struct("size", "ord"))
    return F.max_by("path", at) if largest else F.min_by("path", at)


def pair_files(files: DataFrame) -> DataFrame:
    """zip, category, n, content and metadata by the rule of the category (PAIR-08).

    Presentations (PAIR-02), Images (PAIR-03) and Spreadsheets (PAIR-04) look for their formats; others with two PDFs or
    more go by names and, if either stays open, by size (PAIR-01); the rest by info names, then size (PAIR-05).
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ext = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    info, pdf, always = name.contains("info"), ext == "pdf", F.lit(True)
    starts = F.element_at(F.split("path", "/"), -1).startswith(F.col("base"))
    g = files.groupBy("zip", "category").agg(
        F.count("*").alias("n"), F.count_if(pdf).alias("pdfs"),
        _last(pdf & info).alias("p_info"), _last(pdf & ~info & starts).alias("p_content"), _by_size(pdf, False).alias("p_small"), _by_size(pdf, True).alias("p_large"),
        _first(ext.isin("ppt", "pptx")).alias("slides"), _first(pdf & info).alias("pdf_info"), _first(pdf).alias("pdf_first"),
        _first(ext.isin(*IMAGES)).alias("image"), _first(ext.isin("xlsx", "xls")).alias("sheet"), _first(ext == "csv").alias("csv"),
        _by_size(always, False).alias("small"), _by_size(always, True).alias("large"), _first(info).alias("any_info"), _first(~info).alias("no_info"), _first(always).alias("only"),
    )
    named = F.col("p_info").isNotNull() & F.col("p_content").isNotNull()
    table = F.coalesce("sheet", "csv")
    content = (
        F.when(F.col("category") == "Presentations", F.col("slides"))
        .when(F.col("category") == "Images", F.col("image"))
        .when(F.col("category") == "Spreadsheets", F.coalesce(table, F.when((F.col("n") >= 2) & F.col("pdf_info").isNull(), F.col("large"))))
        .when(F.col("pdfs") >= 2, F.when(named, F.col("p_content")).otherwise(F.col("p_large")))
        .when(F.col("n") == 1, F.col("only"))
        .when(F.col("any_info").isNotNull(), F.col("no_info"))
        .otherwise(F.col("large"))
    )
    metadata = (
        F.when(F.col("category") == "Presentations", F.coalesce("pdf_info", "p_small"))
        .when(F.col("category") == "Images", F.coalesce("pdf_info", "pdf_first"))
        .when(F.col("category") == "Spreadsheets", F.coalesce("pdf_info", F.when(F.col("n") >= 2, F.col("small"))))
        .when(F.col("pdfs") >= 2, F.when(named, F.col("p_info")).otherwise(F.col("p_small")))
        .when(F.col("n") == 1, F.lit(None).cast("string"))
        .when(F.col("any_info").isNotNull(), F.col("any_info"))
        .otherwise(F.col("small"))
    )
    return g.select("zip", "category", "n", content.alias("content"), metadata.alias("metadata"))


def content_candidates(files: DataFrame) -> DataFrame:
    """PAIR-06, WN-03: the content file of each archive: named like the archive first, then the largest; info PDFs are out."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kept = files.where(~(name.contains("info") & name.endswith(".pdf")))
    rank = F.struct(name.contains(F.lower(F.col("base"))).alias("named"), "size", (-F.col("ord")).alias("first"))
    return kept.groupBy("zip").agg(F.max_by("path", rank).alias("content"))


def strict_pairs(files: DataFrame) -> DataFrame:
    """PAIR-09: an error for each archive that doesn't hold exactly two PDFs."""
    n = F.count_if(F.lower("path").endswith(".pdf"))
    return files.groupBy("zip").agg(n.alias("pdfs")).withColumn("error", F.when(F.col("pdfs") != 2, F.concat(F.lit("expected 2 PDFs, found "), F.col("pdfs").cast("string"))))


def vision_pairs(files: DataFrame) -> DataFrame:
    """PAIR-07: zip, content and metadata of archives with two PDFs or more: names with info or metadata tell the metadata,
    names that begin like the archive the content; if either stays open, the smallest PDF is the metadata and the next the content."""
    bare = F.element_at(F.split("path", "/"), -1)
    low = F.lower(bare)
    f = files.where(low.endswith(".pdf"))
    about = F.lower(F.regexp_replace(bare, r"\.[^.]*$", "")).rlike("info|metadata")
    own = ~about & bare.startswith(F.col("base"))
    order = Window.partitionBy("zip").orderBy("size", "ord")
    g = f.withColumn("place", F.row_number().over(order)).groupBy("zip").agg(
        F.count("*").alias("n"), _last(about).alias("m"), _last(own).alias("c"), F.max(F.when(F.col("place") == 1, F.col("path"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("path"))).alias("second")
    )
    named = F.col("m").isNotNull() & F.col("c").isNotNull()
    return g.where("n >= 2").select("zip", F.when(named, F.col("c")).otherwise(F.col("second")).alias("content"), F.when(named, F.col("m")).otherwise(F.col("first")).alias("metadata"))
