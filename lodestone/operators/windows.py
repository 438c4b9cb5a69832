"""Order-dependent operators (WN-01 to WN-13) as windows or folds within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that are no topic.
STOPWORDS = ("the", "and", "that", "for", "with", "this", "are", "from")


def topics(docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """WN-01, WN-02, GR-05, AG-11: the ``k`` most frequent terms of each text with their relevance.

    Terms are words of three letters or more that are no stopwords.  Ties go to the term that stands first.
    """
    terms = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0))
    each = docs.select(F.col(key), F.posexplode(terms).alias("pos", "term")).where(~F.col("term").isin(*STOPWORDS))
    counts = each.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    own = Window.partitionBy(key)
    ranked = counts.withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "first"))).where(F.col("rank") <= k)
    return ranked.withColumn("relevance", F.round(F.col("n") / F.max("n").over(own), 6)).select(key, "term", "n", "rank", "relevance")


def exponential_mean(df: DataFrame, by: str, order: list[str], value: str, alpha: float = 0.1) -> DataFrame:
    """WN-09: the last of h = alpha x + (1 - alpha) h from h = 0, over the values of a group in order.

    As a sum: h is the sum of alpha (1 - alpha)^k x over the values, k counted from the last; so groups of any size
    aggregate without a list of their values.
    """
    last = Window.partitionBy(by).orderBy(*(F.desc(o) for o in order))
    k = F.row_number().over(last) - 1
    return df.withColumn("w", F.lit(alpha) * F.pow(F.lit(1 - alpha), k) * F.col(value)).groupBy(by).agg(F.round(F.sum("w"), 6).alias("ema"), F.count("*").alias("n"))


def cost_gate(df: DataFrame, by: list[str], order: list[str], cost: str, limit: float) -> DataFrame:
    """WN-10, FLT-16: what was spent before each row of its day, and whether the row may still run."""
    before = F.sum(cost).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("spent", F.round(F.coalesce(before, F.lit(0.0)), 6)).withColumn("allowed", F.col("spent") < limit)


def gap_groups(df: DataFrame, by: str, at: str, gap: float, *ties: str) -> DataFrame:
    """WN-06: rows of a group whose distance to the row before is over ``gap`` begin a new line or session (from 1)."""
    order = Window.partitionBy(by).orderBy(at, *ties)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(1))
    return df.withColumn("line", F.sum(new).over(order))


def sections(lines: DataFrame, by: str, pos: str, line: str, heading: Column) -> DataFrame:
    """WN-07: each line's section, the last heading at or before it, "Header" before the first."""
    order = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(F.when(heading, F.col(line)), ignorenulls=True).over(order), F.lit("Header")))


def slide_spans(marks: DataFrame, by: str, start: str, length: str, *ties: str) -> DataFrame:
    """WN-05: from each mark to the next, the last to the end of the text."""
    return marks.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(by).orderBy(start, *ties)), F.col(length)))
