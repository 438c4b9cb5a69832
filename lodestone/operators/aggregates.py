"""Aggregations (AG-01 to AG-34) as grouped expressions with partial aggregation before every shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import is_blank, percent_share


def category_stats(pairs: DataFrame, category: Column, zip_file: Column, ok: Column) -> DataFrame:
    """AG-01, AG-02, AG-07, AG-08: zips, pairs, successes and their share by category."""
    g = pairs.groupBy(category.alias("category")).agg(F.countDistinct(zip_file).alias("zip_files"), F.count("*").alias("pairs"), F.count_if(ok).alias("successful"))
    return g.withColumns({"failed": F.col("pairs") - F.col("successful"), "success_rate": F.round(percent_share(F.col("successful"), F.col("pairs")), 6)})


def stats_rollup(df: DataFrame, by: list[str], ok: Column, seconds: Column) -> DataFrame:
    """AG-03, AG-04: processed, failed and mean time, by all keys and above them; the level says how many keys are rolled up."""
    return df.rollup(*by).agg(F.count("*").alias("processed"), F.count_if(~ok).alias("failed"), F.round(F.avg(seconds), 6).alias("mean_time"), F.grouping_id().cast("bigint").alias("level"))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG-18: for each column, rows with and without content and the share with; one pass, one row per column."""
    sums = df.agg(F.count("*").alias("n"), *(F.count_if(~is_blank(F.col(c).cast("string"))).alias(f"f{i}") for i, c in enumerate(columns)))
    pairs = ", ".join(f"'{c}', f{i}" for i, c in enumerate(columns))
    out = sums.selectExpr("n", f"stack({len(columns)}, {pairs}) as (name, filled)")
    return out.select("name", "filled", (F.col("n") - F.col("filled")).alias("empty"), F.round(percent_share(F.col("filled"), F.col("n")), 6).alias("rate"))


def exact_sum(c: str) -> Column:
    """The sum of doubles, the same in any order of the rows: added as decimals of 18 places, as doubles only if one has 10^9 or more or isn't finite."""
    small = F.abs(c) < 1e9
    return F.when(F.bool_and(small), F.sum(F.when(small, F.col(c).cast("decimal(38,18)"))).cast("double")).otherwise(F.sum(c))


def exact_mean(c: str) -> Column:
    return exact_sum(c) / F.nullif(F.count(c), F.lit(0))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG-19: min, max and mean (2 decimals) of each numeric column."""
    sums = df.agg(*(f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max), ("c", F.avg))))
    pairs = ", ".join(f"'{c}', a{i}, b{i}, c{i}" for i, c in enumerate(columns))
    return sums.selectExpr(f"stack({len(columns)}, {pairs}) as (name, lowest, highest, mean)").withColumn("mean", F.round("mean", 2))


def mode_of(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG-14: the most frequent value of each group, ties to the smallest; null where all are null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("value"))).alias("b"))
    return best.select(*by, F.col("b.value").alias("mode"), (-F.col("b.m")).alias("n"))


def exact_floor_quantiles(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """AG-23 for groups of any size: the values are counted first, and the cumulated counts find the place.

    No group's values meet in one row; equal values travel as one.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(by)
    placed = counts.withColumns({"upto": F.sum("n").over(own.orderBy(value)), "total": F.sum("n").over(own)})
    at = F.floor(F.lit(q) * (F.col("total") - 1))
    return placed.where(F.col("upto") > at).groupBy(by).agg(F.min(value).alias("quantile"), F.first("total").alias("n"))


def joined_in_order(df: DataFrame, by: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """AG-16: the texts of a group that aren't blank, in order, joined."""
    kept = df.where(~is_blank(F.col(text)))
    listed = F.sort_array(F.collect_list(F.struct(order, text)))
    return kept.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x[text]), separator).alias("text"))
