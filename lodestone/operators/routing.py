"""Choice of processors, time limits, costs and the reading of model answers (RT-01 to RT-12).

The model calls themselves are left to plug-ins; here is what decides about them and what is made of their answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.json import embedded

#: Dollars for 1000 tokens in and out, by model family.
PRICES = {"vision": (0.01, 0.03), "text": (0.003, 0.015)}


def steps(c: Column, *limits: tuple[float, float], rest: float) -> Column:
    """The value of the first limit that ``c`` is over, else ``rest``."""
    out = None
    for limit, value in limits:
        out = F.when(c > limit, value) if out is None else out.when(c > limit, value)
    return out.otherwise(rest)


def layout_complexity(density: Column, font: Column, visuals: Column, pages: Column) -> Column:
    """RT-01, AG-26: mean of four scores: density of text, size of the font, visuals a page, and pages; at most 1."""
    small = F.when(font < 9, 0.9).when(font < 11, 0.6).otherwise(0.3)
    scores = steps(density, (0.015, 0.8), (0.010, 0.5), rest=0.2) + small
    scores = scores + steps(visuals / pages, (2, 0.7), (0.5, 0.4), rest=0.1) + steps(pages, (20, 0.6), (5, 0.3), rest=0.1)
    return F.round(F.least(F.lit(1.0), scores / 4), 6)


def difficulty(complexity: Column) -> Column:
    """RT-02."""
    return F.when(complexity > 0.7, "very_complex").when(complexity > 0.5, "complex").when(complexity > 0.3, "moderate").otherwise("simple")


#: Processors in the order of fallback behind each first choice.
FALLBACKS = {
    "cloud_gpt4v": ("cloud_claude", "local_qwen", "local_llava", "fallback_ocr"), "cloud_claude": ("cloud_gpt4v", "local_qwen", "local_llava", "fallback_ocr"),
    "local_qwen": ("cloud_claude", "local_llava", "fallback_ocr"), "local_llava": ("local_qwen", "fallback_ocr"), "fallback_ocr": (),
}


def recommended(text_density: Column, visual_density: Column, level: Column, available: list[str]) -> tuple[Column, Column]:
    """RT-03: the processor for a document, and the confidence in it: many visuals first, then dense text, then difficulty."""
    rules = [
        (visual_density > 1.0, "cloud_gpt4v", 0.9), (text_density > 0.012, "cloud_claude", 0.85), (level.isin("complex", "very_complex"), "local_qwen", 0.8),
        (level.isin("simple", "moderate"), "local_llava", 0.75), (F.lit(True), "local_qwen", 0.6), (F.lit(True), "local_llava", 0.5),
    ]
    name, sure = F.lit("fallback_ocr"), F.lit(0.3)
    for when, processor, confidence in reversed([r for r in rules if r[1] in available]):
        name, sure = F.when(when, processor).otherwise(name), F.when(when, confidence).otherwise(sure)
    return name, sure


def strategy(first: Column, level: Column, pages: Column, available: list[str]) -> dict[str, Column]:
    """RT-04: fallbacks that are available, time limit and cost estimate for a first processor and a difficulty."""
    rest = F.array().cast("array<string>")
    for name, order in FALLBACKS.items():
        rest = F.when(first == name, F.array(*(F.lit(x) for x in order if x in available)).cast("array<string>")).otherwise(rest)
    limit = F.when(level == "very_complex", 300).when(level == "complex", 180).when(level == "moderate", 120).otherwise(60)
    return {"fallbacks": rest, "timeout": limit, "cost": F.when(first.contains("cloud"), F.round(0.01 * pages, 6)).otherwise(0.0)}


def first_success(attempts: DataFrame, key: str, order: str, ok: str, *values: str) -> DataFrame:
    """RT-05: the first attempt of each document that went well; null values if none did."""
    return attempts.groupBy(key).agg(*(F.min_by(v, F.when(F.col(ok), F.col(order))).alias(v) for v in values))


def result_quality(chars: Column, confidence: Column, success: Column) -> Column:
    """RT-06: mean of text length score, confidence and success rate; parts that are null are left out."""
    text = F.when(chars > 100, 0.8).when(chars > 50, 0.5).when(chars > 0, 0.2)
    parts = F.filter(F.array(text, confidence, success), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts), 6))


def adaptive_timeout(p95: Column, factor: float = 1.5, base: float = 180.0, low: float = 60.0, high: float = 600.0) -> Column:
    """RT-07: the 95 % time times ``factor`` within limits; ``base`` without data."""
    return F.when(p95.isNull(), base).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), p95 * factor)))


def parsed_answer(answer: Column, default: float = 0.6, without: float = 0.4, broken: float = 0.3) -> dict[str, Column]:
    """RT-08: content type and confidence that a model's answer gives, from the JSON within its prose."""
    raw = embedded(answer)
    fine = F.try_parse_json(raw).isNotNull()
    said = F.get_json_object(raw, "$.confidence").try_cast("double")
    confidence = F.when(raw.isNull(), without).when(fine, F.coalesce(said, F.lit(default))).otherwise(broken)
    return {"content_type": F.when(fine, F.coalesce(F.get_json_object(raw, "$.content_type"), F.lit("unknown"))).otherwise("unknown"), "confidence": confidence, "parsed": F.coalesce(fine, F.lit(False))}


def token_cost(tokens_in: Column, tokens_out: Column, family: str = "vision") -> Column:
    """RT-10."""
    a, b = PRICES[family]
    return F.round(tokens_in / 1000 * a + tokens_out / 1000 * b, 8)


def backoff_seconds(attempt: Column, most: float = 30.0) -> Column:
    """RT-12: 2 to the power of the attempt, at most ``most``."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(most))


def roll_up_pages(pages: DataFrame, key: str, page: str, kind: str, confidence: str, text: str, ok: str) -> DataFrame:
    """RT-11: one row a document: most frequent type (ties to the smallest), mean confidence, joined text and successes."""
    from lodestone.operators.aggregates import joined_in_order, mode_of

    good = pages.where(F.col(ok))
    stats = pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(F.col(ok)).alias("good_pages"), F.round(F.avg(F.when(F.col(ok), F.col(confidence))), 6).alias("confidence"))
    return stats.join(mode_of(good, [key], kind).select(key, F.col("mode").alias("kind")), key, "left").join(joined_in_order(good, key, page, text), key, "left")
