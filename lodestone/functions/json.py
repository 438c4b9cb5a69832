"""JSON functions: an object within prose, flattening, and a summary of its structure."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedded(c: Column) -> Column:
    """JS-01: the text from the first brace to the last closing one; null without them."""
    first, last = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when((first > 0) & (F.instr(c, "}") > 0) & (last > first), F.substr(c, first, last - first + 1))


def flat_rows(value: object, path: str = "") -> Iterator[tuple[str, str | None]]:
    """JS-02: path and value of each leaf; keys are joined by dots, places of lists in brackets."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flat_rows(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from flat_rows(v, f"{path}[{i}]")
    else:
        yield path, None if value is None else value if isinstance(value, str) else json.dumps(value)


def flatten(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key, path and value of each leaf of the JSON in ``raw``; rows that don't parse or are null give none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for k, t in zip(pdf[key], pdf[raw]):
                try:
                    value = json.loads(t) if t is not None else None
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict | list):
                    out += [(k, p, v) for p, v in flat_rows(value)]
            yield pd.DataFrame(out, columns=[key, "path", "value"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, raw).mapInPandas(run, f"`{key}` {kind}, path string, value string")


def structure(c: Column) -> Column:
    """JS-03: what a JSON text is at its top: object with so many keys, array of so many items, or a single value."""
    keys, items = F.size(F.json_object_keys(c)), F.json_array_length(c)
    head = F.substring(F.ltrim(c), 1, 1)
    return (
        F.when((head == "{") & keys.isNotNull() & (keys >= 0), F.concat(F.lit("object:"), keys.cast("string")))
        .when((head == "[") & items.isNotNull(), F.concat(F.lit("array:"), items.cast("string")))
        .when(F.is_variant_null(F.try_parse_json(c)) | F.try_parse_json(c).isNotNull(), F.lit("value"))
    )


def item_types(c: Column, first: int = 10) -> Column:
    """AG-32: the distinct types of the first items of a JSON array, by name; null for what is no array.

    Names are those of JSON: null, boolean, number, string, array, object.
    """
    at = lambda i: F.regexp_replace(F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), F.format_string("$[%d]", i), "variant")), r"[<(].*", "")
    kind = lambda s: F.when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").when(s == "ARRAY", "array").when(s == "OBJECT", "object").otherwise("number")
    n = F.json_array_length(c)
    named = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(first)) - 1), lambda i: kind(at(i)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n > 0, F.array_sort(F.array_distinct(named)))
