"""Pieces of SQL for the other side of the comparison."""

from __future__ import annotations

SP = r"[ \t\n\r\f\x0B]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '{SP}+'), lambda w: w <> '')"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(x: str, terms) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def labels(x: str, rules) -> str:
    """The labels that fit a text, as a list."""
    low = f"lower(coalesce({x}, ''))"
    return "list_filter([" + ", ".join(f"case when {any_of(low, t)} then {lit(n)} end" for n, t in rules.items()) + "], lambda l: l is not null)"
