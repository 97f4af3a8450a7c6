"""Wildcard patterns over names and values."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_pattern(value) -> bool:
    return isinstance(value, str) and any(c in value for c in "*?[")


def resolve_patterns(patterns: Iterable[str], available: list[str]) -> list[str]:
    """Names that the patterns stand for, in order and once; a literal stands for itself."""
    found = []
    for p in patterns:
        found += fnmatch.filter(available, p) if has_pattern(p) else [p]
    return list(dict.fromkeys(found))


def include_exclude(include: list[str] | None, exclude: list[str] | None, available: list[str]) -> list[str]:
    """Names to keep: those included (all if none are named), less those excluded."""
    kept = resolve_patterns(include, available) if include else list(available)
    gone = set(resolve_patterns(exclude, available)) if exclude else set()
    return [c for c in kept if c not in gone]


def java_regex(pattern: str) -> str:
    """A wildcard pattern as an anchored expression; ``*`` and ``?`` don't match a line end."""
    inner = re.match(r"\(\?s:(.*)\)\\[zZ]\Z", fnmatch.translate(pattern), re.DOTALL)
    body = inner[1] if inner else fnmatch.translate(pattern)
    return rf"\A(?:{body})\z"


def matches(column: Column, pattern: str) -> Column:
    """Wildcard test; plain prefixes, suffixes and parts stay pushable predicates."""
    body = pattern.strip("*")
    if not has_pattern(body) and body:
        one_line = ~column.contains("\n")
        if pattern == body + "*":
            return column.startswith(body) & one_line
        if pattern == "*" + body:
            return column.endswith(body) & one_line
        if pattern == "*" + body + "*":
            return column.contains(body) & one_line
    return column.rlike(java_regex(pattern))


def value_condition(column: Column, values) -> Column:
    """A list is membership, or patterns if any value is one; a single value is equality."""
    if not isinstance(values, (list, tuple)):
        return column == F.lit(values)
    if not any(map(has_pattern, values)):
        return column.isin(list(values))
    condition = F.lit(False)
    for v in values:
        condition = condition | matches(column.cast("string"), str(v))
    return condition
