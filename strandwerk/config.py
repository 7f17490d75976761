"""Configuration trees with ``${a.b}`` references, and checks of request parameters."""

from __future__ import annotations

import re
from datetime import date
from typing import Any

_REF = re.compile(r"\$\{([A-Za-z0-9_.]+)\}")
# Intervals and periods of price and report requests.
INTERVALS = ("second", "minute", "day", "week", "month", "year")
PERIODS = ("annual", "quarterly", "ttm")


def lookup(tree: dict, path: str) -> Any:
    """The value at a dotted path; KeyError if there is none."""
    for part in path.split("."):
        tree = tree[part]
    return tree


def interpolate(tree: dict, values: dict[str, Any] | None = None) -> dict:
    """A tree whose references are replaced, also through other references; ``values`` come before the tree.

    An unknown reference stays as it is; a circle of references raises ValueError.
    """
    values = values or {}

    def text(s: str, seen: tuple[str, ...]) -> Any:
        def one(m: re.Match) -> str:
            key = m[1]
            if key in seen:
                raise ValueError(f"circular reference {key}")
            if key in values:
                return str(values[key])
            try:
                v = lookup(tree, key)
            except (KeyError, TypeError):
                return m[0]
            return str(text(v, (*seen, key))) if isinstance(v, str) else str(v)

        return _REF.sub(one, s)

    def walk(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return text(x, ()) if isinstance(x, str) else x

    return walk(tree)


def check_request(start: str | None = None, end: str | None = None, interval: str | None = None, period: str | None = None) -> None:
    """ValueError if a date isn't ISO, the range is empty, or the interval or period is unknown."""
    days = {}
    for name, s in (("start", start), ("end", end)):
        if s is not None:
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
                raise ValueError(f"{name} is no ISO date: {s}")
            days[name] = date.fromisoformat(s)
    if len(days) == 2 and days["start"] > days["end"]:
        raise ValueError("start is after end")
    if interval is not None and interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval}")
    if period is not None and period not in PERIODS:
        raise ValueError(f"unknown period {period}")
