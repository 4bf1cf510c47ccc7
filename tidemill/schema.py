"""Column roles and the canonical panel layout."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

# Name fragments that mark a column's role, in the order they are tried.
TIME_WORDS = ("date", "month", "year_month", "time", "period")
VALUE_WORDS = ("sales", "revenue", "value", "amount")


class RoleError(ValueError):
    """The time and value columns cannot be told from the column names."""


def _first_with(columns: Sequence[str], words: Sequence[str]) -> str | None:
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


def find_roles(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """(time column, value column) by name only; no job runs."""
    return _first_with(columns, TIME_WORDS), _first_with(columns, VALUE_WORDS)


def require_roles(columns: Sequence[str]) -> tuple[str, str]:
    """Like :func:`find_roles`, but missing or shared roles are errors."""
    ts, y = find_roles(columns)
    if ts is None:
        raise RoleError(f"no time column among {list(columns)}; expected a name with one of {TIME_WORDS}")
    if y is None:
        raise RoleError(f"no value column among {list(columns)}; expected a name with one of {VALUE_WORDS}")
    if ts == y:
        raise RoleError(f"column {ts!r} matches both roles; rename it or pass the roles explicitly")
    return ts, y


def tidy_name(name: str) -> str:
    """Trim, lower-case, blanks to underscores, everything else outside [a-z0-9_] dropped."""
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", name.strip().lower()))


def tidy_column_names(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`tidy_name`; two columns ending up equal is an error."""
    names = [tidy_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes or "" in names:
        raise ValueError(f"column names collide after cleaning: {clashes or ['<empty>']}")
    return df.toDF(*names)
