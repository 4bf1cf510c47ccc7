"""Order-insensitive exact comparison of two result tables."""

from __future__ import annotations

import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _text(v) -> str:
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def table_lines(pdf: pd.DataFrame) -> list[str]:
    cols = sorted(pdf.columns)
    return sorted("|".join(_text(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} vs {sorted(right.columns)}"
    a, b = table_lines(left), table_lines(right)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} vs {len(b)}; {len(only_a)} only left, {len(only_b)} only right\n  left  {only_a[:3]}\n  right {only_b[:3]}"
