"""Long expressions step by step. Catalyst puts the expressions of projections together, so one that names another several times holds
it several times; these keep a value in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed before anything that uses them: a generator of one row, which is not folded into the next step."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as a variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
