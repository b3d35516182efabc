"""Keeps computed columns from being put into later expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Add columns that are computed once per row.

    The optimizer merges projections, and would compute a column again for every
    element of an array function whose lambda refers to it. A generator
    of one row in between stops that, without a shuffle.
    """
    made = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*made))))
