"""Evaluating a costly expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with computed columns that later steps refer to but never recompute.

    The optimizer pushes filters below projections by copying the projected
    expressions into them, once per mention. A parse mentioned in twenty places
    would then run twenty times in one condition. It does not push them below a
    generator, so the values go through a one-element list. They are computed in a
    projection below it, which is compiled where a generator may be interpreted.
    """
    kept = [c for c in df.columns if c not in values]
    made = df.select(*kept, *[v.alias(n) for n, v in values.items()])
    packed = F.explode(F.array(F.struct(*values))).alias("_once")
    return made.select(*kept, packed).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in values])
