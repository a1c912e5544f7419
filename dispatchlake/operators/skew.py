"""Joins to small tables that leave a hot key in many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are spread over.
SALTS = 32


def salted_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined to ``side``, which has one row per key, with the rows of a key spread by ``by``.

    A plain join leaves the rows of a key in one task, and an aggregate by that key on
    top stays there. Here ``side`` is repeated ``salts`` times and the join key has the
    salt, so the aggregate sums in many tasks before it shuffles. ``by`` is a value that
    differs among the rows of a key; equal values only share a task.
    """
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
