"""Running aggregates over an order, without giving a whole key to one task.

A window partitioned by trace alone puts a trace into a single task, and one
trace may hold a third of all rows. Here the rows are range-partitioned on
(key, order), so that a large key covers many blocks, each of bounded size. A
running value is then the carry of all earlier blocks of the same key (one row
per block, a small table) combined with a window inside the block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dispatchlake.session import settle

BLOCK = "_block"


@dataclass(frozen=True)
class Blocks:
    """Rows with a ``_block`` column that grows with (keys, order)."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def block_keys(self) -> list[str]:
        return [*self.keys, BLOCK]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.block_keys).orderBy(*self.order)

    @property
    def before(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def upto(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    # Frames that end at the end of a partition are recomputed for every row, so what
    # follows a row is taken as what precedes it in reverse order.
    @property
    def _backwards(self) -> WindowSpec:
        return Window.partitionBy(*self.block_keys).orderBy(*[F.desc(c) for c in self.order])

    @property
    def after(self) -> WindowSpec:
        """Rows behind this one, nearest last: use ``last`` for the next value."""
        return self._backwards.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def from_here(self) -> WindowSpec:
        return self._backwards.rowsBetween(Window.unboundedPreceding, 0)

    def with_carry(
        self,
        rows: DataFrame,
        per_block: dict[str, Column],
        earlier: dict[str, Column] | None = None,
        later: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Attach to each row what the other blocks of its key add up to.

        ``per_block`` aggregates one block; ``earlier`` and ``later`` combine those
        results over the blocks before and after the row's own, the nearest block last.
        """
        totals = rows.groupBy(*self.block_keys).agg(
            *[value.alias(name) for name, value in per_block.items()]
        )
        line = Window.partitionBy(*self.keys)
        past = line.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        future = line.orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *self.block_keys,
            *[value.over(past).alias(name) for name, value in (earlier or {}).items()],
            *[value.over(future).alias(name) for name, value in (later or {}).items()],
        )
        return rows.join(carried.hint("shuffle_hash"), self.block_keys)


def blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Blocks:
    """Cut ``df`` into ordered blocks. ``order`` must be a total order in a key."""
    ranged = df.repartitionByRange(*keys, *order).withColumn(BLOCK, F.spark_partition_id())
    return Blocks(settle(ranged), tuple(keys), tuple(order))


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_rank`` (0-based position in the key) and ``_total`` (rows in the key).

    Blocks are written in order with the place of every row, so rows move once: a rank is the
    place in the block and what earlier blocks of the key hold, one small row per key and block.
    """
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The id counts the rows of a partition one by one; its upper bits are the partition's number.
    placed = settle(ordered.withColumn("_place", F.monotonically_increasing_id())).withColumn(BLOCK, F.shiftright("_place", 33))
    line = Window.partitionBy(*keys)
    past = line.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy(*keys, BLOCK).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Written, its size is known when the join is planned.
    carried = settle(
        counted.select(*keys, BLOCK, (F.coalesce(F.sum("_n").over(past), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(line).alias("_total"))
    )
    return placed.join(carried, [*keys, BLOCK]).select(*df.columns, (F.col("_place") + F.col("_shift")).alias("_rank"), "_total")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """One row per key with the exact median (mean of the two middle values).

    Equal values are counted together first, so ties never pile up, and the
    middle is found by position; no task holds all values of a key.
    """
    grouped = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    cut = blocks(grouped, keys, [value])
    rows = cut.with_carry(
        cut.rows,
        {"_n": F.sum("_times")},
        {"_earlier": F.sum("_n")},
        {"_later": F.sum("_n")},
    )
    inside = Window.partitionBy(*cut.block_keys)
    earlier = F.coalesce("_earlier", F.lit(0))
    last = earlier + F.sum("_times").over(cut.upto) - 1
    total = earlier + F.sum("_times").over(inside) + F.coalesce("_later", F.lit(0))
    placed = rows.select(
        *keys, value, (last - F.col("_times") + 1).alias("_first"), last.alias("_last"), total.alias("_total")
    )
    low = F.floor((F.col("_total") - 1) / 2)
    high = F.floor(F.col("_total") / 2)
    covers_low = low.between(F.col("_first"), F.col("_last"))
    covers_high = high.between(F.col("_first"), F.col("_last"))
    middle = placed.filter(covers_low | covers_high)
    return middle.groupBy(*keys).agg(
        (
            (F.max(F.when(covers_low, F.col(value))) + F.max(F.when(covers_high, F.col(value)))) / 2
        ).alias(name)
    )
