"""Names derived from names: wait classes, kernel families, readable quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wait bucket names and the class each belongs to.
WAIT_CLASS = {
    "cap_wait": "cap",
    "memory_wait": "dependency",
    "dependency_cv_wait": "dependency",
    "cb_wait_until_completed": "decision",
}
# Scheduler buckets, reported in detail but never added to totals.
SCHEDULER_DETAIL = {"sched_backpressure": "scheduler-mirror", "sched_worker_wait": "idle"}
# Fixed value: how generated kernels are named; group 1 is the family.
CUSTOM_KERNEL = r"^custom_kernel_(.+?)__"
# Units of readable quantities.
TIME_UNITS = [(1e3, 1.0, "ns"), (1e6, 1e3, "µs"), (1e9, 1e6, "ms"), (float("inf"), 1e9, "s")]
BYTE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB"]
NO_VALUE = "—"


def _lookup(value: Column, table: dict[str, str]) -> Column:
    keys = [F.lit(item) for pair in table.items() for item in pair]
    return F.element_at(F.create_map(*keys), value)


def wait_class(bucket: Column) -> Column:
    """Class of a wait bucket; NULL without a bucket, ``other`` for unknown ones."""
    return F.when(bucket.isNotNull(), F.coalesce(_lookup(bucket, WAIT_CLASS), F.lit("other")))


def detail_class(bucket: Column) -> Column:
    return F.coalesce(_lookup(bucket, SCHEDULER_DETAIL), wait_class(bucket))


def headline_category(bucket: Column) -> Column:
    """Class to add the wait to, NULL for buckets that mirror other waits."""
    return F.when(~bucket.isin(*SCHEDULER_DETAIL), wait_class(bucket))


def kernel_family(kernel: Column) -> Column:
    family = F.regexp_extract(kernel, CUSTOM_KERNEL, 1)
    return F.when(family == "", kernel).otherwise(family)


def _compact(value: Column) -> Column:
    """At most two decimals, halves rounded up, no trailing zeros."""
    rounded = F.floor(value * 100 + 0.5) / 100
    whole = value == F.floor(value)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(
        F.regexp_replace(rounded.cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
    )


def human_ns(value: Column) -> Column:
    """Duration in the largest unit that keeps it at or above one."""
    size = F.abs(value)
    text = F.lit(NO_VALUE)
    for limit, divisor, unit in reversed(TIME_UNITS):
        text = F.when(size < limit, F.concat(_compact(value / divisor), F.lit(f" {unit}"))).otherwise(text)
    return F.coalesce(text, F.lit(NO_VALUE))


def human_bytes(value: Column) -> Column:
    """Size in binary units, up to TiB."""
    size = F.abs(value)
    text = F.when(size < float("inf"), F.concat(_compact(value / 1024.0**4), F.lit(f" {BYTE_UNITS[4]}")))
    for power in reversed(range(4)):
        text = F.when(
            size < 1024.0 ** (power + 1),
            F.concat(_compact(value / 1024.0**power), F.lit(f" {BYTE_UNITS[power]}")),
        ).otherwise(text)
    return F.coalesce(text, F.lit(NO_VALUE))
