"""The whole analysis of a corpus: every step of a trace's evaluation, for all traces."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.operators.bins import overview_bins
from dispatchlake.operators.census import KERNEL_SUMS, families, kernel_census, kernel_census_scopes, wait_taxonomy, wait_taxonomy_scopes
from dispatchlake.operators.exposure import encode_coverage, exposure
from dispatchlake.operators.intervals import Coverage
from dispatchlake.operators.launches import LAUNCH, Launches, assign_waits, omissions, partition_launches
from dispatchlake.operators.placement import anchor_waits, counted_kernels, place, quarantine
from dispatchlake.operators.ranges import range_availability
from dispatchlake.operators.summary import summarize
from dispatchlake.session import settle

TRACE = ["trace_id"]


@dataclass(frozen=True)
class Analysis:
    """Steps are built when first asked for, so a report pays only for what it reads.

    ``ops``, ``cbs`` and ``waits`` are normalised records (see ``operators.normalize``).
    """

    ops: DataFrame
    cbs: DataFrame
    waits: DataFrame

    @cached_property
    def _split(self) -> tuple[DataFrame, DataFrame]:
        """(accepted, quarantined). The accepted ones are written once, most steps start there."""
        accepted, set_aside = quarantine(self.cbs)
        return settle(accepted), set_aside

    @property
    def quarantined(self) -> DataFrame:
        return self._split[1]

    @cached_property
    def coverage(self) -> Coverage:
        return encode_coverage(self._split[0])

    @cached_property
    def _launches(self) -> Launches:
        return partition_launches(self._split[0])

    @cached_property
    def command_buffers(self) -> DataFrame:
        """Accepted command buffers with exposure and launch; written once, read by most steps."""
        return settle(exposure(self._launches.cbs, self.coverage))

    @cached_property
    def partitions(self) -> DataFrame:
        """Launches with the bounds of their command buffers, gap and threshold."""
        return settle(self._launches.launches)

    @cached_property
    def dispatches(self) -> DataFrame:
        """Dispatches with position and launch; the largest join, so written once."""
        return settle(place(self.ops, self.command_buffers))

    @cached_property
    def dispatch_times(self) -> DataFrame:
        """Dispatches with launch, time, kernel and owner alone, for those who count them; written once."""
        if "dispatches" in self.__dict__:
            return self.dispatches
        return settle(place(self.ops, self.command_buffers).select(*LAUNCH, "at_ns", "line_no", "kernel", "command_buffer_index"))

    @cached_property
    def anchored_waits(self) -> DataFrame:
        return settle(anchor_waits(self.waits, self._split[0]))

    @cached_property
    def launch_waits(self) -> DataFrame:
        """Waits with anchors and launch; written once."""
        return settle(assign_waits(self.anchored_waits, self.command_buffers, self.partitions))

    @cached_property
    def trace_summary(self) -> DataFrame:
        busy = self.coverage.totals
        cbs = exposure(self._split[0], self.coverage)
        # A dispatch counts whether or not it could be placed.
        return summarize(cbs, self.ops, self.anchored_waits, TRACE, busy)

    @cached_property
    def launch_summary(self) -> DataFrame:
        inside = "launch_index IS NOT NULL"
        return summarize(
            self.command_buffers, self.dispatches.filter(inside), self.launch_waits.filter(inside), LAUNCH
        )

    @cached_property
    def launches(self) -> DataFrame:
        """Launches with the reported bounds, which include the anchors of their waits."""
        anchors = (
            self.launch_waits.filter("launch_index IS NOT NULL")
            .groupBy(*LAUNCH)
            .agg(F.min("at_ns").alias("_first"), F.max("at_ns").alias("_last"))
        )
        widened = self.partitions.join(anchors, LAUNCH, "left")
        bounds = widened.select(
            *LAUNCH,
            F.least("low_ns", "_first").alias("start_ns"),
            F.greatest("end_ns", "_last").alias("end_ns"),
        )
        return settle(self.partitions.drop("start_ns", "end_ns").join(bounds, LAUNCH).drop("low_ns"))

    @cached_property
    def launch_omissions(self) -> DataFrame:
        return omissions(self.dispatches, self.launch_waits, self.partitions)

    @cached_property
    def availability(self) -> DataFrame:
        """One row per launch, written, as good and bad ranges both ask for it.

        Only owners and launches of dispatches are read: of a written table when there is one,
        else nothing more than these is made."""
        written = [self.__dict__[n] for n in ("dispatches", "dispatch_times") if n in self.__dict__]
        dispatches = written[0] if written else place(self.ops, self.command_buffers)
        return settle(range_availability(self.command_buffers, dispatches, self.launches))

    def kernel_census(self, keys: list[str]) -> DataFrame:
        if keys == TRACE:
            return kernel_census(self.ops, keys)
        counted = self._counted.filter("launch_index IS NOT NULL").groupBy(*keys, "kernel")
        return families(counted.agg(*[F.sum(c).alias(c) for c in ("count", *KERNEL_SUMS)]), keys)

    @property
    def _counted(self) -> DataFrame:
        return counted_kernels(self.ops, self._launches.cbs)

    def kernel_census_scopes(self) -> DataFrame:
        """Kernel census of traces and launches together."""
        return kernel_census_scopes(self._counted)

    def wait_taxonomy_scopes(self) -> DataFrame:
        """Wait taxonomy of traces and launches together."""
        return wait_taxonomy_scopes(self.launch_waits)

    def wait_taxonomy(self, keys: list[str]) -> DataFrame:
        rows = self.anchored_waits if keys == TRACE else self.launch_waits.filter("launch_index IS NOT NULL")
        return wait_taxonomy(rows, keys)

    def overview(self, bins: int = 512) -> DataFrame:
        return overview_bins(self.command_buffers, self.dispatches, self.launch_waits, self.launches, bins)
