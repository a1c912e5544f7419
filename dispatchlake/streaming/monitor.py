"""The summary monitor with its state in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from dispatchlake.functions.once import once
from dispatchlake.operators.audit import COMPARED, summary_codes, summary_fields
from dispatchlake.sources.lines import with_parse

STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECTION = "trace_id string, relative_path string, start bigint, part bigint, lines bigint, first bigint, parsed bigint, value string, has_final boolean, is_final boolean"
STATE = "seen bigint, last string, cumulative boolean, ended bigint, due bigint"
FOUND = "trace_id string, line_no bigint, value string, previous string, cumulative boolean, over boolean, code string, detail string"


def sections(stream: DataFrame) -> DataFrame:
    """Lines folded in the tasks that read them: a row per summary, and one per stretch of other lines.

    A stretch has its number of lines, how many of them are JSON values (``parsed``) and the
    place of the first of those. ``part`` is the order inside a split.
    """
    typed = with_parse(stream)
    raw = F.col("raw")
    kind = F.coalesce(F.try_variant_get(raw, "$.record", "string"), F.try_variant_get(raw, "$.kind", "string"))
    fields = summary_fields(raw)
    is_summary = F.coalesce(kind == "summary", F.lit(False))
    rows = once(typed.select("trace_id", "relative_path", "start", "value", "raw"), summary=is_summary, has_final=fields["has_final"], is_final=fields["is_final"], there=raw.isNotNull())
    rows = rows.select("trace_id", "relative_path", "start", F.when(F.col("summary"), F.col("value")).alias("value"), "has_final", "is_final", "there")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            made: list[list] = []
            where = None
            for trace, path, start, value, has_final, is_final, there in zip(*(c.to_pylist() for c in batch.columns)):
                if value is not None:
                    made.append([trace, path, start, part, 1, None, 0, value, bool(has_final), bool(is_final)])
                    part, where = part + 1, None
                    continue
                if where != (path, start):
                    made.append([trace, path, start, part, 0, None, 0, None, False, False])
                    part, where = part + 1, (path, start)
                row = made[-1]
                row[4] += 1
                if there:
                    row[6] += 1
                    row[5] = row[5] or row[4]
            if made:
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, row)) for row in made], schema=_ARROW)

    return rows.mapInArrow(fold, SECTION)


_NAMES = [c.split()[0] for c in SECTION.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in SECTION.split(", ")])


class _Numbering(StatefulProcessor):
    """Numbers the lines of a capture through all batches and gives each summary the one before it."""

    def __init__(self, quiet_ms: int | None) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("capture", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - named by Spark
        seen, last, cumulative, ended, due = self.state.get() if self.state.exists() else (0, None, None, None, None)
        read = pd.concat(list(rows)).sort_values(["relative_path", "start", "part"])
        found, late, late_at = [], 0, None
        for lines, first, parsed, value, has_final, is_final in zip(*(read[c] for c in ("lines", "first", "parsed", "value", "has_final", "is_final"))):
            if value is None:
                if ended is not None and parsed:
                    late += int(parsed)
                    late_at = late_at or seen + int(first)
                seen += int(lines)
                continue
            seen += 1
            cumulative = bool(has_final) if cumulative is None else cumulative
            found.append((key[0], seen, value, last, cumulative, ended is not None, None, None))
            last = value
            if is_final and ended is None:
                ended = seen
        if late:
            found.append((key[0], late_at, None, None, None, None, "rows-after-final", str(late)))
        if self.quiet_ms is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
            self.handle.registerTimer(due)
        self.state.update((seen, last, cumulative, ended, due))
        yield _frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        seen = self.state.get()[0]
        self.state.clear()
        yield _frame([(key[0], seen, None, None, None, None, "state-released", None)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])


def stateful_alerts(stream: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """Streaming alerts (``trace_id, line_no, code, detail``) on captures' cumulative summaries.

    ``stream`` has ``trace_id, relative_path, start, value``; a capture goes on in files of
    later names. Spark's state store keeps one small row per capture, and a batch touches the
    rows of its own captures alone. The rules are those of ``audit.summary_audit``, applied to a
    summary and the one before it, so it does not matter where batches are cut. With
    ``quiet_ms`` the state of a capture that had no line for so long is let go, which is told by
    an alert ``state-released`` with the lines seen.
    """
    timers = "none" if quiet_ms is None else "processingTime"
    numbered = sections(stream).groupBy("trace_id").transformWithStateInPandas(_Numbering(quiet_ms), FOUND, "append", timers)
    empty = F.lit("{}")
    parsed = with_parse(numbered.withColumn("value", F.coalesce("value", empty))).withColumnRenamed("raw", "now").drop("blank")
    parsed = with_parse(parsed.withColumn("value", F.coalesce("previous", empty))).withColumnRenamed("raw", "before").drop("blank")
    before = summary_fields(F.col("before"))
    compared = F.when(F.col("previous").isNotNull(), F.struct(*[before[n].alias(n) for n in COMPARED]))
    fields = summary_fields(F.col("now")) | {"_prev": compared, "_cumulative": F.col("cumulative"), "_over": F.col("over")}
    looked = once(parsed.select("trace_id", "line_no", "code", "detail", "previous", "cumulative", "over", "now", "before"), **fields)
    codes = F.when(F.col("code").isNotNull(), F.array("code")).otherwise(summary_codes())
    return looked.select("trace_id", "line_no", F.explode(codes).alias("code"), "detail")


def start_monitor(stream: DataFrame, folder: str, quiet_ms: int | None = None, partitions: int | None = None, **trigger) -> StreamingQuery:
    """Run the monitor: alerts are appended to ``folder/alerts`` exactly once, progress and state are in ``folder/progress``.

    ``trigger`` as for ``DataStreamWriter.trigger``, by default all that is there now. With ``quiet_ms`` batches also
    run for want of data, so give it ``processingTime``. ``partitions`` of the state are fixed by the first start.
    """
    spark = stream.sparkSession
    settings = {STORE: ROCKS} | ({} if partitions is None else {PARTITIONS: str(partitions)})
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        writer = stateful_alerts(stream, quiet_ms).writeStream.outputMode("append").format("parquet")
        return writer.option("path", f"{folder}/alerts").option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
