"""How far a capture can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.operators.normalize import Records
from dispatchlake.operators.placement import duplicate_indices
from dispatchlake.session import settle

# Names of the record counts.
RECORD_COUNTS = {
    "cb": "command_buffers",
    "op": "operations",
    "wait": "waits",
    "summary": "summaries",
    "unknown": "unrecognized",
    "rejected": "rejected",
}


#: What ``grade`` reads of the records.
GRADED = (
    "trace_id", "line_no", "record_type", "command_buffer_index", "schema_version", "summary_seq", "final", "ops_total",
    "cbs_total", "dropped_rows", "complete",
)


def stored_for_grading(records: Records) -> Records:
    """Records written once with the columns that ``grade`` reads, the others NULL: it reads them three times,
    and each time they would be parsed and typed anew."""
    kept = records.all.select(*GRADED)
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in records.all.schema if f.name not in GRADED]
    return Records(settle(kept).select(*GRADED, *others))


def record_counts(records: Records) -> DataFrame:
    """Rows per trace and record type."""
    kind = F.col("record_type")
    return records.all.groupBy("trace_id").agg(
        *[F.count(F.when(kind == k, 1)).alias(name) for k, name in RECORD_COUNTS.items()]
    )


def select_summary(summaries: DataFrame) -> DataFrame:
    """One summary per trace: the last final one; else the one with the highest
    sequence number (of equals the later); else the last."""
    preference = F.struct(
        F.coalesce(F.col("final"), F.lit(False)).alias("final"),
        # Among final ones only the place in the file counts.
        F.when(F.coalesce(F.col("final"), F.lit(False)), F.lit(0.0))
        .otherwise(F.coalesce("summary_seq", F.lit(-1.0)))
        .alias("seq"),
        F.col("line_no").alias("line_no"),
    )
    carried = [c for c in summaries.columns if c != "trace_id"]
    return (
        summaries.groupBy("trace_id")
        .agg(F.max_by(F.struct(*carried), preference).alias("s"), F.count(F.lit(1)).alias("summary_count"))
        .select("trace_id", "summary_count", "s.*")
    )


def completeness() -> Column:
    """Grade of the selected summary (columns of ``select_summary`` after a left join)."""
    return (
        F.when(F.col("summary_count").isNull(), "missing-summary")
        .when(
            F.col("schema_version").isNull() | F.col("complete").isNull() | F.col("dropped_rows").isNull(),
            "legacy-unverifiable",
        )
        .when(F.col("schema_version") != 1, "unsupported-schema")
        .when(F.col("dropped_rows") > 0, "dropped-rows")
        .when(~F.col("complete"), "incomplete")
        .otherwise("complete")
    )


def grade(records: Records, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row per trace: counts, completeness, mismatches, and ``valid_evidence``.

    ``diagnostics`` (see ``sources.lines.parse_diagnostics``) adds lines that were not
    JSON at all; the command buffers analysed are those left after quarantine.
    """
    counts = record_counts(records)
    if diagnostics is not None:
        counts = counts.join(
            diagnostics.select("trace_id", F.col("malformed_rows").alias("_malformed")), "trace_id", "full"
        )
    else:
        counts = counts.withColumn("_malformed", F.lit(0))
    duplicates = (
        duplicate_indices(records.cbs)
        .groupBy("trace_id")
        .agg(F.count(F.lit(1)).alias("_indices"), F.sum("rows").alias("_rows"))
    )
    zero = F.lit(0)
    joined = counts.join(duplicates, "trace_id", "left").join(
        select_summary(records.summaries).drop("raw", "buckets", "line_no"), "trace_id", "left"
    )
    base = joined.select(
        "trace_id",
        *[F.coalesce(c, zero).alias(c) for c in RECORD_COUNTS.values() if c != "rejected"],
        (F.coalesce("_malformed", zero) + F.coalesce("rejected", zero)).alias("malformed_rows"),
        F.coalesce("_indices", zero).alias("duplicate_indices"),
        F.coalesce("_rows", zero).alias("duplicate_rows"),
        completeness().alias("source_completeness"),
        F.col("ops_total").alias("reported_ops_total"),
        F.col("cbs_total").alias("reported_cbs_total"),
        "dropped_rows",
        "complete",
    )
    analysed = F.col("command_buffers") - F.col("duplicate_rows")
    differs = lambda reported, found: F.coalesce(reported != found, F.lit(False))
    graded = base.withColumn("analyzed_cbs_total", analysed).withColumn(
        "count_mismatches",
        F.array_compact(
            F.array(
                F.when(differs(F.col("reported_ops_total"), F.col("operations")), "ops_total"),
                F.when(differs(F.col("reported_cbs_total"), analysed), "cbs_total"),
            )
        ),
    )
    return graded.withColumn(
        "valid_evidence",
        (F.col("source_completeness") == "complete")
        & (F.col("malformed_rows") == 0)
        & (F.col("unrecognized") == 0)
        & (F.size("count_mismatches") == 0)
        & (F.col("duplicate_indices") == 0),
    )


def _source_label() -> Column:
    doubted = F.coalesce(~F.col("declared_valid_evidence"), F.lit(False))
    legacy = F.col("declared_evidence_status") == "legacy-unverifiable"
    return F.when(doubted, F.when(legacy, "Legacy / unverifiable").otherwise("Not validated"))


def badges(graded: DataFrame) -> DataFrame:
    """Add ``badges``, the list of labels, and ``state``, one phrase for a catalogue.

    Optional columns ``declared_valid_evidence`` and ``declared_evidence_status`` hold
    what the manifest says about the source.
    """
    for name, kind in (("declared_valid_evidence", "boolean"), ("declared_evidence_status", "string")):
        if name not in graded.columns:
            graded = graded.withColumn(name, F.lit(None).cast(kind))
    level = F.col("source_completeness")
    number = lambda c: F.col(c).cast("bigint").cast("string")
    # Badge texts.
    doubts = F.array_compact(
        F.array(
            F.concat(F.lit("Source: "), _source_label()),
            F.when(level == "missing-summary", "No summary"),
            F.when(level == "legacy-unverifiable", "Legacy / unverifiable"),
            F.when(level == "unsupported-schema", "Unsupported schema"),
            F.when(level == "incomplete", "Incomplete capture"),
            F.when(level == "dropped-rows", F.concat(F.lit("Dropped rows: "), number("dropped_rows"))),
            F.when(F.col("malformed_rows") > 0, F.concat(F.lit("Malformed rows: "), number("malformed_rows"))),
            F.when(F.col("unrecognized") > 0, F.concat(F.lit("Unsupported rows: "), number("unrecognized"))),
            F.when(F.size("count_mismatches") > 0, "Summary count mismatch"),
            F.when(F.col("duplicate_indices") > 0, "Duplicate CB IDs quarantined"),
        )
    )
    praise = F.when(F.col("valid_evidence"), "Complete evidence").otherwise("Evidence not validated")
    state = (
        F.when(
            _source_label().isNotNull(),
            F.when(_source_label() == "Legacy / unverifiable", "Legacy source").otherwise("Source degraded"),
        )
        .when(F.col("valid_evidence"), "Capture complete")
        .when(level == "missing-summary", "No summary")
        .when(level == "legacy-unverifiable", "Legacy")
        .when(level == "unsupported-schema", "Unsupported")
        .when(level == "incomplete", "Incomplete")
        .when(level == "dropped-rows", "Dropped rows")
        .otherwise("Degraded")
    )
    return (
        graded.withColumn("badges", F.when(F.size(doubts) > 0, doubts).otherwise(F.array(praise)))
        .withColumn("badges_valid", (F.size(doubts) == 0) & F.col("valid_evidence"))
        .withColumn("state", state)
    )
