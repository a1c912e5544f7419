"""Registered queries over the rules of the strict profile, each broken by some orders: of rows, between summaries, between ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.operators.audit import range_overlaps, summary_audit, summary_rows, validate
from dispatchlake.sources.lines import with_parse
from dispatchlake.sources.tables import read_table

_CB = '{"record":"cb","command_buffer_index":#,'
_OPS = '"op_count":0,"first_op_seq":1,"last_op_seq":1,'
_TIMES = '"encode_start_ns":1,"encode_end_ns":2}'
#: Lines by remainder of the order key, # standing for the key, and the code that each must give; None for a good line.
CASES: list[tuple[str, str | None]] = [
    (_CB + _OPS + _TIMES, None),
    ('{"record":"cb",' + _OPS + _TIMES, "missing-command-buffer-index"),
    (_CB + '"cb_index":0,' + _OPS + _TIMES, "conflicting-aliases:command_buffer_index"),
    (_CB + _OPS + '"encode_start_ns":1,"gpu_start_ns":1,"gpu_end_ns":2}', "unpaired-interval:encode_start_ns"),
    (_CB + _OPS + '"encode_start_ns":1,"encode_end_ns":2,"gpu_end_ns":2}', "unpaired-interval:gpu_start_ns"),
    (_CB + _OPS + '"encode_start_ns":3,"encode_end_ns":2}', "reversed-interval:encode_start_ns"),
    (_CB + _OPS + '"gpu_start_ns":3,"gpu_end_ns":2}', "reversed-interval:gpu_start_ns"),
    (_CB + _OPS + '"pad":0}', "no-interval"),
    (_CB + '"op_count":0,"first_op_seq":1,"last_op_seq":2,' + _TIMES, "empty-range-sentinel"),
    (_CB + '"op_count":3,"first_op_seq":1,"last_op_seq":1,' + _TIMES, "op-range-mismatch"),
    (_CB + '"first_op_seq":1,"last_op_seq":1,' + _TIMES, "bad-integer:op_count"),
    (_CB + '"op_count":0,"last_op_seq":1,' + _TIMES, "bad-integer:first_op_seq"),
    (_CB + '"op_count":0,"first_op_seq":1,' + _TIMES, "bad-integer:last_op_seq"),
    ('{"record":"op","seq":#,"kernel_name":"k"}', "missing-command-buffer-index"),
    ('{"record":"op","seq":-1,"command_buffer_index":0}', "bad-integer:seq"),
    ('{"record":"op","command_buffer_index":0}', "bad-integer:seq"),
    ('{"record":"op","seq":#,"command_buffer_index":-1}', "bad-integer:command_buffer_index"),
    ('{"record":"wait","bucket":"b","at_ns":1}', "missing-duration"),
    ('{"record":"wait","bucket":"b","at_ns":1,"wait_ns":1,"duration_ns":2}', "conflicting-aliases:duration"),
    ('{"record":"wait","bucket":"b","wait_ns":-1}', "bad-integer:duration"),
    ('{"record":"wait","bucket":"b","wait_ns":1,"at_ns":1,"ts_ns":2}', "conflicting-aliases:timestamp"),
    ('{"record":"wait","bucket":3,"wait_ns":1}', "bad-bucket"),
    ('{"record":"other","x":#}', "unknown-record"),
    ('{"record":"wait","x":1,"x":2}', "duplicate-key"),
    ("[#]", "not-an-object"),
    ('{"record":"cb"', "malformed-json"),
    ("  ", "blank-line"),
    (_CB + _OPS + '"encode_start_ns":1,"encode_end_ns":2.5}', "unsafe-integer"),
    (_CB + _OPS + '"encode_start_ns":1,"encode_end_ns":9007199254740993}', "unsafe-integer"),
    ('{"record":"wait","x":1e999}', "non-finite-number"),
    ('{"record":"wait","x":' + "[" * 130 + "]" * 130 + "}", "nested-too-deep"),
]
CODES = sorted({code for _, code in CASES if code})


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def strict_row_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Row-level violations by capture and code; rules between rows are left to other queries."""
    key = F.col("o_orderkey")
    line = F.replace(F.expr(_case("o_orderkey", [f"'{text}'" for text, _ in CASES])), F.lit("#"), key.cast("string"))
    rows = read_table(spark, folder, "orders").select((F.col("o_custkey") % 8).cast("string").alias("trace_id"), key.alias("line_no"), line.alias("value"))
    found = validate(rows).violations.filter(F.col("line_no").isNotNull() & F.col("code").isin(*CODES))
    return found.groupBy("trace_id", "code").agg(F.count(F.lit(1)).alias("violations"), F.sum("line_no").alias("lines"))


#: Summaries of a capture, one per order key k. Spark SQL and other engines read this alike.
SUMMARY = """concat('{"record":"summary","summary_seq":', k, ',"final":', CASE WHEN k % 997 = 11 THEN 'true' ELSE 'false' END,
  ',"complete":true,"dropped_rows":0,"ops_total":', k, ',"cbs_total":', k, ',"mode":"', CASE WHEN k % 53 = 5 THEN 'y' ELSE 'x' END,
  '"', CASE WHEN k % 59 = 6 THEN ',"note":1' ELSE '' END, ',"buckets":{"a":{"count":', k, ',"total_ns":', CASE WHEN k % 61 = 7 THEN 0 ELSE k END, '}',
  CASE WHEN k % 41 = 3 THEN '' ELSE ',"b":{"count":1,"total_ns":1}' END, '}}')"""


def summary_rule_breaches(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed fields that change, buckets that go or shrink, rows and finals after the final summary, by capture and code."""
    key = F.col("o_orderkey")
    orders = read_table(spark, folder, "orders").select((F.col("o_custkey") % 8).cast("string").alias("trace_id"), key.alias("line_no"), key.alias("k"))
    parsed = with_parse(orders.select("trace_id", "line_no", F.expr(SUMMARY).alias("value")))
    found = summary_audit(summary_rows(parsed.withColumn("kind", F.lit("summary"))))
    return found.groupBy("trace_id", "code").agg(F.count(F.lit(1)).alias("violations"), F.sum("line_no").alias("lines"))


def overlapping_operation_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Command buffers whose operations begin before those of the one before have ended."""
    key = F.col("o_orderkey")
    last = 10 * key + F.when(key % 37 == 0, 100).when(key % 5 == 0, 10).otherwise(9)
    cbs = read_table(spark, folder, "orders").select(
        (F.col("o_custkey") % 8).cast("string").alias("trace_id"), key.alias("line_no"), key.alias("command_buffer_index"),
        F.when(key % 11 == 0, 0).otherwise(5).alias("op_count"), (10 * key).alias("first_op_seq"), last.alias("last_op_seq"),
    )
    return range_overlaps(cbs).select("trace_id", "line_no", "code", "detail")


QUERIES = {f.__name__: f for f in (strict_row_rules, summary_rule_breaches, overlapping_operation_ranges)}
_CODE = _case("o_orderkey", [f"'{code}'" if code else "NULL" for _, code in CASES])
ORACLES = {
    "strict_row_rules": f"""
        SELECT CAST(o_custkey % 8 AS VARCHAR) AS trace_id, {_CODE} AS code, count(*) AS violations, CAST(sum(o_orderkey) AS BIGINT) AS lines
        FROM orders WHERE {_CODE} IS NOT NULL GROUP BY ALL""",
    "summary_rule_breaches": """
        WITH o AS (
          SELECT CAST(o_custkey % 8 AS VARCHAR) AS trace_id, o_orderkey AS k, k % 53 = 5 AS mode, k % 59 = 6 AS note, k % 997 = 11 AS final,
            CASE WHEN k % 61 = 7 THEN 0 ELSE k END AS total, k % 41 <> 3 AS b FROM orders
        ),
        s AS (
          SELECT *, lag(mode) OVER w AS mode0, lag(note) OVER w AS note0, lag(total) OVER w AS total0, lag(b) OVER w AS b0,
            coalesce(bool_or(final) OVER (PARTITION BY trace_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over
          FROM o WINDOW w AS (PARTITION BY trace_id ORDER BY k)
        ),
        v AS (
          SELECT *, unnest([
            CASE WHEN note <> note0 THEN 'summary-schema' END, CASE WHEN mode <> mode0 OR note <> note0 THEN 'summary-fixed-fields' END,
            CASE WHEN b0 AND NOT b THEN 'summary-bucket-removed' END, CASE WHEN total < total0 THEN 'summary-bucket-decreased' END,
            CASE WHEN over THEN CASE WHEN final THEN 'several-final-summaries' ELSE 'summary-after-final' END END]) AS code FROM s
        )
        SELECT trace_id, code, count(*) AS violations, CAST(sum(k) AS BIGINT) AS lines FROM v WHERE code IS NOT NULL GROUP BY ALL""",
    "overlapping_operation_ranges": """
        SELECT trace_id, k AS line_no, 'operation-ranges-overlap' AS code, CAST(10 * k AS VARCHAR) AS detail FROM (
          SELECT CAST(o_custkey % 8 AS VARCHAR) AS trace_id, o_orderkey AS k,
            lag(10 * o_orderkey + CASE WHEN o_orderkey % 37 = 0 THEN 100 WHEN o_orderkey % 5 = 0 THEN 10 ELSE 9 END) OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS last
          FROM orders WHERE o_orderkey % 11 <> 0)
        WHERE 10 * k <= last""",
}
