"""Registered queries: each runs one operator over the whole trace tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions import names
from dispatchlake.operators import bins as bins_
from dispatchlake.operators import census, documents, intervals, marks, placement, pyramid, ranges, summary
from dispatchlake.operators.audit import validate
from dispatchlake.operators.curate import Curated, curate, write_curated
from dispatchlake.operators.evidence import badges, grade, select_summary, stored_for_grading
from dispatchlake.operators.exposure import TRACE, exposure, exposure_fragments, gpu_intervals, has_encode
from dispatchlake.operators.launches import LAUNCH
from dispatchlake.operators.normalize import Records, normalize, summary_buckets
from dispatchlake.operators.ordered import with_rank
from dispatchlake.operators.verify import verify_curated
from dispatchlake.plans.analysis import Analysis
from dispatchlake.session import checkpoint_dir, settle
from dispatchlake.sources.captures import closed_lines, mixed_lines
from dispatchlake.sources.lines import parse_diagnostics, parse_lenient, scan_lines, trace_id
from dispatchlake.sources.store import write_bucketed, write_tables
from dispatchlake.sources.tables import read_table, trace_tables

Query = Callable[[SparkSession, str], DataFrame]
REPORT_BINS = 32
DENSITY_WIDTH = 40
CURATED_COMMAND_BUFFERS = 64


def analysis(spark: SparkSession, folder: str) -> Analysis:
    tables = trace_tables(spark, folder)
    return Analysis(tables.ops, tables.cbs, tables.waits)


def whole(df: DataFrame, *names: str) -> DataFrame:
    """Show integral nanosecond and count columns as BIGINT."""
    kinds = dict(df.dtypes)
    chosen = names or [n for n, kind in kinds.items() if kind in ("double", "bigint", "int")]
    return df.select(
        *[F.col(c).cast("bigint").alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


def listed(column: str) -> Column:
    return F.array_join(F.col(column), ",").alias(column)


def encode_intervals(cbs: DataFrame) -> DataFrame:
    return cbs.filter(has_encode()).select(
        "trace_id", F.col("encode_start_ns").alias("start_ns"), F.col("encode_end_ns").alias("end_ns")
    )


def requests(launches: DataFrame) -> DataFrame:
    """Four ranges per launch: all of it, a middle part, one over its start, one outside."""
    low, length = F.col("start_ns"), F.col("end_ns") - F.col("start_ns")
    whole_range = F.struct(F.lit("all").alias("range_id"), low.alias("a"), F.col("end_ns").alias("b"))
    middle = F.struct(F.lit("middle"), low + F.floor(length / 4), low + F.floor(length / 2))
    over = F.struct(F.lit("over-start"), low - 1_000_000, low + F.floor(length / 3))
    outside = F.struct(F.lit("outside"), F.col("end_ns") + 1.0, F.col("end_ns") + 2.0)
    kind = "struct<range_id:string,a:double,b:double>"
    made = F.array(*[s.cast(kind) for s in (whole_range, middle, over, outside)])
    return launches.select(*LAUNCH, F.explode(made).alias("r")).select(
        *LAUNCH, F.col("r.range_id").alias("range_id"), F.col("r.a").alias("start_ns"), F.col("r.b").alias("end_ns")
    )


def range_tables(a: Analysis) -> tuple[DataFrame, DataFrame]:
    good, bad = ranges.range_table(requests(a.launches), a.launches, a.availability)
    return settle(good), bad


def range_result(a: Analysis) -> ranges.RangeResult:
    return ranges.analyze_ranges(
        a.command_buffers, a.dispatches, a.launch_waits, range_tables(a)[0], a.launch_omissions
    )


def trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    return whole(analysis(spark, folder).trace_summary)


def launch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return whole(analysis(spark, folder).launch_summary)


def interval_union(spark: SparkSession, folder: str) -> DataFrame:
    cbs = trace_tables(spark, folder).cbs
    return whole(intervals.union_intervals(gpu_intervals(cbs, TRACE), TRACE))


def interval_intersection(spark: SparkSession, folder: str) -> DataFrame:
    cbs = trace_tables(spark, folder).cbs
    return whole(intervals.intersect_intervals(encode_intervals(cbs), gpu_intervals(cbs, TRACE), TRACE))


def interval_difference(spark: SparkSession, folder: str) -> DataFrame:
    cbs = trace_tables(spark, folder).cbs
    return whole(intervals.subtract_intervals(encode_intervals(cbs), gpu_intervals(cbs, TRACE), TRACE))


def host_exposure(spark: SparkSession, folder: str) -> DataFrame:
    cbs = exposure(trace_tables(spark, folder).cbs)
    return whole(cbs.select("trace_id", "command_buffer_index", "hidden_host_ns", "exposed_host_ns"))


def host_exposure_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = exposure_fragments(trace_tables(spark, folder).cbs)
    return whole(pieces.select("trace_id", "command_buffer_index", "kind", "start_ns", "end_ns"))


def launch_partition(spark: SparkSession, folder: str) -> DataFrame:
    return whole(analysis(spark, folder).partitions.drop("low_ns"))


def command_buffer_launches(spark: SparkSession, folder: str) -> DataFrame:
    cbs = analysis(spark, folder)._launches.cbs
    return whole(cbs.select("trace_id", "command_buffer_index", "launch_index"))


def duplicate_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """The tables hold no duplicates, so every fiftieth index is made to repeat its neighbour's."""
    cbs = trace_tables(spark, folder).cbs
    key = F.col("command_buffer_index")
    repeated = cbs.withColumn("command_buffer_index", F.when(key % 50 == 7, key - 1).otherwise(key)).withColumn(
        "trace_id", F.lit("all")
    )
    accepted, set_aside = placement.quarantine(repeated)
    both = accepted.withColumn("state", F.lit("accepted")).unionByName(
        set_aside.withColumn("state", F.lit("quarantined"))
    )
    return whole(both.select("state", "command_buffer_index", "line_no"))


def operation_bounds(spark: SparkSession, folder: str) -> DataFrame:
    tables = trace_tables(spark, folder)
    found = placement.sequence_bounds(tables.ops, tables.cbs)
    return whole(found.select("trace_id", "command_buffer_index", "first_seq", "last_seq"))


def dispatch_placement(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(analysis(spark, folder).dispatches)


def placement_from_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Dispatches placed out of tables stored by owner: bounds and placement shuffle nothing."""
    a = analysis(spark, folder)
    out = f"{checkpoint_dir(spark)}/buckets-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (ops, unowned), (cbs, _) = (write_bucketed(placement.whole_owner(t), f"{out}/{n}", placement.OWNER, buckets) for n, t in (("ops", a.ops), ("cbs", a._launches.cbs)))
    return _placed(placement.place(ops, cbs).unionByName(placement.place(unowned, cbs.limit(0))))


def _placed(placed: DataFrame) -> DataFrame:
    counted = placed.groupBy("trace_id", "command_buffer_index", "launch_index", "seq", "placement_detail", "at_ns")
    rows = counted.agg(F.count(F.lit(1)).alias("dispatches"))
    positioned = rows.withColumn("position_ns", F.round("at_ns", 3)).drop("at_ns")
    return whole(positioned, "command_buffer_index", "launch_index", "seq", "dispatches")


def wait_anchors(spark: SparkSession, folder: str) -> DataFrame:
    anchored = analysis(spark, folder).anchored_waits
    return whole(anchored.select("trace_id", "line_no", "at_ns", "at_ns_source", "placement"))


def wait_launches(spark: SparkSession, folder: str) -> DataFrame:
    located = analysis(spark, folder).launch_waits
    return whole(located.select("trace_id", "line_no", "launch_index"))


def kernel_census_by_trace(spark: SparkSession, folder: str) -> DataFrame:
    found = analysis(spark, folder).kernel_census(TRACE)
    return whole(found.withColumn("raw_kernels", listed("raw_kernels")))


def kernel_census_by_launch(spark: SparkSession, folder: str) -> DataFrame:
    found = analysis(spark, folder).kernel_census(LAUNCH)
    return whole(found.withColumn("raw_kernels", listed("raw_kernels")))


def kernel_census_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Kernel census of traces and launches out of one aggregate."""
    found = analysis(spark, folder).kernel_census_scopes()
    return whole(found.withColumn("raw_kernels", listed("raw_kernels")))


def wait_taxonomy_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Wait taxonomy of traces and launches out of one aggregate."""
    return whole(analysis(spark, folder).wait_taxonomy_scopes())


def kernel_rows(spark: SparkSession, folder: str) -> DataFrame:
    ops = trace_tables(spark, folder).ops
    # One kind of kernel is left without a name to show the unnamed group.
    nameless = ops.withColumn("kernel", F.when(~F.col("kernel").startswith("LARGE"), F.col("kernel")))
    return whole(census.kernel_census(nameless, TRACE, by="name", unnamed=census.UNNAMED))


def kernel_ranking(spark: SparkSession, folder: str) -> DataFrame:
    found = census.kernel_census(trace_tables(spark, folder).ops, [])
    ordered = census.census_order(found, [])
    return whole(ordered.select("kernel", "count", "set_bytes_total_bytes"))


def wait_taxonomy_by_trace(spark: SparkSession, folder: str) -> DataFrame:
    return whole(analysis(spark, folder).wait_taxonomy(TRACE))


def wait_taxonomy_by_launch(spark: SparkSession, folder: str) -> DataFrame:
    return whole(analysis(spark, folder).wait_taxonomy(LAUNCH))


def wait_report(spark: SparkSession, folder: str) -> DataFrame:
    waits = trace_tables(spark, folder).waits
    bare = waits.withColumn("bucket", F.when(F.col("line_no") % 13 != 0, F.col("bucket"))).withColumn(
        "wait_class", F.when(F.col("bucket").isNotNull(), F.col("wait_class"))
    )
    return whole(census.wait_rows(bare, TRACE))


def headline_waits(spark: SparkSession, folder: str) -> DataFrame:
    return whole(census.wait_totals(trace_tables(spark, folder).waits, TRACE))


def wait_bucket_totals(spark: SparkSession, folder: str) -> DataFrame:
    return whole(census.bucket_totals(trace_tables(spark, folder).waits, TRACE))


def metric_lines(spark: SparkSession, folder: str) -> DataFrame:
    return summary.metric_report(analysis(spark, folder).trace_summary, TRACE)


def launch_overview(spark: SparkSession, folder: str) -> DataFrame:
    found = analysis(spark, folder).overview(REPORT_BINS)
    ns = ("start_ns", "end_ns", "host_encode_ns", "gpu_busy_ns")
    rounded = found.select(*[F.round(c, 3).alias(c) if c in ns else F.col(c) for c in found.columns])
    return whole(rounded.withColumn("wait_classes", listed("wait_classes")), "launch_index", "bin", "dispatch_count", "wait_count")


def dispatch_density(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    selected = ranges.points_in_ranges(a.dispatches, range_tables(a)[0])
    return _density(bins_.density_bins(selected, ranges.RANGE, DENSITY_WIDTH))


def _stored_pyramid(spark: SparkSession, a: Analysis) -> pyramid.Pyramid:
    out = f"{checkpoint_dir(spark)}/pyramid-{uuid.uuid4().hex}"
    pyramid.write_pyramid(pyramid.build_pyramid(a.dispatch_times), out)
    return pyramid.read_pyramid(spark, out)


def density_from_pyramid(spark: SparkSession, folder: str) -> DataFrame:
    """The density of every range read from stored blocks."""
    a = analysis(spark, folder)
    return _density(pyramid.density_from_pyramid(_stored_pyramid(spark, a), range_tables(a)[0], ranges.RANGE, DENSITY_WIDTH))


def density_mode_from_pyramid(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    return whole(pyramid.density_mode_from_pyramid(_stored_pyramid(spark, a), range_tables(a)[0], ranges.RANGE, 800))


def _density(found: DataFrame) -> DataFrame:
    entries = F.transform(
        F.array_sort(F.map_entries("kernel_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return whole(
        found.select(
            *ranges.RANGE,
            "bin",
            F.round("start_ns", 3).alias("bin_start_ns"),
            F.round("end_ns", 3).alias("bin_end_ns"),
            "count",
            "dominant_kernel",
            F.array_join(entries, ",").alias("kernel_counts"),
            "command_buffer_index",
        ),
        "launch_index", "bin", "count", "command_buffer_index",
    )


def dispatch_density_owners(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    selected = ranges.points_in_ranges(a.dispatches, range_tables(a)[0])
    return whole(bins_.density_owners(selected, ranges.RANGE, DENSITY_WIDTH))


def dispatch_density_mode(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    found = range_tables(a)[0]
    selected = ranges.points_in_ranges(a.dispatches, found)
    return whole(bins_.density_mode(selected, found, ranges.RANGE, 800))


def launch_omissions(spark: SparkSession, folder: str) -> DataFrame:
    return whole(analysis(spark, folder).launch_omissions)


def launch_availability(spark: SparkSession, folder: str) -> DataFrame:
    """Some command buffers lose their timing, some become empty instants."""
    a = analysis(spark, folder)
    key = F.col("command_buffer_index")
    start = F.col("encode_start_ns")
    gone, instant = key % 97 == 0, key % 89 == 0
    cbs = (
        a.command_buffers.withColumn("encode_end_ns", F.when(instant, start).otherwise(F.col("encode_end_ns")))
        .withColumn("encode_start_ns", F.when(~gone, start))
        .withColumn("gpu_end_ns", F.when(~gone & ~instant, F.col("gpu_end_ns")))
        .withColumn("op_count", F.when(instant, 0.0))
    )
    owned = a.dispatches.filter("command_buffer_index % 2 = 0")
    found = ranges.range_availability(cbs, owned, a.partitions)
    return whole(found)


def time_marks(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    found = marks.marks(a.dispatches, a.anchored_waits)
    return found.groupBy("trace_id", "kind", "label", "kind_rank").agg(
        F.count(F.lit(1)).alias("marks"),
        F.round(F.min("at_ns"), 3).alias("first_ns"),
        F.round(F.max("at_ns"), 3).alias("last_ns"),
    )


def ordered_marks(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    found = marks.ordered_marks(a.dispatches, a.anchored_waits)
    return found.select("trace_id", F.col("place").cast("bigint").alias("place"), "kind", F.round("at_ns", 3).alias("at_ns"))


def dispatch_ranks(spark: SparkSession, folder: str) -> DataFrame:
    found = placement.dispatch_order(trace_tables(spark, folder).ops)
    return whole(found.select("trace_id", "place", "seq"))


def stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The wait taxonomy written as a stored table and read back."""
    out = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    write_tables({"waits": analysis(spark, folder).wait_taxonomy(TRACE)}, out, {"waits": ["trace_id", "bucket"]})
    return whole(spark.read.parquet(f"{out}/waits"))


def even_samples(spark: SparkSession, folder: str) -> DataFrame:
    found = marks.even_sample(trace_tables(spark, folder).cbs, TRACE, ["line_no"], 100)
    return whole(found.select("trace_id", "line_no", "displayed", "total"))


def sorted_report(spark: SparkSession, folder: str) -> DataFrame:
    totals = census.bucket_totals(trace_tables(spark, folder).waits, TRACE)
    return whole(marks.sort_rows(totals, "total_ns", ascending=False))


def range_requests(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    good, bad = range_tables(a)
    good = good.select(*ranges.RANGE, "start_ns", "end_ns", F.lit(None).cast("string").alias("error"))
    return whole(good.unionByName(bad), "launch_index", "start_ns", "end_ns")


def range_selections(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets as text: a good one, one past the end (shifted), one malformed, one reversed."""
    a = analysis(spark, folder)
    length = F.col("end_ns") - F.col("start_ns")
    text = lambda c: F.format_string("%d", c.cast("bigint"))
    rows = [
        ("inside", "analyze", text(F.floor(length / 4)), text(F.floor(length / 2))),
        ("past-end", "view", text(F.floor(length / 2)), text(F.floor(length * 5 / 4))),
        ("malformed", "view", F.lit("1e3"), F.lit("2000")),
        ("reversed", "analyze", F.lit("500"), F.lit("400")),
    ]
    made = F.array(
        *[F.struct(F.lit(i).alias("range_id"), F.lit(m).alias("mode"), f.alias("from"), t.alias("to")) for i, m, f, t in rows]
    )
    asked = a.launches.select(*LAUNCH, F.explode(made).alias("r")).select(*LAUNCH, "r.*")
    return whole(ranges.parse_selections(asked, a.launches), "launch_index", "start_ns", "end_ns")


def range_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return whole(range_result(analysis(spark, folder)).summary)


def empty_buffers_in_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Some command buffers are instants without operations: they are in a range that has their instant."""
    a = analysis(spark, folder)
    start, instant = F.col("encode_start_ns"), F.col("command_buffer_index") % 89 == 0
    cbs = a.command_buffers.withColumns({
        "encode_end_ns": F.when(instant, start).otherwise(F.col("encode_end_ns")),
        "gpu_end_ns": F.when(~instant, F.col("gpu_end_ns")),
        "op_count": F.when(instant, 0.0),
    })
    found = ranges.analyze_ranges(cbs, a.dispatches, a.launch_waits, range_tables(a)[0], a.launch_omissions)
    return whole(found.summary.select(*ranges.RANGE, "cbs_total"))


def range_kernels(spark: SparkSession, folder: str) -> DataFrame:
    found = range_result(analysis(spark, folder)).kernels
    return whole(found.withColumn("raw_kernels", listed("raw_kernels")))


def range_waits(spark: SparkSession, folder: str) -> DataFrame:
    return whole(range_result(analysis(spark, folder)).wait_taxonomy)


def focus_windows(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    return whole(ranges.focus_ranges(a.command_buffers, a.dispatches, a.launch_waits, a.launches))


def viewport_command_buffers(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    seen = ranges.visible_command_buffers(a.command_buffers, a.launch_waits, range_tables(a)[0])
    return whole(seen.select(*ranges.RANGE, "command_buffer_index"))


def line_report(spark: SparkSession, folder: str) -> DataFrame:
    return whole(parse_diagnostics(mixed_lines(spark, folder)).drop("source_bytes"))


def malformed_lines(spark: SparkSession, folder: str) -> DataFrame:
    return whole(parse_lenient(mixed_lines(spark, folder))[1], "line_no")


def _records(spark: SparkSession, folder: str) -> Records:
    return normalize(parse_lenient(mixed_lines(spark, folder))[0])


def normalized_command_buffers(spark: SparkSession, folder: str) -> DataFrame:
    return whole(_records(spark, folder).cbs.drop("raw", "op_count", "first_op_seq", "last_op_seq"))


def normalized_operations(spark: SparkSession, folder: str) -> DataFrame:
    return whole(_records(spark, folder).ops.drop("raw", "kind", "dispatch", "grid", "threadgroup"))


def normalized_waits(spark: SparkSession, folder: str) -> DataFrame:
    return whole(_records(spark, folder).waits.drop("raw"))


def reported_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return whole(summary_buckets(select_summary(_records(spark, folder).summaries)))


def evidence_grades(spark: SparkSession, folder: str) -> DataFrame:
    lines = settle(mixed_lines(spark, folder))
    records = stored_for_grading(normalize(parse_lenient(lines)[0]))
    found = badges(grade(records, parse_diagnostics(lines)))
    return whole(
        found.select(
            "trace_id", "command_buffers", "operations", "waits", "summaries", "unrecognized", "malformed_rows",
            "duplicate_rows", "source_completeness", "reported_cbs_total", "analyzed_cbs_total",
            listed("count_mismatches"), "valid_evidence", F.array_join("badges", "; ").alias("badges"), "state",
        )
    )


def strict_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Every five-hundredth command buffer gets a fractional GPU end."""
    number = F.get_json_object("value", "$.command_buffer_index").cast("bigint")
    torn = F.regexp_replace("value", r'"gpu_end_ns":[0-9]+', '"gpu_end_ns":1.5')
    lines = closed_lines(spark, folder).withColumn(
        "value", F.when(F.contains("value", F.lit('"record":"cb"')) & (number % 500 == 3), torn).otherwise(F.col("value"))
    )
    found = validate(lines).violations
    return found.groupBy("trace_id", "code").agg(F.count(F.lit(1)).alias("violations"))


def _curated(spark: SparkSession, folder: str) -> Curated:
    checked = validate(closed_lines(spark, folder))
    hashes = checked.traces.select("trace_id", F.sha2("trace_id", 256).alias("source_sha256"))
    return curate(checked, CURATED_COMMAND_BUFFERS, fingerprints=hashes)


def curated_windows(spark: SparkSession, folder: str) -> DataFrame:
    return whole(_curated(spark, folder).summaries.drop("value"))


def curated_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _curated(spark, folder).rows
    member = lambda name: F.get_json_object("value", f"$.{name}")
    return rows.groupBy("trace_id", member("record").alias("record")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(member("encode_start_ns").cast("bigint")).alias("encode_start_ns"),
        F.sum(member("gpu_end_ns").cast("bigint")).alias("gpu_end_ns"),
        F.sum(member("at_ns").cast("bigint")).alias("at_ns"),
        F.sum(member("wait_ns").cast("bigint")).alias("wait_ns"),
        F.sum(member("ops_total").cast("bigint")).alias("ops_total"),
    )


def curated_files(spark: SparkSession, folder: str) -> DataFrame:
    """Curated windows written as files, scanned again: the summary is the last line of each."""
    out = f"{checkpoint_dir(spark)}/curated-{uuid.uuid4().hex}"
    write_curated(_curated(spark, folder), out)
    lines = scan_lines(spark, out, parts=True)
    member = lambda name: F.get_json_object("value", f"$.{name}")
    return lines.groupBy(F.regexp_extract("relative_path", "trace_id=(.*)$", 1).alias("trace_id")).agg(
        F.max("line_no").alias("rows"),
        F.count(F.when(member("record") == "cb", 1)).alias("command_buffers"),
        F.max_by(member("record"), "line_no").alias("last_record"),
    )


def curated_verification(spark: SparkSession, folder: str) -> DataFrame:
    rows = _curated(spark, folder).rows
    numbered = with_rank(rows, TRACE, ["line_no"]).select("trace_id", (F.col("_rank") + 1).alias("line_no"), "value")
    return whole(verify_curated(numbered)[0])


def run_names(spark: SparkSession, folder: str) -> DataFrame:
    """A run name per customer; impossible dates and upper-case owners are mistakes."""
    key = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = F.concat(
        F.when(key % 7 == 0, "Own").otherwise("own"), key.cast("string"), F.lit("--re.po__me__20"), two(key % 30), F.lit("-"),
        two(key % 13), F.lit("-"), two(key % 31 + 1), F.lit("t10-"), two(key % 60), F.lit("-30z."),
        F.when(key % 5 == 0, "window-cb64").otherwise("raw"), F.lit(".jsonl"),
    )
    named = read_table(spark, folder, "customer").select(key, name.alias("name"), F.concat_ws("/", "c_mktsegment", "name").alias("path"))
    run = names.run_name(F.col("name"))
    return named.select(
        F.col("c_custkey").alias("customer"),
        run["capture_utc"].alias("capture_utc"),
        run["artifact"].alias("artifact"),
        F.array_join(names.name_errors(F.col("name")), ",").alias("errors"),
        trace_id(F.col("path")).alias("trace_id"),
        names.path_is_safe(F.col("path")).alias("path_is_safe"),
        names.repository_url(F.concat(F.lit("own/"), F.when(key % 11 == 0, F.lit("bad..")).otherwise(F.lit("r")), key.cast("string"))).alias("url"),
    )


def visible_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Figures read back out of the evidence document of each launch's focus range."""
    a = analysis(spark, folder)
    focus = ranges.focus_ranges(a.command_buffers, a.dispatches, a.launch_waits, a.launches)
    asked = focus.select(
        *LAUNCH, F.lit("focus").alias("range_id"), F.col("focus_start_ns").alias("start_ns"), F.col("focus_end_ns").alias("end_ns")
    )
    found = documents.document_outlines(documents.evidence_documents(documents.document_pieces(a, asked)))
    head = lambda path: F.get_json_object("head", path)
    return found.select(
        *LAUNCH,
        "file_name",
        head("$.evidence_health.coverage.command_buffers").cast("bigint").alias("command_buffers"),
        F.col("command_buffers").alias("listed_command_buffers"),
        head("$.evidence_health.coverage.dispatches").cast("bigint").alias("dispatches"),
        head("$.evidence_health.coverage.waits").cast("bigint").alias("waits"),
        F.get_json_object("first_kernel", "$.kernel").alias("top_kernel"),
        head("$.measurements[3].value").cast("double").cast("bigint").alias("gpu_busy_ns"),
    )


def range_report_figures(spark: SparkSession, folder: str) -> DataFrame:
    a = analysis(spark, folder)
    found = range_tables(a)[0]
    result = ranges.analyze_ranges(a.command_buffers, a.dispatches, a.launch_waits, found, a.launch_omissions)
    member = lambda path: F.get_json_object("text", path)
    return documents.range_reports(a, found, result).select(
        *ranges.RANGE,
        member("$.gpu.gpu_busy_ns").cast("double").cast("bigint").alias("gpu_busy_ns"),
        member("$.cpu.hidden_host_ns").cast("double").cast("bigint").alias("hidden_host_ns"),
        member("$.kernels.dispatches").cast("bigint").alias("dispatches"),
        member("$.waits.headline_wait_ns").cast("double").cast("bigint").alias("headline_wait_ns"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        trace_summary, launch_summary, interval_union, interval_intersection, interval_difference,
        host_exposure, host_exposure_pieces, launch_partition, command_buffer_launches,
        duplicate_quarantine, operation_bounds, dispatch_placement, wait_anchors, wait_launches,
        kernel_census_by_trace, kernel_census_by_launch, kernel_rows, kernel_ranking,
        wait_taxonomy_by_trace, wait_taxonomy_by_launch, wait_report, headline_waits,
        wait_bucket_totals, metric_lines, launch_overview, dispatch_density, dispatch_density_owners, dispatch_density_mode,
        density_from_pyramid, density_mode_from_pyramid, kernel_census_scopes, wait_taxonomy_scopes, placement_from_buckets,
        launch_omissions, launch_availability, time_marks, ordered_marks, dispatch_ranks, stored_tables, curated_files, even_samples, sorted_report,
        range_requests, range_selections, range_summaries, empty_buffers_in_ranges, range_kernels, range_waits,
        focus_windows, viewport_command_buffers, line_report, malformed_lines, normalized_command_buffers,
        normalized_operations, normalized_waits, reported_buckets, evidence_grades, strict_violations,
        curated_windows, curated_rows, curated_verification, run_names, visible_evidence, range_report_figures,
    )
}
