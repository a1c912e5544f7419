"""Capture files as lines, and the lenient parse of those lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispatchlake.functions.json_values import allow_repeated_keys, whole_document
from dispatchlake.functions.once import once
from dispatchlake.session import settle

# File extensions, the longest line, the length of previews.
CAPTURE_FILES = "*.{[jJ][sS][oO][nN][lL],[nN][dD][jJ][sS][oO][nN]}"
MOST_CHARACTERS = 4 * 1024 * 1024
PREVIEW = 200
BLANK = r"^[\s   -     　﻿]*+$"


def root_uri(spark: SparkSession, root: str) -> str:
    """The folder as the file system writes it in file paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toUri().toString()
    return uri.rstrip("/") + "/"


def relative_path(file_path: Column, root: str) -> Column:
    """POSIX path below the root, percent escapes decoded."""
    same = F.regexp_replace(file_path, r"^(\w+):/++", r"$1:/")
    base = root.replace(":///", ":/", 1) if root.startswith("file:///") else root
    rest = F.substring(same, len(_one_slash(base)) + 1, 2**31 - 1)
    return F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))


def _one_slash(uri: str) -> str:
    scheme, _, rest = uri.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if rest else uri


def trace_id(path: Column) -> Column:
    """Stable id of a capture: the first 24 hex digits of its path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 24)


SCANNED = "trace_id string, relative_path string, line_no bigint, value string, file_size bigint"


def scan_lines(spark: SparkSession, root: str, parts: bool = False, paths: Sequence[str] | None = None) -> DataFrame:
    """``trace_id, relative_path, line_no, value, file_size`` for all captures below a folder.

    With ``parts`` a capture is a folder of part files in order, as ``write_curated``
    writes them, instead of a single file. ``paths`` (below the folder) reads those files alone.

    Files are read once, in splits, in parallel, and stored with the split of each
    line and its place in it. A line's number is that place plus the lines of earlier
    splits of the capture. Counts and lines both come from the stored copy: how the
    files are cut into splits changes with the number of executors, and a file may
    grow, so nothing is ever matched against a second read of the text.
    """
    allow_repeated_keys(spark)
    if paths is not None and not paths:
        return spark.createDataFrame([], SCANNED)
    # Of names that look like patterns every sign stands for itself.
    files = root if paths is None else [f"{root}/" + re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]
    read = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "part-*" if parts else CAPTURE_FILES)
        .text(files)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.col("_metadata.file_size").alias("file_size"),
            F.monotonically_increasing_id().alias("_id"),
            "value",
        )
    )
    stored = settle(read)
    capture = F.regexp_replace("_file", "/[^/]*$", "") if parts else F.col("_file")
    # Part files by their number: part-100000 comes after part-99999.
    part = F.regexp_extract("_file", r"/part-([0-9]+)[^/]*$", 1).try_cast("bigint")
    earlier = Window.partitionBy(capture).orderBy(part, "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        stored.groupBy("_file", "_start")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    path = relative_path(capture, root_uri(spark, root))
    return stored.join(splits, ["_file", "_start"]).select(
        trace_id(path).alias("trace_id"),
        path.alias("relative_path"),
        (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"),
        "value",
        "file_size",
    )


def _without_return(value: Column) -> Column:
    return F.when(value.endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(value)


def _characters(value: Column) -> Column:
    """Length in UTF-16 units; counted only where the bytes leave it open."""
    astral = F.length(value) - F.length(F.regexp_replace(value, r"[\x{10000}-\x{10FFFF}]", ""))
    return F.when(F.octet_length(value) > MOST_CHARACTERS, F.length(value) + astral).otherwise(0)


def with_parse(lines: DataFrame) -> DataFrame:
    """Add ``raw`` (NULL where the line is not one JSON value) and ``blank``."""
    allow_repeated_keys(lines.sparkSession)
    value = _without_return(F.col("value"))
    blank = value.rlike(BLANK)
    return once(lines, raw=F.when(~blank, whole_document(value)), blank=blank)


def parse_lenient(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): parsed rows as VARIANT, and what did not parse with a preview."""
    parsed = with_parse(lines)
    rows = parsed.filter("raw IS NOT NULL").select("trace_id", "line_no", "raw")
    value = _without_return(F.col("value"))
    preview = F.when(F.length(value) <= PREVIEW, value).otherwise(
        F.concat(F.substring(value, 1, PREVIEW), F.lit("…"))
    )
    bad = parsed.filter("raw IS NULL AND NOT blank").select(
        "trace_id", "line_no", F.lit("Invalid JSON").alias("message"), preview.alias("preview")
    )
    return rows, bad


def parse_diagnostics(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per trace: bytes, lines, parsed, malformed and blank lines, and whether a line is
    too long to be accepted. ``files`` (see ``catalog.discover``) adds empty captures."""
    parsed = with_parse(lines)
    size = F.max("file_size") if "file_size" in lines.columns else F.lit(None).cast("bigint")
    counted = parsed.groupBy("trace_id").agg(
        size.alias("source_bytes"),
        F.count(F.lit(1)).alias("total_lines"),
        F.count(F.when(F.col("raw").isNotNull(), 1)).alias("parsed_rows"),
        F.count(F.when(F.col("raw").isNull() & ~F.col("blank"), 1)).alias("malformed_rows"),
        F.count(F.when(F.col("blank"), 1)).alias("blank_rows"),
        F.max(_characters(F.col("value")) > MOST_CHARACTERS).alias("line_too_long"),
    )
    if files is None:
        return counted
    numbers = [c for c in counted.columns if c not in ("trace_id", "source_bytes", "line_too_long")]
    return files.select("trace_id", F.col("size").alias("_size")).join(counted, "trace_id", "left").select(
        "trace_id",
        F.coalesce("source_bytes", "_size").alias("source_bytes"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
        F.coalesce("line_too_long", F.lit(False)).alias("line_too_long"),
    )
