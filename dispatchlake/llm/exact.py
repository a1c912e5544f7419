"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import SPACE_BYTES, map_slices, staged, text_key, whole

SHORTEST, MEAN_BITS, LONGEST = 256, 10, 8192
#: An odd multiplier spreads eight bytes over the high bits.
_MIX = np.uint64(0x9E3779B97F4A7C15)
WIDTH = 16


def chunk_ends(data: bytes, shortest: int = SHORTEST, bits: int = MEAN_BITS, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of ``data``.

    A chunk ends where a hash of the last eight bytes has ``bits`` leading
    zeros, so equal passages are cut alike wherever they stand. No chunk but the
    last is below ``shortest`` bytes, none is over ``longest``.
    """
    n = len(data)
    hits: list[int] = []
    if n > shortest:
        window = np.ndarray((n - 7,), "<u8", data, 0, (1,))
        hits = (np.flatnonzero((window * _MIX) >> np.uint64(64 - bits) == 0) + 8).tolist()
    ends, start = [], 0
    for end in [*hits, n]:
        while end - start > longest:
            start += longest
            ends.append(start)
        if end - start >= shortest or start < end == n:
            ends.append(end)
            start = end
    return ends


def recipe(data: bytes) -> tuple[bytes, bytes]:
    """Identifiers of the chunks in order, and as many check values of another hash."""
    ids, checks, start = [], [], 0
    for end in chunk_ends(data):
        chunk = data[start:end]
        ids.append(xxhash.xxh3_128_digest(chunk))
        checks.append(hashlib.sha256(chunk).digest()[:WIDTH])
        start = end
    return b"".join(ids), b"".join(checks)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: figures of its text, and its chunks as identifiers only."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.monotonically_increasing_id().alias("row"), whole(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, digests, ids, checks = [], [], [], []
        for text in batch.column("text").to_pylist():
            data = text.encode().translate(None, SPACE_BYTES)
            lengths.append(len(text))
            digests.append(hashlib.sha256(data).hexdigest())
            mine = recipe(data)
            ids.append(mine[0])
            checks.append(mine[1])
        columns = [pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), pa.array(ids, pa.binary()), pa.array(checks, pa.binary())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "row")), *columns], names=["doc_id", "text_key", "row", "n_chars", "text_sha256", "ids", "checks"])

    return map_slices(source, f"doc_id {kind}, text_key long, row long, n_chars long, text_sha256 string, ids binary, checks binary", work)


def verified(made: DataFrame) -> DataFrame:
    """``made`` with ``identity``: the ordered list of verified chunk identifiers.

    The dictionary of chunks has one row per identifier, summed in every task
    before the shuffle. An identifier with two check values names two chunks;
    documents that have such a chunk are compared by both values.
    """
    places = F.explode(F.sequence(F.lit(0), F.expr(f"CAST(length(ids) / {WIDTH} AS INT) - 1"))).alias("i")
    chunks = made.where("length(ids) > 0").select("row", "ids", "checks", places)
    chunks = chunks.select("row", *(F.expr(f"substring({c}, i * {WIDTH} + 1, {WIDTH})").alias(c) for c in ("ids", "checks")))
    doubtful = chunks.groupBy("ids").agg(F.min("checks").alias("least"), F.max("checks").alias("most")).where("least <> most").select("ids")
    in_doubt = chunks.join(doubtful, "ids", "left_semi").select("row").distinct().withColumn("_doubt", F.lit(True))
    joined = made.join(in_doubt, "row", "left")
    return joined.select(*made.columns, F.when(F.col("_doubt"), F.concat("ids", "checks")).otherwise(F.col("ids")).alias("identity"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group and verdict of every document; of equal texts one row stays.

    Texts are equal when identical after deleting white space. The row with the
    most code points in the original text stays, then the smallest id. Texts are
    read once and never shuffled: what moves is 16 bytes for each chunk of about
    a kilobyte. Groups are summed in every task first, and written, so that the
    rows of a group that holds a third of all are a skewed join that Spark splits.

    Defined results: a null text is empty, and empty texts are one group; a null
    id comes after all others; of repeated rows, which share an id, one has
    ``kept``; other columns are not read; an empty table gives an empty result.
    """
    made = verified(staged(recipes(docs, id_col, text_col)))
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("best")
    groups = made.groupBy("identity").agg(F.count("*").alias("group_size"), best).where("group_size > 1")
    return made.join(staged(groups), "identity", "left").select(
        "doc_id",
        "text_key",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
        "text_sha256",
        F.expr(f"length(ids) / {WIDTH}").cast("long").alias("n_chunks"),
    )
