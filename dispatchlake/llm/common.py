"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.session import checkpoint_dir

#: The white space of the contracts: space, and the five controls from tab to carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where the host keeps a public tokenizer; executors have the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole(text: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    Several branches then read one and the same rows without working them out
    twice, and a lost executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_slices(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``work`` over slices of every Arrow batch, cut by the size of its column ``text``.

    A slice bounds what a task holds as Python objects at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "text"):
                yield work(part)

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches sorted by a key without nulls."""
    open_rows: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        first = 0
        for i, value in enumerate(keys):
            if value != last:
                if i > first:
                    open_rows.append(batch.slice(first, i - first))
                if open_rows:
                    yield pa.Table.from_batches(open_rows)
                open_rows, first, last = [], i, value
        if len(keys) > first:
            open_rows.append(batch.slice(first))
    if open_rows:
        yield pa.Table.from_batches(open_rows)


def text_key(text: str) -> Column:
    """Tells apart rows that share an id and not a text."""
    return F.xxhash64(whole(text))


def rows_of(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (``doc_id``, ``text_key``) ``chosen`` has, with the columns of ``docs``."""
    names = chosen.select(F.col("doc_id").alias("_chosen_id"), F.col("text_key").alias("_chosen_key")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_chosen_id")) & (text_key(text_col) == F.col("_chosen_key"))
    return docs.join(names, same, "left_semi")


def rows_once(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (``doc_id``, ``text_key``, ``kept``; one row per document) keeps, repeated rows once.

    Only where an id and a text repeat are rows compared with each other; all
    others go through one join.
    """
    names = verdicts.groupBy(F.col("doc_id").alias("_chosen_id"), F.col("text_key").alias("_chosen_key")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_copies"))
    same = F.col(id_col).eqNullSafe(F.col("_chosen_id")) & (text_key(text_col) == F.col("_chosen_key"))
    joined = docs.join(staged(names.where("_kept")), same)
    repeated = joined.where("_copies > 1").dropDuplicates(["_chosen_id", "_chosen_key"])
    return joined.where("_copies = 1").unionByName(repeated).select(docs.columns)


def by_size(batch: pa.RecordBatch, column: str, most: int = 8_000_000, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of a column, one row at least, and at most ``rows`` rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and (total + size > most or i - first == rows):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < batch.num_rows:
        yield batch.slice(first)
