"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the session names.

    On a cluster ``spark.checkpoint.dir`` must name shared storage. A private
    folder is made only when nothing is set, which is the case in local tests; it
    goes when Python ends.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="dispatchlake-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return configured


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A session setting for as long as the block runs. A stream started in it keeps it."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and go on from the written copy.

    Used where several branches of a plan must see one and the same assignment of
    rows to blocks, also after an executor is lost. Each branch reads only the
    columns it needs. ``drop_settled`` removes the copies.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession) -> None:
    """Remove the copies that ``settle`` wrote in this session; results that read them must be stored by then."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
