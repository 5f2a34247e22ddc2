"""What the corpus operators share: reading tables, the shared work folder, and bounded Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches sent to Python hold at most this many bytes, so that very long texts do not add up.
BATCH_BYTES = 16 << 20

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def prepare(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of the Python stages by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine alone a local one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def text_hash(text: str) -> Column:
    """XXH64 of the text; null counts as empty, so that both are copies of each other."""
    return F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")))


def set_aside(df: DataFrame, *used: str) -> DataFrame:
    """``df`` with all columns but the used ones under names that no operator takes; ``restored`` turns them back."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in used else f"_own {k}") for k, c in enumerate(df.columns)])


def restored(df: DataFrame, like: DataFrame, *used: str) -> DataFrame:
    """The columns of ``like``, from a table that ``set_aside`` has begun."""
    return df.select(*[F.col(c if c in used else f"`_own {k}`").alias(c) for k, c in enumerate(like.columns)])


#: Spark's setting for deleting the shuffle files of a query at its end, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "step", compression: str = "snappy", clean: bool = False, group: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps start from files.

    The files outlive a lost executor, unlike cached blocks; ``release`` deletes them. For rows of megabytes take ``zstd``:
    snappy's buffers lie outside the heap, are as large as a page, and stay until the next collection of garbage. With
    ``clean`` the shuffle files of this write go when it has ended. ``group`` bounds the bytes of a row group (one longer row
    stands alone); otherwise Parquet looks at sizes every 100 rows only, and writer and readers hold so many rows at once.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, str(clean or before == "true").lower())
    try:
        sizes = {"parquet.block.size": group, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if group else {}
        df.write.options(compression=compression, **sizes).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


WRITTEN: list[str] = []


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the folders that ``written`` has left after the first ``since``, but for the last ``keep``; to be called when no
    table that reads them is needed any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    end = len(WRITTEN) - keep
    for name in WRITTEN[since:end]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del WRITTEN[since:end]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Regroup record batches into tables whose ``column`` holds about ``limit`` bytes; one longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        if start < len(lengths):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
