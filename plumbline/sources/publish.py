"""Atomic publishing: versions lie side by side, and one small file, replaced by a rename, names the current one.

Readers see the old version or the new one, never a part; a failure at any point before the rename leaves the old version
current. Nothing is copied. The file also holds a mark, such as the last batch that the version contains.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, through Hadoop, so that any store works."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder; a target that is there is replaced, a file in one step."""
    jvm = spark.sparkContext._jvm
    a, fs = hadoop_path(spark, source)
    b, _ = hadoop_path(spark, target)
    if fs.exists(b) and fs.getFileStatus(b).isDirectory():
        fs.delete(b, True)
    fs.mkdirs(b.getParent())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(a), fs.makeQualified(b), how)


def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of a published table says (``version``, ``mark``), or None before the first publication."""
    at, fs = hadoop_path(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def point(spark: SparkSession, path: str, version: str, mark=None) -> None:
    """Make a version current."""
    name = f"{path}/_pointer-{uuid.uuid4().hex}"
    at, fs = hadoop_path(spark, name)
    stream = fs.create(at)
    stream.write(json.dumps({"version": version, "mark": mark}).encode())
    stream.close()
    moved(spark, name, f"{path}/{POINTER}")


def staged(df: DataFrame, path: str) -> str:
    """Write a version without making it current; gives its name."""
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    return version


def publish(df: DataFrame, path: str, mark=None) -> str:
    """Write a version and make it current. Earlier versions stay for readers that have begun; ``discard`` deletes them."""
    version = staged(df, path)
    point(df.sparkSession, path, version, mark)
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    now = current(spark, path)
    if now is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{now['version']}")


def discard(spark: SparkSession, path: str) -> int:
    """Delete all versions but the current one; gives how many."""
    now = current(spark, path)
    at, fs = hadoop_path(spark, path)
    gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("version-") and (now is None or s.getPath().getName() != now["version"])]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
