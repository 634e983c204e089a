"""Snapshot tables: each write makes a new version beside the old ones, and a pointer with the next number.

Spark can't overwrite a path it reads; so a reader of the old version is never disturbed. Nothing is deleted or replaced in a write: a
job that dies at any point leaves the pointers before it, and the highest whole one holds. Its version counts as
broken, and the next lower holds, where the pointer can't be read or the version was not finished; a table without any is empty, and so
is a file of it that can't be read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTERS = "_pointers"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, version) of all pointers, the highest first. The version is in the pointer's name."""
    fs, p = _fs(spark, f"{root}/{_POINTERS}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName().split("-", 1) for s in fs.listStatus(p)]
    return sorted(((int(n[0]), n[1]) for n in names if len(n) == 2 and n[0].isdigit() and n[1].startswith("v-")), reverse=True)


def current(spark: SparkSession, root: str) -> str | None:
    for _, version in _pointers(spark, root):
        fs, done = _fs(spark, f"{root}/{version}/_SUCCESS")
        if fs.exists(done):
            return version
    return None


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The current version; a missing one is an empty table of the schema."""
    v = current(spark, root)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(f"{root}/{v}") if v else spark.createDataFrame([], schema)


def write(df: DataFrame, root: str) -> str:
    """Writes a version, then points to it; the versions before it stay for their readers."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    point(spark, root, version)
    return version


def point(spark: SparkSession, root: str, version: str) -> None:
    """A pointer is an empty file with its number and version in the name, so it is there at once or not at all."""
    above = next((n for n, _ in _pointers(spark, root)), 0) + 1
    fs, p = _fs(spark, f"{root}/{_POINTERS}/{above:012d}-{version}")
    if not fs.createNewFile(p):
        raise OSError(f"can't name the current version of {root}")


def prune(spark: SparkSession, root: str) -> None:
    """Deletes all versions but the current one, and the pointers to them."""
    keep = current(spark, root)
    if not keep:
        return
    fs, p = _fs(spark, root)
    for n, version in _pointers(spark, root):
        if version != keep:
            fs.delete(_fs(spark, f"{root}/{_POINTERS}/{n:012d}-{version}")[1], False)
    for s in fs.listStatus(p):
        if s.getPath().getName().startswith("v-") and s.getPath().getName() != keep:
            fs.delete(s.getPath(), True)
