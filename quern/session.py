"""Session settings the engine relies on, and the folder that jobs share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that a session made here carries; queries do not depend on the session having them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, **more: str) -> SparkSession:
    """A local session with the engine's settings; on a cluster the submitted session is used as it is."""
    b = SparkSession.builder.master(master).appName("quern")
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local master gets a temporary folder; any other master is refused, as a
    folder of one machine would lose the tables with it.
    """
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and a lost
    executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsettle(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/quern/" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all settled tables of this application; results that read them can't be computed after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a narrow table that may be broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 2_000_000


def sized(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows allow it, else as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with the place of each row in the order, from 1: sorted by ranges, numbered in each, and moved on by the ranges' counts.

    The counts, one for each partition, are all that reaches the driver.
    """
    one = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "sorted")
    part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    before, rows = 0, []
    for r in one.groupBy(part.alias("p")).count().orderBy("p").collect():
        rows.append((r.p, before))
        before += r["count"]
    at = df.sparkSession.createDataFrame(rows, "p long, before long")
    out = one.join(F.broadcast(at), part == F.col("p"))
    return out.withColumn(name, F.col("before") + within + 1).drop("__id", "p", "before")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A table in a few small files would be read, and all that follows computed, by a few tasks. Larger tables have more
    splits than that and stay as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
