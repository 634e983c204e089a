"""DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import settle, sized, spread, unsettle

__all__ = ["cols", "components", "free", "settle", "sized", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def cols(df: DataFrame, **named: str) -> DataFrame:
    """Just the named columns under the operator's own names; whatever else ``df`` carries stays out."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in named.items()])


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not among the settled ``ids``; a null key stays."""
    return docs.join(sized(ids.select(key).distinct()), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges``: (node, root), root the least node; nodes without edge are absent.

    Alternating large-star and small-star rounds; each round is two shuffled aggregations and joins on
    the edges, whose number does not grow, and ends in the shared folder. O(log n) rounds.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = settle(e, "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u")
        new = small.select(F.col("v").alias("x"), "m").union(small.select(F.col("u").alias("x"), "m"))
        new = new.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        nxt = settle(new, "edges")
        sig = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unsettle(e)
        e = nxt
        if sig == seen:
            break
        seen = sig
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
