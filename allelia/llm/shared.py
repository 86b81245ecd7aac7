"""Helpers for Spark jobs that need a cut lineage or groups of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all tasks run in the driver's process (a ``local`` master), a new folder is made and set.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="allelia-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: an intermediate result that no lost executor takes along.

    options: those of Spark's Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns called c0, c1, ..., and the new name of each: names of callers cannot clash with those of an operator."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def apart(df: DataFrame) -> DataFrame:
    """Deal aggregated rows anew, without a key. A join on the grouping key then shuffles both sides, which lets Spark split a
    hot key of the other side; otherwise it would reuse the partitioning of the aggregation and could not."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"), so
    rounds grow with the logarithm of the size. Edges stay distributed; each half of a round is a written table, so a plan reads few of them
    and each is computed once. No edges give no nodes.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = stored(both.where("b > a").join(apart(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        star = star.join(apart(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(star.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        # settled once every node has one edge, to a node without any
        if now.groupBy("a").count().where("count > 1").isEmpty() and now.join(apart(now.select(F.col("b").alias("a")).distinct()), "a", "left_semi").isEmpty():
            break
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
