"""Pairwise sums per window and population over a stream of site rows.

Site components only add up, so arriving sites can be summed as they come and the ratio is taken when it is read.

``pi_sums`` is a streaming aggregate: the state holds one row of integers per window and population. ``add_batch`` keeps the sums in a table instead, a
part for each micro-batch: a batch that is run again after a failure replaces its own part, so each batch counts once; ``current`` adds
the parts up, ``compact`` makes one of them. Rows are not deduplicated: a site that the source brings in two batches counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators.sites import Populations, by_population, with_populations

SUMS = ("count_diffs", "count_comparisons", "count_missing", "no_sites")


def pi_sums(site_stream: DataFrame, pops: Populations, size: int, start: int = 1) -> DataFrame:
    """An aggregate (chrom, w1, pop, sums) of a stream or a table; write that of a stream in update or complete mode."""
    rows = by_population(with_populations(site_stream, pops)).where(f"pos >= {start}")
    w1 = F.expr(f"(pos - {start}) div {size} * {size} + {start}")
    comps = K.choose2(F.col("n"))
    return rows.groupBy("chrom", w1.alias("w1"), "pop").agg(
        F.sum(K.within_differences(F.col("ac"), F.col("n"))).alias("count_diffs"),
        F.sum(comps).alias("count_comparisons"),
        F.sum(K.choose2(F.col("n_haps")) - comps).alias("count_missing"),
        F.sum(F.when(F.col("n01") > 0, 1).otherwise(0)).alias("no_sites"),
    )


def add_batch(path: str, pops: Populations, size: int, start: int = 1) -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch`` that keeps the sums of each batch of site rows as a part of the table at ``path``."""

    def add(batch: DataFrame, number: int) -> None:
        pi_sums(batch, pops, size, start).write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={number}")

    return add


def current(spark: SparkSession, path: str) -> DataFrame:
    """The sums of all parts."""
    parts = spark.read.option("basePath", path).parquet(path)
    return parts.groupBy("chrom", "w1", "pop").agg(*(F.sum(c).alias(c) for c in SUMS))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the sums of all parts as the one part (-1) of a new table, to which later batches can be added."""
    current(spark, path).write.mode("overwrite").parquet(f"{to.rstrip('/')}/part=-1")


def with_ratio(sums: DataFrame) -> DataFrame:
    return sums.withColumn("avg_pi", F.when(F.col("count_comparisons") > 0, F.col("count_diffs") / F.col("count_comparisons")))
