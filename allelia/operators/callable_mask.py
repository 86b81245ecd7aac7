"""Invariant sites by arithmetic from a callable mask.

A mask row is (chrom, start0, end0, k): a half-open 0-based range and the number of called samples of each population, array<long> in
the order of the populations. Ranges are clipped to windows by an interval join; the variant positions in a clipped range are
counted and taken off its length. A ploidy of None is the column ``ploidy`` of the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .sites import Populations
from .windows import FINE, KEYS, assign_intervals, interval_overlaps

CLIP = [*KEYS, "start0", "end0"]


def invariant_ranges(windows: DataFrame, mask: DataFrame, variants: DataFrame, width: int = FINE) -> DataFrame:
    """(keys, start0, end0, k, n_inv): clipped mask ranges with the number of their invariant sites, over 0 only."""
    # the range itself is its key, so a recomputed task gives the same one; equal ranges count as often as they are there
    ranges = mask.groupBy("chrom", (F.col("start0") + 1).alias("b_lo"), F.col("end0").alias("b_hi"), "k").agg(F.count("*").alias("times"))
    ranges = ranges.withColumn("range_id", F.struct("b_lo", "b_hi", "k"))
    met = interval_overlaps(windows.select(*KEYS, F.col("w1").alias("lo"), F.col("w2").alias("hi")), ranges, width)
    clip = met.select(*KEYS, F.greatest("lo", "b_lo").alias("lo"), F.least("hi", "b_hi").alias("hi"), "k", "range_id", "times")
    # clipped ranges are windows of their own for the variant positions
    as_windows = clip.select("chrom", F.col("lo").alias("w1"), F.col("hi").alias("w2"), F.struct("w1", "w2", "window_ord", "range_id").alias("window_ord"))
    seen = assign_intervals(variants.select("chrom", F.col("pos").cast("long").alias("pos")), as_windows, width)
    counts = seen.groupBy("chrom", F.col("w1").alias("lo"), F.col("w2").alias("hi"), F.col("window_ord").alias("id")).agg(F.count("*").alias("n_var"))
    own = clip.withColumn("id", F.struct("w1", "w2", "window_ord", "range_id"))
    joined = own.join(counts, ["chrom", "lo", "hi", "id"], "left")
    n_inv = F.col("hi") - F.col("lo") + 1 - F.coalesce("n_var", F.lit(0))
    return joined.withColumn("n_inv", n_inv * F.col("times")).where("n_inv > 0").select(*KEYS, "k", "n_inv")


def _entries(ranges: DataFrame, pops: Populations, ploidy: int | None) -> DataFrame:
    sizes, each = pops.sizes(), F.col("ploidy") if ploidy is None else F.lit(ploidy)
    entries = F.array(*(F.struct(F.lit(p).alias("pop"), (F.element_at("k", i + 1) * each).cast("long").alias("n"), (sizes[p] * each).cast("long").alias("n_haps")) for i, p in enumerate(pops.order)))
    return ranges.withColumn("p", entries)


def pi_mask(ranges: DataFrame, pops: Populations, ploidy: int | None = 2) -> DataFrame:
    """count_comparisons, count_missing and no_sites of the invariant sites of each population."""
    rows = _entries(ranges, pops, ploidy).select(*KEYS, "n_inv", F.explode("p").alias("e")).select(*KEYS, "n_inv", "e.*")
    comps = K.choose2(F.col("n"))
    return rows.groupBy(*KEYS, "pop").agg(
        F.sum(F.col("n_inv") * comps).alias("count_comparisons"),
        F.sum(F.col("n_inv") * (K.choose2(F.col("n_haps")) - comps)).alias("count_missing"),
        F.sum(F.when(F.col("n") > 0, F.col("n_inv")).otherwise(0)).alias("no_sites"),
    )


def dxy_mask(ranges: DataFrame, pops: Populations, ploidy: int | None = 2) -> DataFrame:
    """The same for pairs of populations."""
    n = len(pops.order)
    pairs = F.array(*(F.struct(F.get("p", F.lit(i)).alias("a"), F.get("p", F.lit(j)).alias("b")) for i in range(n) for j in range(i + 1, n)))
    rows = _entries(ranges, pops, ploidy).select(*KEYS, "n_inv", F.explode(pairs).alias("e")).select(*KEYS, "n_inv", "e.*")
    comps = F.col("a.n") * F.col("b.n")
    rows = rows.withColumn("pop1", F.col("a.pop")).withColumn("pop2", F.col("b.pop"))
    return rows.groupBy(*KEYS, "pop1", "pop2").agg(
        F.sum(F.col("n_inv") * comps).alias("count_comparisons"),
        F.sum(F.col("n_inv") * (F.col("a.n_haps") * F.col("b.n_haps") - comps)).alias("count_missing"),
        F.sum(F.when((F.col("a.n") > 0) & (F.col("b.n") > 0), F.col("n_inv")).otherwise(0)).alias("no_sites"),
    )


def class_mask(ranges: DataFrame, pops: Populations, ploidy: int | None = 2) -> DataFrame:
    """Invariant sites by number of called alleles, for Watterson's theta and Tajima's D."""
    rows = _entries(ranges, pops, ploidy).select(*KEYS, "n_inv", F.explode("p").alias("e")).select(*KEYS, "n_inv", "e.*")
    return rows.groupBy(*KEYS, "pop", "n").agg(F.sum("n_inv").alias("sites"))
