"""All statistics of one run from one aggregation.

``components`` counts the genotypes of each site once and sums by window: for each population and number n of its called alleles, and for each
pair of populations (n is null there). The result has a row for each window, population and n, and each window and pair; pi, Watterson's theta and Tajima's D
are sums over n of it, dxy and FST are rows of it. Sums only add up, so they may be gathered to other windows before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .sites import Populations
from .stats import _fst_parts
from .windows import KEYS

SINGLE, PAIRED = ("pi", "watterson_theta", "tajima_d"), ("dxy", "fst")
#: Columns that add up.
SUMS = ("sites", "variants", "count_diffs", "count_comparisons", "count_missing", "no_sites", "no_snps", "x", "y", "z")
PARTS = ("pop1", "pop2", "n")


def components(sited: DataFrame, pops: Populations, stats: tuple[str, ...], fst: str = "wc", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, pop1, pop2, n, sums) of sites with population counts (with heterozygotes, for the Weir-Cockerham FST) and site_class.

    FST takes eligible variant sites, for ``wc`` those of diploid contigs (column ``ploidy``, if there is one)."""
    several, k = bool({*PAIRED} & {*stats}), len(pops.order)
    # a number for each population (i, i) and pair (i, j): the plan is as short for many as for two
    codes = [i * k + i for i in range(k)] if {*SINGLE} & {*stats} else []
    codes += [i * k + j for i in range(k) for j in range(i + 1, k)] if several else []
    rows = sited.withColumn("e", F.explode(F.expr(f"array({', '.join(map(str, codes))})")))
    rows = rows.withColumn("a", F.expr(f"get(p, cast(e div {k} as int))")).withColumn("b", F.expr(f"if(e div {k} = e % {k}, null, get(p, cast(e % {k} as int)))")).drop("e", "p")
    alone = F.col("b").isNull()
    n, m = F.col("a.n"), F.col("b.n")
    comps = F.when(alone, K.choose2(n)).otherwise(n * m)
    every = F.when(alone, K.choose2(F.col("a.n_haps"))).otherwise(F.col("a.n_haps") * F.col("b.n_haps"))
    diffs = F.when(alone, K.within_differences(F.col("a.ac"), n)).otherwise(comps - K.shared_products(F.col("a.ac"), F.col("b.ac"))) if several else K.within_differences(F.col("a.ac"), n)
    varies = alone & (n - F.get("a.ac", F.lit(0)) > 0)
    times = lambda on: F.when(on, F.col("mult")).otherwise(0)
    none = F.lit(None).cast("double")
    if "fst" in stats:
        eligible = ~alone & (F.col("n_alleles_all") == 2) & (F.col("site_class") != "invariant")
        if fst == "wc" and "ploidy" in sited.columns:
            eligible &= F.col("ploidy") == 2
        rows = rows.withColumn("no_snps", F.when(eligible, F.lit(1)).otherwise(0).cast("long"))
        rows = _fst_parts(rows, fst, F.col("no_snps") > 0)
    else:
        rows = rows.withColumns({"no_snps": F.lit(0).cast("long"), "x": none, "y": none, "z": none})
    parts = rows.select(
        *keys, F.col("a.pop").alias("pop1"), F.col("b.pop").alias("pop2"), F.when(alone, n).alias("n"),
        times(alone).alias("sites"), times(varies).alias("variants"), (diffs * F.col("mult")).alias("count_diffs"), (comps * F.col("mult")).alias("count_comparisons"), ((every - comps) * F.col("mult")).alias("count_missing"),
        times((F.col("a.n01") > 0) & (alone | (F.col("b.n01") > 0))).alias("no_sites"), "no_snps", "x", "y", "z",
    )
    return parts.groupBy(*keys, *PARTS).agg(*(F.sum(c).alias(c) for c in SUMS))


def classes(found: DataFrame) -> DataFrame:
    """What ``stats.allele_classes`` gives."""
    return found.where("pop2 is null").select(*KEYS, F.col("pop1").alias("pop"), "n", "sites", "variants", F.col("count_diffs").alias("diffs"))


def pi_sums(found: DataFrame) -> DataFrame:
    own = found.where("pop2 is null").groupBy(*KEYS, F.col("pop1").alias("pop"))
    return own.agg(*(F.sum(c).alias(c) for c in ("count_diffs", "count_comparisons", "count_missing", "no_sites")))


def dxy_sums(found: DataFrame) -> DataFrame:
    return found.where("pop2 is not null").select(*KEYS, "pop1", "pop2", "count_diffs", "count_comparisons", "count_missing", "no_sites")


def fst_sums(found: DataFrame) -> DataFrame:
    return found.where("pop2 is not null and no_snps > 0").select(*KEYS, "pop1", "pop2", "no_snps", "x", "y", "z")

