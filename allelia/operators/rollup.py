"""Roll-up of window results to larger windows: sums of components, one division at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .stats import _constants

# The columns that are summed, and the numerator and denominator, by statistic.
SUMMED = {
    "pi": ("no_sites", "count_diffs", "count_comparisons", "count_missing"),
    "dxy": ("no_sites", "count_diffs", "count_comparisons", "count_missing"),
    "wc_fst": ("no_snps", "wc_fst_a", "wc_fst_b", "wc_fst_c"),
    "hudson_fst": ("no_snps", "hudson_fst_num", "hudson_fst_den"),
    "watterson_theta": ("no_sites", "raw_watterson_theta", "no_var_sites", "weighted_no_sites"),
    "tajima_d": ("no_sites", "raw_pi", "raw_watterson_theta"),
}


def rollup(results: DataFrame, stat: str, size: int, most: int = 0) -> DataFrame:
    """Results of ``stat`` (with components) in windows of ``size``, counted from the first window of each contig.

    NULL components are skipped; a sum of none is NULL. ``most``: haplotypes of the largest population, for tajima_d.
    """
    pops = [c for c in ("pop", "pop1", "pop2") if c in results.columns]
    start = results.groupBy("chromosome").agg(F.min("window_pos_1").alias("_start"))
    rows = results.join(start, "chromosome").withColumn("_bin", F.expr(f"(window_pos_1 - _start) div {size}"))
    keys = [*pops, "chromosome", "_start", "_bin"]
    sums = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMMED[stat]))
    if stat == "tajima_d":
        counts = rows.select(*keys, F.explode(K.class_array(F.col("tajima_d_s_counts"))).alias("e")).groupBy(*keys, F.col("e.n").alias("n")).agg(F.sum("e.s").alias("s"))
        s = F.col("s").cast("double")
        spread = F.when((F.col("n") >= 2) & (s > 0), F.sqrt(F.col("e1") * s + F.col("e2") * s * (s - 1))).otherwise(0.0)
        sd = _constants(counts, most).groupBy(*keys).agg(F.sum(spread).alias("tajima_d_stdev"), F.collect_list(F.struct("n", "s")).alias("_c"))
        sums = sums.join(sd, keys, "left").withColumn("tajima_d_stdev", F.when(F.col("raw_pi").isNotNull(), F.coalesce("tajima_d_stdev", F.lit(0.0))))
        value = F.when(K.positive(F.col("tajima_d_stdev")) & ~F.isnan("raw_pi") & ~F.isnan("raw_watterson_theta"), (F.col("raw_pi") - F.col("raw_watterson_theta")) / F.col("tajima_d_stdev"))
        name, more = "tajima_d", ["tajima_d_stdev", K.class_string(F.col("_c")).alias("tajima_d_s_counts")]
    elif stat == "watterson_theta":
        value, name, more = F.when(F.col("no_sites") > 0, F.col("raw_watterson_theta") / F.col("no_sites")), "avg_watterson_theta", []
    elif stat == "wc_fst":
        whole = F.col("wc_fst_a") + F.col("wc_fst_b") + F.col("wc_fst_c")
        value, name, more = F.when(K.positive(whole), F.col("wc_fst_a") / whole), "avg_wc_fst", []
    elif stat == "hudson_fst":
        value, name, more = F.when(K.positive(F.col("hudson_fst_num") + F.col("hudson_fst_den")), K.divide(F.col("hudson_fst_num"), F.col("hudson_fst_den"))), "avg_hudson_fst", []
    else:
        value, name, more = F.when(F.col("count_comparisons") > 0, F.col("count_diffs") / F.col("count_comparisons")), f"avg_{stat}", []
    first = F.col("_start") + F.col("_bin") * size
    return sums.select(*pops, "chromosome", first.alias("window_pos_1"), (first + size - 1).alias("window_pos_2"), value.alias(name), *SUMMED[stat], *more)


def ordered(results: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rolled-up results by contig in order of appearance (contigs: chrom, chrom_rank), window and population; a range-partitioned sort."""
    rows = results.join(F.broadcast(contigs.select(F.col("chrom").alias("chromosome"), "chrom_rank")), "chromosome")  # a row for each contig
    return rows.orderBy("chrom_rank", "window_pos_1", *(c for c in ("pop", "pop1", "pop2") if c in results.columns)).select(*results.columns)


def long_format(results: dict[str, DataFrame]) -> DataFrame:
    """(pop1, pop2, chromosome, window_pos_1, window_pos_2, statistic, value) from results by value column."""
    out = None
    for value, df in results.items():
        first, second = (F.col("pop1"), F.col("pop2")) if "pop1" in df.columns else (F.col("pop"), F.lit(None).cast("string"))
        rows = df.select(first.alias("pop1"), second.alias("pop2"), "chromosome", "window_pos_1", "window_pos_2", F.col(value).alias(value))
        rows = rows.unpivot(["pop1", "pop2", "chromosome", "window_pos_1", "window_pos_2"], [value], "statistic", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
