"""Diversity statistics: sums of per-site components over windows, divided once.

``sited`` is the output of an assignment (operators.windows) on sites with population counts (operators.sites). Every statistic is one
partial and one final aggregation; windows come in by a left join at the end, so the empty ones have rows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .sites import Populations, by_pair, by_population
from .windows import KEYS


def _ratio(a: str, b: str) -> F.Column:
    return F.when(F.col(b) > 0, F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))


def _populations(windows: DataFrame, pops: Populations) -> DataFrame:
    names = F.array(*(F.struct(F.lit(p).alias("pop"), F.lit(i).alias("pop_rank")) for i, p in enumerate(pops.order)))
    return windows.select(*KEYS, F.explode(names).alias("e")).select(*KEYS, "e.*")


def _pairs(windows: DataFrame, pops: Populations) -> DataFrame:
    n = len(pops.order)
    names = F.array(*(F.struct(F.lit(pops.order[i]).alias("pop1"), F.lit(pops.order[j]).alias("pop2")) for i in range(n) for j in range(i + 1, n)))
    return windows.select(*KEYS, F.explode(names).alias("e")).select(*KEYS, "e.*")


def _sums() -> list[F.Column]:
    return [F.sum(c).alias(c) for c in ("count_diffs", "count_comparisons", "count_missing", "no_sites")]


def _with_mask(own: DataFrame, mask: DataFrame | None, keys: list[str]) -> DataFrame:
    """Add the sums of a callable mask; where it brings nothing, a window without rows stays null."""
    if mask is None:
        return own
    some = mask.where("count_comparisons > 0 or count_missing > 0 or no_sites > 0").withColumn("count_diffs", F.lit(0).cast("long"))
    return own.select(*keys, *(("count_diffs", "count_comparisons", "count_missing", "no_sites"))).unionByName(some.select(*keys, "count_diffs", "count_comparisons", "count_missing", "no_sites")).groupBy(*keys).agg(*_sums())


def pi(sited: DataFrame, windows: DataFrame, pops: Populations, mask: DataFrame | None = None) -> DataFrame:
    """Mean pairwise difference within each population."""
    keys = [*KEYS, "pop"]
    rows = by_population(sited)
    comps = K.choose2(F.col("n"))
    parts = rows.select(
        *keys,
        (K.within_differences(F.col("ac"), F.col("n")) * F.col("mult")).alias("count_diffs"),
        (comps * F.col("mult")).alias("count_comparisons"),
        ((K.choose2(F.col("n_haps")) - comps) * F.col("mult")).alias("count_missing"),
        F.when(F.col("n01") > 0, F.col("mult")).otherwise(0).alias("no_sites"),
    )
    return pi_result(parts.groupBy(*keys).agg(*_sums()), windows, pops, mask)


def pi_result(sums: DataFrame, windows: DataFrame, pops: Populations, mask: DataFrame | None = None) -> DataFrame:
    """pi from (keys, pop, count_diffs, count_comparisons, count_missing, no_sites)."""
    keys = [*KEYS, "pop"]
    out = _populations(windows, pops).join(_with_mask(sums, mask, keys), keys, "left")
    return out.select("pop", *_window(), _ratio("count_diffs", "count_comparisons").alias("avg_pi"), F.coalesce("no_sites", F.lit(0)).alias("no_sites"), "count_diffs", "count_comparisons", "count_missing", "window_ord", "pop_rank")


def _window() -> list[F.Column]:
    return [F.col("chrom").alias("chromosome"), F.col("w1").alias("window_pos_1"), F.col("w2").alias("window_pos_2")]


def dxy(sited: DataFrame, windows: DataFrame, pops: Populations, mask: DataFrame | None = None) -> DataFrame:
    """Mean pairwise difference between populations."""
    keys = [*KEYS, "pop1", "pop2"]
    rows = by_pair(sited, pops)
    comps = F.col("a.n") * F.col("b.n")
    parts = rows.select(
        *keys,
        ((comps - K.shared_products(F.col("a.ac"), F.col("b.ac"))) * F.col("mult")).alias("count_diffs"),
        (comps * F.col("mult")).alias("count_comparisons"),
        ((F.col("a.n_haps") * F.col("b.n_haps") - comps) * F.col("mult")).alias("count_missing"),
        F.when((F.col("a.n01") > 0) & (F.col("b.n01") > 0), F.col("mult")).otherwise(0).alias("no_sites"),
    )
    return dxy_result(parts.groupBy(*keys).agg(*_sums()), windows, pops, mask)


def dxy_result(sums: DataFrame, windows: DataFrame, pops: Populations, mask: DataFrame | None = None) -> DataFrame:
    """dxy from (keys, pop1, pop2, count_diffs, count_comparisons, count_missing, no_sites)."""
    keys = [*KEYS, "pop1", "pop2"]
    out = _pairs(windows, pops).join(_with_mask(sums, mask, keys), keys, "left")
    return out.select("pop1", "pop2", *_window(), _ratio("count_diffs", "count_comparisons").alias("avg_dxy"), F.coalesce("no_sites", F.lit(0)).alias("no_sites"), "count_diffs", "count_comparisons", "count_missing", "window_ord")


ELIGIBLE = "n_alleles_all = 2"


def fst_eligible(counted: DataFrame) -> DataFrame:
    """Variant sites at which exactly two alleles are seen over all samples."""
    return counted.where(ELIGIBLE)


def _fst_parts(rows: DataFrame, kind: str, where: F.Column | None = None) -> DataFrame:
    """Per-site components; raw sums keep NaN, the others skip it term by term. Where ``where`` does not hold they are null, and not computed."""
    only = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    if kind == "hudson":
        num, den = K.hudson_site(F.col("a"), F.col("b"))
        return rows.withColumn("_x", only(num)).withColumn("_y", only(den)).withColumns({"x": K.skip_nan(F.col("_x")), "y": K.skip_nan(F.col("_y")), "z": only(F.lit(0.0))})
    # at an eligible site two alleles are seen; the terms of any other are zero, or NaN where those of the two are not finite either.
    # up to three alleles go without a higher-order function
    seen = lambda u: f"coalesce(get(a.ac, {u}), 0) + coalesce(get(b.ac, {u}), 0) > 0"
    found = f"filter(sequence(0, size(a.ac) - 1), u -> {seen('u')})"
    alleles = {
        "_u0": f"case size(a.ac) when 2 then 0 when 3 then if({seen(0)}, 0, 1) else coalesce(get({found}, 0), 0) end",
        "_u1": f"case size(a.ac) when 2 then 1 when 3 then if({seen(0)} and not {seen(2)}, 1, 2) else coalesce(get({found}, 1), if(get({found}, 0) = 0, 1, 0), 1) end",
    }
    names = rows.columns
    for step in (alleles, *K.weir_cockerham_steps(("0", "1"))):
        rows = rows.selectExpr("*", *(f"{sql} as {name}" for name, sql in step.items()))
    both = lambda v, of: only(F.expr(" + ".join(of.format(f"_v{v}{u}") for u in "01")))
    return rows.select(*names, *(both(v, "{}").alias(f"_{v}") for v in "xyz"), *(both(v, "nanvl({}, 0D)").alias(v) for v in "xyz"))


def _fst_names(kind: str, components: bool) -> list[F.Column]:
    if not components:
        return []
    if kind == "hudson":
        return [F.col("x").alias("hudson_fst_num"), F.col("y").alias("hudson_fst_den")]
    return [F.col(v).alias(f"wc_fst_{n}") for v, n in zip("xyz", "abc")]


def fst(sited: DataFrame, pops: Populations, kind: str = "wc", components: bool = False) -> DataFrame:
    """FST of each pair of populations; a window without an eligible site has no row.

    ``wc`` needs counts with heterozygotes and diploid sites.
    """
    keys = [*KEYS, "pop1", "pop2"]
    sums = _fst_parts(by_pair(sited, pops, F.expr(ELIGIBLE)), kind).groupBy(*keys).agg(F.count("*").alias("no_snps"), *(F.sum(v).alias(v) for v in "xyz"))
    return fst_result(sums, kind, components)


def fst_result(sums: DataFrame, kind: str = "wc", components: bool = False) -> DataFrame:
    """FST from (keys, pop1, pop2, no_snps, x, y, z)."""
    whole = F.col("x") + F.col("y") if kind == "hudson" else F.col("x") + F.col("y") + F.col("z")
    value = F.when(K.positive(whole), K.divide(F.col("x"), F.col("y") if kind == "hudson" else whole))
    return sums.select("pop1", "pop2", *_window(), value.alias(f"avg_{kind}_fst"), "no_snps", *_fst_names(kind, components), "window_ord")


def fst_per_site(counted: DataFrame, pops: Populations, kind: str = "wc", components: bool = False) -> DataFrame:
    """FST of each eligible site and pair: a projection, without any aggregation."""
    rows = _fst_parts(by_pair(counted, pops, F.expr(ELIGIBLE)), kind)
    value = K.divide(F.col("_x"), F.col("_y")) if kind == "hudson" else K.divide(F.col("_x"), F.col("_x") + F.col("_y") + F.col("_z"))
    return rows.select("pop1", "pop2", F.col("chrom").alias("chromosome"), F.col("pos").cast("long").alias("window_pos_1"), F.col("pos").cast("long").alias("window_pos_2"), F.when(~F.isnan(value), value).alias(f"avg_{kind}_fst"), F.lit(1).cast("long").alias("no_snps"), *_fst_names(kind, components))


def allele_classes(sited: DataFrame) -> DataFrame:
    """Per window, population and number of called alleles n: sites, variant sites, pairwise differences."""
    rows = by_population(sited)
    variant = F.col("n") - F.element_at("ac", 1) > 0
    return rows.groupBy(*KEYS, "pop", "n").agg(
        F.sum("mult").alias("sites"),
        F.sum(F.when(variant, F.col("mult")).otherwise(0)).alias("variants"),
        F.sum(K.within_differences(F.col("ac"), F.col("n")) * F.col("mult")).alias("diffs"),
    )


def _constants(classes: DataFrame, most: int) -> DataFrame:
    return classes.join(F.broadcast(K.harmonic_table(classes.sparkSession, most)), "n")  # a row for each n up to the haplotypes of a population


def _theta() -> F.Column:
    """Sum of variant sites over a1(n); infinite where a variant site has one called allele."""
    return F.sum(F.when(F.col("variants") > 0, K.divide(F.col("variants"), F.col("a1"))).otherwise(0.0))


def _most(pops: Populations, ploidy: int) -> int:
    return max([1, *pops.sizes().values()]) * ploidy


def watterson_theta(sited: DataFrame, windows: DataFrame, pops: Populations, ploidy: int = 2, mask: DataFrame | None = None) -> DataFrame:
    """Watterson's theta; mask rows are (keys, pop, n, sites) of invariant sites."""
    return watterson_result(allele_classes(sited), windows, pops, ploidy, mask)


def watterson_result(classes: DataFrame, windows: DataFrame, pops: Populations, ploidy: int = 2, mask: DataFrame | None = None) -> DataFrame:
    """Watterson's theta from (keys, pop, n, sites, variants, diffs). ploidy: the largest."""
    keys = [*KEYS, "pop"]
    classes = classes.select(*keys, "n", "sites", "variants", "diffs", F.lit(1).alias("real"))
    if mask is not None:
        extra = mask.where("n > 0 and sites > 0").select(*keys, "n", "sites", F.lit(0).cast("long").alias("variants"), F.lit(0).cast("long").alias("diffs"), F.lit(0).alias("real"))
        classes = classes.unionByName(extra)
    sums = _constants(classes, _most(pops, ploidy)).groupBy(*keys).agg(
        _theta().alias("raw"),
        F.max("real").alias("real"),
        F.sum(F.when(F.col("n") > 0, F.col("sites")).otherwise(0)).alias("no_sites"),
        F.sum("variants").alias("no_var_sites"),
        F.sum(F.col("n") * F.col("sites")).alias("called"),
        F.max("n").alias("most"),
    )
    out = _populations(windows, pops).join(sums, keys, "left")
    # a window that only the mask fills has no sites read: its raw value stays null
    raw = F.when(F.col("real") == 1, F.col("raw"))
    return out.select(
        "pop",
        *_window(),
        F.when(F.col("no_sites") > 0, raw / F.col("no_sites")).alias("avg_watterson_theta"),
        F.coalesce("no_sites", F.lit(0)).alias("no_sites"),
        raw.alias("raw_watterson_theta"),
        F.when(F.col("real") == 1, F.col("no_var_sites")).alias("no_var_sites"),
        F.when(F.col("most") > 0, F.col("called") / F.col("most")).otherwise(F.when(F.col("real") == 1, F.lit(0.0))).alias("weighted_no_sites"),
        "window_ord",
        "pop_rank",
    )


def tajima_d(sited: DataFrame, windows: DataFrame, pops: Populations, ploidy: int = 2, components: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """Tajima's D with the standard deviation summed over classes of sites with equally many called alleles."""
    return tajima_result(allele_classes(sited), windows, pops, ploidy, components, mask)


def tajima_result(classes: DataFrame, windows: DataFrame, pops: Populations, ploidy: int = 2, components: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """Tajima's D from (keys, pop, n, sites, variants, diffs). ploidy: the largest."""
    keys = [*KEYS, "pop"]
    classes = _constants(classes, _most(pops, ploidy))
    s = F.col("variants").cast("double")
    spread = F.when((F.col("n") >= 2) & (s > 0), F.sqrt(F.col("e1") * s + F.col("e2") * s * (s - 1))).otherwise(0.0)
    sums = classes.groupBy(*keys).agg(
        F.sum(F.when(F.col("n") >= 2, F.col("diffs") / K.choose2(F.col("n"))).otherwise(0.0)).alias("raw_pi"),
        _theta().alias("raw"),
        F.sum(spread).alias("sd"),
        F.sum(F.when(F.col("n") > 0, F.col("sites")).otherwise(0)).alias("no_sites"),
        F.collect_list(F.when(F.col("variants") > 0, F.struct("n", F.col("variants").alias("s")))).alias("classes"),
    )
    out = _populations(windows, pops).join(sums, keys, "left")
    sites = F.coalesce("no_sites", F.lit(0))
    if mask is not None:
        extra = mask.where("n > 0").groupBy(*keys).agg(F.sum("sites").alias("more"))
        out = out.join(extra, keys, "left")
        sites = sites + F.coalesce("more", F.lit(0))
    d = F.when(K.positive(F.col("sd")) & ~F.isnan("raw_pi") & ~F.isnan("raw"), (F.col("raw_pi") - F.col("raw")) / F.col("sd"))
    more = [K.class_string(F.col("classes")).alias("tajima_d_s_counts")] if components else []
    return out.select("pop", *_window(), d.alias("tajima_d"), sites.alias("no_sites"), "raw_pi", F.col("raw").alias("raw_watterson_theta"), F.col("sd").alias("tajima_d_stdev"), *more, "window_ord", "pop_rank")
