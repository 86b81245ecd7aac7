"""Queries of the diversity operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callable_mask, fused, pairs, rollup, sites, stats, windows
from ..sources import staging
from ..sources.tables import POPULATIONS, THREE, arriving_sites, order_sites
from ..streaming import sums

SIZE = 500
HIDDEN = ("window_ord", "pop_rank")


def _out(df: DataFrame) -> DataFrame:
    """Without sort keys, doubles rounded to 9 digits (sums of doubles depend on their order)."""
    cols = [c for c in df.columns if c not in HIDDEN]
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, 9).alias(c) if kinds[c] == "double" else F.col(c) for c in cols))


def _fixed(spark: SparkSession, sf_dir: str, pops=POPULATIONS, extra_allele: bool = False, het: bool = False, sited=None, variants_only: bool = False):
    rows = order_sites(spark, sf_dir, extra_allele) if sited is None else sited
    spans = windows.extents(rows)
    kept = sites.retained(rows, multiallelic=extra_allele, variants_only=variants_only)
    return windows.assign_fixed(sites.with_populations(kept, pops, het), 1, SIZE), windows.fixed_windows(spans, SIZE)


def pi_fixed_windows(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir)
    return _out(stats.pi(sited, table, POPULATIONS))


def pi_multiallelic(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir, extra_allele=True)
    return _out(stats.pi(sited, table, POPULATIONS))


def _listed(spark, sf_dir):
    return order_sites(spark, sf_dir).where("row_id % 7 < 2").select("chrom", "pos")


def pi_sites_mask(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir, sited=sites.masked(order_sites(spark, sf_dir), _listed(spark, sf_dir)))
    return _out(stats.pi(sited, table, POPULATIONS))


def _bed(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.selectExpr("concat('chr', cast(n_nationkey % 3 + 1 as string)) as chrom", "cast(n_nationkey * 37 + 1 as bigint) as w1", "cast(n_nationkey * 37 + 200 + n_nationkey % 5 * 150 as bigint) as w2", "cast(n_nationkey as bigint) as window_ord")


def pi_bed_windows(spark, sf_dir):
    table = _bed(spark, sf_dir)
    sited = windows.assign_intervals(sites.with_populations(sites.retained(order_sites(spark, sf_dir)), POPULATIONS), table)
    return _out(stats.pi(sited, table, POPULATIONS))


def pi_single_sites(spark, sf_dir):
    listed = _listed(spark, sf_dir)
    table = windows.site_windows(listed)
    sited = windows.assign_intervals(sites.with_populations(sites.masked(sites.retained(order_sites(spark, sf_dir)), listed), POPULATIONS), table)
    return _out(stats.pi(sited, table, POPULATIONS))


def dxy_fixed_windows(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir, THREE)
    return _out(stats.dxy(sited, table, THREE))


def _fst(kind: str, components: bool):
    def query(spark, sf_dir):
        sited, _ = _fixed(spark, sf_dir, THREE, extra_allele=True, het=kind == "wc", variants_only=True)
        return _out(stats.fst(sited, THREE, kind, components))

    return query


def _fst_per_site(kind: str):
    def query(spark, sf_dir):
        rows = sites.retained(order_sites(spark, sf_dir, True), multiallelic=True, variants_only=True)
        return _out(stats.fst_per_site(sites.with_populations(rows, THREE, kind == "wc"), THREE, kind, True))

    return query


def watterson_theta_windows(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir)
    return _out(stats.watterson_theta(sited, table, POPULATIONS))


def tajima_d_windows(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir)
    return _out(stats.tajima_d(sited, table, POPULATIONS))


def tajima_d_components(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir)
    return _out(stats.tajima_d(sited, table, POPULATIONS, components=True))


def rollup_pi(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir)
    return _out(rollup.rollup(stats.pi(sited, table, POPULATIONS), "pi", 3 * SIZE))


def rollup_tajima_d(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir)
    return _out(rollup.rollup(stats.tajima_d(sited, table, POPULATIONS, components=True), "tajima_d", 3 * SIZE, most=10))


def rollup_fst_wc(spark, sf_dir):
    sited, _ = _fixed(spark, sf_dir, THREE, extra_allele=True, het=True, variants_only=True)
    return _out(rollup.rollup(stats.fst(sited, THREE, "wc", True), "wc_fst", 3 * SIZE))


def rollup_dxy(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir)
    return _out(rollup.rollup(stats.dxy(sited, table, POPULATIONS), "dxy", 3 * SIZE))


def rollup_watterson_theta(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir)
    return _out(rollup.rollup(stats.watterson_theta(sited, table, POPULATIONS), "watterson_theta", 3 * SIZE))


def rollup_fst_hudson(spark, sf_dir):
    sited, _ = _fixed(spark, sf_dir, THREE, extra_allele=True, variants_only=True)
    return _out(rollup.rollup(stats.fst(sited, THREE, "hudson", True), "hudson_fst", 3 * SIZE))


def site_classes(spark, sf_dir):
    return sites.classified(order_sites(spark, sf_dir, True)).groupBy("chrom", "site_class").agg(F.count("*").alias("n"))


def allele_counts(spark, sf_dir):
    rows = sites.by_population(sites.with_populations(order_sites(spark, sf_dir, True), THREE))
    get = lambda i: F.coalesce(F.get("ac", F.lit(i)), F.lit(0)).cast("long")
    return rows.select("chrom", "pos", "pop", get(0).alias("n0"), get(1).alias("n1"), get(2).alias("n2"), "n", "n01", "n_haps")


def fst_eligible_sites(spark, sf_dir):
    rows = sites.with_populations(sites.retained(order_sites(spark, sf_dir, True), multiallelic=True), POPULATIONS)
    return stats.fst_eligible(rows).select("chrom", "pos")


def _gt_strings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "concat('chr', cast(o_orderkey % 3 + 1 as string)) as chrom",
        "o_orderkey as row_id",
        "array(case when o_orderkey % 3 = 2 then '1:9' when o_custkey % 4 = 0 then './.:0' else './1' end, case when o_orderkey % 3 = 2 then '0' when o_orderkey % 3 = 1 then '0/0/1:7' else '0|1' end) as gts",
    )


def ploidy_by_contig(spark, sf_dir):
    return sites.ploidy_by_contig(_gt_strings(spark, sf_dir)).select("chrom", F.col("ploidy").cast("long").alias("ploidy"))


def _every_block(spark, sf_dir):
    """Every order as a record, four positions apart; invariant rows span up to three more positions."""
    more = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as row_id", "case when o_custkey % 5 <> 0 then o_custkey % 4 else 0 end as more")
    rows = order_sites(spark, sf_dir).withColumn("pos", (F.col("pos") - 1) * 4 + 1).drop("info_end").join(more, "row_id")
    return rows.withColumn("info_end", F.expr("case when more > 0 then pos + more end")).drop("more")


def block_expand(spark, sf_dir):
    return sites.expanded(_every_block(spark, sf_dir)).select("chrom", "pos", "row_id", F.size("alts").cast("long").alias("n_alts"))


def pi_block_weighted(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir, sited=sites.blocks_as_sites(_every_block(spark, sf_dir)))
    return _out(stats.pi(sited, table, POPULATIONS))


def _mask(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr("concat('chr', cast(p_partkey % 3 + 1 as string)) as chrom", "p_partkey div 3 * 13 as start0", "p_partkey div 3 * 13 + 9 as end0", "array(p_partkey % 6, p_partkey * 7 % 6) as k")


def _masked_run(spark, sf_dir):
    rows = order_sites(spark, sf_dir)
    spans = windows.extents(rows)
    table = windows.fixed_windows(spans, SIZE)
    variants = sites.retained(rows, variants_only=True)
    sited = windows.assign_fixed(sites.with_populations(variants, POPULATIONS), 1, SIZE)
    return sited, table, callable_mask.invariant_ranges(table, _mask(spark, sf_dir), variants)


def mask_pi(spark, sf_dir):
    sited, table, ranges = _masked_run(spark, sf_dir)
    return _out(stats.pi(sited, table, POPULATIONS, callable_mask.pi_mask(ranges, POPULATIONS)))


def mask_dxy(spark, sf_dir):
    sited, table, ranges = _masked_run(spark, sf_dir)
    return _out(stats.dxy(sited, table, POPULATIONS, callable_mask.dxy_mask(ranges, POPULATIONS)))


def mask_theta(spark, sf_dir):
    sited, table, ranges = _masked_run(spark, sf_dir)
    return _out(stats.watterson_theta(sited, table, POPULATIONS, mask=callable_mask.class_mask(ranges, POPULATIONS)))


def mask_tajima_d(spark, sf_dir):
    sited, table, ranges = _masked_run(spark, sf_dir)
    return _out(stats.tajima_d(sited, table, POPULATIONS, mask=callable_mask.class_mask(ranges, POPULATIONS)))


def window_table(spark, sf_dir):
    return windows.fixed_windows(windows.extents(order_sites(spark, sf_dir)), SIZE)


def long_format(spark, sf_dir):
    sited, table = _fixed(spark, sf_dir)
    return _out(rollup.long_format({"avg_pi": stats.pi(sited, table, POPULATIONS), "avg_dxy": stats.dxy(sited, table, POPULATIONS)}))


def _nested(spark, sf_dir):
    """Windows as wide as a contig, one in another: each covers nearly all sites."""
    ends = windows.extents(order_sites(spark, sf_dir)).select("chrom", "end")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('chr', cast(n_nationkey % 3 + 1 as string)) as chrom", "n_nationkey as k")
    return n.join(ends, "chrom").selectExpr("chrom", "cast(k * 7 + 1 as bigint) as w1", "end - k * 5 as w2", "cast(k as bigint) as window_ord")


def pi_nested_windows(spark, sf_dir):
    """Overlapping windows from sums of cells: a site is counted once, however many windows cover it."""
    table = _nested(spark, sf_dir)
    counted = sites.with_populations(sites.retained(order_sites(spark, sf_dir)), POPULATIONS)
    cells = fused.components(windows.assign_cells(counted, table), POPULATIONS, ("pi",), keys=("chrom", "bin", "cell"))
    found = windows.gather(staging.staged(cells), table, fused.PARTS, fused.SUMS)
    return _out(stats.pi_result(fused.pi_sums(found), table, POPULATIONS))


def five_statistics(spark, sf_dir):
    """All statistics from one scan and one count of the genotypes."""
    sited, table = _fixed(spark, sf_dir)
    sums = staging.staged(fused.components(sited, POPULATIONS, ("pi", "dxy", "fst", "watterson_theta", "tajima_d"), "hudson"))
    classes = fused.classes(sums)
    results = {
        "avg_pi": stats.pi_result(fused.pi_sums(sums), table, POPULATIONS),
        "avg_dxy": stats.dxy_result(fused.dxy_sums(sums), table, POPULATIONS),
        "avg_hudson_fst": stats.fst_result(fused.fst_sums(sums), "hudson"),
        "avg_watterson_theta": stats.watterson_result(classes, table, POPULATIONS),
        "tajima_d": stats.tajima_result(classes, table, POPULATIONS),
    }
    return _out(rollup.long_format(results))


#: Each sample a population of its own.
EACH = sites.Populations(POPULATIONS.samples, tuple(f"P{i}" for i in range(len(POPULATIONS.samples))), tuple(f"P{i}" for i in range(len(POPULATIONS.samples))))


def dxy_many_populations(spark, sf_dir):
    """All pairs of many populations as matrix products."""
    sited, table = _fixed(spark, sf_dir, EACH, extra_allele=True)
    return _out(stats.dxy_result(pairs.dxy_sums(pairs.pair_sums(sited, EACH)), table, EACH))


def fst_many_populations(spark, sf_dir):
    sited, _ = _fixed(spark, sf_dir, THREE, extra_allele=True)
    return _out(stats.fst_result(pairs.fst_sums(pairs.pair_sums(sited, THREE)), "hudson", True))


def stream_pi(spark, sf_dir):
    """Sums kept as sites arrive: the stream runs until its source is read."""
    kept = staging.new_path(spark)
    stream = arriving_sites(spark, sf_dir).writeStream.foreachBatch(sums.add_batch(kept, POPULATIONS, SIZE))
    stream.option("checkpointLocation", staging.new_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return _out(sums.with_ratio(sums.current(spark, kept)))


QUERIES = {
    f.__name__: f
    for f in (
        pi_fixed_windows, pi_multiallelic, pi_sites_mask, pi_bed_windows, pi_single_sites, dxy_fixed_windows, watterson_theta_windows, tajima_d_windows,
        tajima_d_components, rollup_pi, rollup_tajima_d, rollup_dxy, rollup_watterson_theta, rollup_fst_hudson, rollup_fst_wc, site_classes, allele_counts, fst_eligible_sites, ploidy_by_contig, block_expand,
        pi_block_weighted, mask_pi, mask_dxy, mask_theta, mask_tajima_d, window_table, long_format, pi_nested_windows, five_statistics, dxy_many_populations, fst_many_populations, stream_pi,
    )
} | {
    "fst_hudson_windows": _fst("hudson", False),
    "fst_hudson_components": _fst("hudson", True),
    "fst_hudson_persite": _fst_per_site("hudson"),
    "fst_wc_windows": _fst("wc", False),
    "fst_wc_components": _fst("wc", True),
    "fst_wc_persite": _fst_per_site("wc"),
}


def _calls(extra: bool = False, three: bool = False) -> str:
    a2 = "CAST((o_orderkey * 11 + s * 5 + o_custkey) % 3 = 0 AS INT)" + (" * (1 + CAST((o_orderkey + s) % 4 = 0 AS INT))" if extra else "")
    pop = "CASE s % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END" if three else "CASE s % 2 WHEN 0 THEN 'A' ELSE 'B' END"
    missing = "(o_orderkey * 31 + s * 17) % 13 = 0"
    return f"""calls AS (SELECT 'chr' || (o_orderkey % 3 + 1) AS chrom, o_orderkey // 3 + 1 AS pos, o_orderkey AS row_id, s AS sample, {pop} AS pop, o_custkey % 5 = 0 AS variable,
  CASE WHEN {missing} THEN -1 WHEN o_custkey % 5 <> 0 THEN 0 ELSE CAST((o_orderkey * 7 + s * s * 3 + o_custkey) % 4 = 0 AS INT) END AS a1,
  CASE WHEN {missing} THEN -1 WHEN o_custkey % 5 <> 0 THEN 0 ELSE {a2} END AS a2
  FROM orders, range(0, 10) t(s))"""


_SITE_POP = """haps AS (SELECT chrom, pos, row_id, pop, variable, a1 AS a FROM calls UNION ALL SELECT chrom, pos, row_id, pop, variable, a2 FROM calls),
sp AS (SELECT chrom, pos, row_id, pop, variable, CAST(count(*) FILTER (a = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (a = 1) AS BIGINT) AS n1, CAST(count(*) FILTER (a = 2) AS BIGINT) AS n2,
  CAST(count(*) FILTER (a >= 0) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_haps FROM haps GROUP BY ALL)"""
_WINDOWS = f"""ext AS (SELECT 'chr' || (o_orderkey % 3 + 1) AS chrom, max(o_orderkey // 3 + 1) AS e FROM orders GROUP BY 1),
win AS (SELECT chrom, k * {SIZE} + 1 AS w1, k * {SIZE} + {SIZE} AS w2, k AS window_ord FROM (SELECT chrom, unnest(CASE WHEN e - 1 <= {SIZE} THEN [0::BIGINT] ELSE range(0, ((e + {SIZE - 1}) // {SIZE} * {SIZE} - 2) // {SIZE} + 1) END) AS k FROM ext))"""
_PI_OUT = """SELECT p.pop, w.chrom AS chromosome, w.w1 AS window_pos_1, w.w2 AS window_pos_2, CASE WHEN c > 0 THEN round(d / c, 9) END AS avg_pi,
  CAST(coalesce(s, 0) AS BIGINT) AS no_sites, CAST(d AS BIGINT) AS count_diffs, CAST(c AS BIGINT) AS count_comparisons, CAST(m AS BIGINT) AS count_missing"""
_PI_PARTS = "sum((n * n - n0 * n0 - n1 * n1 - n2 * n2) // 2) AS d, sum(n * (n - 1) // 2) AS c, sum(n_haps * (n_haps - 1) // 2 - n * (n - 1) // 2) AS m, count(*) FILTER (n0 + n1 > 0) AS s"
_POPS = "(VALUES ('A'), ('B')) p(pop)"


def _pi(calls: str, wins: str = _WINDOWS) -> str:
    return f"""WITH {calls}, {_SITE_POP}, {wins},
g AS (SELECT win.chrom, w1, w2, window_ord, pop, {_PI_PARTS} FROM sp JOIN win ON sp.chrom = win.chrom AND pos BETWEEN w1 AND w2 GROUP BY ALL)
{_PI_OUT} FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.w2 = w.w2 AND g.window_ord = w.window_ord AND g.pop = p.pop"""


_LISTED = "row_id % 7 < 2"
_MASKED_CALLS = _calls().replace("calls AS (", "calls0 AS (") + f", calls AS (SELECT * REPLACE (CASE WHEN {_LISTED} THEN a1 ELSE -1 END AS a1, CASE WHEN {_LISTED} THEN a2 ELSE -1 END AS a2) FROM calls0)"
_BED = "win AS (SELECT 'chr' || (n_nationkey % 3 + 1) AS chrom, CAST(n_nationkey * 37 + 1 AS BIGINT) AS w1, CAST(n_nationkey * 37 + 200 + n_nationkey % 5 * 150 AS BIGINT) AS w2, CAST(n_nationkey AS BIGINT) AS window_ord FROM nation)"
_SITE_WIN = f"win AS (SELECT DISTINCT chrom, pos AS w1, pos AS w2, pos AS window_ord FROM calls0 WHERE {_LISTED})"
_AT = f"(pos - 1) // {SIZE} * {SIZE} + 1"
_PAIRS = "sp a JOIN sp b ON a.row_id = b.row_id AND a.pop < b.pop"
_NAN = "'nan'::DOUBLE"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN CASE WHEN isnan(({a})::DOUBLE) OR ({a}) = 0 THEN {_NAN} WHEN ({a}) > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE ({a})::DOUBLE / ({b}) END)"


_ELIGIBLE = "elig AS (SELECT row_id FROM haps WHERE a >= 0 AND variable GROUP BY 1 HAVING count(DISTINCT a) = 2)"
_HUDSON_SITE = f"""site AS (SELECT a.chrom, a.pos, a.pop AS pop1, b.pop AS pop2,
  CASE WHEN a.n * b.n = 0 THEN {_NAN} ELSE 1 - (a.n0 * b.n0 + a.n1 * b.n1 + a.n2 * b.n2)::DOUBLE / (a.n * b.n) END AS btw,
  CASE WHEN a.n < 2 THEN {_NAN} ELSE ((a.n * a.n - a.n0 * a.n0 - a.n1 * a.n1 - a.n2 * a.n2) // 2)::DOUBLE / (a.n * (a.n - 1) // 2) END AS m1,
  CASE WHEN b.n < 2 THEN {_NAN} ELSE ((b.n * b.n - b.n0 * b.n0 - b.n1 * b.n1 - b.n2 * b.n2) // 2)::DOUBLE / (b.n * (b.n - 1) // 2) END AS m2
  FROM {_PAIRS} WHERE a.row_id IN (SELECT row_id FROM elig)),
comp AS (SELECT *, btw - (m1 + m2) / 2 AS rx, btw AS ry, 0.0 AS rz, CASE WHEN isnan(btw - (m1 + m2) / 2) THEN 0 ELSE btw - (m1 + m2) / 2 END AS x, CASE WHEN isnan(btw) THEN 0 ELSE btw END AS y, 0.0 AS z FROM site)"""
_WC_SITE = f"""het AS (SELECT row_id, pop, u, CAST(count(*) FILTER (a1 >= 0 AND a2 >= 0 AND a1 <> a2 AND (a1 = u OR a2 = u)) AS BIGINT) AS h FROM calls, range(0, 3) r(u) GROUP BY ALL),
al AS (SELECT sp.*, u, h, CASE u WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS k FROM sp JOIN het USING (row_id, pop)),
q AS (SELECT a.chrom, a.pos, a.pop AS pop1, b.pop AS pop2, a.u, (a.n // 2)::DOUBLE AS i1, (b.n // 2)::DOUBLE AS i2, {_div('a.k', 'a.n')} AS p1, {_div('b.k', 'b.n')} AS p2, {_div('a.k + b.k', 'a.n + b.n')} AS p, (a.h + b.h)::DOUBLE AS hh
  FROM al a JOIN al b ON a.row_id = b.row_id AND a.u = b.u AND a.pop < b.pop WHERE a.row_id IN (SELECT row_id FROM elig)),
q2 AS (SELECT *, (i1 + i2) / 2 AS nb, (i1 + i2) - {_div('i1 * i1 + i2 * i2', 'i1 + i2')} AS nc, {_div('hh', 'i1 + i2')} AS h FROM q),
q3 AS (SELECT *, {_div('i1 * (p1 - p) * (p1 - p) + i2 * (p2 - p) * (p2 - p)', 'nb')} AS s2 FROM q2),
q4 AS (SELECT *, p * (1 - p) - s2 / 2 AS core FROM q3),
w3 AS (SELECT chrom, pos, pop1, pop2, {_div('nb', 'nc')} * (s2 - {_div('1.0', 'nb - 1')} * (core - h / 4)) AS a, {_div('nb', 'nb - 1')} * (core - {_div('(2 * nb - 1) * h', '4 * nb')}) AS b, h / 2 AS c FROM q4),
comp AS (SELECT chrom, pos, pop1, pop2, sum(a) AS rx, sum(b) AS ry, sum(c) AS rz, sum(CASE WHEN isnan(a) THEN 0 ELSE a END) AS x, sum(CASE WHEN isnan(b) THEN 0 ELSE b END) AS y, sum(CASE WHEN isnan(c) THEN 0 ELSE c END) AS z FROM w3 GROUP BY ALL)"""


def _fst_sql(kind: str, components: bool, per_site: bool = False) -> str:
    names = [] if not components else [("x", "hudson_fst_num"), ("y", "hudson_fst_den")] if kind == "hudson" else [("x", "wc_fst_a"), ("y", "wc_fst_b"), ("z", "wc_fst_c")]
    more = "".join(f", round({v}, 9) AS {n}" for v, n in names)
    head = f"WITH {_calls(True, True)}, {_SITE_POP}, {_ELIGIBLE}, {_HUDSON_SITE if kind == 'hudson' else _WC_SITE}"
    if per_site:
        value = _div("rx", "ry" if kind == "hudson" else "rx + ry + rz")
        return f"{head} SELECT pop1, pop2, chrom AS chromosome, pos AS window_pos_1, pos AS window_pos_2, CASE WHEN NOT isnan({value}) THEN round({value}, 9) END AS avg_{kind}_fst, CAST(1 AS BIGINT) AS no_snps{more} FROM comp"
    whole = "x + y" if kind == "hudson" else "x + y + z"
    return f"""{head}, g AS (SELECT pop1, pop2, chrom, {_AT} AS w1, count(*) AS no_snps, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM comp GROUP BY ALL)
SELECT pop1, pop2, chrom AS chromosome, w1 AS window_pos_1, w1 + {SIZE - 1} AS window_pos_2, CASE WHEN {whole} > 0 THEN round({_div('x', 'y' if kind == 'hudson' else whole)}, 9) END AS avg_{kind}_fst, CAST(no_snps AS BIGINT) AS no_snps{more} FROM g"""


_HARMONIC = """hn AS (SELECT n, coalesce(list_sum([1.0::DOUBLE / k FOR k IN range(1, n)]), 0) AS a1, coalesce(list_sum([1.0::DOUBLE / (k * k) FOR k IN range(1, n)]), 0) AS a2 FROM range(0, 41) t(n)),
tj AS (SELECT n, a1, CASE WHEN n < 2 THEN 0 ELSE ((n + 1)::DOUBLE / (3 * (n - 1)) - 1 / a1) / a1 END AS e1,
  CASE WHEN n < 2 THEN 0 ELSE (2.0::DOUBLE * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) END AS e2 FROM hn)"""
_CLASSES = f"cl AS (SELECT chrom, {_AT} AS w1, pop, n, count(*) AS sites, count(*) FILTER (n - n0 > 0) AS s, sum((n * n - n0 * n0 - n1 * n1 - n2 * n2) // 2) AS d, 1 AS real FROM sp GROUP BY ALL)"
_THETA = "sum(CASE WHEN s = 0 THEN 0 WHEN n < 2 THEN 'inf'::DOUBLE ELSE s / a1 END)"


def _theta_sql(mask: bool = False, calls: str = "") -> str:
    more = "" if not mask else f" UNION ALL SELECT chrom, w1, pop, n, sites, 0, 0, 0 FROM mcl WHERE n > 0 AND sites > 0"
    extra = f", {_MASK_ROWS}, mcl AS (SELECT chrom, w1, pop, k AS n, sum(n_inv) AS sites FROM inv GROUP BY ALL)" if mask else ""
    only = " WHERE variable" if mask else ""
    return f"""WITH {calls or f'{_calls()}, {_SITE_POP}'}, {_WINDOWS}, {_HARMONIC}, {_CLASSES.replace('FROM sp', 'FROM sp' + only)}{extra}, allc AS (SELECT * FROM cl{more}),
g AS (SELECT chrom, w1, pop, {_THETA} AS raw, max(real) AS real, sum(sites) FILTER (n > 0) AS ns, sum(s) AS nv, sum(n * sites) AS called, max(n) AS most FROM allc JOIN tj USING (n) GROUP BY ALL)
SELECT p.pop, w.chrom AS chromosome, w.w1 AS window_pos_1, w.w2 AS window_pos_2, CASE WHEN ns > 0 AND real = 1 THEN round(raw / ns, 9) END AS avg_watterson_theta, CAST(coalesce(ns, 0) AS BIGINT) AS no_sites,
  CASE WHEN real = 1 THEN round(raw, 9) END AS raw_watterson_theta, CAST(CASE WHEN real = 1 THEN nv END AS BIGINT) AS no_var_sites, CASE WHEN most > 0 THEN round(called / most, 9) WHEN real = 1 THEN 0.0 END AS weighted_no_sites
FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop = p.pop"""


_TAJIMA_G = f"""g AS (SELECT chrom, w1, pop, sum(CASE WHEN n >= 2 THEN d / (n * (n - 1) / 2) ELSE 0 END) AS raw_pi, {_THETA} AS raw, sum(CASE WHEN n >= 2 AND s > 0 THEN sqrt(e1 * s + e2 * s * (s - 1)) ELSE 0 END) AS sd,
  sum(sites) FILTER (n > 0) AS ns, string_agg(n || ':' || s, ',' ORDER BY n) FILTER (s > 0) AS counts FROM cl JOIN tj USING (n) GROUP BY ALL)"""


def _tajima_sql(components: bool = False, mask: bool = False) -> str:
    counts = ", counts AS tajima_d_s_counts" if components else ""
    only = " WHERE variable" if mask else ""
    extra = f", {_MASK_ROWS}, mk AS (SELECT chrom, w1, pop, sum(n_inv) AS more FROM inv WHERE k > 0 GROUP BY ALL)" if mask else ""
    join = " LEFT JOIN mk ON mk.chrom = w.chrom AND mk.w1 = w.w1 AND mk.pop = p.pop" if mask else ""
    return f"""WITH {_calls()}, {_SITE_POP}, {_WINDOWS}, {_HARMONIC}, {_CLASSES.replace('FROM sp', 'FROM sp' + only)}, {_TAJIMA_G}{extra}
SELECT p.pop, w.chrom AS chromosome, w.w1 AS window_pos_1, w.w2 AS window_pos_2, CASE WHEN sd > 0 THEN round((raw_pi - raw) / sd, 9) END AS tajima_d, CAST(coalesce(ns, 0){' + coalesce(more, 0)' if mask else ''} AS BIGINT) AS no_sites,
  round(raw_pi, 9) AS raw_pi, round(raw, 9) AS raw_watterson_theta, round(sd, 9) AS tajima_d_stdev{counts}
FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop = p.pop{join}"""


_MASK_ROWS = """mask AS (SELECT 'chr' || (p_partkey % 3 + 1) AS chrom, p_partkey // 3 * 13 + 1 AS lo, p_partkey // 3 * 13 + 9 AS hi, p_partkey % 6 AS ka, p_partkey * 7 % 6 AS kb FROM part),
clip AS (SELECT w.chrom, w.w1, greatest(lo, w.w1) AS lo, least(hi, w.w2) AS hi, ka, kb FROM mask JOIN win w ON mask.chrom = w.chrom AND lo <= w.w2 AND hi >= w.w1),
vs AS (SELECT DISTINCT chrom, pos FROM calls WHERE variable),
nv AS (SELECT c.chrom, c.w1, c.lo, c.hi, ka, kb, c.hi - c.lo + 1 - count(vs.pos) AS n_inv FROM clip c LEFT JOIN vs ON vs.chrom = c.chrom AND vs.pos BETWEEN c.lo AND c.hi GROUP BY c.chrom, c.w1, c.lo, c.hi, ka, kb),
inv AS (SELECT chrom, w1, 'A' AS pop, 2 * ka AS k, n_inv FROM nv WHERE n_inv > 0 UNION ALL SELECT chrom, w1, 'B', 2 * kb, n_inv FROM nv WHERE n_inv > 0)"""

_DXY_PARTS = "sum(a.n * b.n - a.n0 * b.n0 - a.n1 * b.n1 - a.n2 * b.n2) AS d, sum(a.n * b.n) AS c, sum(a.n_haps * b.n_haps - a.n * b.n) AS m, count(*) FILTER (a.n0 + a.n1 > 0 AND b.n0 + b.n1 > 0) AS s"
_DXY_OUT = """w.chrom AS chromosome, w.w1 AS window_pos_1, w.w2 AS window_pos_2, CASE WHEN c > 0 THEN round(d / c, 9) END AS avg_dxy, CAST(coalesce(s, 0) AS BIGINT) AS no_sites, CAST(d AS BIGINT) AS count_diffs, CAST(c AS BIGINT) AS count_comparisons, CAST(m AS BIGINT) AS count_missing"""

_EVERY_BLOCK = _calls().replace("calls AS (", "calls0 AS (") + """, recs AS (SELECT * REPLACE (row_id // 3 * 4 + 1 AS pos) FROM calls0),
ends AS (SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 4 ELSE 0 END AS more FROM orders),
calls AS (SELECT chrom, pos + unnest(range(0, more + 1)) AS pos, row_id, sample, pop, variable, a1, a2 FROM recs JOIN ends USING (row_id))"""
_BLOCK_WINDOWS = _WINDOWS.replace("SELECT 'chr' || (o_orderkey % 3 + 1) AS chrom, max(o_orderkey // 3 + 1) AS e FROM orders GROUP BY 1", "SELECT chrom, max(pos) AS e FROM recs GROUP BY 1")

ORACLE = {
    "pi_fixed_windows": _pi(_calls()),
    "pi_multiallelic": _pi(_calls(True)),
    "pi_sites_mask": _pi(_MASKED_CALLS),
    "pi_bed_windows": _pi(_calls(), _BED),
    "pi_single_sites": _pi(_MASKED_CALLS, _SITE_WIN),
    "dxy_fixed_windows": f"""WITH {_calls(three=True)}, {_SITE_POP}, {_WINDOWS}, g AS (SELECT a.chrom, (a.pos - 1) // {SIZE} * {SIZE} + 1 AS w1, a.pop AS pop1, b.pop AS pop2, {_DXY_PARTS} FROM {_PAIRS} GROUP BY ALL)
SELECT p.pop1, p.pop2, {_DXY_OUT} FROM win w CROSS JOIN (VALUES ('A', 'B'), ('A', 'C'), ('B', 'C')) p(pop1, pop2) LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop1 = p.pop1 AND g.pop2 = p.pop2""",
    "watterson_theta_windows": _theta_sql(),
    "tajima_d_windows": _tajima_sql(),
    "tajima_d_components": _tajima_sql(True),
    "fst_hudson_windows": _fst_sql("hudson", False),
    "fst_hudson_components": _fst_sql("hudson", True),
    "fst_hudson_persite": _fst_sql("hudson", True, True),
    "fst_wc_windows": _fst_sql("wc", False),
    "fst_wc_components": _fst_sql("wc", True),
    "fst_wc_persite": _fst_sql("wc", True, True),
    "rollup_pi": f"""WITH {_calls()}, {_SITE_POP}, g AS (SELECT chrom, pop, (pos - 1) // {3 * SIZE} * {3 * SIZE} + 1 AS w1, {_PI_PARTS} FROM sp GROUP BY ALL)
SELECT pop, chrom AS chromosome, w1 AS window_pos_1, w1 + {3 * SIZE - 1} AS window_pos_2, CASE WHEN c > 0 THEN round(d / c, 9) END AS avg_pi, CAST(s AS BIGINT) AS no_sites, CAST(d AS BIGINT) AS count_diffs, CAST(c AS BIGINT) AS count_comparisons, CAST(m AS BIGINT) AS count_missing FROM g""",
    "rollup_tajima_d": f"""WITH {_calls()}, {_SITE_POP}, {_HARMONIC}, {_CLASSES.replace(_AT, f'(pos - 1) // {3 * SIZE} * {3 * SIZE} + 1')}, {_TAJIMA_G}
SELECT pop, chrom AS chromosome, w1 AS window_pos_1, w1 + {3 * SIZE - 1} AS window_pos_2, CASE WHEN sd > 0 THEN round((raw_pi - raw) / sd, 9) END AS tajima_d, CAST(ns AS BIGINT) AS no_sites, round(raw_pi, 9) AS raw_pi, round(raw, 9) AS raw_watterson_theta, round(sd, 9) AS tajima_d_stdev, counts AS tajima_d_s_counts FROM g""",
    "rollup_fst_wc": _fst_sql("wc", True).replace(_AT, f"(pos - 1) // {3 * SIZE} * {3 * SIZE} + 1").replace(f"w1 + {SIZE - 1}", f"w1 + {3 * SIZE - 1}"),
    "rollup_fst_hudson": _fst_sql("hudson", True).replace(_AT, f"(pos - 1) // {3 * SIZE} * {3 * SIZE} + 1").replace(f"w1 + {SIZE - 1}", f"w1 + {3 * SIZE - 1}"),
    "rollup_dxy": f"""WITH {_calls()}, {_SITE_POP}, w AS (SELECT a.chrom, (a.pos - 1) // {3 * SIZE} * {3 * SIZE} + 1 AS w1, {_DXY_PARTS} FROM {_PAIRS} GROUP BY ALL)
SELECT 'A' AS pop1, 'B' AS pop2, {_DXY_OUT.replace('w.w2', f'w.w1 + {3 * SIZE - 1}')} FROM w""",
    "rollup_watterson_theta": f"""WITH small AS ({_theta_sql().replace('round(raw, 9)', 'raw').replace('round(called / most, 9)', 'called / most')})
SELECT pop, chromosome, (window_pos_1 - 1) // {3 * SIZE} * {3 * SIZE} + 1 AS window_pos_1, (window_pos_1 - 1) // {3 * SIZE} * {3 * SIZE} + {3 * SIZE} AS window_pos_2, CASE WHEN sum(no_sites) > 0 THEN round(sum(raw_watterson_theta) / sum(no_sites), 9) END AS avg_watterson_theta,
  CAST(sum(no_sites) AS BIGINT) AS no_sites, round(sum(raw_watterson_theta), 9) AS raw_watterson_theta, CAST(sum(no_var_sites) AS BIGINT) AS no_var_sites, round(sum(weighted_no_sites), 9) AS weighted_no_sites FROM small GROUP BY ALL""",
    "site_classes": "SELECT 'chr' || (o_orderkey % 3 + 1) AS chrom, CASE WHEN o_custkey % 5 = 0 THEN 'multiallelic' ELSE 'invariant' END AS site_class, count(*) AS n FROM orders GROUP BY ALL",
    "allele_counts": f"WITH {_calls(True, True)}, {_SITE_POP} SELECT chrom, pos, pop, n0, n1, n2, n, n0 + n1 AS n01, n_haps FROM sp",
    "fst_eligible_sites": f"WITH {_calls(True)}, {_SITE_POP}, {_ELIGIBLE} SELECT DISTINCT chrom, pos FROM calls WHERE row_id IN (SELECT row_id FROM elig)",
    "ploidy_by_contig": """WITH g AS (SELECT 'chr' || (o_orderkey % 3 + 1) AS chrom, o_orderkey AS row_id, unnest([0, 1]) AS i,
  unnest([CASE WHEN o_orderkey % 3 = 2 THEN '1' WHEN o_custkey % 4 = 0 THEN './.' ELSE './1' END, CASE WHEN o_orderkey % 3 = 2 THEN '0' WHEN o_orderkey % 3 = 1 THEN '0/0/1' ELSE '0|1' END]) AS t FROM orders),
s AS (SELECT chrom, row_id, i, string_split(replace(t, '|', '/'), '/') AS f FROM g),
p AS (SELECT chrom, row_id * 2 + i AS o, CASE WHEN len(f) = 1 OR len(list_filter(f, lambda x: x <> '.')) = 1 THEN 1 ELSE len(f) END AS p FROM s)
SELECT chrom, CAST(coalesce(arg_min(p, o) FILTER (p > 1), 1) AS BIGINT) AS ploidy FROM p GROUP BY 1""",
    "block_expand": f"""WITH {_EVERY_BLOCK} SELECT chrom, CAST(pos AS BIGINT) AS pos, row_id, CAST(max(CASE WHEN variable THEN 1 ELSE 0 END) AS BIGINT) AS n_alts FROM calls GROUP BY ALL""",
    "pi_block_weighted": _pi(_EVERY_BLOCK, _BLOCK_WINDOWS),
    "mask_pi": f"""WITH {_calls()}, {_SITE_POP}, {_WINDOWS}, {_MASK_ROWS},
parts AS (SELECT chrom, {_AT} AS w1, pop, {_PI_PARTS} FROM sp WHERE variable GROUP BY ALL UNION ALL SELECT chrom, w1, pop, 0, sum(n_inv * (k * (k - 1) // 2)), sum(n_inv * (45 - k * (k - 1) // 2)), coalesce(sum(n_inv) FILTER (k > 0), 0) FROM inv GROUP BY ALL),
g AS (SELECT chrom, w1, pop, sum(d) AS d, sum(c) AS c, sum(m) AS m, sum(s) AS s FROM parts GROUP BY ALL)
{_PI_OUT} FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop = p.pop""",
    "mask_dxy": f"""WITH {_calls()}, {_SITE_POP}, {_WINDOWS}, {_MASK_ROWS},
parts AS (SELECT a.chrom, (a.pos - 1) // {SIZE} * {SIZE} + 1 AS w1, {_DXY_PARTS} FROM {_PAIRS} WHERE a.variable GROUP BY ALL UNION ALL SELECT chrom, w1, 0, sum(n_inv * 4 * ka * kb), sum(n_inv * (100 - 4 * ka * kb)), coalesce(sum(n_inv) FILTER (ka > 0 AND kb > 0), 0) FROM nv WHERE n_inv > 0 GROUP BY ALL),
g AS (SELECT chrom, w1, sum(d) AS d, sum(c) AS c, sum(m) AS m, sum(s) AS s FROM parts GROUP BY ALL)
SELECT 'A' AS pop1, 'B' AS pop2, {_DXY_OUT} FROM win w LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1""",
    "mask_theta": _theta_sql(True),
    "mask_tajima_d": _tajima_sql(mask=True),
    "window_table": f"WITH {_WINDOWS} SELECT * FROM win",
    "long_format": f"""WITH {_calls()}, {_SITE_POP}, {_WINDOWS}, g AS (SELECT chrom, {_AT} AS w1, pop, {_PI_PARTS} FROM sp GROUP BY ALL), h AS (SELECT a.chrom, (a.pos - 1) // {SIZE} * {SIZE} + 1 AS w1, {_DXY_PARTS} FROM {_PAIRS} GROUP BY ALL)
SELECT p.pop AS pop1, CAST(NULL AS VARCHAR) AS pop2, w.chrom AS chromosome, w.w1 AS window_pos_1, w.w2 AS window_pos_2, 'avg_pi' AS statistic, CASE WHEN c > 0 THEN round(d / c, 9) END AS value FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop = p.pop
UNION ALL SELECT 'A', 'B', w.chrom, w.w1, w.w2, 'avg_dxy', CASE WHEN c > 0 THEN round(d / c, 9) END FROM win w LEFT JOIN h ON h.chrom = w.chrom AND h.w1 = w.w1""",
    "pi_nested_windows": _pi(_calls(), """win AS (SELECT n.chrom, k * 7 + 1 AS w1, e - k * 5 AS w2, k AS window_ord FROM (SELECT 'chr' || (n_nationkey % 3 + 1) AS chrom, CAST(n_nationkey AS BIGINT) AS k FROM nation) n
  JOIN (SELECT 'chr' || (o_orderkey % 3 + 1) AS chrom, max(o_orderkey // 3 + 1) AS e FROM orders GROUP BY 1) ext ON ext.chrom = n.chrom)"""),
}


def _long(value: str, sql: str, pops: str = "pop AS pop1, CAST(NULL AS VARCHAR) AS pop2") -> str:
    return f"SELECT {pops}, chromosome, window_pos_1, window_pos_2, '{value}' AS statistic, {value} AS value FROM ({sql})"


ORACLE["five_statistics"] = " UNION ALL ".join((
    _long("avg_pi", ORACLE["pi_fixed_windows"]),
    _long("avg_dxy", f"""WITH {_calls()}, {_SITE_POP}, {_WINDOWS}, h AS (SELECT a.chrom, {_AT.replace("pos", "a.pos")} AS w1, {_DXY_PARTS} FROM {_PAIRS} GROUP BY ALL)
SELECT 'A' AS pop1, 'B' AS pop2, {_DXY_OUT} FROM win w LEFT JOIN h ON h.chrom = w.chrom AND h.w1 = w.w1""", "pop1, pop2"),
    _long("avg_hudson_fst", _fst_sql("hudson", False).replace(_calls(True, True), _calls()), "pop1, pop2"),
    _long("avg_watterson_theta", ORACLE["watterson_theta_windows"]),
    _long("tajima_d", ORACLE["tajima_d_windows"]),
))
_EACH_CALLS = _calls(True).replace("CASE s % 2 WHEN 0 THEN 'A' ELSE 'B' END", "'P' || s")
ORACLE |= {
    "dxy_many_populations": f"""WITH {_EACH_CALLS}, {_SITE_POP}, {_WINDOWS}, g AS (SELECT a.chrom, {_AT.replace("pos", "a.pos")} AS w1, a.pop AS pop1, b.pop AS pop2, {_DXY_PARTS} FROM {_PAIRS} GROUP BY ALL)
SELECT p.pop1, p.pop2, {_DXY_OUT} FROM win w CROSS JOIN (SELECT 'P' || x AS pop1, 'P' || y AS pop2 FROM range(0, 10) t(x), range(0, 10) u(y) WHERE x < y) p LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop1 = p.pop1 AND g.pop2 = p.pop2""",
    "fst_many_populations": ORACLE["fst_hudson_components"],
    "stream_pi": f"""WITH {_calls()}, {_SITE_POP} SELECT chrom, {_AT} AS w1, pop, CAST(sum((n * n - n0 * n0 - n1 * n1) // 2) AS BIGINT) AS count_diffs, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS count_comparisons,
  CAST(sum(n_haps * (n_haps - 1) // 2 - n * (n - 1) // 2) AS BIGINT) AS count_missing, count(*) FILTER (n0 + n1 > 0) AS no_sites, round(sum((n * n - n0 * n0 - n1 * n1) // 2) / sum(n * (n - 1) // 2), 9) AS avg_pi FROM sp GROUP BY ALL""",
}
