"""Known answers, invariants and quirks of the diversity statistics on literal genotypes."""

import math

import pytest
from pyspark.sql import functions as F

from allelia.functions import kernels as K
from allelia.operators import callable_mask, rollup, sites, stats, windows
from allelia.operators.sites import Populations

SCHEMA = "chrom string, pos int, row_id long, alts array<string>, is_snp boolean, info_end int, gt array<array<int>>"


def site_rows(spark, genotypes, chrom="1", first=1):
    rows = [(chrom, first + k, k, ["C"] if any(a > 0 for g in gt for a in g) else [], True, None, gt) for k, gt in enumerate(genotypes)]
    return spark.createDataFrame(rows, SCHEMA)


def pops(*sizes):
    names = [chr(65 + i) for i, n in enumerate(sizes) for _ in range(n)]
    return Populations(tuple(f"s{i}" for i in range(len(names))), tuple(names), tuple(chr(65 + i) for i in range(len(sizes))))


def one_window(spark, rows, p, het=False, size=100):
    spans = windows.extents(rows, 1, size)
    return windows.assign_fixed(sites.with_populations(rows, p, het), spans, size), windows.fixed_windows(spans, size)


def brute(genotypes, idx):
    diffs = comps = 0
    n_haps = sum(len(genotypes[0][i]) for i in idx)
    for gt in genotypes:
        called = [a for i in idx for a in gt[i] if a >= 0]
        for i in range(len(called)):
            for j in range(i):
                comps += 1
                diffs += called[i] != called[j]
    return diffs, comps, len(genotypes) * n_haps * (n_haps - 1) // 2 - comps


GENOTYPES = {
    "diploid": [[[0, 0], [0, 1], [1, 1], [0, 1]], [[0, -1], [-1, -1], [1, 1], [0, 2]], [[0, 0], [0, 0], [0, 0], [0, 0]], [[-1, -1], [-1, -1], [0, 1], [2, 2]]],
    "haploid": [[[0], [1], [1], [-1]], [[2], [0], [0], [1]], [[0], [0], [0], [0]]],
    "tetraploid": [[[0, 0, 1, 1], [0, 1, 1, -1], [2, 0, 0, 0], [1, 1, 1, 1]]],
}


@pytest.mark.parametrize("kind", GENOTYPES)
def test_pi_and_dxy_against_pair_loops(spark, kind):
    gts, p = GENOTYPES[kind], pops(2, 2)
    sited, table = one_window(spark, site_rows(spark, gts), p)
    for row, idx in zip(stats.pi(sited, table, p).orderBy("pop").collect(), ([0, 1], [2, 3])):
        assert (row.count_diffs, row.count_comparisons, row.count_missing) == brute(gts, idx)
        assert row.avg_pi == (row.count_diffs / row.count_comparisons if row.count_comparisons else None)
    row = stats.dxy(sited, table, p).first()
    a = [[x for i in (0, 1) for x in gt[i] if x >= 0] for gt in gts]
    b = [[x for i in (2, 3) for x in gt[i] if x >= 0] for gt in gts]
    assert row.count_comparisons == sum(len(x) * len(y) for x, y in zip(a, b))
    assert row.count_diffs == sum(u != v for x, y in zip(a, b) for u in x for v in y)


def test_allele_gap(spark):
    gt = [[0, 0]] * 39 + [[0, 2]]
    sited, table = one_window(spark, site_rows(spark, [gt]), pops(40))
    row = stats.pi(sited, table, pops(40)).first()
    assert (row.count_diffs, row.count_comparisons) == (79, 80 * 79 // 2)


def test_theta_and_tajima_with_one_called_haplotype(spark):
    gts = [[[1], [-1], [-1], [-1]], [[0], [0], [0], [1]]]
    p = pops(4)
    sited, table = one_window(spark, site_rows(spark, gts), p)
    theta = stats.watterson_theta(sited, table, p, ploidy=1).first()
    assert theta.raw_watterson_theta == math.inf and theta.avg_watterson_theta == math.inf
    assert theta.no_var_sites == 2 and theta.weighted_no_sites == 1.25
    d = stats.tajima_d(sited, table, p, ploidy=1).first()
    assert d.tajima_d == -math.inf
    only = stats.tajima_d(*one_window(spark, site_rows(spark, gts[:1]), p), p, ploidy=1).first()
    assert only.tajima_d is None and only.tajima_d_stdev == 0


def test_empty_window_and_fully_missing_window(spark):
    p = pops(2)
    rows = site_rows(spark, [[[-1, -1], [-1, -1]]], first=5)
    spans = windows.extents(rows, 1, 30)
    sited, table = windows.assign_fixed(sites.with_populations(rows, p), spans, 10), windows.fixed_windows(spans, 10)
    first, second, third = stats.pi(sited, table, p).orderBy("window_pos_1").collect()
    assert (first.count_diffs, first.count_comparisons, first.count_missing, first.avg_pi, first.no_sites) == (0, 0, 6, None, 0)
    assert second.count_diffs is None and second.no_sites == 0 and third.count_missing is None
    theta = stats.watterson_theta(sited, table, p).orderBy("window_pos_1").collect()
    assert theta[0].weighted_no_sites == 0 and theta[0].avg_watterson_theta is None and theta[1].raw_watterson_theta is None


def test_harmonic_constants():
    a1, a2, e1, e2 = K.harmonic_constants(10)
    assert a1 == pytest.approx(sum(1 / k for k in range(1, 10))) and a2 == pytest.approx(sum(1 / k**2 for k in range(1, 10)))
    assert e1 > 0 and e2 > 0 and K.harmonic_constants(1) == (0, 0, 0, 0)


def test_wc_and_hudson_agree_on_fixed_difference(spark):
    gts = [[[0, 0], [0, 0], [1, 1], [1, 1]]]
    p = pops(2, 2)
    sited, _ = one_window(spark, site_rows(spark, gts), p, het=True)
    for kind in ("wc", "hudson"):
        row = stats.fst(sited, p, kind, True).first()
        assert row[f"avg_{kind}_fst"] == pytest.approx(1.0) and row.no_snps == 1


def test_fst_without_eligible_site_has_no_row(spark):
    p = pops(2, 2)
    sited, _ = one_window(spark, site_rows(spark, [[[0, 0]] * 4, [[0, 0], [1, 1], [2, 2], [0, 0]]]), p, het=True)
    assert stats.fst(sited, p, "wc").count() == 0


@pytest.mark.parametrize(("start", "end", "size", "want"), [(1, 10001, 10000, [(1, 10000)]), (10, 20, 5, [(10, 14), (15, 19)]), (1, 25, 10, [(1, 10), (11, 20), (21, 30)]), (5, 5, 1, [(5, 5)]), (1, 3, 1, [(1, 1), (2, 2)])])
def test_window_table_rules(spark, start, end, size, want):
    spans = spark.createDataFrame([("1", start, end)], "chrom string, start long, end long")
    assert [(r.w1, r.w2) for r in windows.fixed_windows(spans, size).orderBy("w1").collect()] == want


def test_cover_end(spark):
    spans = spark.createDataFrame([("1", 10, 20)], "chrom string, start long, end long")
    assert [r.w1 for r in windows.fixed_windows(spans, 5, cover_end=True).orderBy("w1").collect()] == [10, 15, 20]


def test_interval_join_keeps_overlapping_and_repeated_windows(spark):
    rows = site_rows(spark, [[[0, 1]]] * 50)
    table = spark.createDataFrame([("1", 1, 10, 0), ("1", 5, 40, 1), ("1", 1, 10, 2), ("2", 1, 10, 3)], "chrom string, w1 long, w2 long, window_ord long")
    got = {r.window_ord: r["count"] for r in windows.assign_intervals(rows, table, width=7).groupBy("window_ord").count().collect()}
    assert got == {0: 10, 1: 36, 2: 10}


def test_blocks_by_weight_equal_expanded_blocks(spark):
    p = pops(2)
    raw = spark.createDataFrame([("1", 3, 0, ["<NON_REF>"], False, 17, [[0, 0], [0, -1]]), ("1", 18, 1, ["C"], True, None, [[0, 1], [1, 1]]), ("1", 19, 2, ["<NON_REF>"], False, 32, [[0, 0], [-1, -1]])], SCHEMA)
    spans = windows.extents(raw, 1, 40)
    table = windows.fixed_windows(spans, 10)
    results = []
    for rows in (sites.expanded(raw), sites.blocks_as_sites(raw)):
        sited = windows.assign_fixed(sites.with_populations(sites.retained(rows), p), spans, 10)
        results.append([stats.pi(sited, table, p).orderBy("window_pos_1").collect(), stats.watterson_theta(sited, table, p).orderBy("window_pos_1").collect(), stats.tajima_d(sited, table, p).orderBy("window_pos_1").collect()])
    assert results[0] == results[1]
    assert sites.expanded(raw, 5, 20).agg(F.min("pos"), F.max("pos"), F.count("*")).first()[0:3] == (5, 20, 16)


def test_rollup_equals_larger_windows(spark):
    p = pops(2, 2)
    rows = site_rows(spark, GENOTYPES["diploid"] * 15)
    small, small_table = one_window(spark, rows, p, size=10)
    spans = windows.extents(rows, 1, 60)
    small, small_table = windows.assign_fixed(sites.with_populations(rows, p, True), spans, 10), windows.fixed_windows(spans, 10)
    large, large_table = windows.assign_fixed(sites.with_populations(rows, p, True), spans, 30), windows.fixed_windows(spans, 30)
    up = rollup.rollup(stats.pi(small, small_table, p), "pi", 30).orderBy("pop", "window_pos_1").collect()
    direct = stats.pi(large, large_table, p).orderBy("pop", "window_pos_1").collect()
    assert [(r.avg_pi, r.no_sites, r.count_diffs, r.count_missing) for r in up] == [(r.avg_pi, r.no_sites, r.count_diffs, r.count_missing) for r in direct]
    up = rollup.rollup(stats.tajima_d(small, small_table, p, components=True), "tajima_d", 30, most=8).orderBy("pop", "window_pos_1").collect()
    direct = stats.tajima_d(large, large_table, p, components=True).orderBy("pop", "window_pos_1").collect()
    assert [r.tajima_d_s_counts for r in up] == [r.tajima_d_s_counts for r in direct]
    assert [r.tajima_d for r in up] == pytest.approx([r.tajima_d for r in direct])
    up = rollup.rollup(stats.fst(small, p, "wc", True), "wc_fst", 30).orderBy("window_pos_1").collect()
    assert [r.avg_wc_fst for r in up] == pytest.approx([r.avg_wc_fst for r in stats.fst(large, p, "wc").orderBy("window_pos_1").collect()])


def test_rolled_up_results_are_ordered(spark):
    rows = [("B", "A", 11), ("A", "A", 11), ("B", "A", 1), ("A", "Z", 1), ("A", "A", 1)]
    df = spark.createDataFrame(rows, "pop string, chromosome string, window_pos_1 long")
    contigs = spark.createDataFrame([("Z", 0), ("A", 5)], "chrom string, chrom_rank long")
    assert [tuple(r) for r in rollup.ordered(df, contigs).collect()] == [("A", "Z", 1), ("A", "A", 1), ("B", "A", 1), ("A", "A", 11), ("B", "A", 11)]


def test_equal_mask_ranges_count_as_often_as_they_are_there(spark):
    table = spark.createDataFrame([("c", 1, 10, 0)], "chrom string, w1 long, w2 long, window_ord long")
    mask = spark.createDataFrame([("c", 0, 10, [1, 2])] * 2 + [("c", 0, 4, [1, 2])], "chrom string, start0 long, end0 long, k array<long>")
    variants = spark.createDataFrame([("c", 3), ("c", 9)], "chrom string, pos int")
    assert sorted(r.n_inv for r in callable_mask.invariant_ranges(table, mask, variants).collect()) == [3, 16]


def test_sites_mask_keeps_rows_as_missing(spark):
    rows = site_rows(spark, [[[0, 1], [1, 1]]] * 4)
    listed = spark.createDataFrame([("1", 2), ("1", 2)], "chrom string, pos int")
    got = sites.masked(rows, listed).orderBy("pos").select("gt").collect()
    assert [r.gt for r in got] == [[[-1, -1], [-1, -1]], [[0, 1], [1, 1]], [[-1, -1], [-1, -1]], [[-1, -1], [-1, -1]]]


def test_mask_mini_fixture(spark):
    p = Populations(("S1", "S2", "S3", "S4"), ("A", "A", "B", "B"), ("A", "B"))
    raw = [("chr1", 100, 0, ["C"], True, None, [[0, 0], [0, 1], [1, 1], [0, 0]]), ("chr1", 250, 1, ["C"], True, None, [[0, 1], [0, 0], [0, 1], [1, 1]])]
    rows = spark.createDataFrame(raw, SCHEMA)
    spans = spark.createDataFrame([("chr1", 1, 1000), ("chr2", 1, 1000)], "chrom string, start long, end long")
    table = windows.fixed_windows(spans, 500)
    mask = spark.createDataFrame([("chr1", 0, 1000, [2, 2]), ("chr2", 0, 1000, [2, 2])], "chrom string, start0 long, end0 long, k array<long>")
    sited = windows.assign_fixed(sites.with_populations(rows, p), spans, 500)
    ranges = callable_mask.invariant_ranges(table, mask, rows, width=64)
    pi = {(r.pop, r.chromosome, r.window_pos_1): r for r in stats.pi(sited, table, p, callable_mask.pi_mask(ranges, p)).collect()}
    a, b, c = pi["A", "chr1", 1], pi["B", "chr1", 1], pi["A", "chr2", 1]
    assert (a.count_diffs, a.count_comparisons, b.count_diffs, b.count_comparisons) == (6, 3000, 7, 3000)
    assert (c.no_sites, c.count_diffs, c.count_comparisons, c.count_missing, c.avg_pi) == (500, 0, 3000, 0, 0)
    dxy = {(r.chromosome, r.window_pos_1): r for r in stats.dxy(sited, table, p, callable_mask.dxy_mask(ranges, p)).collect()}
    assert (dxy["chr1", 1].count_diffs, dxy["chr1", 1].count_comparisons) == (18, 8000)
    theta = {(r.pop, r.chromosome, r.window_pos_1): r for r in stats.watterson_theta(sited, table, p, mask=callable_mask.class_mask(ranges, p)).collect()}
    assert theta["A", "chr1", 1].no_sites == 500 and theta["A", "chr2", 1].no_sites == 500 and theta["A", "chr2", 1].avg_watterson_theta is None


def test_class_string_round_trip(spark):
    df = spark.sql("select array(named_struct('n', 10L, 's', 2L), named_struct('n', 4L, 's', 7L)) as c, cast(array() as array<struct<n: bigint, s: bigint>>) as e")
    row = df.select(K.class_string(F.col("c")).alias("t"), K.class_string(F.col("e")).alias("none"), K.class_array(K.class_string(F.col("c"))).alias("back"), K.class_array(F.lit("NA")).alias("na")).first()
    assert row.t == "4:7,10:2" and row.none is None and [tuple(x) for x in row.back] == [(4, 7), (10, 2)] and row.na == []


def test_gt_functions(spark):
    texts = ["0/0", "./1", "./.", ".", "1", "0|1|1", "./././.", "1/."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(K.gt_ploidy(F.col("t")).alias("p"), K.gt_alleles(F.col("t"), F.lit(2)).alias("a")).collect()
    assert [r.p for r in got] == [2, 1, 2, 1, 1, 3, 4, 1]
    assert [r.a for r in got][:6] == [[0, 0], [-1, 1], [-1, -1], [-1, -1], [1, -1], [0, 1]]
    ends = spark.createDataFrame([("DP=3;END=120",), ("END=x",), (".",), ("XEND=5",)], "i string").select(K.info_end(F.col("i")).alias("e")).collect()
    assert [r.e for r in ends] == [120, None, None, None]


def test_streaming_sums_equal_batch(spark, tmp_path):
    from allelia.streaming.sums import pi_sums, with_ratio

    p = pops(2, 2)
    rows = site_rows(spark, GENOTYPES["diploid"] * 5)
    for k in range(2):
        rows.where(f"row_id % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = pi_sums(stream, p, 10).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    spans = windows.extents(rows, 1, 20)
    sited = windows.assign_fixed(sites.with_populations(rows, p), spans, 10)
    want = {(r.pop, r.window_pos_1): (r.avg_pi, r.no_sites) for r in stats.pi(sited, windows.fixed_windows(spans, 10), p).collect()}
    got = {(r["pop"], r.w1): (r.avg_pi, r.no_sites) for r in with_ratio(spark.table("sums")).collect()}
    assert got == want


def test_wc_against_a_sum_over_all_alleles(spark):
    """Alleles 1 and 3 of five, whole and half missing genotypes, populations of one called individual or none."""
    import random

    dice = random.Random(5)
    p, gts = pops(3, 3), []
    for k in range(60):
        pair, gone = dice.sample(range(5 if k % 2 else 3), 2), (0.15, 0.5, 0.8)[k % 3]
        gts.append([[-1 if dice.random() < gone else dice.choice(pair) for _ in range(2)] for _ in range(6)])
    rows = site_rows(spark, gts)

    def ratio(x, y):
        return x / y if y else math.nan if not x or math.isnan(x) else math.copysign(math.inf, x)

    def brute_sums(gt):
        sums = [0.0, 0.0, 0.0]
        for u in range(max([1, *(a for g in gt for a in g)]) + 1):
            one = [[g for g in part if -1 not in g] for part in (gt[:3], gt[3:])]
            called = [[a for g in part for a in g if a >= 0] for part in (gt[:3], gt[3:])]
            i1, i2 = (len(c) // 2 for c in called)
            both, mean = i1 + i2, (i1 + i2) / 2
            nc = both - ratio(i1 * i1 + i2 * i2, both)
            f1, f2 = (ratio(c.count(u), len(c)) for c in called)
            f = ratio(called[0].count(u) + called[1].count(u), len(called[0]) + len(called[1]))
            s2 = ratio(i1 * (f1 - f) ** 2 + i2 * (f2 - f) ** 2, mean)
            h = ratio(sum(g[0] != g[1] and u in g for part in one for g in part), both)
            core = f * (1 - f) - s2 / 2
            terms = (ratio(mean, nc) * (s2 - ratio(1.0, mean - 1) * (core - h / 4)), ratio(mean, mean - 1) * (core - ratio((2 * mean - 1) * h, 4 * mean)), h / 2)
            sums = [s + (0.0 if math.isnan(t) else t) for s, t in zip(sums, terms)]
        return sums

    found = {r.window_pos_1: [r.wc_fst_a, r.wc_fst_b, r.wc_fst_c] for r in stats.fst_per_site(sites.with_populations(rows, p, True), p, "wc", True).collect()}
    eligible = [k + 1 for k, gt in enumerate(gts) if len({a for g in gt for a in g if a >= 0}) == 2]
    assert sorted(found) == eligible and len(eligible) > 30
    for k in eligible:
        assert found[k] == pytest.approx(brute_sums(gts[k - 1]), nan_ok=True), gts[k - 1]
