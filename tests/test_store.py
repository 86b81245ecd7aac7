"""Packed genotypes, the site store, the fused aggregate and windows over trees of cells."""

import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelia.functions import packing
from allelia.operators import callable_mask, fused, pairs, sites, stats, windows
from allelia.operators.sites import Populations
from allelia.plans import file_queries
from allelia.plans.analysis import AnalysisConfig, analyse, write_results
from allelia.sources import side_files, store, vcf
from allelia.sources.tables import POPULATIONS, genotyped
from allelia.streaming import sums

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def calls(rng, samples, tokens=(".", "0", "1", "2", "12", "x", "")):
    field = lambda: rng.choice("/|").join(rng.choice(tokens) for _ in range(rng.choice([1, 2, 2, 2, 3]))) + rng.choice(["", ":3", ":.:9/1"])
    return "\t".join(field() for _ in range(samples))


@pytest.mark.parametrize("samples", [1, 5, 63, 64, 130])
def test_genotypes_are_packed_as_read(samples):
    rng = random.Random(samples)
    rows = [calls(rng, rng.choice([samples, samples, samples + 2, max(0, samples - 3)])) for _ in range(40)] + [None, "", "0/1", "1|1:9"]
    alleles, ploidy = packing.alleles_of_calls(*packing._bytes(pa.array(rows)), samples)
    flat, first, top = packing.planes(alleles)
    width = packing.words_of(samples)
    for i, r in enumerate(rows):
        fields = (r or "").split("\t") if r else []
        for s in range(samples):
            tokens = re.split(r"[/|]", fields[s].split(":")[0]) if s < len(fields) else []
            want = [int(t) if t.isdigit() else -1 for t in tokens] + [-1] * (alleles.shape[2] - len(tokens))
            assert alleles[i, s].tolist() == want
            assert ploidy[i, s] == (0 if not tokens else 1 if len(tokens) == 1 or sum(t != "." for t in tokens) == 1 else len(tokens))
            for h, a in enumerate(want):
                bit = lambda k: flat[first[i] + (h * (1 + top[i]) + k) * width + s // 63] >> (s % 63) & 1  # noqa: B023, E731
                assert [bit(k) for k in range(1 + top[i])] == [int(a >= 0)] + [int(a == k) for k in range(1, 1 + top[i])]


@pytest.mark.parametrize(("samples", "ploidy", "most"), [(7, 2, 3), (70, 2, 2), (20, 1, 2), (9, 3, 4), (3300, 2, 2)])
def test_counts_of_planes_equal_those_of_arrays(spark, samples, ploidy, most):
    rng = random.Random(samples)
    pops = Populations(tuple(map(str, range(samples))), tuple(rng.choice(["A", "B", None]) for _ in range(samples)), ("A", "B"))
    gts = [[[rng.choice([-1, *range(rng.choice([1, 2, most]))]) for _ in range(ploidy)] for _ in range(samples)] for _ in range(6)]
    schema = "chrom string, pos int, row_id long, alts array<string>, is_snp boolean, info_end int, gt array<array<int>>"
    rows = spark.createDataFrame([("c", k, k, ["C"], True, None, gt) for k, gt in enumerate(gts)], schema)
    flat, first, top = packing.planes(np.array(gts, np.int32))
    packed = spark.createDataFrame([("c", k, k, ["C"], True, None, flat[first[k] : first[k + 1]].tolist(), int(top[k])) for k in range(len(gts))], schema.replace("gt array<array<int>>", "bits array<long>, top int"))
    het = ploidy == 2
    show = lambda df: [(r.pos, r.n_alleles_all, [e.asDict() for e in r.p]) for r in df.orderBy("pos").collect()]
    want = show(sites.with_populations(rows, pops, het))
    assert show(sites.with_populations(packed, pops, het, ploidy)) == want
    assert show(sites.with_populations(packed.withColumn("ploidy", F.lit(ploidy)), pops, het, ploidy + 1)) == want
    if samples < 100:
        bits, tops = packing.pack(F.col("gt"), samples, ploidy)
        assert [list(r.b) for r in rows.select("pos", bits.alias("b")).orderBy("pos").collect()] == [flat[first[k] : first[k + 1]].tolist() for k in range(len(gts))]
    plan = sites.with_populations(packed, pops, het, ploidy)._jdf.queryExecution().executedPlan().toString()
    assert "bit_count" in plan and "Generate" not in plan and "Exchange" not in plan


def test_ploidy_needs_no_row_for_each_sample(spark):
    rows = spark.createDataFrame([("a", 2, ["0/1", "0/0/0"]), ("a", 1, ["0", "./."]), ("b", 3, ["0", "1"]), ("c", 4, ["./1", "0/0/1"]), ("d", 5, [])], "chrom string, row_id long, gts array<string>")
    found = sites.ploidy_by_contig(rows)
    assert {r.chrom: r.ploidy for r in found.collect()} == {"a": 2, "b": 1, "c": 3, "d": 1}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def written(path, contigs=("chr1", "chr2"), n=1500, blocks=False, haploid=()):
    rng = random.Random(5)
    rows = []
    for c in contigs:
        p = 0
        for _ in range(n):
            p += rng.randrange(1, 4)
            end = p + rng.randrange(0, 30) if blocks and rng.random() < 0.4 else p
            alt = "<NON_REF>" if end > p else rng.choice([".", ".", ".", "C", "C,G"])
            top = {".": 0, "C": 1, "C,G": 2}.get(alt, 0)
            one = lambda: rng.choice([".", *map(str, range(top + 1)), "0"])  # noqa: B023, E731
            gts = [one() if c in haploid else f"{one()}/{one()}" for _ in range(6)]
            rows.append(f"{c}\t{p}\t.\tA\t{alt}\t.\t.\t{f'END={end}' if end > p else '.'}\tGT\t" + "\t".join(gts))
            p = end
    path.write_text(HEAD + "\t".join(f"S{i}" for i in range(6)) + "\n" + "\n".join(rows) + "\n")
    return path


@pytest.fixture(scope="module")
def pops_file(tmp_path_factory):
    f = tmp_path_factory.mktemp("pops") / "p.txt"
    f.write_text("".join(f"S{i}\t{'AAABBB'[i]}\n" for i in range(6)))
    return str(f)


def scanned(df):
    """Rows that the scans of an executed plan gave out, and its text."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 2000)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.getClass().getName():
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())), plan.toString()


@pytest.mark.parametrize("kind", ["built", "saved"])
def test_region_scan_reads_what_it_touches(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(store, "ROW_GROUP", 2048)
    made = store.build(spark, str(written(tmp_path / "r.vcf", blocks=True)))
    if kind == "saved":
        store.save(made, str(tmp_path / "saved"))
        made = store.load(spark, str(tmp_path / "saved"))
    assert made.samples == tuple(f"S{i}" for i in range(6))
    one = made.of_contigs(["chr2"])
    whole = made.records.count()
    assert whole == 3000
    few, plan = scanned(one.region(1000, 1100).select("chrom", "pos", "span_end"))
    more, _ = scanned(one.region(1000, 3000).select("chrom", "pos", "span_end"))
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan)[1]
    assert "GreaterThanOrEqual(pos" in pushed and "LessThanOrEqual(pos" in pushed and "chrom" in pushed
    assert few < 0.35 * whole and few < more < whole
    # blocks that begin before the region and reach into it are found by the halo
    every = one.records.where("pos <= 1100 and span_end >= 1000").count()
    assert one.region(1000, 1100).count() == every > 0
    with pytest.raises(ValueError, match="chr9"):
        made.of_contigs(["chr2", "chr9"])


def test_contig_facts(spark, tmp_path):
    made = store.build(spark, str(written(tmp_path / "f.vcf", ("x", "a", "y"), 50, haploid=("y",))))
    got = {r.chrom: r for r in made.contigs.collect()}
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1].chrom_rank)] == ["x", "a", "y"]
    assert (got["x"].ploidy, got["y"].ploidy) == (2, 1) and got["x"].invariant and got["x"].variant and not got["x"].blocks and got["x"].halo == 0
    facts = made.facts()
    assert (facts.n, facts.low, facts.high, facts.blocks) == (3, 1, 2, False)


@pytest.mark.parametrize("kw", [{"window_size": 300}, {"window_size": 100, "chromosomes": ("chr1",), "interval_start": 250, "interval_end": 900}, {"window_size": 1, "stats": ("fst",), "fst_type": "hudson"}])
def test_saved_store_gives_what_the_text_gives(spark, tmp_path, pops_file, kw):
    text = str(written(tmp_path / "s.vcf", n=400, haploid=("chr2",)))
    store.save(store.build(spark, text), str(tmp_path / "saved"))
    base = {"populations": pops_file, "stats": ("pi", "dxy", "fst", "watterson_theta", "tajima_d"), "include_multiallelic_snps": True} | kw
    one, other = analyse(spark, AnalysisConfig(vcf=text, **base)), analyse(spark, AnalysisConfig(store=str(tmp_path / "saved"), **base))
    assert set(one) == set(other) == set(base["stats"])
    for stat in one:
        # the order in which doubles are added differs
        show = lambda df: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())
        assert show(one[stat]) == show(other[stat]), stat


def test_all_statistics_take_one_count(spark, tmp_path, pops_file):
    """The fused sums give what each statistic gives on its own, and the plan counts alleles in one place."""
    made = store.build(spark, str(written(tmp_path / "o.vcf", n=300)))
    pops = Populations(made.samples, tuple("AAABBB"), ("A", "B"))
    rows = sites.with_populations(sites.retained(made.records, multiallelic=True), pops, True)
    sited, table = windows.assign_fixed(rows, 1, 100), windows.fixed_windows(windows.extents(made.records), 100)
    comps = fused.components(sited, pops, ("pi", "dxy", "fst", "watterson_theta", "tajima_d"))
    plan = comps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    comps = comps.cache()
    classes, variants = fused.classes(comps), sited.where("site_class <> 'invariant'")
    pairs = [
        (stats.pi(sited, table, pops), stats.pi_result(fused.pi_sums(comps), table, pops)),
        (stats.dxy(sited, table, pops), stats.dxy_result(fused.dxy_sums(comps), table, pops)),
        (stats.fst(variants, pops, "wc", True), stats.fst_result(fused.fst_sums(comps), "wc", True)),
        (stats.watterson_theta(sited, table, pops), stats.watterson_result(classes, table, pops)),
        (stats.tajima_d(sited, table, pops, components=True), stats.tajima_result(classes, table, pops, components=True)),
    ]
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.fillna(-1).collect())
    for one, other in pairs:
        assert one.columns == other.columns and rounded(one) == rounded(other)
    comps.unpersist()


def brute_sums(rows, wins):
    out = {}
    for c, a, b, o in wins:
        for r in rows:
            n = min(b, r[2]) - max(a, r[1]) + 1
            if r[0] == c and n > 0:
                x = out.setdefault((c, a, b, o, r[3]), [0, 0])
                x[0] += r[4] * n
                x[1] += n
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("width", [16, 64, 16384])
@pytest.mark.parametrize("blocks", [False, True])
def test_windows_of_any_kind_from_cells(spark, width, blocks):
    rng = random.Random(width)
    rows = [(f"c{rng.randrange(2)}", p := rng.randrange(1, 700), p + (rng.choice([0, 3, 40, 200]) if blocks else 0), rng.choice("ab"), rng.randrange(5)) for _ in range(200)]
    wins = [(f"c{rng.randrange(3)}", a := rng.randrange(1, 700), a + rng.choice([0, 1, 5, 40, 300, 700]), k) for k in range(50)]
    wins += [("c0", 1, 700, 100), ("c0", 1, 700, 101), ("c1", 16, 31, 102), ("c1", 15, 32, 103), ("c1", 32, 47, 104)]
    made = spark.createDataFrame(rows, "chrom string, pos int, span_end int, k string, v long")
    table = spark.createDataFrame(wins, "chrom string, w1 long, w2 long, window_ord long")
    cells = windows.assign_cells(made if blocks else made.drop("span_end"), table, width).groupBy("chrom", "bin", "cell", "k").agg(F.sum(F.col("v") * F.col("mult")).alias("v"), F.sum("mult").alias("m"))
    got = {tuple(r)[:5]: tuple(r)[5:] for r in windows.gather(cells, table, ("k",), ("v", "m"), width).collect()}
    assert got == brute_sums(rows, wins)


def test_wide_windows_cost_no_rows_for_each_site(spark):
    """1,000 windows as wide as the contig: sites stay one row each, and windows a few dozen."""
    length, n = 3_000_000, 20_000
    made = spark.range(n).selectExpr("'c' as chrom", f"cast(id * {length // n} + 1 as int) as pos", "'a' as k", "id % 5 as v")
    table = spark.range(1000).selectExpr("'c' as chrom", "id * 3 + 1 as w1", f"{length} - id * 2 as w2", "id as window_ord")
    sited = windows.assign_cells(made, table)
    assert sited.count() == n
    cells = sited.groupBy("chrom", "bin", "cell", "k").agg(F.sum("v").alias("v")).cache()
    got = {r.window_ord: r.v for r in windows.gather(cells, table, ("k",), ("v",)).collect()}
    at = [(k * (length // n) + 1, k % 5) for k in range(n)]
    assert all(got[o] == sum(v for p, v in at if o * 3 + 1 <= p <= length - o * 2) for o in range(0, 1000, 37)) and len(got) == 1000
    cells.unpersist()


def test_listed_positions_in_blocks_add_two_rows_each(spark):
    """A block stays one row, however long; what is listed in it counts, the rest of it is missing."""
    schema = "chrom string, pos int, row_id long, alts array<string>, is_snp boolean, info_end int, bits array<long>, top int"
    made = spark.createDataFrame([("c", 1, 0, ["<NON_REF>"], False, 1_000_000, [3, 0, 3, 0], 1), ("c", 1_000_001, 1, [], True, None, [3, 0, 1, 0], 1), ("c", 1_000_002, 2, ["T"], True, None, [3, 1, 3, 2], 1)], schema)
    listed = spark.createDataFrame([("c", 500), ("c", 600_000), ("c", 600_000), ("c", 1_000_002), ("d", 5)], "chrom string, pos int")
    rows = sites.blocks_with_listed(made, listed)
    assert rows.count() == 3 + 2 * 2
    pops = Populations(("a", "b"), ("A", "A"), ("A",))
    sited = windows.assign_fixed(sites.with_populations(sites.retained(rows), pops), 1, 500_000)
    table = windows.fixed_windows(windows.extents(made), 500_000)
    got = {r.window_pos_1: (r.no_sites, r.count_diffs, r.count_comparisons, r.count_missing) for r in stats.pi(sited, table, pops).collect()}
    assert got == {1: (1, 0, 6, 6 * 499_999), 500_001: (1, 0, 6, 6 * 499_999), 1_000_001: (1, 4, 6, 6)}


def test_plans_do_not_name_contigs(spark, tmp_path, pops_file):
    """400 contigs of both ploidies are rows of a table: the plan is as long as for two."""
    sizes = []
    for k in (2, 400):
        names = tuple(f"scaffold{i}" for i in range(k))
        config = AnalysisConfig(vcf=str(written(tmp_path / f"{k}.vcf", names, 40, haploid=names[1::2])), populations=pops_file, stats=("pi", "fst"), window_size=5)
        began = time.time()
        found = analyse(spark, config)
        sizes.append(sum(len(df._jdf.queryExecution().optimizedPlan().toString()) for df in found.values()))
        assert found["pi"].select("chromosome").distinct().count() == k and time.time() - began < 120
        assert {int(r.chromosome[8:]) % 2 for r in found["fst"].collect()} == {0}
    assert sizes[1] < 1.2 * sizes[0]


def test_header_and_samples_stop_early(spark, tmp_path):
    lines = vcf.read_lines(spark, str(written(tmp_path / "h.vcf", n=5)))
    assert vcf.read_samples(lines) == [f"S{i}" for i in range(6)]


def test_lines_of_several_files_keep_their_order(spark, tmp_path, pops_file):
    """Spark deals large files first; contigs, BED windows and populations follow the files' names all the same."""
    folder, bed, pops = tmp_path / "a folder", tmp_path / "bed", tmp_path / "pops"
    for d in (folder, bed, pops):
        d.mkdir()
    for i, n in enumerate((3, 40, 2000, 10)):
        whole = written(tmp_path / "one.vcf", (f"c{9 - i}",), n).read_text()
        (folder / f"part-{i + 8}").write_text(whole if not i else "".join(x + "\n" for x in whole.splitlines() if x[0] != "#"))
        (bed / f"part-{i + 8}").write_text("".join(f"c{9 - i}\t{k}\t{k + 5}\n" for k in range(n)))
    (pops / "part-2").write_text("S0\tZ\n")
    (pops / "part-10").write_text("".join(f"S{i}\tA\n" for i in range(1, 6)))
    made = store.build(spark, str(folder))
    assert [r.chrom for r in made.contigs.orderBy("chrom_rank").collect()] == ["c9", "c8", "c7", "c6"]
    ids = [r.row_id for r in vcf.read_lines(spark, str(folder)).collect()]
    assert len(set(ids)) == len(ids) == 2055
    assert made.records.orderBy("row_id").select("chrom", "pos").collect() == made.records.orderBy(F.desc("chrom"), "pos").select("chrom", "pos").collect()
    assert [(r.chrom, r.w1) for r in side_files.read_bed(spark, str(bed)).orderBy("window_ord").collect()] == [(f"c{9 - i}", k + 1) for i, n in enumerate((3, 40, 2000, 10)) for k in range(n)]
    assert side_files.populations_of(side_files.read_populations(spark, str(pops)), [f"S{i}" for i in range(6)]).order == ("Z", "A")


def test_numbers_of_lines_do_not_follow_the_tasks(spark, tmp_path):
    """More executors than at the time of planning make more tasks, here as smaller splits do."""
    for i, n in enumerate((3, 4000, 9000, 500)):
        (tmp_path / f"part-{i}").write_text("".join(f"{i} {k:05}\n" for k in range(n)))
    lines = vcf.read_lines(spark, str(tmp_path))
    size, tasks = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    for most in (size, "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            rows = lines.select("row_id", "value", F.spark_partition_id().alias("task")).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        tasks.append(len({r.task for r in rows}))
        assert len({r.row_id for r in rows}) == len(rows) == 13503
        assert [r.value for r in sorted(rows)] == sorted(r.value for r in rows)
    assert tasks[0] < tasks[1]


def test_written_file_follows_contigs_of_several_files(spark, tmp_path, pops_file):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i, n in enumerate((30, 2000, 100)):
        whole = written(tmp_path / "one.vcf", (f"c{i}",), n).read_text()
        (folder / f"part-0000{i}").write_text(whole if not i else "".join(x + "\n" for x in whole.splitlines() if x[0] != "#"))
    config = AnalysisConfig(vcf=str(folder), populations=pops_file, stats=("pi",), window_size=500, output_folder=str(tmp_path))
    (path,) = write_results(analyse(spark, config), config)
    with open(path) as f:
        rows = [line.split("\t") for line in f.readlines()[1:]]
    assert [r[1:3] + r[:1] for r in rows] == sorted((r[1:3] + r[:1] for r in rows), key=lambda r: (r[0], int(r[1]), r[2])) and {r[1] for r in rows} == {"c0", "c1", "c2"}


def test_single_site_windows_meet_sites_by_position(spark, tmp_path, pops_file, monkeypatch):
    """Only the listed rows are counted: no row is paired with all windows of its bin."""
    seen = []
    monkeypatch.setattr(windows, "assign_intervals", lambda *a: seen.append(a))
    listed = tmp_path / "sites.txt"
    listed.write_text("".join(f"{c}\t{p}\n" for c in ("chr1", "chr2", "chr7") for p in range(1, 900, 2)))
    kw = {"vcf": str(written(tmp_path / "s.vcf")), "populations": pops_file, "window_size": 1, "sites_file": str(listed), "include_multiallelic_snps": True}
    config = AnalysisConfig(**kw, stats=("pi", "fst"), fst_type="hudson")
    counted = []
    real = windows.assign_sites
    monkeypatch.setattr(windows, "assign_sites", lambda df: counted.append(df) or real(df))
    found = analyse(spark, config)
    rows = {(int(r.pos), r.chrom) for r in store.build(spark, kw["vcf"]).records.select("chrom", "pos").collect()}
    there = {(p, c) for p, c in rows if p < 900 and p % 2}
    assert not seen and {(r.pos, r.chrom) for df in counted for r in df.select("chrom", "pos").collect()} == there
    pi = found["pi"].collect()
    assert len(pi) == 2 * 2 * 450 and {(r.window_pos_1, r.chromosome) for r in pi if r.no_sites} <= there
    assert {(r.window_pos_1, r.chromosome) for r in found["fst"].collect()} <= there


def test_mask_ranges_meet_few_variants_that_they_do_not_hold(spark, monkeypatch):
    """A bin of the join has few pairs that do not meet; the counts are those of coarse bins."""
    table = spark.createDataFrame([("c", 1, 40_000, 0)], "chrom string, w1 long, w2 long, window_ord long")
    mask = spark.range(3000).selectExpr("'c' as chrom", "id * 13 as start0", "id * 13 + 9 as end0", "array(id % 3, 1L) as k")
    variants = spark.range(1, 40_000, 3).selectExpr("'c' as chrom", "cast(id as int) as pos")
    widths = []
    real = callable_mask.assign_intervals
    monkeypatch.setattr(callable_mask, "assign_intervals", lambda s, w, width: widths.append(width) or real(s, w, width))
    fine = sorted(map(str, callable_mask.invariant_ranges(table, mask, variants).collect()))
    assert widths == [windows.FINE] and windows.FINE < windows.BIN // 8
    assert fine == sorted(map(str, callable_mask.invariant_ranges(table, mask, variants, windows.BIN).collect())) and len(fine) == 3000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_site_classes_count_bit_planes(spark, monkeypatch):
    """No genotype is split into an array of its own; the counts are those of the arrays."""
    path = file_queries._vcf(spark, "/root/testdata/sf0.001")
    rows = sites.classified(vcf.sites_of(vcf.staged_records(vcf.read_lines(spark, path))))
    want = rows.groupBy("chrom", "site_class", "ploidy").agg(F.count("*").alias("n"), F.sum(F.size(F.filter(F.flatten("gt"), lambda a: a >= 0))).alias("called"))
    want = sorted(map(tuple, want.collect()))

    def refused(*_):
        raise AssertionError("genotypes as text")

    monkeypatch.setattr(vcf, "staged_records", refused)
    assert sorted(map(tuple, file_queries.vcf_site_classes(spark, "/root/testdata/sf0.001").collect())) == want


@pytest.mark.parametrize("keys", ["windows", "cells"])
def test_pairs_of_many_populations_as_matrix_products(spark, keys):
    """60 populations: each task hands on a row for each window and pair at most, with the sums that single pairs give."""
    rng = random.Random(3)
    samples, k = 180, 60
    pops = Populations(tuple(map(str, range(samples))), tuple(f"P{i % k}" for i in range(samples)), tuple(f"P{i}" for i in range(k)))
    gts = [[[rng.choice([-1, 0, 0, *range(2 + site % 2)]) for _ in range(2)] for _ in range(samples)] for site in range(40)]
    flat, first, top = packing.planes(np.array(gts, np.int32))
    made = spark.createDataFrame([("c", k, k, ["C"] * (k % 3 > 0), True, None, flat[first[k] : first[k + 1]].tolist(), int(top[k])) for k in range(40)], "chrom string, pos int, row_id long, alts array<string>, is_snp boolean, info_end int, bits array<long>, top int")
    rows = sites.with_populations(sites.retained(made.coalesce(1), multiallelic=True), pops)
    if keys == "windows":
        at, names = windows.assign_fixed(rows, 0, 10), windows.KEYS
    else:
        at, names = windows.assign_cells(rows, spark.createDataFrame([("c", 5, 20, 0)], "chrom string, w1 long, w2 long, window_ord long")), ("chrom", "bin", "cell")
    found = pairs.as_components(pairs.pair_sums(at, pops, names), names)
    want = fused.components(at, pops, ("dxy", "fst"), "hudson", names)
    show = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names, "pop1", "pop2", *pairs.COUNTS, F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))).collect())
    got = show(found)
    assert got == show(want) and len(got) == 1770 * len({r[: len(names)] for r in got})
    table = windows.fixed_windows(windows.extents(made, 0), 10)
    if keys == "windows":
        one, other = stats.fst_result(pairs.fst_sums(pairs.pair_sums(at, pops)), "hudson").count(), stats.dxy_result(pairs.dxy_sums(pairs.pair_sums(at, pops)), table, pops).count()
        assert 0 < one <= other == 1770 * 4


def test_analysis_of_many_populations(spark, tmp_path, pops_file):
    """Nine populations or more take matrix products; the results are those of two at a time."""
    text = tmp_path / "m.vcf"
    rng = random.Random(7)
    rows = [f"c\t{p}\t.\tA\t{rng.choice(['.', 'C'])}\t.\t.\t.\tGT\t" + "\t".join(f"{rng.choice('.001')}/{rng.choice('001')}" for _ in range(20)) for p in range(1, 200)]
    text.write_text(HEAD + "\t".join(f"S{i}" for i in range(20)) + "\n" + "\n".join(rows) + "\n")
    (tmp_path / "all.txt").write_text("".join(f"S{i}\tP{i % 10}\n" for i in range(20)))
    (tmp_path / "two.txt").write_text("".join(f"S{i}\tP{i % 10}\n" for i in range(20) if i % 10 in (2, 7)))
    base = {"vcf": str(text), "stats": ("pi", "dxy", "fst"), "fst_type": "hudson", "window_size": 50}
    many, two = (analyse(spark, AnalysisConfig(populations=str(tmp_path / f"{f}.txt"), **base)) for f in ("all", "two"))
    # eligibility looks at all samples of the callset in both
    for stat, where in (("pi", "pop in ('P2', 'P7')"), ("dxy", "pop1 = 'P2' and pop2 = 'P7'"), ("fst", "pop1 = 'P2' and pop2 = 'P7'")):
        show = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.drop("pop_rank").fillna(-1).collect())
        assert show(many[stat].where(where)) == show(two[stat]) and two[stat].count() > 0, stat


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    orders = spark.range(600).selectExpr("id as o_orderkey", "id * 7 % 50 as o_custkey")
    add, path = sums.add_batch(str(tmp_path / "sums"), POPULATIONS, 100), str(tmp_path / "sums")
    add(genotyped(orders.where("o_orderkey < 200")), 0)
    add(genotyped(orders.where("o_orderkey >= 200")), 1)
    add(genotyped(orders.where("o_orderkey >= 200")), 1)
    want = sorted(map(tuple, sums.pi_sums(genotyped(orders), POPULATIONS, 100).collect()))
    assert sorted(map(tuple, sums.current(spark, path).collect())) == want
    sums.compact(spark, path, str(tmp_path / "small"))
    assert sorted(map(tuple, sums.current(spark, str(tmp_path / "small")).collect())) == want
