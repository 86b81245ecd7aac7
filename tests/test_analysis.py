"""Analyses from small text files: sources, checks, ploidy by contig, output."""

import gzip

import pytest

from allelia.plans.analysis import AnalysisConfig, analyse, main, write_results
from allelia.sources import side_files, vcf

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("vcf")
    rows = ["chr1\t100\t.\tA\tC\t.\t.\t.\tGT\t0/0\t0/1\t1/1\t0/0", "chr1\t101\t.\tA\t.\t.\t.\t.\tGT:DP\t0/0:3\t0/0:1\t./.:0\t0/0:9", "chr1\t250\t.\tG\tT\t.\t.\t.\tGT\t0/1\t0/0\t0/1\t1/1", "chr1\t300\t.\tAT\tA\t.\t.\t.\tGT\t0/1\t0/0\t0/1\t1/1", "chrX\t7\t.\tA\tC\t.\t.\t.\tGT\t0\t1\t1\t0", "chrX\t9\t.\tA\t.\t.\t.\t.\tGT\t0\t0\t.\t0"]
    with gzip.open(d / "a.vcf.gz", "wt") as f:
        f.write(HEAD + "S1\tS2\tS3\tS4\n" + "\n".join(rows) + "\n")
    (d / "pops.txt").write_text("S1\tA\nS2\tA\n\nS3\tB \nS4\tB\n")
    (d / "w.bed").write_text("chr1\t0\t1000\nchr1\t99\t200\nchr9\t0\t10\n")
    (d / "sites.txt").write_text("chr1\t100\nchr1\t101\n")
    (d / "g.vcf").write_text(HEAD + "S1\tS2\tS3\tS4\n" + "chr1\t10\t.\tA\t<NON_REF>\t.\t.\tEND=19\tGT\t0/0\t0/0\t0/0\t./.\nchr1\t20\t.\tA\tC\t.\t.\t.\tGT\t0/0\t0/1\t1/1\t0/0\n")
    (d / "mask.bed").write_text('#wisp_mask_metadata\t{"populations": ["A", "B"], "population_sample_counts": {"A": 2, "B": 2}, "population_columns": [{"column_number": 4, "name": "A"}, {"column_number": 5, "name": "B"}], "threshold": 10}\nchr1\t0\t500\t2\t2\nchrX\t0\t20\t1\t2\n')
    return d


def config(d, **kw):
    base = {"vcf": str(d / "a.vcf.gz"), "populations": str(d / "pops.txt"), "stats": ("pi",), "window_size": 500}
    return AnalysisConfig(**(base | kw))


def test_mixed_ploidy_all_statistics(spark, files):
    out = analyse(spark, config(files, stats=("pi", "dxy", "fst", "watterson_theta", "tajima_d")))
    pi = {(r["pop"], r.chromosome): r for r in out["pi"].collect()}
    assert pi["A", "chr1"].no_sites == 3 and pi["A", "chr1"].count_comparisons == 18 and pi["A", "chr1"].count_diffs == 6
    assert pi["A", "chrX"].count_comparisons == 2 and pi["B", "chrX"].count_missing == 1
    assert {r.chromosome for r in out["fst"].collect()} == {"chr1"}
    hudson = analyse(spark, config(files, stats=("fst",), fst_type="hudson"))["fst"].collect()
    assert {r.chromosome for r in hudson} == {"chr1", "chrX"}


def test_bed_and_sites(spark, files):
    bed = analyse(spark, config(files, window_size=None, bed_file=str(files / "w.bed")))["pi"].orderBy("window_ord", "pop").collect()
    assert [(r.window_pos_1, r.window_pos_2, r["pop"], r.no_sites) for r in bed] == [(1, 1000, "A", 3), (1, 1000, "B", 3), (100, 200, "A", 2), (100, 200, "B", 2)]
    single = analyse(spark, config(files, window_size=1, sites_file=str(files / "sites.txt"), stats=("pi", "fst"), fst_type="hudson"))
    assert sorted((r.window_pos_1, r.no_sites) for r in single["pi"].where("pop = 'A'").collect()) == [(100, 1), (101, 1)]
    assert [r.window_pos_1 for r in single["fst"].collect()] == [100]


def test_interval_bounds_every_statistic(spark, files, tmp_path):
    """A variant beyond the last window of the interval is in no statistic; windows reach past the interval's end to a full one."""
    v = tmp_path / "i.vcf"
    calls = {100: "0/0\t0/1\t1/1\t0/0", 1400: "0/1\t0/0\t1/1\t1/1", 5000: "0/0\t0/0\t1/1\t1/1"}
    v.write_text(HEAD + "S1\tS2\tS3\tS4\n" + "".join(f"chr1\t{p}\t.\tA\tC\t.\t.\t.\tGT\t{g}\n" for p, g in calls.items()) + "chr1\t5001\t.\tA\t.\t.\t.\t.\tGT\t0/0\t0/0\t0/0\t0/0\n")
    for kind in ("wc", "hudson"):
        out = analyse(spark, config(files, vcf=str(v), stats=("pi", "dxy", "fst", "watterson_theta", "tajima_d"), fst_type=kind, chromosomes=("chr1",), interval_start=1, interval_end=1300))
        for stat, df in out.items():
            found = {(r.window_pos_1, r.window_pos_2) for r in df.collect()}
            assert found == ({(1, 500), (1001, 1500)} if stat == "fst" else {(1, 500), (501, 1000), (1001, 1500)}), stat
        single = analyse(spark, config(files, vcf=str(v), stats=("fst",), fst_type=kind, chromosomes=("chr1",), interval_start=1, interval_end=1300, window_size=1))
        assert [r.window_pos_1 for r in single["fst"].collect()] == [100]


def test_variant_free_and_missing_files(spark, files, tmp_path, caplog):
    v = tmp_path / "flat.vcf"
    v.write_text(HEAD + "S1\tS2\tS3\tS4\nchr1\t5\t.\tA\t.\t.\t.\t.\tGT\t0/0\t0/0\t0/0\t0/0\n")
    assert analyse(spark, config(files, vcf=str(v)))["pi"].where("no_sites = 1").count() == 2
    assert "no variant site" in caplog.text
    with pytest.raises(FileNotFoundError, match="no VCF"):
        analyse(spark, config(files, vcf=str(tmp_path / "none.vcf")))


def test_parquet_output(spark, files, tmp_path):
    c = config(files, stats=("pi", "fst"), output_folder=str(tmp_path / "p"), output_format="parquet")
    results = analyse(spark, c)
    pi, fst = (spark.read.parquet(p) for p in write_results(results, c))
    assert sorted(map(tuple, pi.collect()), key=str) == sorted((tuple(r)[:9] for r in results["pi"].collect()), key=str) and fst.count() == 1
    assert [r.chromosome for r in pi.collect()] == ["chr1", "chr1", "chrX", "chrX"]


def test_gvcf_blocks_count_each_position(spark, files):
    out = analyse(spark, config(files, vcf=str(files / "g.vcf"), gvcf=True, window_size=100))["pi"].collect()
    a = next(r for r in out if r["pop"] == "A")
    assert a.no_sites == 11 and a.count_comparisons == 66 and a.count_diffs == 3
    with pytest.raises(ValueError, match="reference blocks"):
        analyse(spark, config(files, vcf=str(files / "g.vcf")))


def test_mask(spark, files):
    out = {(r["pop"], r.chromosome): r for r in analyse(spark, config(files, mask=str(files / "mask.bed")))["pi"].collect()}
    assert out["A", "chr1"].no_sites == 500 and out["A", "chr1"].count_comparisons == 3000 and out["A", "chr1"].count_diffs == 6
    assert out["A", "chrX"].count_missing == 19 and out["B", "chrX"].count_comparisons == 20


def test_output_files(spark, files, tmp_path):
    c = config(files, stats=("pi", "tajima_d"), output_folder=str(tmp_path / "out"), output_prefix="run", tajima_components=True)
    paths = write_results(analyse(spark, c), c)
    lines = open(paths[0]).read().splitlines()
    assert lines[0].split("\t") == ["pop", "chromosome", "window_pos_1", "window_pos_2", "avg_pi", "no_sites", "count_diffs", "count_comparisons", "count_missing"]
    assert lines[1] == f"A\tchr1\t1\t500\t{6 / 18:.14g}\t3\t6\t18\t0" and len(lines) == 5
    assert main(["--stats", "pi", "--vcf", c.vcf, "--populations", c.populations, "--window_size", "500", "--output_folder", str(tmp_path / "cli")])[0].endswith("allelia_pi.txt")


@pytest.mark.parametrize(
    ("kw", "match"),
    [
        ({"window_size": None}, "window size or a BED"),
        ({"bed_file": "x"}, "window size or a BED"),
        ({"interval_start": 3}, "both its start"),
        ({"interval_start": 3, "interval_end": 9}, "one chromosome"),
        ({"interval_start": 9, "interval_end": 3, "chromosomes": ("chr1",)}, "exceeds"),
        ({"gvcf": True, "mask": "x"}, "cannot be combined"),
        ({"stats": ("phi",)}, "some of"),
        ({"output_prefix": "a/b"}, "slashes"),
    ],
)
def test_conflicts(kw, match, tmp_path):
    with pytest.raises(ValueError, match=match):
        config(tmp_path, **kw).check()


def test_checks_on_data(spark, files, tmp_path):
    (tmp_path / "p.txt").write_text("S1\tA\nZ9\tB\n")
    with pytest.raises(ValueError, match="lacks.*Z9"):
        analyse(spark, config(files, populations=str(tmp_path / "p.txt")))
    (tmp_path / "one.txt").write_text("S1\n")
    with pytest.raises(ValueError, match="two columns"):
        side_files.read_populations(spark, str(tmp_path / "one.txt"))
    (tmp_path / "bad.bed").write_text("chr1\t5\t5\n")
    with pytest.raises(ValueError, match="BED"):
        side_files.read_bed(spark, str(tmp_path / "bad.bed"))
    with pytest.raises(ValueError, match="not in the VCF"):
        analyse(spark, config(files, chromosomes=("chr7",)))
    variants = tmp_path / "v.vcf"
    variants.write_text(HEAD + "S1\tS2\tS3\tS4\nchr1\t100\t.\tA\tC\t.\t.\t.\tGT\t0/0\t0/1\t1/1\t0/0\n")
    with pytest.raises(ValueError, match="no invariant"):
        analyse(spark, config(files, vcf=str(variants)))
    assert analyse(spark, config(files, vcf=str(variants), bypass_invariant_check=True))["pi"].count() == 2
    with pytest.raises(ValueError, match="metadata"):
        side_files.MaskHeader.parse("chr1\t0\t1\t2")
    assert vcf.read_samples(vcf.read_lines(spark, str(variants))) == ["S1", "S2", "S3", "S4"]
