"""Queries of whole analyses from files: the driver's tables are written as VCF, gVCF, populations, BED, sites and mask text in the
shared folder, read back through the sources, and analysed; and the SQL that gives the same rows straight from the tables.

The callset has SNPs with one or two alternate alleles (``*`` among them), indels, a symbolic allele, invariant sites with
long REFs, half-called and missing genotypes, both separators, a haploid contig, and a sample in no population.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packing
from ..operators import sites
from ..sources import staging, store, vcf
from ..sources.tables import plane
from .analysis import AnalysisConfig, analyse, text_rows, write_results
from .queries import _BED, _DXY_OUT, _DXY_PARTS, _ELIGIBLE, _HARMONIC, _HUDSON_SITE, _PAIRS, _PI_OUT, _PI_PARTS, _POPS, _WC_SITE, _WINDOWS, SIZE, _bed, _div, _out, _theta_sql

SAMPLES = 10
HEAD = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"s{i}" for i in range(SAMPLES))])]
#: The last sample is in no population.
POPULATIONS = [f"s{i}\t{'AB'[i % 2]}" for i in range(SAMPLES - 1)]


def _text(spark: SparkSession, lines: DataFrame | list[str], head: list[str] | None = None) -> str:
    """Write lines as text files in the shared folder, a head before all others."""
    own = lambda rows: spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1)
    body = own(lines) if isinstance(lines, list) else lines
    path = staging.new_path(spark)
    (own(head).unionByName(body) if head else body).write.text(path)
    return path


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))


#: Orders on one of many small contigs.
SCAFFOLD = 40


def _vcf(spark: SparkSession, sf_dir: str, blocks: bool = False, scaffolds: bool = False) -> str:
    haploid = "false" if blocks else f"o div {SCAFFOLD} % 3 = 2" if scaffolds else "o % 3 = 2"
    # the samples of each property are bits; the text of a sample is a lookup by its bits and the form of the line
    texts = [(f"{a}" if one else f"{a}{by}{b}") + more for one in (False, True) for by in "/|" for more in ("", ":3") for a in ".01" for b in ".012"]
    bit = lambda word: f"(shiftright({word}, s) & 1)"
    # one short function for all samples: written out, the line's code is too long for the JVM to compile
    gts = f"array_join(transform(array({', '.join(map(str, range(SAMPLES)))}), s -> get(array({', '.join(map(repr, texts))}), cast(_form + 4 * {bit('_whole')} * (1 + {bit('_first')}) + {bit('_called')} * (1 + {bit('_other')} + {bit('_second')}) as int))), '\t')"

    def with_genotypes(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({
            "_missing": plane("o * 31", lambda s: 17 * s, 13),
            "_half": plane("o * 5", lambda s: s, 17),
            "_one": plane("o * 7 + c", lambda s: 3 * s * s, 4),
            "_two": plane("o * 11 + c", lambda s: 5 * s, 3),
            "_more": plane("o", lambda s: s, 4),
        })
        rows = rows.withColumns({
            "_called": F.expr(f"{(1 << SAMPLES) - 1}L & ~_missing"),
            "_whole": F.expr(f"{(1 << SAMPLES) - 1}L & ~_missing & ~_half"),
            "_first": F.expr("if(c % 5 <> 0, 0L, _one)"),
            "_other": F.expr("if(c % 5 <> 0, 0L, _two)"),
            "_second": F.expr("if(c % 5 <> 0 or kind not in (0, 3), 0L, _two & _more)"),
            "_form": F.expr(f"if({haploid}, 48, 0) + if(o % 2 = 0, 0, 24) + if(o % 4 = 0, 12, 0)"),
        })
        return rows

    rows = _orders(spark, sf_dir).withColumn("kind", F.expr("4" if blocks else "o % 7"))
    chrom, group = (f"concat('s', o div {SCAFFOLD})", f"o div {SCAFFOLD}") if scaffolds else ("concat('chr', o % 3 + 1)", "o % 3")
    pos = "(o div 3) * 4 + 1" if blocks else f"o % {SCAFFOLD} + 1" if scaffolds else "o div 3 + 1"
    end = "case when c % 5 <> 0 and c % 4 > 0 then c % 4 else 0 end" if blocks else "0"
    alt = f"case when c % 5 <> 0 then case when {end} > 0 then '<NON_REF>' else '.' end when kind = 0 then 'C,G' when kind = 1 then 'A' when kind = 2 then '<DEL>' when kind = 3 then 'C,*' else 'C' end"
    ref = "case when c % 5 = 0 and kind = 1 or c % 5 <> 0 and o % 11 = 3 then 'AT' else 'A' end"
    info = f"case when {end} > 0 then concat('END=', {pos} + {end}) else '.' end"
    line = F.expr(f"concat_ws('\t', {chrom}, {pos}, '.', {ref}, {alt}, '.', '.', {info}, case when o % 4 = 0 then 'GT:DP' else 'GT' end, {gts})")
    return _text(spark, with_genotypes(rows.repartitionByRange(F.expr(group), "o").sortWithinPartitions(F.expr(group), "o")).select(line.alias("value")), HEAD)


def _run(spark: SparkSession, sf_dir: str, stat: str, blocks: bool = False, **kw) -> DataFrame:
    """An analysis of one statistic, without its sort keys, doubles rounded."""
    config = AnalysisConfig(**({"window_size": SIZE} | kw | {"vcf": _vcf(spark, sf_dir, blocks), "populations": _text(spark, POPULATIONS), "stats": (stat,), "gvcf": blocks}))
    return _out(analyse(spark, config)[stat].drop("chrom_rank"))


def vcf_pi(spark, sf_dir):
    return _run(spark, sf_dir, "pi")


def vcf_dxy_bed(spark, sf_dir):
    """A contig that the VCF lacks is left out with a warning."""
    bed = _bed(spark, sf_dir).select(F.concat_ws("\t", "chrom", F.col("w1") - 1, "w2").alias("value"))
    bed = bed.unionByName(spark.createDataFrame([("chr9\t0\t10",)], "value string")).coalesce(1)
    return _run(spark, sf_dir, "dxy", window_size=None, bed_file=_text(spark, bed), include_multiallelic_snps=True)


def vcf_fst_hudson(spark, sf_dir):
    return _run(spark, sf_dir, "fst", fst_type="hudson", include_multiallelic_snps=True, fst_components=True)


def vcf_fst_wc(spark, sf_dir):
    """The haploid contig is left out with a warning."""
    return _run(spark, sf_dir, "fst", include_multiallelic_snps=True)


def vcf_fst_interval(spark, sf_dir):
    return _run(spark, sf_dir, "fst", fst_type="hudson", include_multiallelic_snps=True, chromosomes=("chr1",), interval_start=51, interval_end=420, window_size=100)


def vcf_short_interval(spark, sf_dir):
    """An interval of less than a window has one window."""
    return _run(spark, sf_dir, "pi", chromosomes=("chr2",), interval_start=51, interval_end=80, window_size=100)


def vcf_watterson_theta(spark, sf_dir):
    return _run(spark, sf_dir, "watterson_theta", include_multiallelic_snps=True)


def vcf_pi_sites(spark, sf_dir):
    listed = _orders(spark, sf_dir).where("o % 7 < 2").selectExpr("concat_ws('\t', concat('chr', o % 3 + 1), o div 3 + 1) as value")
    return _run(spark, sf_dir, "pi", window_size=1, sites_file=_text(spark, listed))


def vcf_mask_pi(spark, sf_dir):
    head = ['#wisp_mask_metadata\t{"populations": ["A", "B"], "population_sample_counts": {"A": 5, "B": 4}, "population_columns": [{"column_number": 4, "name": "A"}, {"column_number": 5, "name": "B"}], "threshold": 10}']
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat_ws('\t', concat('chr', p_partkey % 3 + 1), p_partkey div 3 * 13, p_partkey div 3 * 13 + 9, p_partkey % 6, p_partkey * 7 % 5) as value")
    return _run(spark, sf_dir, "pi", chromosomes=("chr1", "chr2"), mask=_text(spark, rows, head))


def gvcf_pi(spark, sf_dir):
    return _run(spark, sf_dir, "pi", blocks=True)


def vcf_pi_text(spark, sf_dir):
    """The lines of the output file."""
    config = AnalysisConfig(vcf=_vcf(spark, sf_dir), populations=_text(spark, POPULATIONS), stats=("pi",), window_size=SIZE)
    return text_rows(analyse(spark, config)["pi"]).select(F.col("value").alias("line"))


def vcf_site_classes(spark, sf_dir):
    made = store.build(spark, _vcf(spark, sf_dir))
    every = packing.Counter(packing.mask_of(list(range(SAMPLES)), SAMPLES), made.facts().high, by_row=True)
    rows = sites.classified(made.with_contig(made.records.select("chrom", "alts", "is_snp", "bits", "top"), "ploidy"))
    return rows.groupBy("chrom", "site_class", "ploidy").agg(F.count("*").alias("n"), F.sum(F.expr(every.called())).alias("called"))


def vcf_contigs(spark, sf_dir):
    """Contigs in order of appearance with their extent."""
    found = vcf.contigs(vcf.staged_records(vcf.read_lines(spark, _vcf(spark, sf_dir))))
    later = found.select(F.col("chrom_rank").alias("other"))
    return found.join(later, F.col("other") < F.col("chrom_rank"), "left").groupBy("chrom", F.col("first").cast("long").alias("first_pos"), F.col("last").cast("long").alias("last_pos")).agg(F.count("other").alias("place"))


def vcf_region_pi(spark, sf_dir):
    """A region of a saved store: of the sites, only the row groups that it touches are read."""
    saved = staging.new_path(spark)
    store.save(store.build(spark, _vcf(spark, sf_dir)), saved)
    config = AnalysisConfig(store=saved, populations=_text(spark, POPULATIONS), stats=("pi",), window_size=100, chromosomes=("chr1",), interval_start=101, interval_end=400)
    return _out(analyse(spark, config)["pi"].drop("chrom_rank"))


def vcf_scaffolds_pi(spark, sf_dir):
    """Thousands of small contigs of both ploidies, in one plan."""
    config = AnalysisConfig(vcf=_vcf(spark, sf_dir, scaffolds=True), populations=_text(spark, POPULATIONS), stats=("pi",), window_size=15)
    return _out(analyse(spark, config)["pi"].drop("chrom_rank"))


def gvcf_pi_sites(spark, sf_dir):
    """Listed positions in reference blocks and beside them; blocks stay rows with a weight."""
    listed = _orders(spark, sf_dir).where("o % 7 < 4").selectExpr("concat_ws('\t', concat('chr', o % 3 + 1), o div 3 * 4 + 1 + o % 4) as value")
    return _run(spark, sf_dir, "pi", blocks=True, sites_file=_text(spark, listed), interval_start=1, interval_end=1200, chromosomes=("chr2",))


def vcf_pi_file(spark, sf_dir):
    """The lines of the written file, numbered from 0."""
    config = AnalysisConfig(vcf=_vcf(spark, sf_dir), populations=_text(spark, POPULATIONS), stats=("pi",), window_size=SIZE, output_folder=staging.new_path(spark))
    # stored, as the parts' sizes and the lines must come from one reading
    lines = staging.staged(staging.numbered_lines(spark, write_results(analyse(spark, config), config)[0])).select(F.col("row_id").alias("id"), F.col("value").alias("line"))
    lines = lines.withColumn("part", F.shiftright("id", 33)).withColumn("place", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = lines.groupBy("part").agg(F.count("*").alias("n"))  # a row for each part of the file
    before = sizes.select(F.col("part").alias("own")).join(sizes, F.col("part") < F.col("own"), "left").groupBy("own").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    return lines.join(before, F.col("own") == F.col("part")).select((F.col("before") + F.col("place")).alias("line_number"), "line")


QUERIES = {f.__name__: f for f in (vcf_region_pi, vcf_scaffolds_pi, gvcf_pi_sites, vcf_pi_file, vcf_pi, vcf_dxy_bed, vcf_fst_hudson, vcf_fst_wc, vcf_fst_interval, vcf_short_interval, vcf_watterson_theta, vcf_pi_sites, vcf_mask_pi, gvcf_pi, vcf_pi_text, vcf_site_classes, vcf_contigs)}


_ALL = f"""calls0 AS (SELECT 'chr' || (o % 3 + 1) AS chrom, o // 3 + 1 AS pos, o AS row_id, s AS sample, CASE WHEN s = {SAMPLES - 1} THEN NULL WHEN s % 2 = 0 THEN 'A' ELSE 'B' END AS pop, v AS variable, kind,
  CASE WHEN missing OR half THEN -1 WHEN NOT v THEN 0 ELSE CAST((o * 7 + s * s * 3 + c) % 4 = 0 AS INT) END AS a1,
  CASE WHEN missing THEN -1 WHEN NOT v THEN 0 ELSE CAST((o * 11 + s * 5 + c) % 3 = 0 AS INT) * CASE WHEN kind IN (0, 3) AND (o + s) % 4 = 0 THEN 2 ELSE 1 END END AS a2
  FROM (SELECT o_orderkey AS o, o_custkey AS c, s, o_custkey % 5 = 0 AS v, o_orderkey % 7 AS kind, (o_orderkey * 31 + s * 17) % 13 = 0 AS missing, (o_orderkey * 5 + s) % 17 = 0 AS half FROM orders, range(0, {SAMPLES}) t(s)))"""
_HAPS = """haps AS (SELECT chrom, pos, row_id, pop, variable, a1 AS a FROM calls UNION ALL SELECT chrom, pos, row_id, pop, variable, a2 FROM calls WHERE chrom <> 'chr3'),
sp AS (SELECT chrom, pos, row_id, pop, variable, CAST(count(*) FILTER (a = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (a = 1) AS BIGINT) AS n1, CAST(count(*) FILTER (a = 2) AS BIGINT) AS n2,
  CAST(count(*) FILTER (a >= 0) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_haps FROM haps GROUP BY ALL)"""


def _called(multiallelic: bool = False, more: str = "") -> str:
    kinds = "(0, 3, 4, 5, 6)" if multiallelic else "(4, 5, 6)"
    return f"{_ALL}, calls AS (SELECT * FROM calls0 WHERE (NOT variable OR kind IN {kinds}){more}), {_HAPS}"


def _pi_sql(wins: str = _WINDOWS, more: str = "") -> str:
    return f"""WITH {_called(more=more)}, {wins},
g AS (SELECT win.chrom, w1, w2, window_ord, pop, {_PI_PARTS} FROM sp JOIN win ON sp.chrom = win.chrom AND pos BETWEEN w1 AND w2 GROUP BY ALL)
{_PI_OUT} FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.w2 = w.w2 AND g.window_ord = w.window_ord AND g.pop = p.pop"""


def _fst(kind: str, start: int, size: int, where: str, components: bool = False) -> str:
    whole = "x + y" if kind == "hudson" else "x + y + z"
    more = ", round(x, 9) AS hudson_fst_num, round(y, 9) AS hudson_fst_den" if components else ""
    return f"""WITH {_called(True)}, {_ELIGIBLE}, {_HUDSON_SITE if kind == 'hudson' else _WC_SITE},
g AS (SELECT pop1, pop2, chrom, (pos - {start}) // {size} * {size} + {start} AS w1, count(*) AS no_snps, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM comp WHERE {where} GROUP BY ALL)
SELECT pop1, pop2, chrom AS chromosome, CAST(w1 AS BIGINT) AS window_pos_1, CAST(w1 + {size - 1} AS BIGINT) AS window_pos_2, CASE WHEN {whole} > 0 THEN round({_div('x', 'y' if kind == 'hudson' else whole)}, 9) END AS avg_{kind}_fst, CAST(no_snps AS BIGINT) AS no_snps{more} FROM g"""


_ONE_SITE = "win AS (SELECT DISTINCT chrom, pos AS w1, pos AS w2, pos AS window_ord FROM calls0 WHERE row_id % 7 < 2)"
_LISTED_ONLY = _ALL.replace("calls0 AS (", "every AS (") + ", calls0 AS (SELECT * REPLACE (CASE WHEN row_id % 7 < 2 THEN a1 ELSE -1 END AS a1, CASE WHEN row_id % 7 < 2 THEN a2 ELSE -1 END AS a2) FROM every)"
_GVCF = f"""calls AS (SELECT 'chr' || (o % 3 + 1) AS chrom, (o // 3) * 4 + 1 + unnest(range(0, CASE WHEN v THEN 1 ELSE c % 4 + 1 END)) AS pos, o AS row_id, CASE WHEN s = {SAMPLES - 1} THEN NULL WHEN s % 2 = 0 THEN 'A' ELSE 'B' END AS pop, v AS variable,
  CASE WHEN missing OR half THEN -1 WHEN NOT v THEN 0 ELSE CAST((o * 7 + s * s * 3 + c) % 4 = 0 AS INT) END AS a1, CASE WHEN missing THEN -1 WHEN NOT v THEN 0 ELSE CAST((o * 11 + s * 5 + c) % 3 = 0 AS INT) END AS a2
  FROM (SELECT o_orderkey AS o, o_custkey AS c, s, o_custkey % 5 = 0 AS v, (o_orderkey * 31 + s * 17) % 13 = 0 AS missing, (o_orderkey * 5 + s) % 17 = 0 AS half FROM orders, range(0, {SAMPLES}) t(s)))"""
_GVCF_WINDOWS = _WINDOWS.replace("max(o_orderkey // 3 + 1) AS e", "max(o_orderkey // 3 * 4 + 1) AS e")
_MASK = """mask AS (SELECT 'chr' || (p_partkey % 3 + 1) AS chrom, p_partkey // 3 * 13 + 1 AS lo, p_partkey // 3 * 13 + 9 AS hi, p_partkey % 6 AS ka, p_partkey * 7 % 5 AS kb FROM part),
clip AS (SELECT w.chrom, w.w1, greatest(lo, w.w1) AS lo, least(hi, w.w2) AS hi, ka, kb FROM mask JOIN win w ON mask.chrom = w.chrom AND lo <= w.w2 AND hi >= w.w1),
vs AS (SELECT DISTINCT chrom, pos FROM calls WHERE variable),
nv AS (SELECT c.chrom, c.w1, c.lo, c.hi, ka, kb, c.hi - c.lo + 1 - count(vs.pos) AS n_inv FROM clip c LEFT JOIN vs ON vs.chrom = c.chrom AND vs.pos BETWEEN c.lo AND c.hi GROUP BY c.chrom, c.w1, c.lo, c.hi, ka, kb),
inv AS (SELECT chrom, w1, 'A' AS pop, 2 * ka AS k, 45 AS whole, n_inv FROM nv WHERE n_inv > 0 UNION ALL SELECT chrom, w1, 'B', 2 * kb, 28, n_inv FROM nv WHERE n_inv > 0)"""

ORACLE = {
    "vcf_pi": _pi_sql(),
    "vcf_dxy_bed": f"""WITH {_called(True)}, {_BED}, g AS (SELECT win.chrom, w1, w2, window_ord, {_DXY_PARTS} FROM {_PAIRS} JOIN win ON a.chrom = win.chrom AND a.pos BETWEEN w1 AND w2 GROUP BY ALL)
SELECT 'A' AS pop1, 'B' AS pop2, {_DXY_OUT} FROM win w LEFT JOIN g ON g.window_ord = w.window_ord""",
    "vcf_fst_hudson": _fst("hudson", 1, SIZE, "true", True),
    "vcf_fst_wc": _fst("wc", 1, SIZE, "chrom <> 'chr3'"),
    "vcf_fst_interval": _fst("hudson", 51, 100, "chrom = 'chr1' AND pos BETWEEN 51 AND 550"),
    "vcf_short_interval": _pi_sql("win AS (SELECT 'chr2' AS chrom, CAST(51 AS BIGINT) AS w1, CAST(150 AS BIGINT) AS w2, 0 AS window_ord)"),
    "vcf_watterson_theta": _theta_sql(calls=_called(True)),
    "vcf_pi_sites": _pi_sql(_ONE_SITE).replace(_ALL, _LISTED_ONLY),
    "vcf_mask_pi": f"""WITH {_called(more=" AND chrom <> 'chr3'")}, {_WINDOWS.replace('win AS (', 'w0 AS (')}, win AS (SELECT * FROM w0 WHERE chrom <> 'chr3'), {_MASK},
parts AS (SELECT chrom, (pos - 1) // {SIZE} * {SIZE} + 1 AS w1, pop, {_PI_PARTS} FROM sp WHERE variable GROUP BY ALL UNION ALL SELECT chrom, w1, pop, 0, sum(n_inv * (k * (k - 1) // 2)), sum(n_inv * (whole - k * (k - 1) // 2)), coalesce(sum(n_inv) FILTER (k > 0), 0) FROM inv GROUP BY ALL),
g AS (SELECT chrom, w1, pop, sum(d) AS d, sum(c) AS c, sum(m) AS m, sum(s) AS s FROM parts GROUP BY ALL)
{_PI_OUT} FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop = p.pop""",
    "gvcf_pi": f"""WITH {_GVCF}, {_HAPS.replace(" WHERE chrom <> 'chr3'", "")}, {_GVCF_WINDOWS},
g AS (SELECT win.chrom, w1, w2, window_ord, pop, {_PI_PARTS} FROM sp JOIN win ON sp.chrom = win.chrom AND pos BETWEEN w1 AND w2 GROUP BY ALL)
{_PI_OUT} FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop = p.pop""",
    "vcf_pi_text": f"""SELECT concat_ws(chr(9), pop, chromosome, window_pos_1, window_pos_2, coalesce(printf('%.14g', raw), 'NA'), no_sites, coalesce(CAST(count_diffs AS VARCHAR), 'NA'), coalesce(CAST(count_comparisons AS VARCHAR), 'NA'), coalesce(CAST(count_missing AS VARCHAR), 'NA')) AS line
FROM (SELECT *, CASE WHEN count_comparisons > 0 THEN count_diffs / count_comparisons END AS raw FROM ({_pi_sql()}))""",
    "vcf_site_classes": f"""WITH {_ALL} SELECT chrom, CASE WHEN NOT variable THEN 'invariant' WHEN kind IN (4, 5, 6) THEN 'biallelic' WHEN kind IN (0, 3) THEN 'multiallelic' ELSE 'other' END AS site_class, CASE WHEN chrom = 'chr3' THEN 1 ELSE 2 END AS ploidy,
  count(DISTINCT row_id) AS n, CAST(sum(CAST(a1 >= 0 AS INT) + CASE WHEN chrom <> 'chr3' THEN CAST(a2 >= 0 AS INT) ELSE 0 END) AS BIGINT) AS called FROM calls0 GROUP BY ALL""",
    "vcf_contigs": "SELECT 'chr' || (o_orderkey % 3 + 1) AS chrom, CAST(min(o_orderkey // 3 + 1) AS BIGINT) AS first_pos, CAST(max(o_orderkey // 3 + 1) AS BIGINT) AS last_pos, CAST(o_orderkey % 3 AS BIGINT) AS place FROM orders GROUP BY ALL",
    "vcf_region_pi": _pi_sql("win AS (SELECT 'chr1' AS chrom, k * 100 + 101 AS w1, k * 100 + 200 AS w2, k AS window_ord FROM range(0, 3) t(k))"),
    "vcf_scaffolds_pi": f"""WITH {_called().replace("'chr' || (o % 3 + 1)", f"'s' || (o // {SCAFFOLD})").replace("o // 3 + 1 AS pos", f"o % {SCAFFOLD} + 1 AS pos").replace("WHERE chrom <> 'chr3'", "WHERE CAST(substr(chrom, 2) AS BIGINT) % 3 <> 2")},
win AS (SELECT chrom, k * 15 + 1 AS w1, k * 15 + 15 AS w2, k AS window_ord FROM (SELECT chrom, unnest(CASE WHEN e - 1 <= 15 THEN [0::BIGINT] ELSE range(0, ((e + 14) // 15 * 15 - 2) // 15 + 1) END) AS k FROM (SELECT 's' || (o_orderkey // {SCAFFOLD}) AS chrom, max(o_orderkey % {SCAFFOLD} + 1) AS e FROM orders GROUP BY 1))),
g AS (SELECT win.chrom, w1, w2, window_ord, pop, {_PI_PARTS} FROM sp JOIN win ON sp.chrom = win.chrom AND pos BETWEEN w1 AND w2 GROUP BY ALL)
{_PI_OUT} FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop = p.pop""",
    "gvcf_pi_sites": f"""WITH {_GVCF.replace("calls AS (", "calls1 AS (")}, listed AS (SELECT DISTINCT 'chr' || (o_orderkey % 3 + 1) AS chrom, o_orderkey // 3 * 4 + 1 + o_orderkey % 4 AS pos FROM orders WHERE o_orderkey % 7 < 4),
calls AS (SELECT c.* REPLACE (CASE WHEN l.pos IS NULL THEN -1 ELSE a1 END AS a1, CASE WHEN l.pos IS NULL THEN -1 ELSE a2 END AS a2) FROM calls1 c LEFT JOIN listed l ON l.chrom = c.chrom AND l.pos = c.pos), {_HAPS.replace(" WHERE chrom <> 'chr3'", "")},
win AS (SELECT 'chr2' AS chrom, k * {SIZE} + 1 AS w1, k * {SIZE} + {SIZE} AS w2, k AS window_ord FROM range(0, 3) t(k)),
g AS (SELECT win.chrom, w1, w2, window_ord, pop, {_PI_PARTS} FROM sp JOIN win ON sp.chrom = win.chrom AND pos BETWEEN w1 AND w2 GROUP BY ALL)
{_PI_OUT} FROM win w CROSS JOIN {_POPS} LEFT JOIN g ON g.chrom = w.chrom AND g.w1 = w.w1 AND g.pop = p.pop""",
    "vcf_pi_file": f"""SELECT CAST(0 AS BIGINT) AS line_number, concat_ws(chr(9), 'pop', 'chromosome', 'window_pos_1', 'window_pos_2', 'avg_pi', 'no_sites', 'count_diffs', 'count_comparisons', 'count_missing') AS line
UNION ALL SELECT row_number() OVER (ORDER BY chromosome, window_pos_1, pop), concat_ws(chr(9), pop, chromosome, window_pos_1, window_pos_2, coalesce(printf('%.14g', raw), 'NA'), no_sites, coalesce(CAST(count_diffs AS VARCHAR), 'NA'), coalesce(CAST(count_comparisons AS VARCHAR), 'NA'), coalesce(CAST(count_missing AS VARCHAR), 'NA'))
FROM (SELECT *, CASE WHEN count_comparisons > 0 THEN count_diffs / count_comparisons END AS raw FROM ({_pi_sql()}))""",
}
