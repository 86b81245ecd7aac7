"""A whole analysis from files: configuration, checks, statistics, tab-separated output."""

from __future__ import annotations

import argparse
import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callable_mask, fused, pairs, sites, stats, windows
from ..sources import side_files, staging, store, vcf

log = logging.getLogger(__name__)
STATS = ("pi", "dxy", "fst", "watterson_theta", "tajima_d")


@dataclass(frozen=True)
class AnalysisConfig:
    """vcf: VCF text; or store: a folder that ``sources.store.save`` wrote, of which an interval reads only its row groups."""

    vcf: str | None = None
    populations: str | None = None
    stats: tuple[str, ...] = ()
    store: str | None = None
    window_size: int | None = None
    bed_file: str | None = None
    sites_file: str | None = None
    mask: str | None = None
    chromosomes: tuple[str, ...] | None = None
    interval_start: int | None = None
    interval_end: int | None = None
    fst_type: str = "wc"
    fst_components: bool = False
    tajima_components: bool = False
    include_multiallelic_snps: bool = False
    bypass_invariant_check: bool = False
    gvcf: bool = False
    output_folder: str | None = None
    output_prefix: str = "allelia"
    output_format: str = "tsv"

    def check(self) -> None:
        """Conflicts that need no data."""
        if not self.stats or set(self.stats) - set(STATS):
            raise ValueError(f"stats must be some of {', '.join(STATS)}")
        if (self.vcf is None) == (self.store is None) or self.populations is None:
            raise ValueError("A VCF or a store, and a populations file are needed.")
        if (self.window_size is None) == (self.bed_file is None):
            raise ValueError("Either a window size or a BED file must be given, and not both.")
        if self.window_size is not None and self.window_size < 1:
            raise ValueError("The window size must be positive.")
        if (self.interval_start is None) != (self.interval_end is None):
            raise ValueError("An interval needs both its start and its end.")
        if self.interval_start is not None:
            if self.bed_file is not None:
                raise ValueError("An interval and a BED file cannot be combined.")
            if self.chromosomes is None or len(self.chromosomes) != 1:
                raise ValueError("An interval needs exactly one chromosome.")
            if self.interval_start > self.interval_end:
                raise ValueError(f"An interval cannot begin behind its end: its start {self.interval_start} exceeds {self.interval_end}")
        if self.gvcf and self.mask:
            raise ValueError("A gVCF and a callable mask cannot be combined.")
        if self.fst_type not in ("wc", "hudson"):
            raise ValueError(f"The FST type is wc or hudson, not {self.fst_type}")
        if self.output_format not in ("tsv", "parquet"):
            raise ValueError("The output format is tsv or parquet.")
        if "/" in self.output_prefix:
            raise ValueError("The output prefix must not contain slashes.")


def analyse(spark: SparkSession, config: AnalysisConfig) -> dict[str, DataFrame]:
    """The results by statistic, in output order of columns (with chrom_rank and window_ord behind).

    The text is parsed once (or a saved store is read), the genotypes are counted and summed once for all statistics; the results are small plans over these sums.
    """
    config.check()
    needs = {"pi", "dxy", "watterson_theta", "tajima_d"} & set(config.stats)
    variants_only = bool(config.mask) or not needs
    loaded = store.load(spark, config.store) if config.store else None
    samples = loaded.samples if loaded else vcf.read_samples(vcf.read_lines(spark, config.vcf))
    pops = side_files.populations_of(side_files.read_populations(spark, config.populations), list(samples))
    if {"fst", "dxy"} & set(config.stats) and len(pops.order) < 2:
        raise ValueError("fst and dxy need two populations or more.")
    # where no statistic takes invariant sites, their genotypes are not parsed
    sited = loaded or store.build(spark, config.vcf, variants_only)
    if config.chromosomes:
        sited = sited.of_contigs(list(config.chromosomes))
    facts = sited.facts()
    if config.gvcf != facts.blocks:
        raise ValueError("The VCF has reference blocks but is not declared a gVCF." if not config.gvcf else "The VCF has no reference blocks but is declared a gVCF.")
    if needs and not (config.bypass_invariant_check or config.mask or config.gvcf) and not facts.invariant:
        raise ValueError("All records of the VCF have an ALT allele: with no invariant sites, pi, dxy and theta have wrong denominators.")
    if not facts.variant:
        log.warning("The VCF has no variant site: every ALT is '.'")
    mask = None
    if config.mask:
        header, mask = side_files.read_mask(spark, config.mask, pops.order)
        side_files.check_mask(header, pops)
    listed = side_files.read_sites(spark, config.sites_file) if config.sites_file else None
    table, spans = _windows(spark, config, sited, listed)
    counted = _counted(config, sited, facts, pops, listed, spans, variants_only)
    at, comps = _summed(config, counted, table, spans, pops, _skipped(config, sited, facts))
    ploidy = facts.high if facts.low == facts.high else None
    ranges = None
    if mask is not None:
        ranges = callable_mask.invariant_ranges(table, mask, counted.where("site_class <> 'invariant'"))
        ranges = staging.staged(ranges if ploidy else sited.with_contig(ranges, "ploidy"))
    results = {}
    masked = lambda f: f(ranges, pops, ploidy) if ranges is not None else None
    for stat in config.stats:
        if stat == "pi":
            results[stat] = stats.pi_result(fused.pi_sums(comps), table, pops, masked(callable_mask.pi_mask))
        elif stat == "dxy":
            results[stat] = stats.dxy_result(fused.dxy_sums(comps), table, pops, masked(callable_mask.dxy_mask))
        elif stat == "watterson_theta":
            results[stat] = stats.watterson_result(fused.classes(comps), table, pops, facts.high, masked(callable_mask.class_mask))
        elif stat == "tajima_d":
            results[stat] = stats.tajima_result(fused.classes(comps), table, pops, facts.high, config.tajima_components, masked(callable_mask.class_mask))
        elif at is not None:
            # a projection of the sites in the windows, which for a list of sites are the listed ones
            results[stat] = stats.fst_per_site(at, pops, config.fst_type, config.fst_components).withColumn("window_ord", F.col("window_pos_1"))
        elif not _skipped(config, sited, facts):
            results[stat] = stats.fst_result(fused.fst_sums(comps), config.fst_type, config.fst_components)
    if not results:
        raise ValueError("No statistic has a result.")
    return {stat: sited.with_contig(df.withColumn("chrom", F.col("chromosome")), "chrom_rank").drop("chrom") for stat, df in results.items()}


def _skipped(config: AnalysisConfig, sited: store.SiteStore, facts) -> bool:
    """Whether FST has no contig to take; warns of contigs that it leaves out."""
    if "fst" not in config.stats or config.fst_type != "wc" or facts.low == facts.high == 2:
        return False
    other = sited.contigs.where("ploidy <> 2").select("chrom").limit(20).collect()
    log.warning("Weir-Cockerham FST is skipped on contigs that are not diploid: %s", [r.chrom for r in other])
    return sited.contigs.where("ploidy = 2").isEmpty()


def _counted(config: AnalysisConfig, sited: store.SiteStore, facts, pops, listed: DataFrame | None, spans: DataFrame | None, variants_only: bool) -> DataFrame:
    """The sites that count, with allele counts of the populations; where contigs differ, with their ploidy and their windows' start and end."""
    rows = sited.records
    if config.interval_start is not None:
        rows = sited.region(config.interval_start, windows.last_of(config.interval_start, config.interval_end, config.window_size), facts.halo)
    if variants_only:
        rows = rows.where("n_alts > 0")
    rows = rows.select("chrom", "pos", "row_id", "alts", "is_snp", "info_end", "bits", "top")
    if config.gvcf:
        rows = sites.blocks_with_listed(rows, listed) if listed is not None else sites.blocks_as_sites(rows)
    kept = sites.retained(rows, config.include_multiallelic_snps, variants_only=variants_only)
    if listed is not None and not config.gvcf:
        # rows at other positions meet no window of a single listed site
        kept = sites.listed_only(kept, listed) if _at_listed(config) else sites.masked(kept, listed)
    if spans is not None:
        ends = spans.select("chrom", "start", windows.last_position(config.window_size).alias("_last"))
        ends = sited.contigs.select("chrom", "ploidy").join(ends, "chrom")
        if facts.low == facts.high:
            ends = ends.drop("ploidy")
        kept = kept.join(F.broadcast(ends) if facts.n <= store.SENT_CONTIGS else ends, "chrom")  # a row for each contig
    elif facts.low != facts.high:
        kept = sited.with_contig(kept, "ploidy")
    return sites.with_populations(kept, pops, "fst" in config.stats and config.fst_type == "wc", facts.high)


def _at_listed(config: AnalysisConfig) -> bool:
    """Whether the windows are the single positions of the list of sites."""
    return config.sites_file is not None and config.window_size == 1 and config.interval_start is None


def _summed(config: AnalysisConfig, counted: DataFrame, table: DataFrame, spans: DataFrame | None, pops, no_fst: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """The sites for FST of single sites, if that is asked for; and the sums of all other statistics by window, stored."""
    single = "fst" in config.stats and config.window_size == 1 and not no_fst
    fused_stats = tuple(s for s in config.stats if s != "fst" or not (single or no_fst))

    def assigned(df: DataFrame) -> DataFrame:
        if _at_listed(config):
            return windows.assign_intervals(df, table, windows.FINE) if config.gvcf else windows.assign_sites(df)
        if spans is None:
            return windows.assign_intervals(df, table)
        # a window past the last one of the table holds no rows
        return windows.assign_fixed(df, None, config.window_size).where("w2 <= _last")

    at = comps = None
    if single:
        at = assigned(counted.where("site_class <> 'invariant'" + (" and ploidy = 2" if config.fst_type == "wc" and "ploidy" in counted.columns else ""))).drop("w1", "w2", "window_ord", "mult")
    if fused_stats:
        if config.bed_file:
            cells = _components(config, windows.assign_cells(counted, table), pops, fused_stats, ("chrom", "bin", "cell"))
            comps = windows.gather(staging.staged(cells), table, fused.PARTS, fused.SUMS)
        else:
            comps = _components(config, assigned(counted), pops, fused_stats, windows.KEYS)
        comps = staging.staged(comps)
    return at, comps


def _components(config: AnalysisConfig, at: DataFrame, pops, chosen: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """The sums of ``fused.components``; those of the pairs of many populations as matrix products, where all that is asked of pairs has that form."""
    paired = [s for s in chosen if s in fused.PAIRED]
    if len(pops.order) < pairs.MANY or not paired or "fst" in paired and config.fst_type == "wc":
        return fused.components(at, pops, chosen, config.fst_type, keys)
    found = pairs.as_components(pairs.pair_sums(at, pops, keys), keys)
    single = tuple(s for s in chosen if s in fused.SINGLE)
    return found.unionByName(fused.components(at, pops, single, keys=keys)) if single else found


def _windows(spark: SparkSession, config: AnalysisConfig, sited: store.SiteStore, listed: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The window table, and the spans of fixed windows."""
    known = sited.contigs.select("chrom")
    if config.bed_file:
        table = side_files.read_bed(spark, config.bed_file)
        _warn_unknown(table, known, "BED file")
        return table.join(known, "chrom", "left_semi"), None
    if listed is not None:
        _warn_unknown(listed, known, "sites file")
        listed = listed.join(known, "chrom", "left_semi")
    if _at_listed(config):
        return windows.site_windows(listed), None
    if config.interval_start is not None:
        spans = known.select("chrom", F.lit(config.interval_start).cast("long").alias("start"), F.lit(config.interval_end).cast("long").alias("end"))
    elif listed is None:
        spans = sited.contigs.select("chrom", F.lit(1).cast("long").alias("start"), F.col("last").cast("long").alias("end"))
    else:
        spans = windows.extents(listed, start=None)
    return windows.fixed_windows(spans, config.window_size), spans


def _warn_unknown(table: DataFrame, known: DataFrame, what: str) -> None:
    unknown = [r.chrom for r in table.join(known, "chrom", "left_anti").select("chrom").distinct().limit(20).collect()]
    if unknown:
        log.warning("The %s names contigs that the VCF lacks: %s", what, unknown)


def shown(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Doubles with 14 significant digits; NA for null and NaN."""
    for v in values:
        yield v.map(lambda x: "NA" if pd.isna(x) else f"{x:.14g}")


def text_rows(result: DataFrame) -> DataFrame:
    """Output lines of a result, sorted by contig, window and population; the sort keys are kept out of the lines."""
    hidden = [c for c in ("chrom_rank", "window_ord", "pop_rank") if c in result.columns]
    as_text = F.pandas_udf(shown, "string")
    cells = [as_text(F.col(n)) if t == "double" else F.coalesce(F.col(n).cast("string"), F.lit("NA")) for n, t in result.dtypes if n not in hidden]
    order = [c for c in ("chrom_rank", "window_pos_1", "window_ord", "pop_rank", "pop1", "pop2") if c in result.columns]
    return result.orderBy(*order).select(F.concat_ws("\t", *cells).alias("value"))


def write_tables(results: dict[str, DataFrame], config: AnalysisConfig) -> list[str]:
    """A Parquet folder ``<prefix>_<stat>.parquet`` for each statistic, range-partitioned in output order and written by the tasks."""
    paths = []
    for stat, df in results.items():
        path = f"{(config.output_folder or '.').rstrip('/')}/{config.output_prefix}_{stat}.parquet"
        order = [c for c in ("chrom_rank", "window_pos_1", "window_ord", "pop_rank", "pop1", "pop2") if c in df.columns]
        df.orderBy(*order).drop("chrom_rank", "window_ord", "pop_rank").write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths


def write_results(results: dict[str, DataFrame], config: AnalysisConfig) -> list[str]:
    """The results in the configured format. As tab-separated text: the tasks write sorted parts to the shared folder, and the parts' bytes are put
    together behind a line of names as one file ``<prefix>_<stat>.txt`` for each statistic, in any file system that Hadoop knows. No row passes through the driver's Python."""
    if config.output_format == "parquet":
        return write_tables(results, config)
    folder = config.output_folder or "."
    paths = []
    for stat, df in results.items():
        names = [c for c in df.columns if c not in ("chrom_rank", "window_ord", "pop_rank")]
        parts = staging.new_path(df.sparkSession)
        text_rows(df).write.text(parts)
        paths.append(f"{folder.rstrip('/')}/{config.output_prefix}_{stat}.txt")
        _put_together(df.sparkSession, "\t".join(names) + "\n", parts, paths[-1])
    for stat in config.stats:
        if stat not in results:
            log.warning("No result for %s", stat)
    return paths


def _put_together(spark: SparkSession, head: str, parts: str, path: str) -> None:
    """One file of a first line and the files of a folder in order of their names."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{os.path.abspath(path)}")
    of, to = source.getFileSystem(conf), target.getFileSystem(conf)
    try:
        out = to.create(target, True)
    except Exception as e:
        raise PermissionError(f"{path} cannot be written.") from e
    try:
        out.write(bytearray(head.encode()))
        for name in sorted(str(f.getPath()) for f in of.listStatus(source) if f.getPath().getName().startswith("part-")):
            piece = of.open(jvm.org.apache.hadoop.fs.Path(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
            piece.close()
    finally:
        out.close()


def main(argv: list[str] | None = None) -> list[str]:
    """Command line with the options of ``AnalysisConfig``."""
    p = argparse.ArgumentParser(prog="allelia")
    p.add_argument("--stats", nargs="+", choices=STATS, required=True)
    p.add_argument("--populations", required=True)
    for name in ("window_size", "interval_start", "interval_end"):
        p.add_argument(f"--{name}", type=int)
    for name in ("vcf", "store", "bed_file", "sites_file", "mask", "chromosomes", "output_folder"):
        p.add_argument(f"--{name}")
    p.add_argument("--output_prefix", default="allelia")
    p.add_argument("--output_format", choices=("tsv", "parquet"), default="tsv")
    p.add_argument("--fst_type", choices=("wc", "hudson"), default="wc")
    for name in ("fst_components", "tajima_components", "include_multiallelic_snps", "bypass_invariant_check", "gvcf"):
        p.add_argument(f"--{name}", action="store_true")
    args = vars(p.parse_args(argv))
    chromosomes = args.pop("chromosomes")
    config = AnalysisConfig(**args | {"stats": tuple(args["stats"])})
    if chromosomes and chromosomes != "all":
        config = replace(config, chromosomes=tuple(chromosomes.split(",")))
    spark = SparkSession.builder.appName("allelia").getOrCreate()
    return write_results(analyse(spark, config), config)


if __name__ == "__main__":
    main()
