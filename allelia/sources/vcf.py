"""VCF text as site rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators.sites import ploidy_by_contig, snp
from .staging import numbered_lines, staged

BLOCK_ALTS = ("<NON_REF>", "<*>")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value) of all lines, in order; a gzip file is one partition, so use ``staged_records`` for more than one pass."""
    try:
        return numbered_lines(spark, path)
    except AnalysisException as e:
        raise FileNotFoundError(f"There is no VCF at {path}") from e


def read_samples(lines: DataFrame) -> list[str]:
    """Sample names of the #CHROM line."""
    head = lines.where(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not head:
        raise ValueError("The VCF has no #CHROM line.")
    return head[0].value.split("\t")[9:]


def read_records(lines: DataFrame, variants_only: bool = False) -> DataFrame:
    """(row_id, chrom, pos, ref, alts, info, gts): the first five cells are cut before the samples, so invariant lines
    can be left out without splitting them."""
    head = F.split("value", "\t", 6)
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("_h", head)
    if variants_only:
        rows = rows.where(F.get("_h", F.lit(4)) != ".")
    cells = F.split("value", "\t")
    alts = F.when(F.get("_h", F.lit(4)) == ".", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.get("_h", F.lit(4)), ","))
    return rows.select("row_id", F.get("_h", F.lit(0)).alias("chrom"), F.get("_h", F.lit(1)).try_cast("int").alias("pos"), F.get("_h", F.lit(3)).alias("ref"), alts.alias("alts"), F.get(cells, F.lit(7)).alias("info"), F.slice(cells, 10, F.greatest(F.lit(0), F.size(cells) - 9)).alias("gts"))


def staged_records(lines: DataFrame) -> DataFrame:
    """The records of all lines with their cells as text, parsed and written once. The lines are dealt out by a hash of row_id before their cells are split,
    so one compressed file is read once and parsed by all tasks. ``store.build`` packs the genotypes instead."""
    many = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(read_records(lines.repartition(many, F.xxhash64("row_id"))), "row_id")


def sites_of(records: DataFrame, ploidy: DataFrame | None = None) -> DataFrame:
    """Site rows with genotypes; ploidy by contig is inferred where it is not given."""
    by = ploidy_by_contig(records) if ploidy is None else ploidy
    rows = records.join(F.broadcast(by), "chrom")  # a row per contig
    gt = F.transform("gts", lambda g: K.gt_alleles(g, F.col("ploidy")))
    return rows.select("chrom", "pos", "row_id", "ref", "alts", snp(F.col("ref"), F.col("alts")).alias("is_snp"), K.info_end(F.col("info")).alias("info_end"), gt.alias("gt"), "ploidy")


def has_invariant_sites(records: DataFrame) -> bool:
    return not records.where(F.size("alts") == 0).isEmpty()


def has_variant_sites(records: DataFrame) -> bool:
    return not records.where(F.size("alts") > 0).isEmpty()


def has_blocks(records: DataFrame) -> bool:
    marked = F.exists("alts", lambda a: a.isin(*BLOCK_ALTS)) | (K.info_end(F.col("info")) > F.col("pos"))
    return not records.where(marked).isEmpty()


def contigs(records: DataFrame) -> DataFrame:
    """(chrom, chrom_rank, first, last): contigs in order of appearance with their extent."""
    return records.groupBy("chrom").agg(F.min("row_id").alias("chrom_rank"), F.min("pos").alias("first"), F.max("pos").alias("last"))
