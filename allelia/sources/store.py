"""Sites of a VCF as a store: packed genotypes sorted by contig and position, with a row of facts for each contig.

``build`` reads the text once. The header line comes first, from the first lines only. The records' lines are dealt out by a hash of their number, so
one compressed file is parsed by all tasks and read once; each task packs the genotypes into bit planes and writes its records sorted by contig
and position, in small row groups. Everything that an analysis has to know before it runs (extent, order, ploidy, longest block, and
whether there are blocks, invariant and variant sites) is one aggregation of narrow columns, kept as the table of contigs.

``save`` writes a store that later runs ``load``: range-partitioned by contig and position, in one folder for each shard of contigs. ``region`` reads
from either kind: the filters on contig and position reach Parquet's statistics, so what is read grows with the region. Blocks begin
before the positions that they cover, so the scan begins earlier by the longest block of the contig (the halo).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import packing
from ..operators.sites import snp
from . import staging, vcf

SHARDS = 64
ROW_GROUP = 8 << 20
#: Tables of contigs with at most so many rows (some 60 bytes each) go to the tasks whole.
SENT_CONTIGS = 1_000_000


@dataclass(frozen=True)
class SiteStore:
    """records: site rows, sorted in their files. contigs: (chrom, chrom_rank, first, last, ploidy, halo, blocks, invariant, variant). sharded: whether
    records have a column ``shard`` that is a folder."""

    records: DataFrame
    contigs: DataFrame
    samples: tuple[str, ...]
    sharded: bool = False

    def facts(self):
        """One row over the contigs: n, low and high ploidy, halo, blocks, invariant, variant."""
        return self.contigs.agg(
            F.count("*").alias("n"), F.coalesce(F.min("ploidy"), F.lit(1)).alias("low"), F.coalesce(F.max("ploidy"), F.lit(1)).alias("high"), F.coalesce(F.max("halo"), F.lit(0)).alias("halo"),
            *(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("blocks", "invariant", "variant")),
        ).first()

    def of_contigs(self, names: list[str]) -> SiteStore:
        """Only some contigs; unknown names are an error."""
        own = self.contigs.where(F.col("chrom").isin(names))
        known = {r.chrom for r in own.select("chrom").collect()}  # at most as many as are named
        if lacking := [c for c in names if c not in known]:
            raise ValueError(f"These chromosomes are not in the VCF: {lacking}")
        records = self.records.where(F.col("chrom").isin(names))
        if self.sharded:
            records = records.where(F.col("shard").isin([shard(F.lit(c)) for c in names]))
        return replace(self, records=records, contigs=own)

    def region(self, start: int, end: int, halo: int | None = None) -> DataFrame:
        """Records that touch the positions from start to end, of the contigs at hand. halo: that of ``facts``, if it is known."""
        halo = self.facts().halo if halo is None else halo
        return self.records.where(F.col("pos").between(start - halo, end) & (F.col("span_end") >= start))

    def with_contig(self, rows: DataFrame, *columns: str | Column) -> DataFrame:
        """Join facts of the rows' contigs; rows of other contigs go. The table is sent to the tasks if it is of a checked size."""
        facts = self.contigs.select("chrom", *columns)
        return rows.join(F.broadcast(facts) if self.contigs.count() <= SENT_CONTIGS else facts, "chrom")


def shard(chrom: Column) -> Column:
    return F.pmod(F.xxhash64(chrom), F.lit(SHARDS)).cast("int")


def parsed(lines: DataFrame, samples: int, variants_only: bool = False) -> DataFrame:
    """(row_id, chrom, pos, span_end, ref, n_alts, alts, is_snp, info_end, block, bits, top, site_ploidy) of the record lines.

    variants_only: the genotypes of lines without ALT are not packed (their bits are those of a site without calls)."""
    head = F.split("value", "\t", 10)
    cell = lambda i: F.get("_h", F.lit(i))
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("_h", head)
    alts = F.when(cell(4) == ".", F.expr("cast(array() as array<string>)")).otherwise(F.split(cell(4), ","))
    rows = rows.select("row_id", cell(0).alias("chrom"), cell(1).try_cast("int").alias("pos"), cell(3).alias("ref"), alts.alias("alts"), K.info_end(cell(7)).alias("info_end"), cell(9).alias("calls"))
    span = F.greatest("pos", F.coalesce("info_end", "pos"))
    block = F.exists("alts", lambda a: a.isin(*vcf.BLOCK_ALTS)) | F.coalesce(F.col("info_end") > F.col("pos"), F.lit(False))
    calls = F.when(F.size("alts") > 0, F.col("calls")) if variants_only else F.col("calls")
    rows = rows.select("row_id", "chrom", "pos", span.alias("span_end"), "ref", F.size("alts").alias("n_alts"), "alts", snp(F.col("ref"), F.col("alts")).alias("is_snp"), "info_end", block.alias("block"), calls.alias("calls"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(packing.pack_calls(samples), f"{kept}, bits array<long>, top int, site_ploidy int")


def contig_facts(records: DataFrame) -> DataFrame:
    """A row for each contig. The ploidy is the first over 1 that a sample field has, else 1."""
    return records.groupBy("chrom").agg(
        F.min("row_id").alias("chrom_rank"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.coalesce(F.min(F.when(F.col("site_ploidy").isNotNull(), F.struct("row_id", "site_ploidy")))["site_ploidy"], F.lit(1)).alias("ploidy"),
        F.max(F.col("span_end") - F.col("pos")).alias("halo"), F.max("block").alias("blocks"), F.max(F.col("n_alts") == 0).alias("invariant"), F.max(F.col("n_alts") > 0).alias("variant"),
    )


def build(spark: SparkSession, path: str, variants_only: bool = False) -> SiteStore:
    """The store of a VCF, in the shared folder."""
    lines = vcf.read_lines(spark, path)
    samples = tuple(vcf.read_samples(lines))  # stops at the header line
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.rdd.getNumPartitions())
    records = parsed(lines.repartition(many, F.xxhash64("row_id")), len(samples), variants_only)
    records = staging.staged(records, "chrom", "pos", "row_id", **{"parquet.block.size": str(ROW_GROUP)})
    return SiteStore(records, staging.staged(contig_facts(records)), samples)


def save(store: SiteStore, path: str) -> None:
    """Write a store for later runs."""
    spark, path = store.records.sparkSession, path.rstrip("/")
    order = ["shard", "chrom", "pos", "row_id"]
    rows = store.records.withColumn("shard", shard(F.col("chrom"))).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.partitionBy("shard").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/sites")
    store.contigs.repartitionByRange("chrom_rank").sortWithinPartitions("chrom_rank").write.parquet(f"{path}/contigs")
    spark.createDataFrame(list(enumerate(store.samples)), "i int, sample string").coalesce(1).write.parquet(f"{path}/samples")


def load(spark: SparkSession, path: str) -> SiteStore:
    """A store that ``save`` wrote."""
    path = path.rstrip("/")
    samples = tuple(r["sample"] for r in sorted(spark.read.parquet(f"{path}/samples").collect()))  # a row for each sample
    return SiteStore(spark.read.parquet(f"{path}/sites"), spark.read.parquet(f"{path}/contigs"), samples, sharded=True)
