"""Genotype calls derived from the driver's tables (orders x the first suppliers), as site rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sites import Populations

SAMPLES = 10
POPULATIONS = Populations(tuple(str(i) for i in range(SAMPLES)), tuple("AB"[i % 2] for i in range(SAMPLES)), ("A", "B"))
THREE = Populations(POPULATIONS.samples, tuple("ABC"[i % 3] for i in range(SAMPLES)), ("A", "B", "C"))


def order_sites(spark: SparkSession, sf_dir: str, extra_allele: bool = False) -> DataFrame:
    """One site per order: contig from the key modulo 3, position from the key; genotypes by integer arithmetic, as bit planes.

    ``extra_allele`` turns some alternate alleles into a second one.
    """
    return genotyped(spark.read.parquet(f"{sf_dir}/orders.parquet"), extra_allele)


def arriving_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sites as a stream, in micro-batches of files."""
    path = f"{sf_dir}/orders.parquet"
    # a pattern, as a stream's path may be one file only that way
    return genotyped(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))


def plane(value: str, step, n: int) -> F.Column:
    """The samples s with (value + step(s)) % n = 0, as bits: as that depends on a small remainder only, a lookup by remainder."""
    words = ", ".join(f"{sum(1 << s for s in range(SAMPLES) if (r + step(s)) % n == 0)}L" for r in range(n))
    return F.expr(f"get(array({words}), cast(pmod({value}, {n}) as int))")


def genotyped(orders: DataFrame, extra_allele: bool = False) -> DataFrame:
    """Site rows of orders, from a table or a stream."""
    rows = orders.select("o_orderkey", "o_custkey").withColumns({
        "_missing": plane("o_orderkey * 31", lambda s: 17 * s, 13),
        "_first": plane("o_orderkey * 7 + o_custkey", lambda s: 3 * s * s, 4),
        "_other": plane("o_orderkey * 11 + o_custkey", lambda s: 5 * s, 3),
        "_second": plane("o_orderkey", lambda s: s, 4),
    })
    varies = "o_custkey % 5 = 0"
    called = f"({(1 << SAMPLES) - 1}L & ~_missing)"
    first, other, second = f"({called} & _first)", f"({called} & _other & ~_second)", f"({called} & _other & _second)"
    planes = [[first, "0L"], [other, second]] if extra_allele else [[first], [f"({called} & _other)"]]
    bits = ", ".join(w for h in planes for w in [called, *(f"if({varies}, {x}, 0L)" for x in h)])
    alts = F.when(~F.expr(varies), F.expr("cast(array() as array<string>)")).when(F.lit(extra_allele), F.array(F.lit("C"), F.lit("G"))).otherwise(F.array(F.lit("C")))
    return rows.select(
        F.concat(F.lit("chr"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("chrom"),
        (F.expr("o_orderkey div 3") + 1).alias("pos"),
        F.col("o_orderkey").alias("row_id"),
        alts.alias("alts"),
        F.lit(True).alias("is_snp"),
        F.lit(None).cast("int").alias("info_end"),
        F.expr(f"array({bits})").alias("bits"),
        F.lit(2 if extra_allele else 1).alias("top"),
    )
