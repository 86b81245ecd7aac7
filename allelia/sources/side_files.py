"""Populations, windows, site lists and callable masks from tab-separated files without a header line."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sites import Populations
from .staging import numbered_lines, staged


def _fields(spark: SparkSession, path: str, least: int, empty: str, short: str) -> DataFrame:
    """(line, f): cells of the lines that are not blank, stripped, in file order; fewer than ``least`` cells are an error."""
    text = staged(numbered_lines(spark, path).where(F.trim("value") != "").select(F.col("row_id").alias("line"), "value"))
    lines = text.select("line", F.transform(F.split("value", "\t"), lambda x: F.trim(x)).alias("f"))
    if not lines.where(F.size("f") < least).isEmpty():
        raise ValueError(short)
    filled = lines.where(~F.exists(F.slice("f", 1, least), lambda x: x == ""))
    if filled.isEmpty() or not lines.where(F.exists(F.slice("f", 1, least), lambda x: x == "")).isEmpty():
        raise ValueError(empty)
    return lines


def read_populations(spark: SparkSession, path: str) -> DataFrame:
    """(line, sample, pop) of a populations file."""
    rows = _fields(spark, path, 2, "The populations file has missing data, all samples must be assigned to a population.", "The populations file must have two columns: sample and population.")
    return rows.select("line", F.get("f", F.lit(0)).alias("sample"), F.get("f", F.lit(1)).alias("pop"))


def populations_of(rows: DataFrame, samples: list[str]) -> Populations:
    """Populations over the samples of a callset; samples that the callset lacks are an error. One row per sample reaches the driver."""
    found = rows.orderBy("line").collect()
    if missing := sorted({r["sample"] for r in found} - set(samples)):
        raise ValueError(f"The populations file has samples that the VCF lacks: {missing}")
    of = {r["sample"]: r["pop"] for r in found}
    return Populations(tuple(samples), tuple(of.get(s) for s in samples), tuple(dict.fromkeys(r["pop"] for r in found)))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, w1, w2, window_ord): 0-based half-open ranges become 1-based closed windows, in file order."""
    rows = _fields(spark, path, 3, "The BED file has missing data.", "The BED file must have three columns: chrom, start and end.")
    out = rows.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("s"), F.get("f", F.lit(2)).try_cast("long").alias("e"), F.col("line").alias("window_ord"))
    if not out.where("s is null or e is null or s < 0 or e <= s").isEmpty():
        raise ValueError("The BED file has starts or ends that are not integers, negative starts, or ends that are not after their starts.")
    return out.select("chrom", (F.col("s") + 1).alias("w1"), F.col("e").alias("w2"), "window_ord")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos), distinct."""
    rows = _fields(spark, path, 2, "The sites file has missing data.", "The sites file must have two columns: chrom and pos.")
    out = rows.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("int").alias("pos"))
    if not out.where("pos is null").isEmpty():
        raise ValueError("The sites file has positions that are not integers.")
    return out.distinct()


#: Fixed value of the mask format.
MASK_HEADER = "#wisp_mask_metadata\t"


@dataclass(frozen=True)
class MaskHeader:
    """The first line of a mask: populations, their sample counts and columns (from 1), and the threshold."""

    sample_counts: dict[str, int]
    columns: dict[str, int]
    threshold: int | None

    @staticmethod
    def parse(line: str) -> MaskHeader:
        if not line.startswith(MASK_HEADER):
            raise ValueError("The mask must begin with its metadata line.")
        try:
            data = json.loads(line[len(MASK_HEADER) :])
            names, counts = [str(p) for p in data["populations"]], {str(k): int(v) for k, v in data["population_sample_counts"].items()}
            columns = {str(c["name"]): int(c["column_number"]) for c in data["population_columns"]}
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise ValueError(f"The mask's metadata is malformed: {e}") from e
        if set(names) != set(counts) or set(names) != set(columns) or any(c < 4 for c in columns.values()):
            raise ValueError("The mask's metadata disagrees on its populations or their columns.")
        return MaskHeader({p: counts[p] for p in names}, columns, data.get("threshold"))


def read_mask(spark: SparkSession, path: str, order: tuple[str, ...]) -> tuple[MaskHeader, DataFrame]:
    """Header and rows (chrom, start0, end0, k) with the populations in the given order; every row is validated."""
    text = spark.read.text(path)
    head = text.where(F.col("value").startswith("#")).limit(1).collect()
    if not head:
        raise ValueError("The mask must begin with its metadata line.")
    header = MaskHeader.parse(head[0].value)
    if lacking := [p for p in order if p not in header.columns]:
        raise ValueError(f"The mask lacks populations: {lacking}")
    rows = text.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    if rows.isEmpty():
        raise ValueError("The mask has a header only.")
    k = F.array(*(F.get("f", F.lit(header.columns[p] - 1)).try_cast("long") for p in order))
    out = rows.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("start0"), F.get("f", F.lit(2)).try_cast("long").alias("end0"), k.alias("k"))
    most = F.array(*(F.lit(header.sample_counts[p]) for p in order))
    wrong = F.exists(F.zip_with("k", most, lambda x, m: x.isNull() | (x < 0) | (x > m)), lambda x: x)
    if not out.where(F.col("start0").isNull() | F.col("end0").isNull() | (F.col("end0") <= F.col("start0")) | wrong).isEmpty():
        raise ValueError("The mask has rows with too few fields, bad ranges, or counts outside 0 and the sample count.")
    return header, out


def check_mask(header: MaskHeader, pops: Populations) -> None:
    """The mask and the populations must have the same names and sample counts."""
    sizes = pops.sizes()
    if set(sizes) != set(header.sample_counts):
        raise ValueError(f"The mask's populations {sorted(header.sample_counts)} are not those of the populations file {sorted(sizes)}")
    if wrong := [p for p in sizes if sizes[p] != header.sample_counts[p]]:
        raise ValueError(f"The mask's sample counts differ from the populations file for {wrong}")
