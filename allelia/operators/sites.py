"""Site classes, site lists, reference blocks, ploidy, and allele counts per population.

A site is a row (chrom, pos, row_id, alts, is_snp, info_end) with its genotypes: as bit planes (bits, top, ploidy; see functions.packing), which
is how files and the driver's tables are read, or as gt, array<array<int>> with one entry per sample and -1 for missing.
Positions may repeat: every row is a site of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import packing


@dataclass(frozen=True)
class Populations:
    """Samples in the order of the genotype array, and the population of each (None: in none). Populations rank by first
    appearance in ``order``."""

    samples: tuple[str, ...]
    of_sample: tuple[str | None, ...]
    order: tuple[str, ...]

    def indices(self, pop: str) -> list[int]:
        return [i for i, p in enumerate(self.of_sample) if p == pop]

    def sizes(self) -> dict[str, int]:
        return {p: len(self.indices(p)) for p in self.order}


SNP = r"^[ACGTNacgtn]$"


def snp(ref: Column, alts: Column) -> Column:
    """REF and every ALT are single nucleotides (``*`` counts too)."""
    return ref.rlike(SNP) & F.forall(alts, lambda a: a.rlike(SNP) | (a == "*"))


def classified(sites: DataFrame) -> DataFrame:
    """Add site_class: invariant (no ALT, REF of any length), biallelic, multiallelic, or other (indels, symbols)."""
    n = F.size("alts")
    kind = F.when(n == 0, "invariant").when(F.col("is_snp") & (n == 1), "biallelic").when(F.col("is_snp"), "multiallelic").otherwise("other")
    return sites.withColumn("site_class", kind)


def retained(sites: DataFrame, multiallelic: bool = False, variants_only: bool = False) -> DataFrame:
    kinds = ["biallelic"] + ["multiallelic"] * multiallelic + ["invariant"] * (not variants_only)
    return classified(sites).where(F.col("site_class").isin(kinds))


def masked(sites: DataFrame, listed: DataFrame) -> DataFrame:
    """Genotypes of positions that are not in (chrom, pos) become missing; the rows stay and count as missing.

    The listed positions are a broadcast only if Spark finds them small enough; else both sides shuffle by position."""
    hit = listed.select("chrom", "pos").distinct().withColumn("_hit", F.lit(True))
    rows = sites.join(hit, ["chrom", "pos"], "left")
    if "bits" in sites.columns:
        return rows.withColumn("bits", F.when(F.col("_hit"), F.col("bits"))).drop("_hit")
    none = F.transform("gt", lambda g: F.transform(g, lambda _: F.lit(-1)))
    return rows.withColumn("gt", F.when(F.col("_hit"), F.col("gt")).otherwise(none)).drop("_hit")


def listed_only(sites: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows at positions that are in (chrom, pos)."""
    return sites.join(listed.select("chrom", "pos"), ["chrom", "pos"], "left_semi")


def is_block() -> Column:
    return F.coalesce(F.col("info_end") > F.col("pos"), F.lit(False))


def expanded(sites: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Reference blocks become one invariant row for each position, clipped to [start, end]; other rows are clipped only."""
    low = F.col("pos") if start is None else F.greatest("pos", F.lit(start))
    high = F.when(is_block(), F.col("info_end")).otherwise(F.col("pos"))
    high = high if end is None else F.least(high, F.lit(end))
    block = is_block()
    rows = sites.where(low <= high).withColumn("_block", block).withColumn("_at", F.explode(F.sequence(low, high)))
    return (
        rows.withColumn("alts", F.when(F.col("_block"), F.expr("cast(array() as array<string>)")).otherwise(F.col("alts")))
        .withColumn("is_snp", F.col("is_snp") & ~F.col("_block"))
        .withColumn("info_end", F.when(~F.col("_block"), F.col("info_end")))
        .withColumn("pos", F.col("_at"))
        .drop("_at", "_block")
    )


def blocks_as_sites(sites: DataFrame) -> DataFrame:
    """Reference blocks stay one row, as invariant sites that span pos..span_end."""
    block = is_block()
    return (
        sites.withColumn("span_end", F.when(block, F.col("info_end")).otherwise(F.col("pos")))
        .withColumn("alts", F.when(block, F.expr("cast(array() as array<string>)")).otherwise(F.col("alts")))
        .withColumn("is_snp", F.col("is_snp") & ~block)
    )


def blocks_with_listed(sites: DataFrame, listed: DataFrame, width: int = 16_384) -> DataFrame:
    """``blocks_as_sites`` and ``masked`` at once: reference blocks of which only listed positions count, others are missing.

    A block stays one row without calls; each listed position in it adds a row with its calls, and one without calls of
    weight -1. So there are as many rows as blocks and listed positions, not as positions. Needs bit planes."""
    rows = blocks_as_sites(sites).withColumn("weight", F.lit(1).cast("long")).withColumn("_block", is_block())
    other = masked(rows.where("not _block"), listed)
    blocks = rows.where("_block")
    binned = blocks.withColumn("_bin", F.explode(F.expr(f"sequence(pos div {width}, span_end div {width})")))
    at = listed.select("chrom", F.col("pos").alias("_at")).distinct().withColumn("_bin", F.expr(f"_at div {width}"))
    met = binned.join(at, ["chrom", "_bin"]).where("_at between pos and span_end").withColumn("pos", F.col("_at")).withColumn("span_end", F.col("_at")).drop("_at", "_bin")
    no_calls = lambda df: df.withColumn("bits", F.lit(None).cast("array<bigint>"))
    whole = no_calls(blocks).unionByName(met).unionByName(no_calls(met).withColumn("weight", F.lit(-1).cast("long")))
    return whole.unionByName(other.select(whole.columns)).drop("_block")


def row_ploidy(gts: Column) -> Column:
    """The first ploidy over 1 among the sample fields of a row, or null; mostly the first field decides, and the others are not looked at."""
    one = lambda g: K.gt_ploidy(F.element_at(F.split(g, ":"), 1))
    first = one(F.get(gts, F.lit(0)))
    return F.when(first > 1, first).otherwise(F.get(F.filter(F.transform(gts, one), lambda p: p > 1), F.lit(0)))


def ploidy_by_contig(raw: DataFrame) -> DataFrame:
    """(chrom, ploidy) from (chrom, row_id, gts array<string>): the first sample field with ploidy over 1 decides, else 1.

    No sample becomes a row: the first fitting field is found inside each row's array, and the first row by a minimum."""
    each = raw.select("chrom", "row_id", row_ploidy(F.col("gts")).alias("p"))
    first = each.groupBy("chrom").agg(F.min(F.when(F.col("p").isNotNull(), F.struct("row_id", "p"))).alias("first"))
    return first.select("chrom", F.coalesce("first.p", F.lit(1)).alias("ploidy"))


def with_populations(sites: DataFrame, pops: Populations, heterozygotes: bool = False, haplotypes: int | None = None) -> DataFrame:
    """Add p: array<struct<pop, pop_rank, ac, n, n01, n_haps[, het]>>, one entry per population, and n_alleles_all over all samples.

    haplotypes: of bit planes, the largest ploidy (2 if it is not given).

    One row stays one row: nothing is exploded or shuffled here.
    """
    if "bits" in sites.columns:
        return _from_planes(sites, pops, heterozygotes, haplotypes)
    flat = F.flatten("gt")
    rows = sites.withColumn("_top", F.greatest(F.coalesce(F.array_max(flat), F.lit(0)), F.lit(1)))
    rows = rows.withColumn("n_alleles_all", F.size(F.array_distinct(F.array_remove(flat, -1))))
    rows = rows.withColumns({f"_g{k}": _members(pops.indices(pop)) for k, pop in enumerate(pops.order)})
    rows = rows.withColumns({f"_f{k}": F.flatten(f"_g{k}") for k in range(len(pops.order))})
    entries = []
    for k, pop in enumerate(pops.order):
        own, size = F.col(f"_f{k}"), F.size(f"_f{k}")
        count = _counter(own)
        fields = {
            "pop": F.lit(pop),
            "pop_rank": F.lit(k),
            # two alleles, the usual case, are counted in compiled code
            "ac": F.when(F.col("_top") == 1, F.array(count(F.lit(0)), count(F.lit(1)))).otherwise(F.transform(F.sequence(F.lit(0), F.col("_top")), count)),
            "n_haps": size.cast("long"),
            "n": F.size(F.array_remove(own, -1)).cast("long"),
            "n01": count(F.lit(0)) + count(F.lit(1)),
        }
        if heterozygotes:
            fields["het"] = K.heterozygotes(F.col(f"_g{k}"), F.col("_top"))
        entries.append(F.struct(*(v.alias(n) for n, v in fields.items())))
    hidden = [f"_{x}{k}" for x in "gf" for k in range(len(pops.order))]
    return rows.withColumn("p", F.array(*entries)).drop("_top", "gt", *hidden)


def _from_planes(sites: DataFrame, pops: Populations, heterozygotes: bool, haplotypes: int | None = None) -> DataFrame:
    """The same from bit planes. Where ``ploidy`` is a column, haplotypes beyond it do not count; ``haplotypes`` is its maximum.

    The counts of each population are columns first, so that each is computed once."""
    samples, by_row = len(pops.samples), "ploidy" in sites.columns
    most = haplotypes or 2
    ploidy = "ploidy" if by_row else str(most)
    own = [packing.Counter(packing.mask_of(pops.indices(p), samples), most, by_row) for p in pops.order]
    every = packing.Counter(packing.mask_of(list(range(samples)), samples), most, by_row)
    counters = [*own, every]
    rows = sites.withColumns({f"_n{k}": F.expr(c.called()) for k, c in enumerate(counters)} | {f"_m{k}": F.expr(c.allele("1")) for k, c in enumerate(counters)})
    rows = rows.withColumns({f"_c{k}": F.expr(c.counts(f"_n{k}", f"_m{k}")) for k, c in enumerate(counters)})
    last = len(own)
    entries = []
    for k, pop in enumerate(pops.order):
        fields = {
            "pop": F.lit(pop),
            "pop_rank": F.lit(k),
            "ac": F.col(f"_c{k}"),
            "n_haps": F.expr(f"cast({len(pops.indices(pop))} * {ploidy} as bigint)"),
            "n": F.col(f"_n{k}"),
            "n01": F.expr(f"get(_c{k}, 0) + get(_c{k}, 1)"),
        }
        if heterozygotes:
            fields["het"] = F.expr(own[k].heterozygotes())
        entries.append(F.struct(*(v.alias(n) for n, v in fields.items())))
    # two alleles, the usual case, without a higher-order function
    seen = F.expr(f"if(top = 1, if(_n{last} > _m{last}, 1, 0) + if(_m{last} > 0, 1, 0), if(top = 2, if(get(_c{last}, 0) > 0, 1, 0) + if(get(_c{last}, 1) > 0, 1, 0) + if(get(_c{last}, 2) > 0, 1, 0), size(filter(_c{last}, x -> x > 0))))")
    rows = rows.withColumn("n_alleles_all", seen).withColumn("p", F.array(*entries))
    return rows.drop("bits", "top", *(f"_{x}{k}" for x in "nmc" for k in range(len(counters))))


def _counter(alleles: Column):
    """How often an allele occurs, as a function of it."""
    return lambda a: (F.size(alleles) - F.size(F.array_remove(alleles, a))).cast("long")


WRITTEN_OUT = 200


def _members(indices: list[int]) -> Column:
    """The genotypes of some samples; written out for few, so that it compiles, by a lookup array for many."""
    if len(indices) <= WRITTEN_OUT:
        return F.array(*(F.get("gt", F.lit(i)) for i in indices))
    return F.transform(F.array(*(F.lit(i) for i in indices)), lambda i: F.get(F.col("gt"), i))


def by_population(counted: DataFrame) -> DataFrame:
    """One row for each site and population.

    The outer form, as no array is empty: Spark would else compute each array once more in a filter below.
    """
    return counted.withColumn("e", F.explode_outer("p")).select("*", "e.*").drop("e", "p")


def by_pair(counted: DataFrame, pops: Populations, where: Column | None = None) -> DataFrame:
    """One row for each site and pair of populations (structs a and b), in the order of the populations.

    ``where``: of these sites only. As a filter before, Spark would push it below the counts and compute them twice."""
    n = len(pops.order)
    pairs = F.array(*(F.struct(F.get("p", F.lit(i)).alias("a"), F.get("p", F.lit(j)).alias("b")) for i in range(n) for j in range(i + 1, n)))
    rows = counted.withColumn("e", F.explode_outer(pairs if where is None else F.when(where, pairs)))
    rows = rows if where is None else rows.where("e is not null")
    return rows.select("*", "e.*").drop("e", "p").withColumn("pop1", F.col("a.pop")).withColumn("pop2", F.col("b.pop"))
