"""Column expressions for genotypes, allele counts and per-site statistics.

All counts are BIGINT and all divisions are guarded, so nothing depends on the ANSI setting. Float division follows
IEEE 754 (x/0 is an infinity, 0/0 is NaN) where a statistic is defined by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gt_ploidy(gt: Column) -> Column:
    """Ploidy of a GT string: its tokens between ``/`` or ``|``, but 1 for one token or exactly one called token."""
    tokens = F.split(gt, r"[/|]")
    called = F.size(F.filter(tokens, lambda t: t != "."))
    return F.when((F.size(tokens) == 1) | (called == 1), F.lit(1)).otherwise(F.size(tokens))


def gt_alleles(field: Column, ploidy: Column) -> Column:
    """Alleles of a sample field (``GT:...``) cut or padded with -1 to the ploidy; a missing allele is -1."""
    raw = F.transform(F.split(F.element_at(F.split(field, ":"), 1), r"[/|]"), lambda t: F.coalesce(t.try_cast("int"), F.lit(-1)))
    return F.transform(F.sequence(F.lit(0), ploidy - 1), lambda i: F.coalesce(F.get(raw, i), F.lit(-1)))


def info_end(info: Column) -> Column:
    """The integer after ``END=`` in an INFO field, else null."""
    # most fields have none, and are not given to the regular expression
    return F.when(F.contains(info, F.lit("END=")), F.regexp_extract(info, r"(?:^|;)END=(-?\d+)(?:;|$)", 1).try_cast("int"))


def choose2(n: Column) -> Column:
    return F.shiftright(n * (n - 1), 1)


def within_differences(counts: Column, n: Column) -> Column:
    """Pairs of different alleles in one population."""
    a, b = F.get(counts, F.lit(0)), F.get(counts, F.lit(1))
    c = F.get(counts, F.lit(2))
    squares = F.when(F.size(counts) == 2, a * a + b * b).when(F.size(counts) == 3, a * a + b * b + c * c).otherwise(F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x * x))
    return F.shiftright(n * n - squares, 1)


def shared_products(a: Column, b: Column) -> Column:
    """Sum of products of two allele counts; the shorter one is filled with zeros."""
    zero = F.lit(0).cast("long")
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) * F.coalesce(y, zero))
    plain = F.get(a, F.lit(0)) * F.get(b, F.lit(0)) + F.get(a, F.lit(1)) * F.get(b, F.lit(1))
    three = plain + F.get(a, F.lit(2)) * F.get(b, F.lit(2))
    return F.when((F.size(a) == 2) & (F.size(b) == 2), plain).when((F.size(a) == 3) & (F.size(b) == 3), three).otherwise(F.aggregate(both, zero, lambda s, x: s + x))


def divide(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles."""
    a, b = a.cast("double"), b.cast("double")
    over_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def skip_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def positive(x: Column) -> Column:
    """x > 0, false for NaN (which Spark orders above all numbers)."""
    return ~F.isnan(x) & (x > 0)


def hudson_site(a: Column, b: Column) -> tuple[Column, Column]:
    """Numerator and denominator of Hudson's FST at a site, from structs with ac and n."""
    nan = F.lit(float("nan"))
    mean = lambda p: F.when(p["n"] < 2, nan).otherwise(F.try_divide(within_differences(p["ac"], p["n"]).cast("double"), choose2(p["n"]).cast("double")))
    pairs = a["n"] * b["n"]
    between = F.when(pairs == 0, nan).otherwise(1 - F.try_divide(shared_products(a["ac"], b["ac"]).cast("double"), pairs.cast("double")))
    return between - (mean(a) + mean(b)) / 2, between


def weir_cockerham_steps(alleles: tuple[str, ...]) -> list[dict[str, str]]:
    """SQL of columns to add one step after the other, from the structs ``a`` and ``b`` of two diploid populations: for each allele, whose index is the
    column ``_u`` with its name, ``_vx``, ``_vy`` and ``_vz`` with its name are the variance components a, b and c (Weir and Cockerham 1984).

    In steps, as each value is used several times: one expression would hold each of them as often, and be too long to compile."""

    def ratio(x: str, y: str) -> str:
        return f"if({y} = 0, if(isnan({x}) or {x} = 0, double('NaN'), if({x} > 0, double('Infinity'), double('-Infinity'))), try_divide({x}, {y}))"

    at = lambda field, u: f"cast(coalesce(get({field}, _u{u}), 0) as double)"
    counts = {"_i1": "cast(shiftright(a.n, 1) as double)", "_i2": "cast(shiftright(b.n, 1) as double)", "_n1": "cast(a.n as double)", "_n2": "cast(b.n as double)"}
    totals, factors, parts = {"_it": "_i1 + _i2", "_mean": "(_i1 + _i2) / 2", "_nt": "_n1 + _n2"}, {"_nc": f"_it - {ratio('(_i1 * _i1 + _i2 * _i2)', '_it')}", "_fm": ratio("1D", "(_mean - 1)"), "_fb": ratio("_mean", "(_mean - 1)")}, {}
    spread, core = {"_fa": ratio("_mean", "_nc")}, {}
    for u in alleles:
        counts |= {f"_k1{u}": at("a.ac", u), f"_k2{u}": at("b.ac", u), f"_h{u}": f"{at('a.het', u)} + {at('b.het', u)}"}
        totals |= {f"_k{u}": f"_k1{u} + _k2{u}", f"_f1{u}": ratio(f"_k1{u}", "_n1"), f"_f2{u}": ratio(f"_k2{u}", "_n2")}
        factors |= {f"_p{u}": ratio(f"_k{u}", "_nt"), f"_g{u}": ratio(f"_h{u}", "_it")}
        spread |= {f"_e{u}": f"_i1 * (_f1{u} - _p{u}) * (_f1{u} - _p{u}) + _i2 * (_f2{u} - _p{u}) * (_f2{u} - _p{u})", f"_q{u}": f"(2 * _mean - 1) * _g{u}"}
        core |= {f"_s{u}": ratio(f"_e{u}", "_mean"), f"_c{u}": f"_p{u} * (1 - _p{u}) - {ratio(f'_e{u}', '_mean')} / 2"}
        parts |= {f"_vx{u}": f"_fa * (_s{u} - _fm * (_c{u} - _g{u} / 4))", f"_vy{u}": f"_fb * (_c{u} - {ratio(f'_q{u}', '(4 * _mean)')})", f"_vz{u}": f"_g{u} / 2"}
    return [counts, totals, factors, spread, core, parts]


def heterozygotes(genotypes: Column, top: Column) -> Column:
    """For each allele, the fully called heterozygous diploid genotypes that carry it."""
    mixed = lambda g: (F.size(g) == 2) & (F.get(g, F.lit(0)) >= 0) & (F.get(g, F.lit(1)) >= 0) & (F.get(g, F.lit(0)) != F.get(g, F.lit(1)))
    return F.transform(F.sequence(F.lit(0), top), lambda u: F.size(F.filter(genotypes, lambda g: mixed(g) & F.array_contains(g, u))).cast("long"))


def class_string(counts: Column) -> Column:
    """``n:s,n:s`` of an array<struct<n, s>>, by n; null stays for an empty one."""
    rows = F.transform(F.array_sort(counts), lambda c: F.concat(c["n"].cast("string"), F.lit(":"), c["s"].cast("string")))
    return F.when(F.size(counts) > 0, F.array_join(rows, ","))


def class_array(text: Column) -> Column:
    """array<struct<n, s>> of a string by ``class_string``; empty for null, an empty string or NA."""
    items = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.contains(x, F.lit(":")))
    return F.transform(items, lambda x: F.struct(F.element_at(F.split(x, ":"), 1).cast("long").alias("n"), F.element_at(F.split(x, ":"), 2).cast("long").alias("s")))


def harmonic_constants(n: int) -> tuple[float, float, float, float]:
    """a1, a2 (sums of 1/k and 1/k**2 for k < n) and Tajima's e1, e2; zeros where they are not defined."""
    if n < 2:
        return 0.0, 0.0, 0.0, 0.0
    a1, a2 = sum(1.0 / k for k in range(1, n)), sum(1.0 / (k * k) for k in range(1, n))
    return a1, a2, *_tajima(n, a1, a2)


def _tajima(n: int, a1: float, a2: float) -> tuple[float, float]:
    c1 = (n + 1) / (3 * (n - 1)) - 1 / a1
    c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    return c1 / a1, c2 / (a1 * a1 + a2)


def harmonic_table(spark: SparkSession, most: int) -> DataFrame:
    """(n, a1, a2, e1, e2) for n up to the largest number of haplotypes in a population: a lookup table of that size."""
    rows, a1, a2 = [(0, 0.0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0, 0.0)], 0.0, 0.0
    for n in range(2, most + 1):
        a1, a2 = a1 + 1.0 / (n - 1), a2 + 1.0 / ((n - 1) * (n - 1))
        rows.append((n, a1, a2, *_tajima(n, a1, a2)))
    return spark.createDataFrame(rows, "n long, a1 double, a2 double, e1 double, e2 double")
