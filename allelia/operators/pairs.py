"""Sums over pairs of many populations, as matrix products.

Every pair sum of dxy and of Hudson's FST is a product of per-site numbers of one population with those of the other, summed over sites: called alleles,
allele counts and frequencies. So the sums of all pairs are products of (sites x populations) matrices. Each task multiplies the sites that it has
of a window, and hands on one row for each window and pair, not one for each site and pair; the rows of tasks are then added up.

Integer sums are exact: the sites of a batch are few enough for doubles to hold them. A population without a called allele at a site has no
frequency there and adds nothing; a mean difference needs two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sites import Populations
from .windows import KEYS

COUNTS = ("count_diffs", "count_comparisons", "count_missing", "no_sites", "no_snps")
FIELDS = "pop1 string, pop2 string, " + ", ".join(f"{c} long" for c in COUNTS) + ", x double, y double"
#: From so many populations on, ``plans.analysis`` takes matrix products.
MANY = 9


def _lists(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def products(n: np.ndarray, haps: np.ndarray, ac: np.ndarray, seen: np.ndarray, weight: np.ndarray, eligible: np.ndarray) -> dict[str, np.ndarray]:
    """All pair sums of some sites. n, haps, seen: (sites, populations); ac: (sites, populations, alleles); weight: positions of each; eligible: for FST."""
    w = weight[:, None]
    comps = n.T @ (w * n)
    shared = sum(ac[:, :, a].T @ (w * ac[:, :, a]) for a in range(ac.shape[2]))
    out = {"count_diffs": comps - shared, "count_comparisons": comps, "count_missing": haps.T @ (w * haps) - comps, "no_sites": seen.T @ (w * seen)}
    n, ac = n[eligible], ac[eligible]
    some, two = (n > 0).astype(float), (n > 1).astype(float)
    p = ac / np.maximum(n, 1)[:, :, None]
    mean = np.where(n > 1, (n * n - (ac * ac).sum(axis=2)) / np.maximum(n * (n - 1), 1), 0)
    alike = lambda on: sum((on * p[:, :, a]).T @ (on * p[:, :, a]) for a in range(p.shape[2]))
    halves = mean.T @ two
    out["no_snps"] = np.full(comps.shape, float(len(n)))
    out["x"] = two.T @ two - alike(two) - (halves + halves.T) / 2
    out["y"] = some.T @ some - alike(some)
    return out


def pair_sums(sited: DataFrame, pops: Populations, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, pop1, pop2, COUNTS, x, y) from sites with population counts and windows (or cells): what dxy and Hudson's FST need, for any number of populations.

    site_class, if it is there, keeps invariant sites out of FST."""
    k = len(pops.order)
    i, j = np.triu_indices(k, 1)
    first, second = pa.array([pops.order[a] for a in i.tolist()], pa.string()), pa.array([pops.order[b] for b in j.tolist()], pa.string())
    eligible = (F.col("n_alleles_all") == 2) & ((F.col("site_class") != "invariant") if "site_class" in sited.columns else F.lit(True))
    rows = sited.select(
        *keys, F.col("mult").cast("long").alias("mult"), eligible.alias("eligible"), F.size(F.get("p", F.lit(0))["ac"]).alias("alleles"),
        *(F.col(f"p.{c}").alias(c) for c in ("n", "n_haps", "n01")), F.flatten("p.ac").alias("ac"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            n, haps, seen = (_lists(get(c), float).reshape(-1, k) for c in ("n", "n_haps", "n01"))
            alleles, weight, fits = get("alleles").to_numpy(), get("mult").to_numpy().astype(float), get("eligible").to_numpy(zero_copy_only=False).astype(bool)
            most = int(alleles.max())
            ac = np.zeros((len(n), k, most))
            at, flat = np.append(0, np.cumsum(alleles.astype(np.int64) * k)), _lists(get("ac"), float)
            for a in np.unique(alleles).tolist():
                own = np.flatnonzero(alleles == a)
                ac[own, :, :a] = flat[at[own][:, None] + np.arange(a * k)].reshape(-1, k, a)
            key = pa.Table.from_arrays([get(c) for c in keys], names=list(keys))
            codes = np.zeros(len(n), np.int64)
            for c in keys:
                code = key.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
                codes = np.unique(codes * (int(code.max()) + 1) + code, return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                sums = products(n[own], haps[own], ac[own], (seen[own] > 0).astype(float), weight[own], fits[own])
                same = [pa.array([key.column(c)[int(own[0])].as_py()] * len(i), key.schema.field(c).type) for c in keys]
                counts = [pa.array(np.rint(sums[c][i, j]).astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([*same, first, second, *counts, pa.array(sums["x"][i, j]), pa.array(sums["y"][i, j])], names=[*keys, "pop1", "pop2", *COUNTS, "x", "y"])

    own_fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    parts = rows.mapInArrow(run, f"{own_fields}, {FIELDS}")
    return parts.groupBy(*keys, "pop1", "pop2").agg(*(F.sum(c).alias(c) for c in (*COUNTS, "x", "y")))


def dxy_sums(found: DataFrame) -> DataFrame:
    """For ``stats.dxy_result``."""
    return found.select(*KEYS, "pop1", "pop2", *COUNTS[:4])


def fst_sums(found: DataFrame) -> DataFrame:
    """For ``stats.fst_result`` with kind hudson."""
    return found.where("no_snps > 0").select(*KEYS, "pop1", "pop2", "no_snps", "x", "y", F.lit(0.0).alias("z"))


def as_components(found: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """In the columns of ``fused.components``."""
    zero = lambda c, kind: F.lit(0).cast(kind).alias(c)
    return found.select(*keys, "pop1", "pop2", F.lit(None).cast("long").alias("n"), zero("sites", "long"), zero("variants", "long"), *COUNTS, "x", "y", zero("z", "double"))
