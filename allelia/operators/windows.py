"""Windows over positions: tables, assignment of sites, interval joins. A window is [w1, w2], 1-based, both ends in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 16_384
#: Bins for short ranges: a long one is a row for each bin, but a bin has few pairs that do not meet.
FINE = 1_024
KEYS = ("chrom", "w1", "w2", "window_ord")


def extents(sites: DataFrame, start: int | None = 1, end: int | None = None) -> DataFrame:
    """(chrom, start, end): start as given, or the first position (None); end as given, or the last position."""
    first = F.min("pos") if start is None else F.lit(start)
    last = F.max("pos") if end is None else F.lit(end)
    return sites.groupBy("chrom").agg(first.cast("long").alias("start"), last.cast("long").alias("end"))


def fixed_windows(spans: DataFrame, size: int, cover_end: bool = False) -> DataFrame:
    """(chrom, w1, w2, window_ord): windows of one size from each start.

    An interval of at most ``size`` + 1 positions gets one window. Otherwise the end is rounded up to a multiple of size, counted from 0,
    and windows start below it; so a last position may be left over, unless cover_end asks for a window there.
    """
    up = F.expr(f"(end + {size - 1}) div {size} * {size}")
    last = F.when(F.col("end") - F.col("start") <= size, F.col("start")).otherwise(up - 1)
    if cover_end:
        last = F.greatest(last, F.col("end"))
    starts = F.expr(f"transform(sequence(0L, (last - start) div {size}), k -> start + k * {size})")
    rows = spans.withColumn("last", last).select("chrom", F.posexplode(starts).alias("k", "w1"))
    return rows.select("chrom", "w1", (F.col("w1") + size - 1).alias("w2"), F.col("k").cast("long").alias("window_ord"))


def last_of(start: int, end: int, size: int) -> int:
    """The end of the last window of ``fixed_windows`` for one span."""
    return start + size - 1 if end - start <= size else start + (-(-end // size) * size - 1 - start) // size * size + size - 1


def last_position(size: int) -> F.Column:
    """The same from columns start and end."""
    return F.expr(f"if(end - start <= {size}, start + {size - 1}, start + ((end + {size - 1}) div {size} * {size} - 1 - start) div {size} * {size} + {size - 1})")


def assign_fixed(sites: DataFrame, spans: DataFrame | int | None, size: int) -> DataFrame:
    """Add w1, w2, window_ord by arithmetic. Spans are one start for all contigs, which takes no join, or one row for each
    contig, which are sent to the tasks; None if sites have a column ``start``. Rows before the start have no window.

    A row with span_end (a block) goes to every window that it meets, with ``mult`` positions in each, times its ``weight`` if it has one.
    """
    if spans is None:
        rows = sites
    elif isinstance(spans, int):
        rows = sites.withColumn("start", F.lit(spans).cast("long"))
    else:
        rows = sites.join(F.broadcast(spans.select("chrom", "start")), "chrom")  # a row for each contig
    if "span_end" in sites.columns:
        first, last = F.expr(f"(greatest(pos, start) - start) div {size}"), F.expr(f"(span_end - start) div {size}")
        rows = rows.where("span_end >= start").withColumn("window_ord", F.explode(F.sequence(first, last)))
    else:
        rows = rows.where("pos >= start").withColumn("window_ord", F.expr(f"(pos - start) div {size}"))
    rows = rows.withColumn("w1", F.expr(f"start + window_ord * {size}")).withColumn("w2", F.expr(f"start + window_ord * {size} + {size - 1}")).drop("start")
    return _weighted(rows)


def _weighted(rows: DataFrame) -> DataFrame:
    if "span_end" in rows.columns:
        length = F.expr("least(span_end, w2) - greatest(pos, w1) + 1").cast("long")
        return rows.withColumn("mult", length * F.col("weight") if "weight" in rows.columns else length)
    return rows.withColumn("mult", F.lit(1).cast("long"))


def assign_intervals(sites: DataFrame, windows: DataFrame, width: int = BIN) -> DataFrame:
    """Add w1, w2, window_ord (and mult) for any windows: they may overlap, repeat and differ in width.

    Both sides meet in an equi-join on bins of positions; the exact test follows. A pair that shares several bins is taken
    in the first of them.
    """
    end = "span_end" if "span_end" in sites.columns else "pos"
    left = sites.withColumn("_bin", F.explode(F.expr(f"sequence(pos div {width}, {end} div {width})")) if end != "pos" else F.expr(f"pos div {width}"))
    right = windows.select(*KEYS).withColumn("_bin", F.explode(F.expr(f"sequence(w1 div {width}, w2 div {width})")))
    met = left.join(right, ["chrom", "_bin"]).where(f"pos <= w2 and {end} >= w1 and _bin = greatest(pos div {width}, w1 div {width})")
    return _weighted(met.drop("_bin"))


def interval_overlaps(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of rows of a (chrom, lo, hi) and b (chrom, b_lo, b_hi) whose closed intervals meet."""
    left = a.withColumn("_bin", F.explode(F.expr(f"sequence(lo div {width}, hi div {width})")))
    right = b.withColumn("_bin", F.explode(F.expr(f"sequence(b_lo div {width}, b_hi div {width})")))
    return left.join(right, ["chrom", "_bin"]).where(f"lo <= b_hi and hi >= b_lo and _bin = greatest(lo div {width}, b_lo div {width})").drop("_bin")


def site_windows(listed: DataFrame) -> DataFrame:
    """One window for each listed position."""
    return listed.select("chrom", F.col("pos").cast("long").alias("w1"), F.col("pos").cast("long").alias("w2")).distinct().withColumn("window_ord", F.col("w1"))


def assign_sites(sites: DataFrame) -> DataFrame:
    """Add w1, w2, window_ord and mult of ``site_windows`` to rows of listed positions: each is its own window."""
    own = F.col("pos").cast("long")
    return _weighted(sites.withColumns({"w1": own, "w2": own, "window_ord": own}))


def breakpoints(windows: DataFrame, width: int = BIN) -> DataFrame:
    """(chrom, bin, ats): the positions in each bin of the genome at which a window begins, or the last has just ended, in order (at most ``width``)."""
    at = windows.select("chrom", F.explode(F.array(F.col("w1").cast("long"), F.col("w2").cast("long") + 1)).alias("at"))
    return at.groupBy("chrom", F.expr(f"at div {width}").alias("bin")).agg(F.array_sort(F.collect_set("at")).alias("ats"))


def assign_cells(sites: DataFrame, windows: DataFrame, width: int = BIN) -> DataFrame:
    """Add bin, cell and mult: the bins of the genome, cut where windows begin or end, are cells that no window divides.

    A site is in one cell, however many windows cover it. A row with span_end (a block) is a row for each cell that it meets."""
    cuts = breakpoints(windows, width)
    if "span_end" not in sites.columns:
        rows = sites.withColumn("bin", F.expr(f"cast(pos as bigint) div {width}")).join(cuts, ["chrom", "bin"], "left")
        return rows.withColumn("cell", F.when(F.col("ats").isNull(), 0).otherwise(F.size(F.filter("ats", lambda a: a <= F.col("pos"))))).withColumn("mult", F.lit(1).cast("long")).drop("ats")
    rows = sites.withColumn("bin", F.explode(F.expr(f"sequence(cast(pos as bigint) div {width}, cast(span_end as bigint) div {width})"))).join(cuts, ["chrom", "bin"], "left")
    rows = rows.withColumn("_lo", F.expr(f"greatest(cast(pos as bigint), bin * {width})")).withColumn("_hi", F.expr(f"least(cast(span_end as bigint), (bin + 1) * {width} - 1)"))
    inside = F.expr("filter(coalesce(ats, cast(array() as array<bigint>)), a -> a > _lo and a <= _hi)")
    starts = F.concat(F.array("_lo"), inside)
    ends = F.concat(F.transform(inside, lambda a: a - 1), F.array("_hi"))
    pieces = F.explode(F.arrays_zip(starts.alias("lo"), ends.alias("hi")))
    rows = rows.withColumn("_p", pieces).withColumn("cell", F.expr("size(filter(coalesce(ats, cast(array() as array<bigint>)), a -> a <= _p.lo))"))
    # "mult" of a block that already counts (for instance -1) stays a factor
    length = F.col("_p.hi") - F.col("_p.lo") + 1
    return rows.withColumn("mult", length * F.col("weight") if "weight" in sites.columns else length).drop("ats", "_lo", "_hi", "_p")


def _cover(lo: F.Column, hi: F.Column, levels: int, tier: int, bin_: F.Column) -> F.Column:
    """The nodes (tier, bin, level, node) of a binary tree over numbers that make up lo..hi: two for each level at most, none where hi < lo."""

    def at(level: F.Column) -> F.Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first, last = F.floor((lo + size - 1) / size).cast("long"), F.floor((hi + 1) / size).cast("long") - 1
        node = lambda k: F.struct(F.lit(tier).alias("tier"), bin_.cast("long").alias("bin"), level.alias("level"), k.alias("node"))
        return F.array_compact(F.array(F.when((first <= last) & (first % 2 == 1), node(first)), F.when((first <= last) & (last % 2 == 0), node(last))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def gather(cells: DataFrame, windows: DataFrame, parts: tuple[str, ...], sums: tuple[str, ...], width: int = BIN) -> DataFrame:
    """(chrom, w1, w2, window_ord, parts, sums) of windows of any kind from sums by (chrom, bin, cell, parts).

    Cells are summed up two binary trees, over the cells of a bin and over the bins of a contig, and each window takes the few nodes that make it up. So a window as
    wide as a contig costs some dozens of rows, and overlapping windows share what they cover. Only sums are added, so doubles lose nothing to
    cancellation. A window that nothing is in has no rows.
    """
    cell_levels, bin_levels = (2 * width).bit_length(), (1 << 31) // width
    bin_levels = bin_levels.bit_length()
    cuts = breakpoints(windows, width)
    whole = windows.select(*KEYS).distinct().withColumns({"_b1": F.expr(f"cast(w1 as bigint) div {width}"), "_b2": F.expr(f"cast(w2 as bigint) div {width}")})
    first = cuts.select("chrom", F.col("bin").alias("_b1"), F.col("ats").alias("_a1"))
    last = cuts.select("chrom", F.col("bin").alias("_b2"), F.col("ats").alias("_a2"))
    whole = whole.join(first, ["chrom", "_b1"]).join(last, ["chrom", "_b2"], "left")
    whole = whole.withColumns({"_k1": F.expr("size(filter(_a1, a -> a <= w1))"), "_end1": F.size("_a1"), "_k2": F.expr("if(_a2 is null, 0, size(filter(_a2, a -> a <= w2)))")})
    same = F.col("_b1") == F.col("_b2")
    nodes = F.concat(
        _cover(F.col("_k1"), F.when(same, F.col("_k2")).otherwise(F.col("_end1")), cell_levels, 1, F.col("_b1")),
        _cover(F.lit(0), F.when(same, -1).otherwise(F.col("_k2")), cell_levels, 1, F.col("_b2")),
        _cover(F.col("_b1") + 1, F.col("_b2") - 1, bin_levels, 2, F.lit(-1)),
    )
    wanted = whole.select(*KEYS, F.explode(nodes).alias("e")).select(*KEYS, "e.*")
    add = [F.sum(c).alias(c) for c in sums]
    node = ["chrom", "tier", "bin", "level", "node"]
    up = lambda rows, tier, bin_, at, levels: rows.withColumn("level", F.explode(F.sequence(F.lit(0), levels))).select("chrom", F.lit(tier).alias("tier"), bin_.cast("long").alias("bin"), "level", F.call_function("shiftright", at.cast("long"), F.col("level")).alias("node"), *parts, *sums)
    bins = cells.groupBy("chrom", "bin", *parts).agg(*add)
    # in a bin, only as many levels as its cells need
    depth = cells.join(cuts, ["chrom", "bin"], "left").withColumn("_levels", F.coalesce(F.ceil(F.log2(F.size("ats") + 1.0)).cast("int"), F.lit(0))).drop("ats")
    rows = up(depth, 1, F.col("bin"), F.col("cell"), F.col("_levels")).unionByName(up(bins, 2, F.lit(-1), F.col("bin"), F.lit(bin_levels)))
    used = rows.join(wanted.select(*node).distinct(), node, "left_semi").groupBy(*node, *parts).agg(*add)
    return used.join(wanted, node).groupBy(*KEYS, *parts).agg(*add)
