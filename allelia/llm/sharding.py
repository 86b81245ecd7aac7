"""Shards by extendible hashing.

Every row has 60 hash bits: 30 of its key, then 30 of its content, so a key that holds a large part of all rows still
splits. A directory starts with one bucket; only buckets over the byte limit split on their next bit, so the bucket of
a row is the shortest prefix of its bits whose rows fit. ``STEP`` bits are tried at a time: one aggregation
gives the sizes of the longest prefixes, from which those of the shorter ones follow; only oversized buckets go on.

Rows that are equal in all bits (repeated rows) are dealt over numbered parts of their bucket so that each fits. A row that
is itself over the limit, as a very long text may be, gets a part of its own and is marked ``oversize``. A null key is a key like any
other; a null text has 0 bytes; an empty table has no shards. Only the key and the text are read, so other columns, however
called, play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

BITS = 60
STEP = 12
LIMIT = 8 << 20


def _half(*columns: str) -> F.Column:
    """30 bits of an MD5 as a long."""
    text = F.concat_ws("", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns))
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 2)


def assign(rows: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shard, depth, n_bytes, oversize) for each row; shard is the bits of the bucket, with ``.part`` for repeated rows."""
    base = stored(rows.select(F.col(key).alias("k"), (F.shiftleft(_half(key), 30) + _half(text)).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")))
    level = base.withColumn("task", F.spark_partition_id())
    done, low = [], 0
    while low < BITS:
        deep = low + STEP
        level = level.withColumn("p", F.shiftright("bits", BITS - deep))
        fine = level.groupBy("p").agg(F.sum("n_bytes").alias("size"))
        each = fine.select("p", "size", F.explode(F.sequence(F.lit(low + (low > 0)), F.lit(deep))).alias("d")).withColumn("q", F.expr(f"shiftright(p, {deep} - d)"))
        fits = each.groupBy("d", "q").agg(F.sum("size").alias("total")).where(F.col("total") <= limit)
        depth = each.join(fits, ["d", "q"]).groupBy("p").agg(F.min("d").alias("depth"))
        directory = stored(fine.select("p").join(depth, "p", "left"))
        done.append(level.join(directory.where("depth is not null"), "p"))
        over = directory.where("depth is null")
        level = level.join(over.select("p"), "p", "left_semi")
        low = deep
        if over.isEmpty():
            break
    else:
        # repeated rows: numbered within each task, then the counts of the tasks before are added
        counts = level.groupBy("bits", "task").agg(F.count("*").alias("c"))
        before = counts.select("bits", "task", F.coalesce(F.sum("c").over(Window.partitionBy("bits").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        number = F.row_number().over(Window.partitionBy("bits", "task").orderBy("n_bytes")) - 1
        fit = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(n_bytes, 1)"))
        parts = level.withColumn("number", number).join(before, ["bits", "task"]).withColumn("part", ((F.col("number") + F.col("before")) / fit).cast("long"))
        done.append(parts.withColumn("depth", F.lit(BITS)))
    bits = f"substring(lpad(conv(cast(bits as string), 10, 2), {BITS}, '0'), 1, depth)"
    out = None
    for found in done:
        part = F.concat(F.lit("."), F.col("part").cast("string")) if "part" in found.columns else F.lit("")
        found = found.select(F.col("k").alias(key), F.concat(F.expr(bits), part).alias("shard"), F.col("depth").cast("int").alias("depth"), "n_bytes", (F.col("n_bytes") > limit).alias("oversize"))
        out = found if out is None else out.unionByName(found)
    return out
