"""Line dedup with content-defined chunks, in DataFrame functions only.

A text, however long, is cut at line feeds as a whole. A rolling hash over the hashes of three consecutive lines decides after which line a chunk
ends (one in ``EVERY`` on average), so an inserted or missing line moves only the boundaries near it. Chunks of two
lines or more whose bytes occur more than once in the corpus keep their first occurrence (smallest doc_id, then place; null
ids last) and lose the others. Equal hashes only propose a chunk: its bytes are compared with those of the first one.

``dedup_passages`` takes the chunks of several densities, ``DENSITIES`` and at last every pair of adjacent lines, all by the same hashes, first occurrences and
byte comparison in one pass; all lines of a chunk that occurs earlier go. Long repeated passages go as few long chunks, pairs take what content-defined
cuts leave at the ends of passages and of short ones. So every run of two lines or more that occurs earlier goes, whatever stands around it;
``n_removed_by`` says how many lines each density, from the coarsest, was the first to remove. The first occurrence of each line always stays.

Rows with equal doc_id and text are one document: repeated rows are treated alike and stay. A null text has no lines
and stays null. A text that loses every line becomes empty. An empty table gives an empty one. Other columns stay; those called like
an added one are replaced, and any other name is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, stored

EVERY = 4
#: Content-defined cuts after one line in so many, for ``dedup_passages``; pairs of lines, the last density, are called 1.
DENSITIES = (16, 4)
ADDED = ("n_lines", "n_removed", "n_chunks_removed")
BY = "n_removed_by"


def _line_hash(line: str) -> str:
    return f"cast(conv(substring(md5({line}), 1, 7), 16, 10) as bigint)"


def _cut(every: int) -> str:
    """array<struct<at, n>>: first line (from 1) and number of lines of each chunk of _lines."""
    rolled = "_h[i] + 31 * coalesce(get(_h, i - 1), 0L) + 961 * coalesce(get(_h, i - 2), 0L)"
    ends = f"filter(sequence(0, size(_lines) - 1), i -> i = size(_lines) - 1 or ({rolled}) % {every} = 0)"
    return f"transform({ends}, i -> i + 1)"


def _chunked(rows: DataFrame, every: int | None) -> DataFrame:
    """Add _lines and _chunks, array<struct<at, n, every>>, to rows with a text; every None takes all densities and each pair of adjacent lines."""
    rows = rows.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("_h", F.expr(f"transform(_lines, x -> {_line_hash('x')})"))
    chunks = "transform({ends}, (e, k) -> struct(coalesce(get({ends}, k - 1), 0) + 1 as at, e - coalesce(get({ends}, k - 1), 0) as n, {d} as every))"
    if every is not None:
        return rows.withColumn("_ends", F.expr(_cut(every))).withColumn("_chunks", F.expr(chunks.format(ends="_ends", d=every))).drop("_h", "_ends")
    rows = rows.withColumns({f"_ends{d}": F.expr(_cut(d)) for d in DENSITIES})
    pairs = "transform(slice(sequence(0, size(_lines) - 1), 2, size(_lines)), i -> struct(i as at, 2 as n, 1 as every))"
    longer = [f"filter({chunks.format(ends=f'_ends{d}', d=d)}, c -> c.n > 2)" for d in DENSITIES]
    return rows.withColumn("_chunks", F.expr(f"concat({', '.join([*longer, pairs])})")).drop("_h", *(f"_ends{d}" for d in DENSITIES))


_BODY = "array_join(slice(_lines, {c}.at, {c}.n), '\n')"


def _judged(docs: DataFrame, every: int | None) -> tuple[DataFrame, dict[str, str]]:
    """The documents with _lines, _chunks and _gone, the chunks that occur earlier, beside doc_id and text; and the
    names of all other columns by the documents' own."""
    rows, names = numbered(docs.select("doc_id", "text", *(c for c in docs.columns if c not in (*ADDED, "doc_id", "text"))))
    keyed = rows.withColumnsRenamed({names.pop("doc_id"): "doc_id", names.pop("text"): "text"}).withColumn("_key", F.xxhash64("doc_id", "text"))
    cut = _chunked(keyed.select("_key", "doc_id", "text"), every)
    hashed = f"transform(filter(_chunks, c -> c.n > 1), c -> struct(c.at as at, c.n as n, c.every as every, xxhash64({_BODY.format(c='c')}) as h, hash({_BODY.format(c='c')}) as g, length({_BODY.format(c='c')}) as size))"
    chunks = stored(cut.select("_key", "doc_id", F.explode(F.expr(hashed)).alias("c")).select("_key", "doc_id", "c.*"))
    place = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "_key", "at", "n")
    first = chunks.groupBy("h", "g", "size").agg(F.count("*").alias("times"), F.min(place).alias("f")).where("times > 1")
    # the bytes of each first occurrence, from its document; doc_id is no join key, so both joins of the texts shuffle by _key
    # alone and, where no other columns are kept, share one shuffle
    wanted = first.groupBy(F.col("f._key").alias("_key"), F.col("f.doc_id").alias("_doc")).agg(F.collect_list(F.struct("h", "g", "size", "f.at", "f.n")).alias("_wanted"))
    found = keyed.join(wanted, "_key").where("coalesce(doc_id = _doc, doc_id is null and _doc is null)").dropDuplicates(["_key", "_doc"])
    found = found.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    bodies = found.select("_doc", F.col("_key").alias("_from"), F.explode(F.expr(f"transform(_wanted, c -> struct(c.h as h, c.g as g, c.size as size, c.at as first_at, {_BODY.format(c='c')} as body))")).alias("b")).select("_doc", "_from", "b.*")
    later = chunks.join(bodies, ["h", "g", "size"]).where("not (_key = _from and doc_id <=> _doc and at = first_at)")
    drop = later.groupBy("_key").agg(F.collect_set(F.struct("doc_id", "at", "n", "every", "body")).alias("_later"))
    whole = keyed.join(drop, "_key", "left")
    gone = f"transform(filter(_later, r -> r.doc_id <=> doc_id and r.body = {_BODY.format(c='r')}), r -> struct(r.at as at, r.n as n, r.every as every))"
    return _chunked(whole, every).withColumn("_gone", F.coalesce(F.expr(gone), F.expr("cast(array() as array<struct<at: int, n: int, every: int>>)"))), names


def _made(whole: DataFrame, docs: DataFrame, names: dict[str, str], text: Column, removed: Column, chunks: Column, more: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """The columns of docs with the text that is left, those of ADDED, and more ones."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    text = F.when(F.size("_gone") == 0, F.col("text")).otherwise(text)
    # one struct, taken apart by a generator: a later filter on these columns stays above it and computes nothing again
    made = F.struct(text.alias("text"), n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), chunks.cast("long").alias("n_chunks_removed"), *(c.alias(n) for n, c in more.items()))
    out = whole.select("doc_id", *names.values(), F.explode_outer(F.array(made)).alias("_made"))
    shown = {"doc_id": F.col("doc_id"), "text": F.col("_made.text")} | {n: F.col(c) for n, c in names.items()}
    return out.select(*(shown[c].alias(c) for c in docs.columns if c in shown), *(F.col(f"_made.{c}") for c in (*ADDED, *more)))


def dedup(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """Documents without repeated chunks, with n_lines (before), n_removed lines and n_chunks_removed added."""
    whole, names = _judged(docs, every)
    whole = whole.withColumn("_kept", F.expr("filter(_chunks, c -> not array_contains(_gone.at, c.at))"))
    removed = F.expr("aggregate(filter(_chunks, c -> array_contains(_gone.at, c.at)), 0, (s, c) -> s + c.n)")
    text = F.expr(f"array_join(transform(_kept, c -> {_BODY.format(c='c')}), '\n')")
    return _made(whole, docs, names, text, removed, F.size("_gone"))


def dedup_passages(docs: DataFrame, by_density: bool = False) -> DataFrame:
    """Documents without the runs of two lines or more that occur earlier; n_chunks_removed counts the removed runs. by_density: with n_removed_by, array<long>."""
    docs = docs.drop(BY) if by_density else docs
    whole, names = _judged(docs, None)
    gone = lambda d: f"array_distinct(flatten(transform(filter(_gone, c -> c.every >= {d}), c -> sequence(c.at, c.at + c.n - 1))))"
    steps = (*DENSITIES, 1)
    whole = whole.withColumn("_out", F.expr(gone(1)))
    whole = whole.withColumn("_left", F.expr("array_except(sequence(1, size(_lines)), _out)"))
    text = F.expr("array_join(transform(_left, i -> _lines[i - 1]), '\n')")
    runs = F.size(F.expr("array_except(_out, transform(_out, i -> i + 1))"))
    sizes = [f"size({gone(d)})" for d in steps[:-1]] + ["size(_out)"]
    by = F.expr("transform(array({}), (x, k) -> cast(x - coalesce(get(array({}), k - 1), 0) as bigint))".format(*[", ".join(sizes)] * 2))
    return _made(whole, docs, names, text, F.size("_out"), runs, {BY: by} if by_density else {})


def digests(docs: DataFrame) -> DataFrame:
    return _digested(dedup(docs.select("doc_id", "text")))


def passage_digests(docs: DataFrame) -> DataFrame:
    return _digested(dedup_passages(docs.select("doc_id", "text")))


def _digested(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
