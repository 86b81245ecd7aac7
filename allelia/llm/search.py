"""Ranked lexical search: an index of postings, and the best documents for each of many queries, scored in integers.

A term is a maximal run of bytes of letters, digits and characters beyond ASCII, A-Z lower-cased. ``index`` writes a posting (bucket, term, doc,
doc_id, tf, n) for each distinct term of a document: its occurrences tf and the n terms of the document. Postings are dealt into buckets by
term and sorted by bucket and term in the files of each task, so a search reads the row groups of its terms' buckets only; files follow the
documents, so writing shuffles nothing and a frequent term is spread over all of them. A posting of the empty term, which no text has, holds a
document's length.

``search`` joins the distinct terms of the queries with the postings, takes only what matches, brings the postings of a document
together, scores each match, sums by query and document, and ranks by a window whose limit Spark also applies before its shuffle. So what is
shuffled are the matching postings once, and then at most k rows of each query and task. The terms go to the tasks as a broadcast of at most
``QUERY_BYTES``; more queries are searched in blocks, each with a pass over its terms' buckets, and a single query beyond that joins by shuffles.

With N documents that have terms, L terms in all of them, df documents with a term: w = floor(1000 * ln((2N + 2) / (2df + 1))) in doubles;
m = 100 - 50 + (50 * n * N) div L; a score is the sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over the terms of a query, each once.
Equal scores rank by ascending doc_id, nulls first.

Null and empty texts, and texts without terms, are no documents; queries without terms have no rows. Each row is a document of its own, repeated rows and ids
too (rows with equal scores and ids take any order among them, which no column shows); so is each row of the queries. Very long texts are blocks of
their own. Empty tables give no rows. Of the tables, only the id and the text are read, so other columns, however called, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .textops import LOWER, U64, Words, blocks, mix

BUCKET_BITS = 10
LENGTHS = -(1 << (BUCKET_BITS - 1)) - 1
#: Bytes of the (query, term) pairs that go to the tasks at once.
QUERY_BYTES = 16_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, id, term, tf, n) of the distinct terms of each row, and (doc, id, "", 0, n) of the row itself."""
    for batch in batches:
        for a, b, data, offs in blocks(batch.column(2)):
            words = Words(data, offs)
            n, low = words.counts(), LOWER[data]
            row = np.repeat(np.arange(len(n)), n)
            # equal keys propose equal words of a row; each is then compared with the first of its kind
            key = mix(words.hash ^ ((row.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93)))
            order = np.argsort(key, kind="stable")
            start, end, r, key = words.start[order], words.end[order], row[order], key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(r)))
            lead = np.repeat(first, tf)
            if (r == r[lead]).all() and _alike(low, start, end, start[lead], end[lead]):
                r, start, end = r[first], start[first], end[first]
            else:
                r, start, end, tf = _slowly(low.tobytes(), row, words)
            some = np.flatnonzero(n)
            place = np.concatenate([r, some])
            taken = pa.array(place + a)
            terms = _strings(low, np.append(start, np.zeros(len(some), np.int64)), np.append(end, np.zeros(len(some), np.int64)))
            counts = [pa.array(np.append(tf, np.zeros(len(some), np.int64)), pa.int32()), pa.array(n[place], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), terms, *counts], names=["doc", "id", "term", "tf", "n"])


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of bytes as strings."""
    first = np.append(0, np.cumsum(end - start))
    flat = data[np.repeat(start - first[:-1], end - start) + np.arange(first[-1])]
    made = pa.StringArray.from_buffers(len(start), pa.py_buffer(first.astype(np.int32)), pa.py_buffer(flat))
    try:
        made.validate(full=True)
    except pa.ArrowInvalid:  # a text that is not UTF-8
        made = pa.array([flat[x:y].tobytes().decode(errors="replace") for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.string())
    return made


def _alike(low: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> bool:
    """Whether slices are equal, pair by pair."""
    if not (end - start == other_end - other).all():
        return False
    on = np.flatnonzero(start != other)
    size = (end - start)[on]
    first = np.append(0, np.cumsum(size))
    inside = np.arange(first[-1])
    return bool((low[np.repeat(start[on] - first[:-1], size) + inside] == low[np.repeat(other[on] - first[:-1], size) + inside]).all())


def _slowly(low: bytes, row: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts, ends and numbers of the distinct words, for a block in which unlike words have one key."""
    found: dict[tuple[int, bytes], list[int]] = {}
    for r, x, y in zip(row.tolist(), words.start.tolist(), words.end.tolist()):
        found.setdefault((r, low[x:y]), [r, x, y, 0])[3] += 1
    return tuple(np.array(list(found.values()), np.int64).reshape(-1, 4).T)


def terms(rows: DataFrame, key: str) -> DataFrame:
    """(doc, key, term, tf, n) of each row's distinct terms and of the row itself (term "", tf 0). doc numbers the rows; it is fixed once the result is stored."""
    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.monotonically_increasing_id().alias("doc"), F.col(key).alias("id"), "text").mapInArrow(_counted, f"doc long, id {kind}, term string, tf int, n int")
    return found.withColumnRenamed("id", key)


def bucket_of(term: F.Column) -> F.Column:
    """The leading bits of the term's hash; document lengths, of the empty term, have a bucket of their own before all others."""
    return F.when(term == "", LENGTHS).otherwise(F.shiftright(F.xxhash64(term), 64 - BUCKET_BITS)).cast("int")


def index(docs: DataFrame) -> DataFrame:
    """The stored postings (bucket, term, doc, doc_id, tf, n)."""
    rows = terms(docs, "doc_id").select(bucket_of(F.col("term")).alias("bucket"), "term", "doc", "doc_id", "tf", "n")
    # one number to sort by, which orders the buckets too
    return stored(rows.sortWithinPartitions(F.when(F.col("term") == "", F.lit(-(1 << 63))).otherwise(F.xxhash64("term"))), compression="zstd")


def _blocks(wanted: DataFrame, most: int) -> list[tuple[DataFrame, bool]]:
    """The (query, term) pairs in blocks of whole queries, and whether each is of ``most`` bytes at most (one query may be longer)."""
    rows = wanted.withColumn("_bytes", F.octet_length("term") + 32)
    many = max(1, 2 * (rows.agg(F.sum("_bytes")).first()[0] or 0) // most)
    while True:
        block = F.pmod(F.xxhash64("query"), F.lit(many))
        sizes = rows.groupBy(block.alias("b")).agg(F.sum("_bytes").alias("bytes"), F.min("query").alias("lo"), F.max("query").alias("hi")).collect()  # a row for each block
        if all(s.bytes <= most or s.lo == s.hi for s in sizes):
            return [(wanted.where(block == s.b) if many > 1 else wanted, s.bytes <= most) for s in sorted(sizes)]
        many *= 2


def search(postings: DataFrame, queries: DataFrame, k: int = 50, key: str = "item_id", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(key, rank, doc_id, score) of the k best documents of each row of queries (key, text)."""
    wanted = stored(terms(queries, key).where("term <> ''").select(F.col("doc").alias("query"), key, "term", bucket_of(F.col("term")).alias("bucket")))
    size = postings.where(F.col("bucket") == LENGTHS).agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    parts = [_best(postings, block, F.broadcast if small else lambda df: df, size.docs, size.terms or 0, k, key) for block, small in _blocks(wanted, query_bytes)]
    return reduce(DataFrame.unionByName, parts) if parts else _best(postings, wanted, F.broadcast, 0, 0, k, key)


def _best(postings: DataFrame, wanted: DataFrame, sent: Callable[[DataFrame], DataFrame], docs: int, total: int, k: int, key: str) -> DataFrame:
    """The best documents for a block of queries; ``sent`` marks its tables, of a row for each term or query, as broadcasts where their size is bounded."""
    asked = wanted.groupBy("bucket", "term").agg(F.collect_list("query").alias("queries"))
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # 1,024 numbers at most
    near = postings.where(F.col("bucket").isin(buckets))
    df = near.join(sent(asked.select("term")), "term").groupBy("term").agg(F.count("*").alias("df"))
    odds = F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1).cast("double")
    # stored, so that the counting is not repeated where this is sent
    weights = stored(df.select("term", F.floor(1000 * F.log(odds)).cast("long").alias("w")))
    asked = asked.join(weights, "term").select("term", "queries", "w")
    met = near.join(sent(asked.select("term")), "term").withColumn("m", F.expr(f"50L + (50L * n * {docs}L) div {max(total, 1)}L"))
    part = F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
    # the postings that match come together by document, so the sums need no further shuffle
    met = met.select("doc", "doc_id", "term", part.alias("part")).repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")
    scored = met.join(sent(asked), "term").select("doc", "doc_id", (F.col("w") * F.col("part")).alias("score"), F.explode("queries").alias("query"))
    sums = scored.groupBy("doc", "doc_id", "query").agg(F.sum("score").alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("doc")))
    best = sums.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(sent(wanted.select("query", key).distinct()), "query").select(key, "rank", "doc_id", "score")
