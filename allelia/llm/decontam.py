"""Benchmark decontamination with a positional inverted index of the training tokens.

``index`` stores the postings of all training words in the shared folder, partitioned by documents: a row holds the sorted terms
of some 250 KB of documents with the places of each. Test windows (``WINDOW`` consecutive words; shorter items whole) start from the
postings of their rarest term, counted over the whole index, and are intersected, offset by offset, with those of the next
rarest terms until all words agree. With ``gap`` > 0 also near matches are returned: at least ``share`` of a window's words within
``gap`` places of where they belong.

Every index row must see every window, so windows go to the tasks in blocks of at most ``BLOCK_WORDS`` words or one item; a
larger benchmark makes more passes over the index and no larger broadcast, and only one block at a time is in the driver.

Null and empty texts have no words; items without words have no window; repeated item ids count once, repeated rows are
judged alike; a long text is one row of the index; an empty table gives an empty one. Other columns stay; those called like an
added one are replaced, and any other name is safe.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import numbered, stored
from .textops import Words, binary_column, blocks

BLOCK_WORDS = 200_000
WINDOW = 13
SHARD_BYTES = 1 << 18


class Windows:
    """The distinct windows of some items as term ids of a sorted vocabulary."""

    def __init__(self, ids: list[str], texts: list[str], size: int = WINDOW):
        words = Words(*binary_column(pa.array(texts, pa.string())))
        self.vocab, terms = np.unique(words.hash, return_inverse=True)
        self.items = sorted({i for i in ids})
        place = {x: k for k, x in enumerate(self.items)}
        rows: dict[tuple, None] = {}
        for item, a, b in zip(ids, words.first[:-1].tolist(), words.first[1:].tolist()):
            for s in range(a, max(a + 1, b - size + 1) if b > a else a):
                rows[place[item], *terms[s : min(s + size, b)].tolist()] = None
        self.item = np.array([r[0] for r in rows], np.int64)
        self.length = np.array([len(r) - 1 for r in rows], np.int64)
        self.term = np.full((len(rows), size), -1, np.int64)
        for k, r in enumerate(rows):
            self.term[k, : len(r) - 1] = r[1:]

    def ordered(self, seen: dict[int, int]) -> None:
        """Sort the offsets of each window by how rare its terms are in the corpus."""
        count = np.array([seen.get(int(h.view(np.int64)), 0) for h in self.vocab], np.int64)
        rarity = np.where(self.term >= 0, count[self.term] if len(count) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(rarity, axis=1, kind="stable")

    def terms_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[k] == hashes, k, -1)

    def search(self, shard: Shard, gap: int = 0, share: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, exact) of the matches in the documents of an index row."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        known = self.terms_of(shard.terms)  # both are sorted by hash, so these rise as well
        on = known >= 0
        if not len(self.length) or not on.any():
            return none
        posting = shard.places[np.repeat(on, shard.counts)]
        at = np.append(0, np.cumsum(np.bincount(known[on], weights=shard.counts[on], minlength=len(self.vocab)).astype(np.int64)))
        term = np.full(len(shard.places), -1, np.int64)
        term[posting] = np.repeat(known[on], shard.counts[on])
        first = shard.first
        window, start, row = self.proposals(np.arange(len(self.length)), 0, posting, at, first)
        near = self.near(term, first, posting, at, gap, share) if gap else None
        inside = (start >= first[row]) & (start + self.length[window] <= first[row + 1])
        window, start = window[inside], start[inside]
        for k in range(1, self.term.shape[1]):
            off = self.order[window, k]
            want = self.term[window, off]
            same = want < 0
            same |= term[np.minimum(start + off, len(term) - 1)] == want
            window, start = window[same], start[same]
            if not len(window):
                break
        exact = np.ones(len(window), bool)
        if near is None:
            return window, start, exact
        loose = ~np.isin(near[0] * (1 << 40) + near[1], window * (1 << 40) + start)
        return np.append(window, near[0][loose]), np.append(start, near[1][loose]), np.append(exact, np.zeros(loose.sum(), bool))

    def proposals(self, windows: np.ndarray, k: int, posting: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, row) from the postings of the k-th rarest term of each window, adjusted by its offset."""
        off = self.order[windows, k]
        term = self.term[windows, off]
        size = at[term + 1] - at[term]
        ends = np.append(0, np.cumsum(size))
        place = posting[np.repeat(at[term] - ends[:-1], size) + np.arange(ends[-1])]
        return np.repeat(windows, size), place - np.repeat(off, size), np.searchsorted(first, place, "right") - 1

    def near(self, term: np.ndarray, first: np.ndarray, posting: np.ndarray, at: np.ndarray, gap: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Windows with enough of their words about where they belong. As many of the rarest terms propose as make sure that one of them is there,
        each for all starts that it may be off from; starts before the document are its first word."""
        most = self.length - np.ceil(share * self.length - 1e-9).astype(np.int64) + 1
        parts = [self.proposals(np.flatnonzero(most > k), k, posting, at, first) for k in range(int(most.max()))]
        window, start, row = (np.concatenate(x) for x in zip(*parts))
        wide = 2 * gap + 1
        window, start, row = np.repeat(window, wide), (start[:, None] + np.arange(-gap, gap + 1)).ravel(), np.repeat(row, wide)
        # a start outside of the row of its place may be proposed, so the row counts too
        order = np.lexsort((start, row, window))
        window, start, row = window[order], start[order], row[order]
        fresh = np.append(True, (window[1:] != window[:-1]) | (start[1:] != start[:-1]) | (row[1:] != row[:-1]))[: len(window)]
        window, start, row = window[fresh], start[fresh], row[fresh]
        found = np.zeros(len(window), np.int64)
        for k in range(self.term.shape[1]):
            want = self.term[window, k]
            hit = np.zeros(len(window), bool)
            for d in range(-gap, gap + 1):
                p = start + k + d
                fit = (p >= first[row]) & (p < first[row + 1])
                hit |= fit & (term[np.clip(p, 0, len(term) - 1)] == want)
            found += hit & (want >= 0)
        ok = found >= share * self.length[window] - 1e-9
        pair = np.unique(np.stack([window[ok], np.maximum(start[ok], first[row[ok]])]), axis=1)
        return pair[0], pair[1]


class Shard:
    """One row of the index: sorted term hashes, how often each occurs, its places, and where each document's words begin."""

    def __init__(self, n_words: np.ndarray, terms: pa.Buffer, counts: pa.Buffer, places: pa.Buffer):
        self.first = np.append(0, np.cumsum(n_words.astype(np.int64)))
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts, self.places = (np.frombuffer(x, _width(self.first[-1])).astype(np.int64) for x in (counts, places))


def _width(n: int) -> type:
    """Two bytes hold the places and counts of a row of so many words, or four."""
    return np.uint16 if n < 1 << 16 else np.uint32


KEY = ["_k1", "_k2"]


def index(docs: DataFrame) -> DataFrame:
    """The stored index of (_k1, _k2, doc_id, text): shard, the documents' keys, ids and numbers of words, and the postings."""
    id_type = docs.schema["doc_id"].dataType
    listed = [T.StructField(c, T.ArrayType(T.LongType())) for c in KEY] + [T.StructField("doc_id", T.ArrayType(id_type)), T.StructField("n_words", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField("shard", T.StringType()), *listed, *(T.StructField(c, T.BinaryType()) for c in ("terms", "counts", "places"))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(3), SHARD_BYTES):
                words = Words(data, offs)
                order = np.argsort(words.hash, kind="stable")
                term, counts = np.unique(words.hash[order], return_counts=True)
                width = _width(len(order))
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                lists = [whole(batch.column(k).slice(a, b - a)) for k in range(3)] + [whole(pa.array(words.counts(), pa.int32()))]
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (term, counts.astype(width), order.astype(width))]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, *raw], names=schema.names)  # kept once it is stored

    return stored(docs.select(*KEY, "doc_id", "text").mapInArrow(build, schema), **{"parquet.enable.dictionary": "false"})


def _counts(index_: DataFrame, windows: Windows) -> dict[int, int]:
    """Occurrences of the test terms in the index, at most those of a block; partial counts are summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(windows.vocab) + 1, np.int64)
        for batch in batches:
            for terms, counts, size in zip(*(batch.column(k) for k in range(3))):
                here = windows.terms_of(np.frombuffer(terms.as_buffer(), np.uint64)) + 1
                n += np.bincount(here, weights=np.frombuffer(counts.as_buffer(), _width(size.as_py())), minlength=len(n)).astype(np.int64)
        some = np.flatnonzero(n[1:])
        yield pa.RecordBatch.from_arrays([pa.array(windows.vocab[some].view(np.int64)), pa.array(n[1:][some])], names=["term", "n"])

    size = F.aggregate("n_words", F.lit(0).cast("long"), lambda s, x: s + x)
    rows = index_.select("terms", "counts", size.alias("size")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in rows.collect()}


def item_blocks(benchmark: DataFrame, size: int = WINDOW, limit: int = BLOCK_WORDS) -> Iterator[Windows]:
    """Windows of the items, a block at a time; no block for no items."""
    ids, texts, n = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        n += len(r.t) // 2 + 1
        if n >= limit:
            yield Windows(ids, texts, size)
            ids, texts, n = [], [], 0
    if ids:
        yield Windows(ids, texts, size)


SPAN = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("exact", T.BooleanType())])
FOUND = T.StructType([T.StructField("shard", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("matches", T.ArrayType(SPAN))])


def _found(index_: DataFrame, w: Windows, gap: int, share: float, with_spans: bool) -> DataFrame:
    """(shard, row, items, runs, matches) of the documents with a match; runs are the maximal runs of hit words, flat."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n_words, *postings in zip(*(batch.column(k) for k in range(5))):
                shard, out = Shard(n_words.values.to_numpy(), *(x.as_buffer() for x in postings)), []
                window, start, exact = w.search(shard, gap, share)
                row = np.searchsorted(shard.first, start, "right") - 1
                order = np.lexsort((start, row))
                window, start, exact, row = (x[order] for x in (window, start, exact, row))
                cut = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) if len(row) else np.zeros(1, np.int64)
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    k, s, e = window[lo:hi], start[lo:hi] - shard.first[row[lo]], exact[lo:hi]
                    a, z = s[e], s[e] + w.length[k[e]]
                    upto = np.maximum.accumulate(z) if len(z) else z
                    new = np.append(True, a[1:] > upto[:-1]) if len(a) else np.zeros(0, bool)
                    ends = upto[np.append(new[1:], True)] if len(a) else a
                    items = [w.items[i] for i in np.unique(w.item[k[e]]).tolist()]
                    spans = [{"item_id": w.items[w.item[x]], "start": y, "end": y + int(w.length[x]), "exact": v} for x, y, v in zip(k.tolist(), s.tolist(), e.tolist())] if with_spans else []
                    out.append({"shard": name.as_py(), "row": int(row[lo]), "items": items, "runs": np.stack([a[new], ends], axis=1).ravel(), "matches": spans})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)

    return index_.select("shard", "n_words", "terms", "counts", "places").mapInArrow(run, FOUND)


def search(index_: DataFrame, benchmark: DataFrame, size: int = WINDOW, gap: int = 0, share: float = 0.8, with_spans: bool = True, limit: int = BLOCK_WORDS) -> DataFrame:
    """(_k1, _k2, doc_id, n_words, n_hit, items, matches) of each document of the index."""
    found = None
    for w in item_blocks(benchmark, size, limit):
        w.ordered(_counts(index_, w))
        some = stored(_found(index_, w, gap, share, with_spans))
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = index_.sparkSession.createDataFrame([], FOUND)
    pairs = F.expr("transform(sequence(0, size(runs) - 1, 2), i -> struct(runs[i] as lo, runs[i + 1] as hi))")
    found = found.withColumn("runs", F.when(F.size("runs") > 0, pairs))
    # runs of several blocks may overlap: in order of their starts, each adds what lies beyond all before it
    step = "(s, r) -> struct(greatest(s.hi, r.hi) as hi, s.n + greatest(0L, r.hi - greatest(s.hi, r.lo)) as n)"
    hit = F.expr(f"aggregate(array_sort(flatten(runs)), struct(0L as hi, 0L as n), {step}, s -> s.n)")
    found = found.groupBy("shard", "row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"), F.collect_list("runs").alias("runs"))
    found = found.select("shard", "row", "items", F.array_sort("matches", lambda x, y: _in_order(x, y)).alias("matches"), hit.alias("n_hit"))
    rows = index_.select("shard", F.posexplode(F.arrays_zip(*KEY, "doc_id", "n_words")).alias("row", "d")).select("shard", "row", "d.*")
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as {kind})")).alias(c)
    out = rows.join(found, ["shard", "row"], "left")
    return out.select(*KEY, "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), none("items", "array<string>"), none("matches", SPAN_SQL))


SPAN_SQL = "array<struct<item_id: string, start: bigint, end: bigint, exact: boolean>>"


def _in_order(x: F.Column, y: F.Column) -> F.Column:
    """Matches by start, then item."""
    lower = (x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["item_id"] < y["item_id"]))
    same = (x["start"] == y["start"]) & (x["item_id"] == y["item_id"])
    return F.when(lower, -1).when(same, 0).otherwise(1)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the keys of a row, which equal rows share."""
    return docs.withColumns({"_k1": F.xxhash64(doc_id, text), "_k2": F.xxhash64(F.lit(1), doc_id, text)})


ADDED = ("n_words", "n_hit", "items", "matches")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, gap: int = 0, share: float = 0.8, with_spans: bool = True, limit: int = BLOCK_WORDS) -> DataFrame:
    """Add n_words, n_hit (words inside an exact match), items array<string> and matches array<struct> to each document.

    ``matches`` holds word spans [start, end) with their item, exact or near; it is left empty if with_spans is False.
    """
    rows, names = numbered(docs.select(*(c for c in docs.columns if c not in ADDED)))
    rows = keyed(rows, names["doc_id"], names["text"])
    found = search(index(rows.select(*KEY, F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"))), benchmark, size, gap, share, with_spans, limit)
    out = rows.join(found.drop("doc_id").dropDuplicates(KEY), KEY)
    return out.select(*(F.col(c).alias(n) for n, c in names.items()), *ADDED)


def contaminated() -> F.Column:
    """The rule of the contract: at least a twentieth of the words lie in test windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule leaves."""
    rows, names = numbered(docs)
    rows = keyed(rows, names["doc_id"], names["text"])
    found = search(index(rows.select(*KEY, F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"))), benchmark, with_spans=False)
    gone = found.where(contaminated()).select(*KEY).distinct()
    return rows.join(gone, KEY, "left_anti").select(*(F.col(c).alias(n) for n, c in names.items()))


def near_digests(docs: DataFrame, benchmark: DataFrame, gap: int = 2, share: float = 0.8) -> DataFrame:
    """Counts of exact and of near matches of each document, and its items with near ones."""
    found = search(index(keyed(docs.select("doc_id", "text"))), benchmark, gap=gap, share=share)
    near = F.filter("matches", lambda m: ~m["exact"])
    items = F.array_sort(F.array_distinct(F.transform(near, lambda m: m["item_id"])))
    return found.select("doc_id", "n_words", (F.size("matches") - F.size(near)).cast("long").alias("n_exact"), F.size(near).cast("long").alias("n_near"), F.size(items).cast("long").alias("n_near_items"), F.sha2(F.array_join(items, ","), 256).alias("near_items_sha256"))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = search(index(keyed(docs.select("doc_id", "text"))), benchmark, with_spans=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
