"""Removal of every byte that a repeated 400-byte string covers, with suffix arrays per shard.

Each window of ``LENGTH`` bytes is assigned to its anchor: the place in it whose ``CORE``-byte string has the smallest hash. Equal
windows have equal anchors at equal places, so windows that may repeat meet by the hash of the anchor's string.
Consecutive windows of one anchor form a context (their bytes run from the first window's start to the last one's end).

1. One scan finds the contexts of all documents: hash of the anchor's string, hash of the context, place. Anchors whose hash
   occurs once in the corpus are done: none of their windows repeats. This moves a few bytes for about 140 bytes of text.
2. Equal contexts are collapsed with their count; all windows of a context that occurs twice repeat. Only anchors with several
   unlike contexts go on, one of each with its bytes.
3. These are dealt to shards by anchor hash. Each shard sorts its suffixes by Larsson-Sadakane refinement in numpy
   (ranks of 8 bytes, then doubled, only for groups that are not yet single), and gets the common prefixes of
   neighbours by Kasai's rule in text order: along a diagonal the value falls by one with each place, so only its head is compared.
   Windows with a common prefix of ``LENGTH`` bytes or more repeat.
4. An anchor with more than ``SPLIT`` unlike contexts has several shards. Each shard hands on one window of each of its classes,
   sorted by digest and cut into digest ranges; for each range, the lists of all shards are merged and each list's
   windows are found in the merged one by binary search.
5. Repeated windows return to all documents that have the context; each document's covered bytes go.

The same anchors over words instead of bytes tell which documents share a run of ``PASSAGE`` words with another one (column
``passage``); a run of words need not reach ``LENGTH`` bytes. There, unlike contexts compare the hashes of their windows.

Rows are documents: repeated rows repeat each other. A long text is searched for anchors as one array (some ten numbers of 8 bytes for each of its bytes);
one of 1 GiB or more is refused with an error. A null text is empty; texts under ``LENGTH`` bytes keep all. An empty
table gives an empty one. Other columns stay; those called like an added one are replaced, and any other name is safe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import apart, numbered, stored
from .textops import U64, Words, blocks, flat_list, key_runs, mix, pieces, powers

LENGTH = 400
CORE = 128
SPLIT = 4000
PASSAGE = 51
BYTES, WORDS = 0, 1


def _loads(raw: np.ndarray, n: int, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from each of the first n places, zeros beyond the end."""
    padded = np.zeros(n + 8, np.uint8)
    padded[: len(raw)] = raw[: n + 8]
    return np.ndarray((n,), kind, padded, strides=(1,)).astype(np.uint64)


def core_hashes(data: np.ndarray, core: int = CORE) -> np.ndarray:
    """Hash of the core bytes from each place (a power of two of 8 at least), built by doubling."""
    h, width, weight = mix(_loads(data, len(data))), 8, 0xD6E8FEB86659FD93
    while width < core:
        wide = h * U64(weight)
        if len(h) > width:
            wide[:-width] += h[width:]
        h, width, weight = wide, width * 2, (weight * weight + 2) % (1 << 64)
    return mix(h)


def contexts(h: np.ndarray, offs: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, anchor) of each context, as places in h; h[p] is the hash of the core at p."""
    size = np.diff(offs)
    long_rows = np.flatnonzero(size >= length)
    if not len(long_rows):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    n, w = len(h), length - core + 1
    bits = U64(30)  # a block, or one text, is shorter than that
    if n >= 1 << 30:
        raise ValueError("a text must be shorter than 1 GiB")
    key = (h >> bits << bits) | np.arange(n, dtype=U64)
    padded = np.full(-(-n // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(-1, w)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    beyond = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = size[long_rows] - length + 1
    ends = np.append(0, np.cumsum(windows))
    place = np.repeat(offs[long_rows] - ends[:-1], windows) + np.arange(ends[-1])
    row = np.repeat(long_rows, windows)
    anchor = (np.minimum(beyond[place], upto[place + w - 1]) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    start = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    return row[start], place[start], np.diff(np.append(start, len(place))), anchor[start]


def byte_contexts(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, ...]:
    """(row, start in the row, number of windows, core hash, context hash) of each context of a block."""
    import xxhash

    h = core_hashes(data, core)
    row, first, count, anchor = contexts(h, offs, length, core)
    view = memoryview(np.ascontiguousarray(data))
    context = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + c - 1 + length]) for a, c in zip(first.tolist(), count.tolist())), U64, len(first))
    return row, first - offs[row], count, h[anchor].view(np.int64), context.view(np.int64)


class Runs:
    """Hashes of runs of words of a block."""

    def __init__(self, words: Words):
        up, self.down = powers(len(words.hash) + 1)
        self.total = np.append(U64(0), np.cumsum(words.hash * up[: len(words.hash)]))

    def of(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.total[first + size] - self.total[first]) * self.down[first] + np.asarray(size).astype(U64))


def word_contexts(words: Words, passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """The same over words, each context once for a row."""
    runs, core = Runs(words), (passage + 1) // 2
    n = len(words.hash)
    h = np.full(n, np.iinfo(np.uint64).max, U64)
    if n >= core:
        h[: n - core + 1] = runs.of(np.arange(n - core + 1), core)
    row, first, count, anchor = contexts(h, words.first, passage, core)
    c = runs.of(first, count + passage - 1)
    _, one = np.unique(np.stack([row.astype(np.uint64), c]), axis=1, return_index=True) if len(row) else (None, np.zeros(0, np.int64))
    row, first, count, anchor, c = (x[one] for x in (row, first, count, anchor, c))
    return row, first - words.first[row], count, h[anchor].view(np.int64), c.view(np.int64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text sorted by at least ``depth`` bytes from each (zeros beyond the end)."""
    n = len(text)
    key = _loads(text, n, ">u8")
    sa = np.argsort(key)
    key = key[sa]
    sa = sa.astype(np.int32)
    fresh = np.append(True, key[1:] != key[:-1])
    del key
    rank = np.zeros(n + 1, np.int32)  # from 1; 0 beyond the end
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(1, n + 1, dtype=np.int32), 0))
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True))).astype(np.int32)
    h = 8
    while h < depth and len(open_):
        at = sa[open_]
        both = rank[at].astype(np.int64) << 32
        both |= rank[np.minimum(at + h, n)]
        order = np.argsort(both)
        both, at = both[order], at[order]
        del order
        sa[open_] = at
        fresh = np.append(True, both[1:] != both[:-1])
        del both
        rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at), dtype=np.int32), 0))] + 1
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return sa


def repeated_windows(text: np.ndarray, room: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For the starts of a shard with room for a window: whether it occurs at another such start, and whether it is the first of its class.

    room: bytes from each place to the end of its context.
    """
    n = len(text)
    sa = suffix_array(text, length)
    sa = sa[room[sa] >= length]
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    del sa
    place = np.flatnonzero(before >= 0).astype(np.int32)
    earlier = before[place]
    del before
    head = np.append(True, (place[1:] != place[:-1] + 1) | (earlier[1:] != earlier[:-1] + 1)) if len(place) else np.zeros(0, bool)
    p, q = place[head].astype(np.int64), earlier[head].astype(np.int64)
    most = np.minimum(room[p], room[q])
    word = _loads(text, n)
    common, live = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(live):
        a, b = p[live] + common[live], q[live] + common[live]
        fit = (a < n) & (b < n) & (common[live] < most[live])
        live, a, b = live[fit], a[fit], b[fit]
        differ = word[a] ^ word[b]
        low = differ & (~differ + U64(1))
        tail = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        common[live] += tail
        live = live[differ == 0]
    del word
    end = p + np.minimum(common, most)
    same = end[np.cumsum(head, dtype=np.int32) - 1] - place >= length if len(place) else np.zeros(0, bool)
    equal = np.zeros(n, bool)
    equal[place[same]] = True  # to the one before it in the suffix array
    again = equal.copy()
    again[earlier[same]] = True
    return again, ~equal


FOUND = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("spans", pa.list_(pa.int32())), ("part", pa.int32()), ("range", pa.int32()), ("digests", pa.binary()), ("kinds", pa.binary()), ("offs", pa.binary())])


def _shard(table: pa.Table, length: int) -> pa.RecordBatch:
    """Repeated windows of some contexts as rows (h, c, spans); for anchors of several shards also, for each range of digests, the
    sorted digests of one window of each class, with its context and offset."""
    import xxhash

    data = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8)
    h, c, n, parts, part = (table.column(x).to_numpy() for x in ("h", "c", "n", "parts", "part"))
    size = n + length - 1
    at = np.append(0, np.cumsum(size))
    again, lead = repeated_windows(data, np.repeat(at[1:].astype(np.int32), size) - np.arange(at[-1], dtype=np.int32), length)
    view, out = memoryview(data), []
    left: dict[tuple[int, int, int], list[tuple[int, int, np.ndarray]]] = {}
    for k, (a, m, split) in enumerate(zip(at[:-1].tolist(), n.tolist(), (parts > 1).tolist())):
        spans = np.flatnonzero(np.diff(np.concatenate([[0], again[a : a + m].view(np.int8), [0]])))
        if len(spans):
            out.append({"h": h[k], "c": c[k], "spans": spans})
        if split:
            left.setdefault((h[k], part[k], parts[k]), []).append((a, c[k], np.flatnonzero(lead[a : a + m])))
    for (anchor, own, many), rows in left.items():
        raw = b"".join(xxhash.xxh3_128_digest(view[a + i : a + i + length]) for a, _, offs in rows for i in offs.tolist())
        kinds, offs = np.repeat([x for _, x, _ in rows], [len(o) for _, _, o in rows]), np.concatenate([o for _, _, o in rows]).astype(np.int32)
        order = np.argsort(np.frombuffer(raw, "S16"), kind="stable")
        digests, kinds, offs = np.frombuffer(raw, np.uint8).reshape(-1, 16)[order], kinds[order], offs[order]
        cut = np.searchsorted(np.ascontiguousarray(digests[:, :4]).view(">u4").ravel(), [-(-r * 2**32 // int(many)) for r in range(many)])
        for r, (a, b) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(offs)])):
            if b > a:
                out.append({"h": anchor, "part": own, "range": r, "digests": digests[a:b].tobytes(), "kinds": kinds[a:b].tobytes(), "offs": offs[a:b].tobytes()})
    return pa.RecordBatch.from_pylist(out, schema=FOUND)


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The findings of all shards of batches sorted by them. An Arrow batch may hold thousands of shards: they are sorted in pieces
    of ``BLOCK_BYTES`` or one shard, as sorting takes some 50 bytes of memory for each byte."""
    for table, edge in key_runs(batches, ["h", "part"], 5000):
        offs = np.append(0, np.cumsum(table.column("n").to_numpy() + np.int64(length - 1)))[edge]
        for a, b in pieces(offs):
            piece = table.slice(edge[a], edge[b] - edge[a])
            # a repeated row may have been cut in two tasks
            one = {x: i for i, x in enumerate(zip(*(piece.column(c).to_pylist() for c in ("h", "c", "n"))))}
            yield _shard(piece.take(pa.array(list(one.values()))), length)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that another shard of the anchor has too: for each digest range, each shard's list is searched in the merged one."""
    for table, edge in key_runs(batches, ["h", "range"]):
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            raw = {c: [np.frombuffer(x, kind) for x in table.column(c).slice(lo, hi - lo).to_pylist()] for c, kind in (("digests", "S16"), ("kinds", np.int64), ("offs", np.int32))}
            merged = np.sort(np.concatenate(raw["digests"]))
            found = np.concatenate([np.searchsorted(merged, own, "right") - np.searchsorted(merged, own) > 1 for own in raw["digests"]])
            if not found.any():
                continue
            kind, off = np.concatenate(raw["kinds"])[found], np.concatenate(raw["offs"])[found]
            order = np.lexsort((off, kind))
            kind, off = kind[order], off[order]
            first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            spans = [np.stack([x, x + 1], axis=1).ravel() for x in np.split(off, first[1:])]
            h = np.full(len(first), table.column("h")[lo].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(kind[first]), pa.array(spans, pa.list_(pa.int32()))], names=["h", "c", "spans"])


KEY = ["_k1", "_k2"]
PLACES = "_k1 long, _k2 long, unit int, at int, n int, h long, c long"
CUTS = "_k1 long, _k2 long, unit int, h long, c long, n int, parts int, part int, body binary, runs array<long>"


def _places(docs: DataFrame, length: int, core: int, passage: int) -> DataFrame:
    """A row for each context of a document; those of words count once in a document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(2)):
                both = byte_contexts(data, offs, length, core), word_contexts(Words(data, offs), passage)
                row, at, n, h, c = (np.concatenate(x) for x in zip(*both))
                take = pa.array(row + a)
                unit = np.repeat(np.array([BYTES, WORDS], np.int32), [len(x[0]) for x in both])
                new = [pa.array(unit), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *new], names=[*KEY, "unit", "at", "n", "h", "c"])

    return docs.select(*KEY, "text").mapInArrow(find, PLACES)


def _cuts(docs: DataFrame, wanted: DataFrame, length: int, passage: int) -> DataFrame:
    """The bytes of the wanted contexts, and the hashes of the windows of those of words. Repeated rows are cut once in a task."""
    kind = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("unit", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("parts", pa.int32()), ("part", pa.int32()), ("body", pa.binary()), ("runs", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for a, b, data, offs in blocks(get("text")):
                out, runs = [], None
                for k, (k1, k2, some) in enumerate(zip(*(get(c).slice(a, b - a).to_pylist() for c in (*KEY, "wanted")))):
                    if (k1, k2) in seen:
                        continue
                    seen.add((k1, k2))
                    for w in some:
                        row = {"_k1": k1, "_k2": k2, "unit": w["unit"], "h": w["h"], "c": w["c"], "n": w["n"], "parts": w["parts"], "part": w["c"] % w["parts"]}
                        if w["unit"] == BYTES:
                            out.append(row | {"body": data[offs[k] + w["at"] : offs[k] + w["at"] + w["n"] + length - 1].tobytes()})
                        else:
                            if runs is None:
                                words = Words(data, offs)
                                runs = Runs(words)
                            first = words.first[k] + w["at"]
                            out.append(row | {"runs": np.unique(runs.of(np.arange(first, first + w["n"]), passage)).view(np.int64)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)

    return docs.select(*KEY, "text").join(wanted, KEY).select(*KEY, "text", "wanted").mapInArrow(cut, CUTS)


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, split: int = SPLIT, passage: int = PASSAGE) -> DataFrame:
    """(_k1, _k2, starts, passage): starts of repeated windows of a document as flat [from, to) pairs, and whether it shares a passage."""
    places = stored(_places(docs, length, core, passage))
    shared = places.groupBy("unit", "h").agg(F.count("*").alias("total")).where("total > 1").drop("total")
    suspects = stored(places.join(apart(shared), ["unit", "h"]))
    kinds = stored(suspects.groupBy("unit", "h", "c", "n").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "at")).alias("one")))
    unlike = kinds.groupBy("unit", "h").agg(F.count("*").alias("m")).where("m > 1").select("unit", "h", F.ceil(F.col("m") / split).cast("int").alias("parts"))
    open_ = kinds.join(apart(unlike), ["unit", "h"]).select("one.*", F.struct("unit", "h", "c", "n", "parts", "one.at").alias("w"))
    cuts = stored(_cuts(docs, open_.groupBy(*KEY).agg(F.collect_list("w").alias("wanted")), length, passage))

    bodies = cuts.where(F.col("unit") == BYTES).select("h", "part", "c", "n", "parts", "body")
    found = stored(bodies.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(lambda batches: _shards(batches, length), "h long, c long, spans array<int>, part int, range int, digests binary, kinds binary, offs binary"))
    lists = found.where("digests is not null").select("h", "range", "digests", "kinds", "offs")
    met = lists.repartition("h", "range").sortWithinPartitions("h", "range").mapInArrow(_merge, "h long, c long, spans array<int>")
    twice = kinds.where("times > 1").select("unit", "h", "c", F.array(F.lit(0), F.col("n")).alias("spans"))
    inside = found.where("spans is not null").select("h", "c", "spans").unionByName(met).select(F.lit(BYTES).alias("unit"), "h", "c", "spans")
    spans = suspects.join(apart(twice.unionByName(inside)), ["unit", "h", "c"])
    spans = spans.select(*KEY, F.when(F.col("unit") == BYTES, F.transform("spans", lambda s: s + F.col("at"))).alias("starts"), (F.col("unit") == WORDS).alias("passage"))
    runs = cuts.where(F.col("unit") == WORDS).select(*KEY, F.explode("runs").alias("r")).distinct()
    again = runs.groupBy("r").agg(F.count("*").alias("m")).where("m > 1").select("r")
    passages = runs.join(apart(again), "r").select(*KEY, F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("passage"))
    return spans.unionByName(passages).groupBy(*KEY).agg(F.flatten(F.collect_set("starts")).alias("starts"), F.max("passage").alias("passage"))


ADDED = (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("removed", T.ArrayType(T.LongType())), ("kept", T.BinaryType()))


def dedup(docs: DataFrame, length: int = LENGTH, core: int = CORE, split: int = SPLIT, passage: int = PASSAGE) -> DataFrame:
    """Add n_bytes, n_removed, removed (maximal runs as [from, to) pairs of bytes), kept (binary) and passage to the documents."""
    keep = [c for c in docs.columns if c not in {*(n for n, _ in ADDED), "passage"}]
    rows, names = numbered(docs.select(*keep))
    text = names["text"]
    keyed = rows.withColumns({"_k1": F.xxhash64(names["doc_id"], text), "_k2": F.xxhash64(F.lit(1), names["doc_id"], text)})
    spans = repeated_spans(keyed.select(*KEY, F.col(text).alias("text")), length, core, split, passage)
    joined = keyed.join(spans, KEY, "left").select(*names.values(), "starts", F.coalesce("passage", F.lit(False)).alias("passage"))
    kept = [*names.values(), "passage"]
    schema = T.StructType([joined.schema[c] for c in kept] + [T.StructField(n, k) for n, k in ADDED])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for a, b, data, offs in blocks(get(text)):
                flat, first = flat_list(get("starts").slice(a, b - a))
                place = flat.astype(np.int64) + np.repeat(offs[:-1], np.diff(first))
                edge = np.bincount(place[::2], minlength=len(data) + 1) - np.bincount(place[1::2] - 1 + length, minlength=len(data) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                fresh = np.zeros(len(data) + 1, bool)
                fresh[offs] = True
                starts = np.flatnonzero(gone & (fresh[:-1] | ~np.append(False, gone[:-1])))
                stops = np.flatnonzero(gone & (fresh[1:] | ~np.append(gone[1:], False))) + 1
                row = np.searchsorted(offs, starts, "right") - 1
                runs = np.stack([starts - offs[row], stops - offs[row]], axis=1).ravel()
                runs_at = 2 * np.searchsorted(row, np.arange(b - a + 1))
                left = data[~gone].tobytes()
                left_at = np.append(0, np.cumsum(~gone))[offs]
                size, kept_size = np.diff(offs), np.diff(left_at)
                bodies = pa.array([left[x:y] for x, y in zip(left_at[:-1].tolist(), left_at[1:].tolist())], pa.binary())
                new = [pa.array(size), pa.array(size - kept_size), pa.ListArray.from_arrays(pa.array(runs_at.astype(np.int32)), pa.array(runs)), bodies]
                yield pa.RecordBatch.from_arrays([get(c).slice(a, b - a) for c in kept] + new, names=[*kept, *(n for n, _ in ADDED)])

    out = joined.mapInArrow(cover, schema)
    return out.select(*(F.col(c).alias(n) for n, c in names.items()), *(n for n, _ in ADDED), "passage")


def digests(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passage")
