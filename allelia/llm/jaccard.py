"""Similarity join on word shingles by chosen paths.

Sets of five-word shingles are linked when their Jaccard similarity is 0.8 or more. Each run sends a set x down the
paths of its sampled tokens. On the first level a token is sampled when its hash in this run is under 1 / (threshold * |x|), so two
similar sets share about one sampled token and unlike sets hardly any; on the next levels it is the token with the smallest
hash of the run and level, which two sets share with the probability of their similarity. A bucket of more than ``LIMIT`` sets is split
on the next level, at most ``LEVELS`` times; members like its pivot are settled before. Two sets at the threshold share a path of the first level in one run with probability 0.63 or more, and stay
together in each split with 0.8 or more, so after the deepest split a run still finds them with 0.63 * 0.8 ** 2 = 0.40; eighteen runs reach
0.9999 there (``recall`` gives the number of runs).

Buckets are brute-forced on sketches (one-permutation minhash, 64 bytes) with a margin of five standard deviations; they
emit a spanning forest of the candidates, never all pairs. Candidate components then meet with their whole sets, in blocks
of bounded bytes, and every pair of a component is verified exactly. Results per set are its links and its class.

Equal sets are collapsed from the start and stand for all their documents. Rows without words are equal when their
texts are; null is an empty text. Texts of one to four words have one shingle of all their words. Repeated rows are linked to each
other; ties for the class go to the smallest doc_id, nulls aside; a long text is one block; an empty table gives an empty one. Only
doc_id and text are read, so other columns, however called, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import apart, connected_components, stored
from .textops import U64, Words, blocks, key_runs, mix, seeds, set_id, shingles

THRESHOLD = 0.8
RECALL = 0.9999
LEVELS = 3
LIMIT = 1024
BLOCK_SETS = 1024
BLOCK_TOKENS = 1_000_000
SKETCH = 64
RUN_BITS = 8
CELLS = 1 << 16
MARGIN = 0.25


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    """Runs until a pair at the threshold is found with this probability also where its bucket is split as deep as can be.

    A run finds it with 1 - 1/e or more on the first level, and each of the LEVELS - 1 splits keeps it together with
    the probability of its similarity.
    """
    once = (1 - math.exp(-1)) * threshold ** (LEVELS - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def sketch(tokens: np.ndarray) -> bytes:
    """One byte for each of 64 ranges of hashes: of the smallest token in it, 0 if there is none."""
    out = np.zeros(SKETCH, np.uint8)
    bin_, first = np.unique(tokens >> U64(58), return_index=True)
    out[bin_.astype(np.int64)] = (mix(tokens[first]) % U64(255)).astype(np.uint8) + 1
    return out.tobytes()


def _described(docs: DataFrame, k: int, threshold: float, runs: int) -> DataFrame:
    """(doc_id, text_key, sid, n, sketch, first, deeper): the set's id and size, its sampled paths of the first level (the run stands
    in RUN_BITS bits), and one key for each further level and run."""
    odd = seeds(LEVELS * runs, 21) | U64(1)
    salt = seeds(LEVELS * runs, 22)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(2)):
                sid, size, marks, keys = [], [], [], ([], [])
                for j, tokens in enumerate(shingles(Words(data, offs), k)):
                    sid.append(set_id(tokens, data[offs[j] : offs[j + 1]].tobytes()))
                    size.append(len(tokens))
                    marks.append(sketch(tokens))
                    if not len(tokens):
                        keys[0].append([])
                        keys[1].append([])
                        continue
                    most = U64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
                    step = max(1, CELLS // len(tokens))  # some runs at a time, so a long text stays small
                    found = [np.nonzero(tokens[None, :] * odd[r : min(r + step, runs), None] <= most) for r in range(0, runs, step)]
                    which, token = np.concatenate([w + k * step for k, (w, _) in enumerate(found)]), np.concatenate([t for _, t in found])
                    path = mix(tokens[token] ^ salt[which]) & ~U64(2**RUN_BITS - 1) | which.astype(U64)
                    keys[0].append(path.view(np.int64))
                    least = tokens[np.concatenate([np.argmin(tokens[None, :] * odd[r : r + step, None], axis=1) for r in range(runs, LEVELS * runs, step)])]
                    keys[1].append(mix(least ^ salt[runs:]).view(np.int64))
                new = [pa.array(sid, pa.binary()), pa.array(size, pa.int32()), pa.array(marks, pa.binary())] + [pa.array(x, pa.list_(pa.int64())) for x in keys]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *new], names=["doc_id", "text_key", "sid", "n", "sketch", "first", "deeper"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, sid binary, n int, sketch binary, first array<long>, deeper array<long>")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    filled = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    return ((a == b) & (a > 0)).sum(axis=1) / filled


def _against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        a, b = (np.frombuffer(b"".join(get(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch", "pivot_sketch"))
        names = ["path", "run", "sid", "pivot"]
        yield pa.RecordBatch.from_arrays([get(c) for c in names] + [pa.array(_agreement(a, b))], names=[*names, "near"])


def _buckets(sets: DataFrame, marks: DataFrame, runs: int, limit: int, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Leaves (path, sid, m) of m members, two at least; and candidate edges (a, b) from buckets over the limit.

    An oversized bucket first meets one pivot of it. Members that are about as similar to the pivot as a link asks are linked to
    it and leave: by the triangle inequality of the Jaccard distance, whatever is similar to them is near enough to the
    pivot to be linked to it as well. Only the others go down another level, so a large group of near copies is
    settled by one comparison each, as average similarity settles it in the published algorithm.
    """
    leaves, edges = None, None
    rows = sets.select(F.explode("first").alias("path"), "sid")
    rows = rows.withColumn("run", F.col("path").bitwiseAND(F.lit(2**RUN_BITS - 1).cast("long")))
    for level in range(1, LEVELS + 1):
        rows = rows.distinct()
        sizes = rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1")
        found = stored(rows.join(apart(sizes), "path"))
        leaf = found.where(F.col("m") <= limit).select("path", "sid", "m")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        big = found.where(F.col("m") > limit)
        if big.isEmpty():
            break
        # set ids are hashes, so the smallest is any member; buckets of one group of sets mostly have the same, so their edges fall together
        pivots = big.groupBy("path").agg(F.min("sid").alias("pivot"))
        pivots = pivots.join(marks.select(F.col("sid").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
        met = big.select("path", "run", "sid").join(marks, "sid").join(pivots, "path").select("path", "run", "sid", "pivot", "sketch", "pivot_sketch")
        met = stored(met.mapInArrow(_against_pivot, "path long, run long, sid binary, pivot binary, near double"))
        linked = met.where(F.col("near") >= threshold - 2 * (1 - threshold)).where("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
        edges = linked if edges is None else edges.unionByName(linked)
        rest = met.where(F.col("near") < threshold).select("path", "run", "sid")
        if level == LEVELS:
            left = rest.join(apart(rest.groupBy("path").agg(F.count("*").alias("m")).where("m > 1")), "path")
            leaves = leaves.unionByName(left.select("path", "sid", "m"))
            break
        more = sets.select("sid", "deeper").dropDuplicates(["sid"])
        key = F.get("deeper", (F.lit((level - 1) * runs) + F.col("run")).cast("int"))
        rows = rest.join(more, "sid").select(F.xxhash64("path", key).alias("path"), "sid", "run")
    return leaves, edges


def _pairs_of_blocks(rows: DataFrame, blocks_: F.Column, by: str) -> DataFrame:
    """Add blk, i, j: rows are dealt over blocks, and each block meets each other one, and itself, once."""
    rows = rows.withColumn("_k", blocks_.cast("int")).withColumn("blk", F.pmod(F.xxhash64(by), F.col("_k")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return rows.withColumn("i", F.least("blk", "_o")).withColumn("j", F.greatest("blk", "_o")).drop("_k", "_o")


def _leaders(near: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component, from an adjacency matrix."""
    n = len(near)
    lead = np.arange(n)
    while True:
        low = np.minimum(lead, np.where(near, lead[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == lead).all():
            return lead
        lead = low


def _forests(cut: float):
    """Spanning forests of the candidates in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in key_runs(batches, ["path", "i", "j"], 20_000):
            marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            blk, i, j = (table.column(c).to_numpy() for c in ("blk", "i", "j"))
            size = np.diff(at)
            two = at[:-1][size == 2]
            fit = two[_agreement(marks[two], marks[two + 1]) >= cut]
            left, right = [fit], [fit + 1]
            for lo, m in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
                s = marks[lo : lo + m]
                same, both_empty = np.zeros((m, m), np.int16), np.zeros((m, m), np.int16)
                for c in range(SKETCH):
                    col = s[:, c]
                    equal = col[:, None] == col[None, :]
                    empty = col == 0
                    if empty.any():
                        pair = empty[:, None] & empty[None, :]
                        both_empty += pair
                        equal &= ~pair
                    same += equal
                near = same >= cut * np.maximum(SKETCH - both_empty, 1)
                if i[lo] != j[lo]:
                    near &= blk[lo : lo + m][:, None] != blk[lo : lo + m][None, :]
                lead = _leaders(near)
                other = np.flatnonzero(lead != np.arange(m))
                left.append(lo + lead[other])
                right.append(lo + other)
            sid = table.column("sid").combine_chunks()
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(np.concatenate(left))), sid.take(pa.array(np.concatenate(right)))], names=["a", "b"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, holds = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    on = holds[column] > 1
    row, column = row[on], np.unique(column[on], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m), np.float32)
    wide = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        x = np.zeros((m, wide), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def _verified(threshold: float):
    """For each set of a block pair: linked documents and sets, and the smallest set id of its links' component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in key_runs(batches, ["root", "i", "j"], 200):
            sids = np.array(table.column("sid").to_pylist(), object)
            raw = table.column("tokens").to_pylist()
            copies = table.column("copies").to_numpy()
            blk, i, j = (table.column(c).to_numpy() for c in ("blk", "i", "j"))
            docs, sets, lead = np.zeros(len(sids), np.int64), np.zeros(len(sids), np.int64), sids.copy()
            first = np.zeros(len(sids), bool)  # a repeated row may bring a set twice
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                _, one = np.unique(np.array([s.hex() for s in sids[lo:hi]]), return_index=True)
                place = lo + one  # in order of the set ids
                first[place] = True
                tokens = [np.frombuffer(raw[p], np.uint64) for p in place.tolist()]
                n = np.array([len(t) for t in tokens])
                if len(place) == 2:
                    both = len(np.intersect1d(*tokens, assume_unique=True))
                    common = np.array([[n[0], both], [both, n[1]]])
                else:
                    common = overlaps(tokens)
                near = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9
                np.fill_diagonal(near, False)
                if i[lo] != j[lo]:
                    near &= blk[place][:, None] != blk[place][None, :]
                docs[place], sets[place] = near @ copies[place], near.sum(axis=1)
                lead[place] = sids[place][_leaders(near)]
            keep = np.flatnonzero(first)
            yield pa.RecordBatch.from_arrays([pa.array(sids[keep], pa.binary()), pa.array(docs[keep]), pa.array(sets[keep]), pa.array(lead[keep], pa.binary())], names=["sid", "docs", "sets", "lead"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = 5, recall: float = RECALL, limit: int = LIMIT, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, class_id, n_links, lead, text_key) for each row.

    class_id is the smallest doc_id of its class (documents that links connect), n_links counts the other documents that are
    linked to it directly, lead names the class also where doc_ids repeat, text_key is the text's xxhash64.
    """
    runs = runs_for(recall, threshold)
    if runs > 2**RUN_BITS:
        raise ValueError(f"recall {recall} at threshold {threshold} asks for {runs} runs, over {2**RUN_BITS}")
    sets = stored(_described(docs, k, threshold, runs))
    # rep names the set's class; pick is one text that has the set, by its id and its hash, so rows with one id (or none) do not meet each other's sets
    unique = sets.groupBy("sid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_key")).alias("pick"), F.min("n").alias("n"))
    marks = sets.select("sid", "sketch").dropDuplicates(["sid"])
    leaves, far = _buckets(sets, marks, runs, limit, threshold)
    leaves = _pairs_of_blocks(leaves, F.ceil(F.col("m") / (2 * limit)), "sid")
    members = leaves.join(marks, "sid").select("path", "i", "j", "blk", "sid", "sketch")
    cut = max(0.0, threshold - MARGIN)
    # by set id within a bucket, so the leader of a forest is the smallest and different buckets give equal edges
    edges = members.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "sid").mapInArrow(_forests(cut), "a binary, b binary")
    parts = connected_components(edges if far is None else edges.unionByName(far))
    parts = stored(parts.join(unique, F.col("node") == F.col("sid")).select("root", "sid", "copies", "pick", "n"))
    weight = parts.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_tokens)).alias("k"))
    wanted = parts.join(apart(weight), "root").select("root", "k", "sid", "copies", F.col("pick.doc_id").alias("pick_id"), F.col("pick.text_key").alias("pick_key"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent_before: set[bytes] = set()  # equal rows bring a set many times; one is enough
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for a, b, data, offs in blocks(get("text")):
                found = shingles(Words(data, offs), k)
                same = [len(t) > 0 and set_id(t, b"") == s and s not in sent_before and not sent_before.add(s) for t, s in zip(found, get("sid").slice(a, b - a).to_pylist())]
                part = batch.slice(a, b - a).filter(pa.array(same))
                sent = pa.array([t.tobytes() for t, s in zip(found, same) if s], pa.binary())
                names = ["root", "k", "sid", "copies"]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [sent], names=[*names, "tokens"])

    with_text = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("pick_id")) & (F.xxhash64("text") == F.col("pick_key")))
    whole = with_text.select("root", "k", "sid", "copies", "text").mapInArrow(tokens, "root binary, k long, sid binary, copies long, tokens binary")
    whole = _pairs_of_blocks(whole, F.col("k"), "sid").drop("k")
    checked = stored(whole.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verified(threshold), "sid binary, docs long, sets long, lead binary"))
    links = checked.groupBy("sid").agg(F.sum("docs").alias("docs"), F.sum("sets").alias("sets"), F.count("*").alias("met"), F.min("lead").alias("lead"))
    if checked.groupBy("sid").count().where("count > 1").isEmpty():
        links = links.select("sid", "docs", "lead")
    else:  # components of several blocks
        roots = connected_components(checked.select(F.col("sid").alias("a"), F.col("lead").alias("b")))
        links = links.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "docs", F.coalesce("root", "sid").alias("lead"))
    each = stored(unique.join(links, "sid", "left").select("sid", "copies", "rep", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("lead", "sid").alias("lead")))
    classes = each.groupBy("lead").agg(F.min("rep").alias("class_id"))
    found = each.join(apart(classes), "lead").select("sid", "class_id", "lead", (F.col("copies") - 1 + F.col("docs")).alias("n_links"))
    return sets.select("doc_id", "text_key", "sid").join(found, "sid").select("doc_id", "class_id", "n_links", "lead", "text_key")
