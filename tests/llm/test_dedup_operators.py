"""Suffix arrays, similarity join, line dedup and sharding against plain-Python versions; toxicity on held-out rows."""

import hashlib
import os
import pickle
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import DOCS, invented, words

from allelia.llm import jaccard, lines, sharding, shared, suffix, textops, toxicity


def mixed_docs(seed=1):
    """Exact and near copies, shared passages, nulls, empty and periodic texts, a long text, repeated rows."""
    rng = random.Random(seed)
    passage, base = invented(rng, 70, 400), [invented(rng, 90, 400) for _ in range(4)]
    docs = [(k, invented(rng, rng.randrange(1, 120), 400)) for k in range(30)]
    docs += [(100 + k, base[k % 4]) for k in range(9)]
    for k in range(14):
        w = base[k % 4].split()
        w[rng.randrange(len(w))] = f"new{k}"
        docs.append((200 + k, " ".join(w)))
    docs += [(300 + k, f"{invented(rng, 20, 400)} {passage} {invented(rng, 20, 400)}") for k in range(6)]
    docs += [(400, None), (401, ""), (402, None), (403, "?!"), (404, "?!"), (405, "one two"), (406, "One, two!"), (407, "ab" * 900), (408, "ab" * 700 + "c"), (409, invented(rng, 9000, 400))]
    return docs + [docs[3], docs[3], docs[31], (None, "no id here at all, none"), (None, base[0])]


# suffix arrays


def brute_repeats(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(docs, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "core", "split"), [(400, 128, 4000), (48, 16, 4000), (48, 16, 2)])
def test_suffix_dedup_against_brute_force(spark, length, core, split):
    docs = mixed_docs()
    out = suffix.dedup(spark.createDataFrame([(*d, 1, "k") for d in docs], DOCS + ", n_bytes int, kept string"), length, core, split)
    got = Counter(tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", (F.size("removed") / 2).cast("int"), F.sha2("kept", 256)).collect())
    assert got == brute_repeats(docs, length)


def brute_shared_passages(docs, size):
    runs = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (words(t) for _, t in docs)]
    seen = Counter(g for r in runs for g in r)
    return Counter((d, any(seen[g] > 1 for g in r)) for (d, _), r in zip(docs, runs))


@pytest.mark.parametrize("passage", [51, 6])
def test_documents_that_share_a_passage(spark, passage):
    rng = random.Random(21)
    share = invented(rng, 90, 400).split()
    docs = mixed_docs(4) + [(500 + k, f"{invented(rng, 30, 400)} {' '.join(share[: 45 + k])} {invented(rng, 30, 400)}") for k in range(12)]
    docs += [(600, " ".join(share[60:64] * 40)), (601, "one two three four five six"), (602, "one two three four five SIX!")]
    got = suffix.dedup(spark.createDataFrame([(*d, True) for d in docs], DOCS + ", passage boolean"), passage=passage).select("doc_id", "passage")
    assert Counter(tuple(r) for r in got.collect()) == brute_shared_passages(docs, passage)


def test_suffix_dedup_of_many_repeated_rows(spark):
    """Equal rows and rows without an id are collapsed before anything is compared."""
    text = invented(random.Random(5), 900, 400)
    rows = [(1, text)] * 2000 + [(None, text + " end")] * 2000 + [(2, "start " + text), (3, "short")]
    out = suffix.dedup(spark.createDataFrame(rows, DOCS)).groupBy("doc_id", "n_bytes", "n_removed", "passage").count().collect()
    n = len(text.encode())
    assert {tuple(r) for r in out} == {(1, n, n, True, 2000), (None, n + 4, n + 4, True, 2000), (2, n + 6, n, True, 1), (3, 5, 0, False, 1)}


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op3_url_filter", "op4_jaccard_join", "op6_licence_scan", "op7_decontamination", "op8_sharding", "op10_line_dedup", "op10_line_chunks"])
def test_text_queries_equal_their_sql(spark, name):
    import duckdb

    from allelia.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(rel.columns)
    assert Counter(tuple(r) for r in got.select(*rel.columns).collect()) == Counter(rel.fetchall())


def test_suffix_dedup_of_nothing(spark):
    assert suffix.digests(spark.createDataFrame([], DOCS)).collect() == []


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1600] = text[:600]
    sa = suffix.suffix_array(text, 3000)
    raw = text.tobytes()
    assert [raw[i:] for i in sa] == sorted(raw[i:] for i in range(len(raw)))


def test_many_shards_of_one_batch_take_the_memory_of_a_piece():
    """An Arrow batch of 2,400 contexts (1.4 MB) of 600 anchors; sorted at once, it took 100 bytes for each of its own."""
    rng, rows = np.random.default_rng(2), []
    for h in range(600):
        stem = rng.integers(97, 123, 672, dtype=np.uint8)
        for k in range(4):
            n = int(rng.integers(100, 274))
            at = int(rng.integers(0, 274 - n))
            body = stem[at : at + n + 399].copy()
            if k % 2:
                body[rng.integers(0, len(body))] ^= 1
            rows.append({"h": h, "part": 0, "c": len(rows), "n": n, "parts": 1, "body": body.tobytes()})
    kind = pa.schema([("h", pa.int64()), ("part", pa.int32()), ("c", pa.int64()), ("n", pa.int32()), ("parts", pa.int32()), ("body", pa.binary())])
    batch = pa.RecordBatch.from_pylist([*rows, rows[-1]], kind)  # the last one cut in two tasks
    tracemalloc.start()
    try:
        found = list(suffix._shards(iter([batch]), 400))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 50e6
    seen = Counter((r["h"], hash(r["body"][i : i + 400])) for r in rows for i in range(r["n"]))
    again = {r["c"]: [seen[r["h"], hash(r["body"][i : i + 400])] > 1 for i in range(r["n"])] for r in rows}
    spans = {c: np.flatnonzero(np.diff([0, *x, 0])).tolist() for c, x in again.items() if any(x)}
    assert {r["c"]: r["spans"] for t in found for r in t.to_pylist()} == spans


# similarity join


def brute_link_rows(docs, t=0.8):
    """(doc_id, smallest doc_id of the class, links) of each row."""
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    links = defaultdict(set)
    for i in range(len(docs)):
        for j in range(len(docs)):
            if i != j:
                a, b = sets[i], sets[j]
                same = (docs[i][1] or "") == (docs[j][1] or "") if a is None or b is None else len(a & b) >= t * len(a | b) - 1e-9
                if same:
                    links[i].add(j)
    classes = {}
    for i in range(len(docs)):
        if i not in classes:
            todo, members = [i], {i}
            while todo:
                for v in links[todo.pop()]:
                    if v not in members:
                        members.add(v)
                        todo.append(v)
            low = min((docs[m][0] for m in members if docs[m][0] is not None), default=None)
            classes |= dict.fromkeys(members, low)
    return [(docs[i][0], classes[i], len(links[i])) for i in range(len(docs))]


def brute_links(docs, t=0.8):
    return Counter(brute_link_rows(docs, t))


@pytest.mark.parametrize("kw", [{}, {"limit": 3, "block_sets": 2}])
def test_similarity_join_against_brute_force(spark, kw):
    docs = mixed_docs(2)
    got = jaccard.near_duplicates(spark.createDataFrame(docs, DOCS), **kw)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_links(docs)


def test_rows_without_ids_do_not_meet_each_others_sets(spark):
    """2,000 near copies without an id, and as many with one id; the rows with texts grow with the sets, not with their square."""
    rng = random.Random(8)
    base = invented(rng, 200, 400).split()
    docs = []
    for k in range(2000):
        w = list(base)
        w[rng.randrange(len(w))] = f"own{k}"
        docs.append((None if k % 2 else 7, " ".join(w)))
    docs += [docs[1]] * 50
    got = jaccard.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert len(got) == 2050 and {r.class_id for r in got} == {7} and len({r.lead for r in got}) == 1
    assert min(r.n_links for r in got) >= 2000


def test_similarity_join_of_nothing(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert jaccard.near_duplicates(spark.createDataFrame([(1, None)], DOCS)).select("doc_id", "class_id", "n_links").collect() == [(1, 1, 0)]


def hot_pairs(n=400):
    """Pairs that differ in one of twelve passages, at a similarity just over the threshold; every passage stands in many documents."""
    rng = random.Random(11)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(100)]
    docs = []
    for k in range(n):
        *one, new = rng.sample(range(100), 13)
        other = [*one[:-1], new]
        docs += [(2 * k, " ".join(passages[i] for i in sorted(one))), (2 * k + 1, " ".join(passages[i] for i in sorted(other)))]
    return docs


def test_similarity_join_keeps_its_recall_in_split_buckets(spark):
    docs = hot_pairs()
    want = sum(n for (_, _, n), times in brute_links(docs).items() for _ in range(times))
    got = jaccard.near_duplicates(spark.createDataFrame(docs, DOCS), recall=0.9, limit=4).agg(F.sum("n_links")).first()[0]
    assert 700 <= want and 0.9 * want <= got <= want


@pytest.mark.parametrize("recall", [0.9, 0.9999, 0.999999])
def test_runs_are_counted_for_the_deepest_split(recall):
    once = (1 - np.exp(-1)) * jaccard.THRESHOLD ** (jaccard.LEVELS - 1)
    runs = jaccard.runs_for(recall)
    assert 1 - (1 - once) ** runs >= recall > 1 - (1 - once) ** (runs - 1)


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = jaccard.overlaps(sets)
    assert all(got[i, j] == want[i][j] for i in range(12) for j in range(12) if i != j)


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(20)]
    got = {r.node: r.root for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[100 + k] == 100 for k in range(40))
    assert all(got[a] == got[b] for a, b in edges if a != b)


def test_no_plan_of_the_join_reads_many_tables(spark, monkeypatch):
    """For each file scan and stage of a plan the driver broadcasts a block of 4 MB, so plans that are run at once are small."""
    scans, put = [], shared.stored

    def counted(df, **options):
        scans.append(df._jdf.queryExecution().sparkPlan().toString().count("FileScan"))
        return put(df, **options)

    monkeypatch.setattr(shared, "stored", counted)
    monkeypatch.setattr(jaccard, "stored", counted)
    found = jaccard.near_duplicates(spark.createDataFrame(mixed_docs(4), DOCS))
    scans.append(found._jdf.queryExecution().sparkPlan().toString().count("FileScan"))
    assert len(scans) > 4 and max(scans) <= 4, scans


# line dedup


def line_docs():
    rng = random.Random(4)
    shared_lines = [f"shared line {k} {'x' * (k % 5)}" for k in range(40)]
    docs = []
    for k in range(40):
        own = [f"own {k} {i} {rng.random()}" for i in range(rng.randrange(9))]
        docs.append((k, "\n".join(own + (shared_lines[: rng.randrange(5, 40)] if k % 2 else []) + own[:1])))
    return docs + [(90, None), (91, ""), (92, "\n\n\n"), (93, "\n\n\n"), (94, "a\r\nb"), docs[3], docs[3], (None, docs[5][1]), (95, "\n".join(f"l{i}" for i in range(4000)))]


def brute_lines(docs, every):
    def value(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)

    def chunks(text):
        ls = (text or "").split("\n")
        h, out, start = [value(x) for x in ls], [], 0
        for i in range(len(ls)):
            roll = h[i] + 31 * (h[i - 1] if i > 0 else 0) + 961 * (h[i - 2] if i > 1 else 0)
            if i == len(ls) - 1 or roll % every == 0:
                out.append((start, ls[start : i + 1]))
                start = i + 1
        return out

    first = {}
    for d, text in sorted({*docs}, key=lambda x: (x[0] is None, x[0] or 0)):
        for at, c in chunks(text):
            if len(c) > 1:
                first.setdefault("\n".join(c), (d, text, at))
    out = []
    for d, text in docs:
        kept, removed = [], 0
        for at, c in chunks(text):
            if len(c) > 1 and first["\n".join(c)] != (d, text, at):
                removed += len(c)
            else:
                kept.append("\n".join(c))
        out.append((d, text if not removed else "\n".join(kept), removed))
    return Counter(out)


def test_line_dedup_against_brute_force(spark):
    docs = line_docs()
    df = spark.createDataFrame([(d, t, "en", 3) for d, t in docs], DOCS + ", lang string, n_removed int")
    out = lines.dedup(df)
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_removed", "n_chunks_removed"]
    assert Counter((r.doc_id, r.text, r.n_removed) for r in out.collect()) == brute_lines(docs, lines.EVERY)
    assert lines.digests(df.limit(0)).collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_passages(docs):
    """(doc_id, text without the runs of two lines or more that occur earlier, removed lines, removed runs)."""
    first, cut = {}, {d: (d[1] or "").split("\n") for d in docs}
    for d in sorted({*docs}, key=lambda x: (x[0] is None, x[0] or 0)):
        for i, pair in enumerate(zip(cut[d], cut[d][1:])):
            first.setdefault(pair, (d, i))
    out = []
    for d in docs:
        gone = {k for i, pair in enumerate(zip(cut[d], cut[d][1:])) if first[pair] != (d, i) for k in (i, i + 1)}
        left = "\n".join(x for i, x in enumerate(cut[d]) if i not in gone)
        out.append((d[0], left if gone else d[1], len(gone), sum(k - 1 not in gone for k in gone)))
    return Counter(out)


def test_line_passages_against_brute_force(spark):
    docs = line_docs() + [(96, "a\na\na\nb"), (97, "c\na\na\nb\nc")]
    out = lines.dedup_passages(spark.createDataFrame([(d, t, "en", 3) for d, t in docs], DOCS + ", lang string, n_removed int"))
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_removed", "n_chunks_removed"]
    assert Counter((r.doc_id, r.text, r.n_removed, r.n_chunks_removed) for r in out.collect()) == brute_passages(docs)
    assert lines.passage_digests(out.limit(0)).collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_short_passages_in_unlike_contexts_go(spark):
    """Passages of 2 to 10 lines between lines of their own: each later occurrence loses exactly its passage."""
    rng = random.Random(6)
    own = lambda: [f"own {rng.random()}" for _ in range(rng.randrange(1, 9))]
    passages = [[f"passage {k} {i}" for i in range(2 + k % 9)] for k in range(36)]
    first = [(k, "\n".join(own() + p + own())) for k, p in enumerate(passages)]
    around = [(own(), own()) for _ in passages]
    later = [(100 + k, "\n".join(a + p + b)) for k, (p, (a, b)) in enumerate(zip(passages, around))]
    got = {r.doc_id: (r.text, r.n_removed, r.n_chunks_removed) for r in lines.dedup_passages(spark.createDataFrame(first + later, DOCS)).collect()}
    assert all(got[d] == (t, 0, 0) for d, t in first)
    assert all(got[100 + k] == ("\n".join(a + b), len(p), 1) for k, (p, (a, b)) in enumerate(zip(passages, around)))


def test_each_density_removes_what_coarser_ones_leave(spark):
    """Long repeated passages go mostly as long chunks, also if lines before them differ; pairs take their ends and the short ones."""
    rng = random.Random(12)
    passage = [f"line {k} of a long passage" for k in range(400)]
    own = lambda n: [f"own {rng.random()}" for _ in range(n)]
    docs = [(0, "\n".join(passage))] + [(k, "\n".join([*own(k % 5), *passage[k : 380 + k], *own(3)])) for k in range(1, 12)]
    docs += [(20, "\n".join([*own(1), *passage[5:7], *own(1)])), (21, None), (22, "")]
    rows = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", n_removed_by string")
    got = {r.doc_id: r for r in lines.dedup_passages(rows, by_density=True).collect()}
    plain = {r.doc_id: r for r in lines.dedup_passages(rows).collect()}
    assert all((got[d].text, got[d].n_removed) == (plain[d].text, plain[d].n_removed) and sum(got[d].n_removed_by) == got[d].n_removed for d, _ in docs)
    for k in range(1, 12):
        coarse, middle, pairs = got[k].n_removed_by
        assert got[k].n_removed == 380 and coarse > 200 and coarse + middle + pairs == 380 and pairs < 40
    assert got[20].n_removed_by == [0, 0, 2] and plain[20].n_removed_by == "x"


# sharding


@pytest.mark.parametrize("limit", [200, 3000, 10**9])
def test_shards_fit_and_split_only_where_needed(spark, limit):
    docs = mixed_docs(3) + [(7, "same row " * 9)] * 30 + [(8, f"hot key {k}") for k in range(60)]
    got = sharding.assign(spark.createDataFrame([(*d, "s") for d in docs], DOCS + ", shard string"), limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((d, len((t or "").encode())) for d, t in docs)
    size = defaultdict(int)
    for r in got:
        size[r["shard"]] += r.n_bytes
        assert r.oversize == (r.n_bytes > limit) and (r.oversize or len(r["shard"].split(".")[0]) == r.depth)
    alone = {r["shard"] for r in got if r.oversize}
    assert all(n <= limit for s, n in size.items() if s not in alone)
    # a bucket's parent is over the limit
    whole = defaultdict(int)
    for r in got:
        bits = r["shard"].split(".")[0]
        for d in range(len(bits)):
            whole[bits[:d]] += r.n_bytes
    assert all(n > limit for n in whole.values())
    if limit == 10**9:
        assert set(size) == {""}


def test_shards_of_nothing(spark):
    assert sharding.assign(spark.createDataFrame([], DOCS)).collect() == []


# toxicity


def toxic_rows(n=700):
    rng = random.Random(8)
    bad = ["vile", "nasty", "rotten"]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        w = invented(rng, rng.randrange(20, 90), 300).split()
        if toxic:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(len(w)), b)
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_rows()
    rows = [*docs, (9000, None), (9001, ""), (9002, "vile nasty " * 20_000)]
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(x[0], None, x[2]) for x in labels[:4]] + [x for x in labels if not x[0] % 4], "doc_id long, quality int, toxic int")
    out = toxicity.judge(spark.createDataFrame([(*r, 0.5) for r in rows], DOCS + ", p_toxic double"), known)
    got = {r.doc_id: r for r in out.collect()}
    held = [x for x in labels if x[0] % 4 == 2]
    hits = sum(got[d].toxic == bool(t) for d, _, t in held)
    assert hits >= 0.97 * len(held) and len(got) == len(rows)
    assert not got[9000].toxic and not got[9001].toxic and got[9002].toxic
    assert got[9000].p_toxic == got[9001].p_toxic


def brute_chain(docs, labels):
    """p_toxic of the chain by dense matrices: features by sets of words, Newton's method on whole matrices, the same folds."""
    known = sorted(labels)
    text = dict(docs)

    def shape(t):
        raw, w = (t or "").encode(), words(t)
        n, size = max(len(w), 1), max(len(raw), 1)
        upper = sum(65 <= b <= 90 for b in raw)
        sign = sum(b < 128 and b != 32 and not chr(b).isalnum() for b in raw)
        return [upper / size, sign / size, len({column[x] for x in w}) / n, np.log1p(n) / 10]

    vocab = sorted({w for _, t in docs for w in words(t)})
    column = dict(zip(vocab, (int(h) % toxicity.DIMS for h in textops.word_hashes(vocab))))  # few words share a column
    columns = sorted({*column.values()})
    has = lambda ids: np.array([[c in s for c in columns] for s in ({column[w] for w in words(text[i])} for i in ids)], float)
    ids, every = [i for i, _, _ in known], [i for i, _ in docs]
    x, xs = has(ids), has(every)
    extra, extras = np.array([shape(text[i]) for i in ids]), np.array([shape(text[i]) for i in every])
    fold = np.arange(len(ids)) % toxicity.FOLDS

    def model(on, y, extra):
        if y[on].min() == y[on].max():
            return None, np.append(np.zeros(extra.shape[1]), 30.0 if y[on][0] else -30.0)
        holds, share = x[on].sum(axis=0), y[on].mean()
        z = np.abs(x[on].T @ y[on] - holds * share) / np.sqrt(np.maximum(holds, 1) * share * (1 - share))
        chosen = np.flatnonzero((holds >= toxicity.LEAST_ROWS) & (z > toxicity.LEAST_Z))
        m = np.column_stack([x[on][:, chosen], extra[on], np.ones(on.sum())])
        hold, w = np.full(m.shape[1], toxicity.PENALTY), np.zeros(m.shape[1])
        hold[-1] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
            step = np.linalg.solve((m.T * (p * (1 - p))) @ m + np.diag(hold), m.T @ (p - y[on]) + hold * w)
            w -= step * min(1, 5 / np.abs(step).max())
        return chosen, w

    def scores(found, x, extra):
        chosen, w = found
        m = np.column_stack([x[:, chosen] if chosen is not None else x[:, :0], extra, np.ones(len(x))])
        return 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))

    for col, value in ((1, 0), (2, 1)):
        y = np.array([int(r[col] == value) for r in known])
        outside = np.zeros(len(ids))
        for k in range(toxicity.FOLDS):
            outside[fold == k] = scores(model(fold != k, y, extra), x[fold == k], extra[fold == k])
        whole = scores(model(np.ones(len(ids), bool), y, extra), xs, extras)
        extra, extras = np.column_stack([extra, outside]), np.column_stack([extras, whole])
    return dict(zip(every, extras[:, -2:].tolist()))


def test_toxicity_against_brute_force(spark):
    docs, labels = toxic_rows(300)
    labels = [(d, int(d % 5 > 0), t) for d, _, t in labels if d % 4]
    docs = [(d, t + " shoddy" * (d % 5 == 0)) for d, t in docs]
    want = brute_chain(docs, labels)
    out = toxicity.judge(spark.createDataFrame(docs + docs[:4], DOCS), spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) + 4
    for r in out:
        assert np.allclose([r.p_low_quality, r.p_toxic], want[r.doc_id], atol=1e-3), (r, want[r.doc_id])
    assert len({round(r.p_toxic, 6) for r in out}) > 20


def test_toxicity_rows_stay_out_of_the_driver(spark, monkeypatch):
    """Training brings weights and probabilities to the driver and sends out no more, however long the texts are."""
    sent = []
    for kind, name in ((type(spark.range(1)), "collect"), (type(spark.range(1)), "toArrow"), (type(spark.range(1)), "toPandas")):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name): sent.append(out := f(self)) or out)
    put = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or put(value))
    rows = [(k, " ".join([f"w{k}x{i}" for i in range(1500)] + ["vile"] * (k % 3 == 0))) for k in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k, _ in rows], "doc_id long, quality int, toxic int")
    models = toxicity.train(docs, labels)
    assert sum(len(pickle.dumps(x)) for x in sent) < 50_000  # their words alone take 900,000
    assert len(np.flatnonzero(models[1])) > 1


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "vile"), (1, "vile")], DOCS)
    assert [r.toxic for r in toxicity.judge(docs, none).collect()] == [False, False]
    assert toxicity.judge(docs.limit(0), spark.createDataFrame([(1, 1, 1)], none.schema)).collect() == []


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(1)
    y = np.arange(300) % 2
    column, first, extra = np.zeros(0, np.int32), np.zeros(301, np.int64), (y + rng.normal(0, 0.1, 300))[:, None]
    w = toxicity.fit(column, first, extra, y)
    p = toxicity.probability(w, column, first, extra)
    assert ((p > 0.5) == y).mean() > 0.98
