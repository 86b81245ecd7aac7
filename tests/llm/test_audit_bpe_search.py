"""Filter interactions, byte-level BPE and ranked search against plain-Python versions and the library."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_text_operators import DOCS, invented

from allelia.llm import audit, bpe, search

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# filter interactions


def brute_audit(docs, labels):
    flags = []
    for d, t, lang in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        own = [(q, x) for i, q, x in labels if i is not None and i == d]
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * any(x is not None and d is not None and x < d and (y or "") == t for x, y, _ in docs)
        flags.append((lang or "", set(fails), any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = []
    for part in {p for p, *_ in flags}:
        own = [f[1:] for f in flags if f[0] == part]
        shares = Counter()
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shares[f] += len(hit)
                rows.append((part, "".join(order), step, len(left), len(hit), sum(f in x[0] for x in own) - len(hit), sum(x[0] == {f} for x in own), sum(x[1] for x in hit), sum(x[2] for x in hit), f))
        out += [(*r[:-1], shares[r[-1]]) for r in rows]
    return sorted(out)


def audit_docs():
    rng = random.Random(4)
    docs = []
    for k in range(160):
        t = invented(rng, rng.choice([5, 99, 100, 140]), rng.choice([20, 4000]))
        t = t.upper() if rng.random() < 0.2 else t
        t += rng.choice(["", " #", "\x0bend", " one ", " $5"])
        docs.append((k, t, rng.choice(["en", "de", None, ""])))
    docs += [(1000 + k, docs[k % 3][1], "en") for k in range(20)] + [(300, None, "en"), (301, "", "en"), (None, docs[0][1], "en"), (None, None, None), docs[5], docs[5], (302, "Aa" * 5000, "de"), (5, "", "fr")]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(0, 160, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_brute_force(spark):
    docs, labels = audit_docs()
    rows = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, lang string, every int, digest string")
    found = audit.audit(rows, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string"))
    assert found.columns == COLUMNS
    got = sorted(map(tuple, found.collect()))
    assert got == brute_audit(docs, labels) and len(got) == 4 * 600


def test_audit_identities(spark):
    """What remains is the same in every order, the shares of all filters add up to what is removed, and no filter removes what it does not fail."""
    docs, labels = audit_docs()
    rows = audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for part in {r.part for r in rows}:
        own = [r for r in rows if r.part == part]
        assert len({r.kept for r in own if r.step == 5}) == 1
        shares = {r.filter_order[r.step - 1]: r.shapley for r in own}
        size = own[0].kept + own[0].removed
        assert sum(shares.values()) == 120 * (size - next(r.kept for r in own if r.step == 5))
        assert all(r.unique_fails <= r.removed and r.redundant >= 0 for r in own)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = audit.audit(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and {r.good_lost for r in one} == {0}


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))


def hostile():
    rng = random.Random(6)
    parts = ["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "1", "²", "!", "é", "漢", "　", " ", "<|endoftext|>", "<|endof", "'ve", "'S", "\U0001f600", "xxxx", "the", "ing", "\x00", "̀", "​", "▁", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    return [*texts, "", "a" * 5000, "ab" * 3000, "the" * 2000, "\n" * 300, "<|endoftext|>" * 5, " <|endoftext|> ", "it'll we've I'm 'tis ''s", "".join(chr(c) for c in range(0x20, 0x3000))]


def test_bpe_equals_the_library(spark, library):
    texts = hostile()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = [(k, t, 5, "mine") for k, t in enumerate(texts)] + [(-1, None, 5, "mine"), (3, texts[3], 5, "mine"), (None, "no id", 5, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for k, ids in enumerate(want):
        r = got[k]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), repr(texts[k])
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert (got[-1].n_tokens, got[-1].decoded_sha256) == (0, hashlib.sha256(b"").hexdigest()) and bpe.digests(docs).count() == len(rows)
    whole = bpe.decode(bpe.encode(docs))
    assert whole.columns == ["doc_id", "n_tokens", "ids", "text"]
    assert all(r.text == (texts[r.doc_id] if r.doc_id is not None and r.doc_id >= 0 else "no id" if r.doc_id is None else "") for r in whole.collect())
    assert bpe.digests(docs.limit(0)).count() == 0


def test_neighbours_are_compatible_just_when_they_encode_to_themselves(library):
    m = bpe.model(None)
    rng = np.random.default_rng(2)
    ids = np.array([i for i in range(m.width) if m.bytes_of[i] and i not in set(m.added.values())])
    short = ids[[len(m.bytes_of[i]) <= 3 for i in ids]]
    a, b = np.concatenate([rng.choice(ids, 1500), rng.choice(short, 3000)]), np.concatenate([rng.choice(ids, 1500), rng.choice(short, 3000)])
    got = m.compatible(a, b)
    assert m.sound.all() and 100 < got.sum() < len(got)
    for x, y, fit in zip(a.tolist(), b.tolist(), got.tolist()):
        exact = m.one_by_one([int(m.byte_id[c]) for c in m.bytes_of[x] + m.bytes_of[y]])
        assert (exact == [x, y]) == fit


def test_bpe_decodes_any_ids(library):
    m, rng = bpe.model(None), np.random.default_rng(3)
    rows = [rng.integers(0, m.width, rng.integers(0, 9)) for _ in range(400)] + [np.array([m.width + 5, 1, -3])]
    first = np.append(0, np.cumsum([len(r) for r in rows]))
    got = m.decode(np.concatenate(rows).astype(np.int64), first)
    assert [r.decode() for r in got[:-1]] == [library.decode(r.tolist(), skip_special_tokens=False) for r in rows[:-1]]
    assert got[-1] == m.bytes_of[1]


def test_bpe_of_bytes_that_are_no_text():
    m = bpe.model(None)
    raw = np.frombuffer(b"ok \xff\xfe go", np.uint8)
    ids, first = m.encode(raw, np.array([0, len(raw)]))
    assert m.decode(ids.astype(np.int64), first) == ["ok �� go".encode()]


# ranked search


def brute_search(docs, items, k):
    split = [(d, [w.translate(LOWER) for w in WORD.findall((t or "").translate(LOWER))]) for d, t in docs]
    split = [(d, w) for d, w in split if w]
    n_docs, total = len(split), sum(len(w) for _, w in split)
    counts = [(d, len(w), Counter(w)) for d, w in split]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = set(WORD.findall((text or "").translate(LOWER)))
        scored = []
        for d, n, c in counts:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, d is not None, d))
        for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, d, -s))
    return Counter(out)


def search_tables():
    rng = random.Random(9)
    docs = [(k, invented(rng, rng.randrange(1, 60), 80)) for k in range(150)]
    docs += [(500 + k, docs[k % 4][1]) for k in range(30)] + [(600, None), (601, ""), (602, "?! --"), (None, docs[2][1]), (None, docs[2][1]), docs[7], docs[7], (603, "ONE One oNe Été été"), (604, invented(rng, 30000, 3000)), (605, "w" * 3000)]
    items = [(k, invented(rng, rng.randrange(1, 40), 100)) for k in range(25)] + [(100, None), (101, ""), (102, "not there"), (103, "one Été"), (None, docs[0][1]), (3, docs[1][1]), (104, docs[9][1]), (104, docs[9][1]), (105, "w" * 3000)]
    return docs, items


@pytest.mark.parametrize(("k", "query_bytes"), [(50, 16_000_000), (5, 4000), (3, 100)])
def test_search_against_brute_force(spark, k, query_bytes):
    docs, items = search_tables()
    made = spark.createDataFrame([(*d, 4, "t") for d in docs], DOCS + ", rank int, term string").repartition(3)
    asked = spark.createDataFrame([(*x, 4, 9) for x in items], "item_id long, text string, score int, query int")
    found = search.search(search.index(made), asked, k, query_bytes=query_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute_search(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = search_tables()
    none, some = spark.createDataFrame([], DOCS), search.index(spark.createDataFrame(docs, DOCS))
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search.search(search.index(none), asked).count() == 0
    assert search.search(some, asked.where("item_id is null and text = ''")).count() == 0
    assert search.search(search.index(none), asked.limit(0)).count() == 0


def test_index_is_sorted_by_bucket_and_holds_each_length_once(spark):
    docs, _ = search_tables()
    rows = search.index(spark.createDataFrame(docs, DOCS).coalesce(1)).collect()
    order = [r.bucket for r in rows]
    assert order == sorted(order) and order[0] == search.LENGTHS
    assert sum(r.tf for r in rows) == sum(r.n for r in rows if r.term == "") and len({r.doc for r in rows if r.term == ""}) == sum(r.term == "" for r in rows)


def test_words_with_one_hash_are_told_apart():
    import pyarrow as pa

    from allelia.llm.textops import Words, binary_column

    data, offs = binary_column(pa.array(["b a b", "a A"]))
    words = Words(data, offs)
    row, start, end, tf = search._slowly(search.LOWER[data].tobytes(), np.repeat(np.arange(2), words.counts()), words)
    low = search.LOWER[data].tobytes()
    assert [(r, low[x:y], n) for r, x, y, n in zip(row.tolist(), start.tolist(), end.tolist(), tf.tolist())] == [(0, b"b", 2), (0, b"a", 1), (1, b"a", 2)]
