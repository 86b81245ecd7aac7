"""The pipeline's stages on a small corpus."""

import hashlib
from collections import Counter

import pytest
from test_dedup_operators import brute_link_rows, brute_links, brute_passages, mixed_docs, toxic_rows
from test_text_operators import brute_matches

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    toxic, labels = toxic_rows(240)
    docs = [(x + 1000, t) for x, t in toxic] + mixed_docs(5)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(x + 1000, q, t) for x, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    passage = " ".join(mixed_docs(5)[9][1].split()[:30])
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_on_their_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    gone = Counter(rows(docs)) - Counter(rows(kept))
    assert len(gone) >= 38 and all("vile" in t or "nasty" in t or "rotten" in t for _, t in gone)

    cut = stages["line_dedup"](spark, docs, sf_dir)
    want = Counter({(d, t): n for (d, t, k, _), n in brute_passages(rows(docs)).items() if t or not k})
    assert Counter(rows(cut)) == want and cut.columns == docs.columns

    single = rows(stages["ngram_jaccard_join"](spark, docs, sf_dir))
    classes = brute_links(rows(docs))
    named = Counter(c for _, c, _ in classes)
    assert len(single) == len(named) and Counter(d for d, _ in single) == Counter(named.keys())

    clean = stages["benchmark_decontamination"](spark, docs, sf_dir)
    found = brute_matches([(k, t) for k, (_, t) in enumerate(rows(docs))], [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()], 13)
    want = Counter(x for k, x in enumerate(rows(docs)) if not found[k][4])
    assert Counter(rows(clean)) == want and len(want) < docs.count()


def test_run_equals_the_stages_by_brute_force(spark, sf_dir):
    """Every stage but the classifier by a plain-Python version on what the one before it kept."""
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    docs = rows(corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir))
    docs = [(d, t) for (d, t, gone, _), n in brute_passages(docs).items() for _ in range(n) if t or not gone]
    classes = {}
    for k, (_, c, _) in enumerate(brute_link_rows(docs)):
        classes.setdefault(c, []).append(docs[k])
    docs = [next(x for x in members if x[0] == c) for c, members in classes.items()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = brute_matches([(k, t) for k, (_, t) in enumerate(docs)], items, 13)
    docs = [x for k, x in enumerate(docs) if not found[k][4]]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for d, t in docs:
        ids = sp.encode(t or "")
        want[d, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += 1
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want and len(want) > 150


def test_clashing_columns_nulls_and_a_long_text(spark, sf_dir):
    """Columns called like those that a stage adds come through unchanged."""
    names = ["p_toxic", "toxic", "n_lines", "n_removed", "lead", "_key", "_doc", "class_id", "items", "n_words", "n_hit", "_k1", "others", "_text_key", "shard", "sid", "c0"]
    texts = [(1, "plain words stand here alone"), (2, None), (3, ""), (3, ""), (None, "no id, but a text"), (4, "word " * 60_000), (5, "same line\nsame line two\nown one"), (6, "same line\nsame line two\nown two")]
    docs = spark.createDataFrame([(d, t, *[f"{n}-{k}" for n in names]) for k, (d, t) in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        for r in kept.collect():
            k = int(r.toxic.rpartition("-")[2])
            assert all(r[n] == f"{n}-{k}" for n in names) and r.doc_id == texts[k][0], name
            assert r.text == texts[k][1] or name == "line_dedup" and (r.doc_id, r.text) == (6, "own two")
        assert kept.count() == {"ngram_jaccard_join": 6}.get(name, 8), name
    assert corpus_pipeline.tokenize(spark, docs, sf_dir).count() == 8


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []
