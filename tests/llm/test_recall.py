"""Recall of the similarity join against exact intersections: every document whose id is divisible by 20, against all others.

RECALL_SF_DIR names the folder of tables (by default the smallest with copies of each kind); the figures in README.md are from larger ones.
"""

import os
from collections import Counter, defaultdict

import pytest
from test_text_operators import words

from allelia.llm import jaccard

SF = os.environ.get("RECALL_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_links_of_every_twentieth_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.n_links for r in jaccard.near_duplicates(docs).where("doc_id % 20 = 0").collect()}
    sets, of = {}, defaultdict(list)
    for r in docs.toLocalIterator():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("=", r.text or "")}
        for g in sets[r.doc_id]:
            of[g].append(r.doc_id)
    links = 0
    for d in found:
        met = Counter(x for g in sets[d] for x in of[g] if x != d)
        exact = sum(n >= 0.8 * (len(sets[d]) + len(sets[x]) - n) - 1e-9 for x, n in met.items())
        assert found[d] <= exact
        links += exact
    got = sum(found.values())
    print(f"recall: {got} of {links} links")
    assert links > 0 and got >= 0.9 * links
