"""Pipeline stages take null ids, repeated rows and several texts under one id."""

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import EDGES
from tracelake.llm import mixing

NEAR = "one two three four five six seven eight nine ten " * 4


def test_mixed_rows_meet_the_budget(docs):
    rows = mixing.mixed_documents(docs(*EDGES, source=None)).collect()
    words = sum(len((t or "").split()) for _, t in EDGES)
    assert sum(len(r.text.split()) for r in rows) == int(1.5 * words)
    most = Counter((i, t) for i, t in EDGES)
    whole = Counter((r.doc_id, r.text) for r in rows)
    assert all(whole[k] in (n, 2 * n, 2 * n - 1) for k, n in most.items() if (k[1] or "").split() and k[0] != 6)


def test_near_duplicates_go_by_row(spark, docs):
    extra = [(20, NEAR), (21, "a text of its own that is like no other one here"), (21, NEAR + "end"), (22, NEAR)]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, docs(*EDGES, *extra), "").collect())
    left = Counter(i for i, _ in got.elements())
    assert got[(1, "a b c d e f")] == 1 and got[(None, "a b c d e f")] == 0
    assert got[(20, NEAR)] == 1 and got[(22, NEAR)] == 0
    assert got[(21, extra[1][1])] == 1 and left[21] == 1
    assert all(got[(i, t)] == 1 for i, t in EDGES if not (t or "").split())
