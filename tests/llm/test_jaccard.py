import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tracelake.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def twin(rows):
    """Components by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)) if i is not None)


def made(seed, n=160):
    """Random texts, chains of edited copies, exact copies, and a passage in many of them."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40))
    passage, texts = [word() for _ in range(20)], []
    while len(texts) < n:
        if texts and rng.random() < 0.6:
            w = rng.choice(texts[-25:]).split()
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randrange(1, 90))]
            if rng.random() < 0.5:
                w[len(w) // 2 : len(w) // 2] = passage
        texts.append(" ".join(w))
    return list(enumerate(texts))


def ours(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect() if r.doc_id is not None)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_twin(docs, seed):
    rows = made(seed)
    assert ours(docs(*rows)) == twin(rows)


def test_split_blocks_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    rows = made(3)
    assert ours(docs(*rows)) == twin(rows)


def test_hot_tokens_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 4)
    rows = made(5, 240)
    assert ours(docs(*rows)) == twin(rows)


def test_null_ids_link(docs):
    words = [f"w{k}" for k in range(60)]
    end = lambda k: " ".join(words[:-k] + [f"x{k}{j}" for j in range(k)])
    # 4 and 9 link with the row without id, not with each other
    rows = [(4, end(5)), (None, " ".join(words)), (9, " ".join([f"y{j}" for j in range(5)] + words[5:])), (1, "nothing like it at all here"), (None, "only ever here in this row")]
    got = jaccard.jaccard_components(docs(*rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (4, 4), (9, 4)]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["4", "None"]


def test_copies_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine"
    rows = [(k, text, k) for k in range(600)] + [(700 + k, f"{text} ten eleven", 0) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long").withColumn("sid", F.lit("x")).withColumn("n_shingles", F.lit(-1))
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == 603 and {(r.n_shingles, r.class_id, r.component_id) for r in got if r.doc_id < 700} == {(5, 0, 0)}
    assert {(r.n_shingles, r.class_id, r.component_id) for r in got if r.doc_id >= 700} == {(7, 700, 700)}


def test_edges(docs):
    rows = [r for r in EDGES if r[0] is not None]
    assert ours(docs(*EDGES)) == twin(rows)
    assert jaccard.jaccard_components(docs(*EDGES).limit(0)).count() == 0


def test_tree_rules_out_no_link():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * 0.2], rng.integers(0, 2**63, 20, dtype=np.uint64)])) for b in base for _ in range(8)]
    block = jaccard.Block.of_sets(sets, 75)
    _, labels = block.links(75)
    for a in range(len(sets)):
        for b in range(a):
            if jaccard.linked(sets[a], sets[b], 75):
                assert labels[a] == labels[b]
                assert jaccard.may_link(block.bitmaps[a], len(sets[a]), block.bitmaps[b], len(sets[b]), 75)


def orders(n):
    """Paths over n nodes: in order, at random, from both ends to the middle and back."""
    mixed = list(range(n))
    random.Random(1).shuffle(mixed)
    return {"sorted": list(range(n)), "random": mixed, "two-sided": [*range(0, n, 2), *reversed(range(1, n, 2))]}


@pytest.mark.parametrize("order", ["sorted", "random", "two-sided"])
def test_long_paths_settle(spark, monkeypatch, order):
    path, turns = orders(10_000)[order], []
    hooked = jaccard._hooked
    monkeypatch.setattr(jaccard, "_hooked", lambda edges, turn: turns.append(turn) or hooked(edges, turn))
    links = spark.createDataFrame([*zip(path, path[1:], strict=False), (20_001, 20_000), (20_001, 20_002)], "a long, b long")
    got = {r.node: r.label for r in jaccard.components(links).collect()}
    assert got == {**dict.fromkeys(range(10_000), 0), 20_000: 20_000, 20_001: 20_000, 20_002: 20_000}
    assert len(turns) <= 14


def test_chain_of_drifting_copies_is_one_component(docs):
    words = [f"w{k}" for k in range(44 + 5 * 250)]
    got = jaccard.jaccard_components(docs(*[(k, " ".join(words[5 * k : 5 * k + 44])) for k in range(250)])).collect()
    assert len(got) == 250 and {r.component_id for r in got} == {0} and len({r.class_id for r in got}) == 250
    assert jaccard.components(docs(*EDGES).limit(0).selectExpr("doc_id a", "doc_id b")).count() == 0
