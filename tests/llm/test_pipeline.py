from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import EDGES
from tracelake.llm import jaccard, toxicity


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).persist()
        seen[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = out
    ids = {n: [r.doc_id for r in df.select("doc_id").collect()] for n, df in seen.items()}
    assert len(ids["quality_rules"]) < 200 and set(ids["toxicity"]) <= set(ids["quality_rules"])
    groups = jaccard.jaccard_components(seen["near_duplicates"]).collect()
    assert len({r.component_id for r in groups}) == len(groups)
    assert set(ids["mixing"]) <= set(ids["near_duplicates"]) and sorted(ids["bpe"]) == sorted(ids["mixing"])
    kept = toxicity.train(seen["quality_rules"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert toxicity.score_toxicity(seen["toxicity"], kept).filter("predicted = 1").count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


LONG = " ".join(f"word{k} of{k}" for k in range(40))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edges(spark, docs, sf_dir, name):
    """Nulls, empty texts, repeated rows, ids that stand twice, an empty table, and columns named like the operators' own."""
    stage = dict(corpus_pipeline.STAGES)[name]
    more = [(1, LONG), (1, LONG + " end"), (None, LONG), (30, LONG.replace("word3 ", "other "))]
    df = docs(*EDGES, *more)
    for c in ("kept", "score", "predicted", "size", "taken", "component_id", "n_words", "spans", "ids"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    out = stage(spark, df, sf_dir).collect()
    assert stage(spark, df.limit(0), sf_dir).count() == 0
    seen = Counter((r.doc_id, r.text) for r in out) if name != "bpe" else None
    every = Counter([*EDGES, *more])
    if name == "quality_rules":
        assert seen == Counter(more)
    elif name == "toxicity":
        assert seen == every
    elif name == "near_duplicates":
        assert sum(seen[k] for k in more) == 1 and seen[(1, LONG)] == 1
        assert all(seen[k] == n for k, n in every.items() if not (k[1] or "").split())
    elif name == "mixing":
        assert sum(len(r.text.split()) for r in out) == int(1.5 * sum(len((t or "").split()) for _, t in [*EDGES, *more]))
    else:
        assert Counter(r.doc_id for r in out) == Counter(i for i, _ in [*EDGES, *more])
    if name != "bpe":
        assert all(r.kept == "own kept" and r.score == "own score" and r.size == "own size" and r.ids == "own ids" for r in out)
