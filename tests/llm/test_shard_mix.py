from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tracelake.llm import mixing, queries, shard


def test_shards_are_gapless_and_near_equal(spark, sf_dir):
    rows = queries.op1_sharding(spark, sf_dir).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) == set(range(16))
    most = max(r.size for r in rows)
    mean = sum(r.size for r in rows) / 16
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        assert abs(sum(r.size for r in s) - mean) <= 2 * most + 0.01 * mean
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_hot_text_is_cut(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.lit("same " * 5)).otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    sums = [r.s for r in shard.shard_documents(rows, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 60


def test_edges_of_sharding(docs):
    got = shard.shard_documents(docs(*EDGES), 4).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGES)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 2} == {(1, 0)}
    assert shard.shard_documents(docs(*EDGES).limit(0)).count() == 0
    wide = shard.histogram_shards(docs(*EDGES).withColumn("key", shard.sort_key(F.col("text"), F.col("doc_id"))).withColumn("size", F.lit(1)).withColumn("slot", F.lit("clash")), "key", "size", 3)
    assert "extra" in wide.columns and wide.count() == len(EDGES)


def sizes_twin(sizes, weights, share, most):
    """Reshares the excess until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, None: 300, "z": 2}, {"only": 7}])
def test_targets_twin(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(sizes_twin(sizes, (5, 2, 1), 1.5, 2.0))


def test_mix_meets_budgets(spark, sf_dir):
    rows = queries.op4_mixing(spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken = defaultdict(int)
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for r in rows:
        assert taken[source[r.doc_id]] == int(r.target)
    again = {r.doc_id: r.taken for r in queries.op4_mixing(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_edges_of_mixing(docs):
    df = docs(*EDGES, source=None).withColumn("size", mixing.words_of(F.col("text")))
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(EDGES) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_cut_rows_keep_their_first_words(docs):
    rows = mixing.mixed_documents(docs(*[(i, f"w{i} x\ty  z") for i in range(30)])).collect()
    per = Counter(r.doc_id for r in rows)
    assert sum(len(r.text.split()) for r in rows) == 1.5 * 4 * 30
    assert set(per.values()) <= {1, 2} and all(f"w{r.doc_id} x\ty  z".startswith(r.text) for r in rows)


def test_equal_rows_are_cut(spark):
    df = spark.createDataFrame([(None, "same text")] * 400 + [(k, f"other {k}") for k in range(400)], "doc_id long, text string").repartition(5)
    rows = shard.shard_documents(df, 8).collect()
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(rows) == 800 and len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 12
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(8) for k in range(sum(r.shard == s for r in rows))]


def test_null_ids_are_spread_over_cells(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 9 + 1).alias("size"))
    keyed = mixing.keyed_rows(df.unionByName(df.withColumn("doc_id", F.lit(5))), 1, "doc_id", "source", "size", None)
    assert keyed.select("key").distinct().count() == keyed.count() == 40_000
    taken, again = (sorted(r.taken for r in mixing.mix_plan(df).collect()) for _ in range(2))
    assert taken == again and sum(taken) == int(1.5 * df.agg(F.sum("size")).first()[0])
