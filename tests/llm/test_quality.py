import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tracelake.llm import kit, queries, repetition, resample, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, n):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    many = {w for w, c in Counter(windows).items() if c > 1}
    return {j for i, w in enumerate(windows) if w in many for j in range(i, i + n)}


def rules_twin(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered(words, 3))}
    out |= {f"dup_chars_{n}": sum(len(words[j]) for j in covered(words, n)) for n in repetition.LIMITS}
    seen, again = set(), 0
    for x in lines:
        again += sum(map(len, WORD.findall(x))) if x in seen else 0
        seen.add(x)
    marks = [c for c in text or "" if "!" <= c <= "~" and not c.isalnum()]
    return out | {"dup_line_chars": again, "dup_mark_chars": len(covered(marks, repetition.MARKS))}


def test_rules_twin(spark, docs, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(docs(*EDGES, (9, "a b c\na b c\nd é ##|\n\n a b c")).select("doc_id", "text"))
    for r in repetition.repetition_rules(df).collect():
        twin = rules_twin(r.text)
        assert {k: r[k] for k in twin} == twin
        failed = twin["n_words"] < 50 or 100 * twin["n_repeat_words"] > 50 * twin["n_words"]
        assert r.base_failed == failed and not (failed and r.kept)
    clash = repetition.repetition_rules(docs(*EDGES).withColumn("kept", F.lit("x")))
    assert clash.count() == len(EDGES) and dict(clash.dtypes)["kept"] == "boolean"
    assert repetition.repetition_rules(docs(*EDGES).limit(0)).count() == 0


def test_rules_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op7_quality_rules(spark, sf).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.98 and kept[0] < 0.1


@pytest.mark.parametrize("seen", [[[], [], [0], [], [1, 2], [0], [], []], [[2]], [[0], [1]], [[], [], [], [2]], [[1], [], [], [], [], [], [0, 1]], [[], []]])
def test_marginals_twin(seen):
    """Log of the sum over all labellings and marginals, against all labellings of a document behind another one."""
    field = toxicity.Field(np.array([11, 22, 33], np.uint64), np.array([1.3, -0.4, 2.0]))
    field.chain = np.array([-2.0, -1.0, 0.5, 1.2, -0.7])
    plain, w01, w10, w11, start = field.chain
    step = {(0, 0): 0.0, (0, 1): w01, (1, 0): w10, (1, 1): w11}
    total, one = 0.0, np.zeros(len(seen))
    for y in itertools.product((0, 1), repeat=len(seen)):
        z = start * y[0] + sum(y[t] * (plain + field.weights[v].sum()) for t, v in enumerate(seen)) + sum(step[a] for a in itertools.pairwise(y))
        total += np.exp(z)
        one += np.exp(z) * np.array(y)
    every = [[], [0], *seen]  # a document of two tokens before it
    hashes = [np.array([field.keys[v[k]] if k < len(v) else 0 for v in every], np.uint64) for k in range(2)]
    doc = np.array([0, 0] + [1] * len(seen))
    hit, p = field.marginals(hashes, doc, 2)
    own = [k for k, v in enumerate(seen) if v]
    assert [h - 2 for h in hit.tolist()][1:] == own and p[1:] == pytest.approx([one[k] / total for k in own])
    token, feature = field.found(hashes)
    hit, token = np.unique(token, return_inverse=True)
    chains = toxicity.Chains(np.array([2, len(seen)]), doc[hit], hit - np.array([0, 2])[doc[hit]])
    log_z, _ = field._run(chains, field.emission(token, feature, len(hit)), field.chain, False)
    assert log_z[chains.by_hits.tolist().index(1)] == pytest.approx(np.log(total))


def test_chain_is_fitted_to_documents(spark):
    """On rows held out, tags differ from what a list of the same features' log odds says, and documents are told better."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = toxicity.train(docs, labels)
    assert len(field.keys) and field.chain[3] - field.chain[1] > 0.5
    got = queries.op8_toxicity(spark, sf).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert {r.held_out for r in got} == {True, False} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.93
    assert not [r for r in out if r.predicted and not r.toxic]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_toxicity_on_held_out_rows(spark, docs):
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(1)
    bad = ["zornfel", "zornfig", "quaxble", "quaxton"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        text = [words[k] for k in rng.integers(0, 300, 60)]
        if toxic:
            for k in rng.integers(0, 60, 3):
                text[k] = bad[rng.integers(0, 4)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    df, lab = docs(*rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    field = toxicity.train(df, lab)
    got = toxicity.score_toxicity(df.withColumn("score", F.lit("clash")), field).withColumn("held", toxicity.held_out("doc_id")).filter("held").collect()
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got]) > 0.97
    one = next(r for r in got if r.predicted)
    assert {one.text[s.start : s.end] for s in one.spans} <= set(bad)
    edges = toxicity.score_toxicity(docs(*EDGES), field).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == 0 for r in edges)
    nothing = toxicity.train(df, lab.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(docs(*EDGES), nothing).collect()} == {0}


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0, 2.0, 2.0, 2.0], [float(x % 17) for x in range(200)], [1e-300, 1.0, 1e300]])
def test_largest_twin(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, len(values) + 1, max(1, len(values) // 7)):
        edge = sorted(values, reverse=True)[k - 1]
        assert resample.largest(df, "v", k) == (edge, k - sum(v > edge for v in values))


def test_resampling_prefers_the_target(spark, docs):
    rng = np.random.default_rng(2)
    good = [(i, " ".join(f"g{k}" for k in rng.integers(0, 50, 40))) for i in range(60)]
    junk = [(i + 100, " ".join(f"### j{k}" for k in rng.integers(0, 50, 40))) for i in range(40)]
    targets = spark.createDataFrame([(i, True) for i in range(0, 60, 2)] + [(i + 100, False) for i in range(0, 40, 2)], "doc_id long, target boolean")
    got = resample.resample(docs(*good, *junk), targets).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept) == 60 and len([i for i in kept if i < 100]) >= 58
    edges = resample.resample(docs(*EDGES), targets.limit(0)).collect()
    assert len(edges) == len(EDGES) and all(r.kept for r in edges)
    assert resample.resample(docs(*EDGES).limit(0), targets).count() == 0


def grams_twin(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    marks = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
    words = re.findall(rf"[{re.escape(marks)}]+|[^{re.escape(marks)}\x20\x09-\x0D]+", low)
    return words + [f"{a} {b}" for a, b in itertools.pairwise(words)]


def test_op9_twin(spark, sf_dir):
    """Models, log weights and kept rows over a whole table, with dictionaries in place of buckets looked up by hash."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    bucket = {}
    for text in docs.values():
        raw = np.frombuffer((text or "").encode(), np.uint8)
        names, (at, _) = grams_twin(text), resample.grams(raw, np.array([0, len(raw)]))
        assert len(names) == len(at)
        for g, b in zip(names, at.tolist(), strict=True):
            assert bucket.setdefault(g, b) == b
    every, aimed = Counter(), Counter()
    for i, text in docs.items():
        found = Counter(bucket[g] for g in grams_twin(text))
        every += found
        if labels.get(i) == 1:
            aimed += found
    n, m, size = sum(every.values()), sum(aimed.values()), resample.BUCKETS
    ratio = {b: np.log((aimed[b] + 1) / (m + size)) - np.log((every[b] + 1) / (n + size)) for b in every}
    got = {r.doc_id: r for r in queries.op9_resampling(spark, sf_dir).collect()}
    key = {}
    for i, text in docs.items():
        names = grams_twin(text)
        weight = sum(ratio[bucket[g]] for g in names)
        uniform = (int(hashlib.md5(f"{i}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        key[i] = weight - np.log(-np.log(uniform))
        assert (got[i].n_grams, got[i].log_weight, got[i].sample_key) == (len(names), pytest.approx(weight, abs=1e-6), pytest.approx(key[i], abs=1e-6))
    k = round(len(docs) * sum(q == 1 for q in labels.values()) / len(labels))
    assert {i for i, r in got.items() if r.kept} == set(sorted(key, key=key.get, reverse=True)[:k])


def test_resampling_takes_clashing_names(spark, docs):
    targets = spark.createDataFrame([(1, True), (2, False)], "doc_id long, target boolean")
    df = docs(*EDGES).withColumn("target", F.lit("x")).withColumn("log_weight", F.lit("y")).withColumn("kept", F.lit(1)).withColumn("_id", F.lit("z"))
    rows = resample.resample(df, targets).collect()
    assert len(rows) == len(EDGES) and {type(r.kept) for r in rows} == {bool}


def test_slices_hold_whole_documents():
    import pyarrow as pa

    column = pa.array(["ab", None, "", "x" * 50, "cd"])[1:]
    got = [(i, j, bytes(d), o.tolist()) for i, j, d, o in kit.text_slices(column, 10)]
    assert got == [(0, 2, b"", [0, 0, 0]), (2, 3, b"x" * 50, [0, 50]), (3, 4, b"cd", [0, 2])]


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op7_quality_rules"])
def test_oracles(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(want.columns)
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())
