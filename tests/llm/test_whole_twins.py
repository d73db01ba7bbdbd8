"""Whole tables against brute force: sharding, scores of the field, and the rows of the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import twin as components_twin
from tests.llm.test_quality import rules_twin
from tests.llm.test_shard_mix import sizes_twin
from tracelake.llm import kit, queries, repetition, toxicity

SF = "/root/testdata/sf0.01"


def test_op1_twin(spark):
    """Sizes, checksums, gapless slots, sums within the tolerance, and equal texts one after the other."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = sorted(queries.op1_sharding(spark, SF).collect(), key=lambda r: (r.shard, r.slot))
    assert Counter(r.doc_id for r in rows) == Counter(list(docs))
    raw = {i: (t or "").encode() for i, t in docs.items()}
    assert all((r.size, r.text_crc32) == (len(raw[r.doc_id]) + 1, zlib.crc32(raw[r.doc_id])) for r in rows)
    seen = Counter()
    for r in rows:
        assert r.slot == seen[r.shard]
        seen[r.shard] += 1
    sums, most, mean = Counter(), max(r.size for r in rows), sum(r.size for r in rows) / 16
    for r in rows:
        sums[r.shard] += r.size
    assert set(sums) == set(range(16)) and all(abs(s - mean) <= most + 0.002 * mean for s in sums.values())
    runs = Counter(k for k, _ in groupby(raw[r.doc_id] for r in rows))
    assert set(runs.values()) == {1}


def score_twin(field, text):
    """Score of one text and its marginals, by a pass over all tokens each way with plain two-by-two steps."""
    data = (text or "").encode()
    _, _, doc, hashes = toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    weight = dict(zip(field.keys.tolist(), field.weights.tolist(), strict=True))
    plain, w01, w10, w11, start = field.chain
    odds = [plain + sum(weight.get(int(h[t]), 0.0) for h in hashes) for t in range(len(doc))]
    known = [any(int(h[t]) in weight for h in hashes) for t in range(len(doc))]
    trans = [[1.0, math.exp(w01)], [math.exp(w10), math.exp(w11)]]
    emit = [(1.0, math.exp(o)) for o in odds]
    forward, backward = [], [(1.0, 1.0)] * len(odds)
    for t, e in enumerate(emit):
        v = (1.0, math.exp(start)) if t == 0 else tuple(sum(forward[-1][a] * trans[a][b] for a in (0, 1)) for b in (0, 1))
        v = (v[0] * e[0], v[1] * e[1])
        forward.append((v[0] / sum(v), v[1] / sum(v)))
    for t in range(len(emit) - 2, -1, -1):
        v = tuple(sum(trans[a][b] * emit[t + 1][b] * backward[t + 1][b] for b in (0, 1)) for a in (0, 1))
        backward[t] = (v[0] / sum(v), v[1] / sum(v))
    p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b, k in zip(forward, backward, known, strict=True) if k]
    a, b, c = field.doc_weights
    return 1 / (1 + math.exp(-(a + b * math.log1p(sum(p)) + c * max(p, default=0.0)))), sum(x >= 0.5 for x in p)


def test_op8_twin(spark):
    """Every document's score and number of toxic tokens, token by token."""
    docs, labels = kit.table(spark, SF, "documents"), kit.table(spark, SF, "labels")
    field = toxicity.train(docs.select("doc_id", "text"), labels)
    assert len(field.keys)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = queries.op8_toxicity(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(text))
    for r in rows:
        score, spans = score_twin(field, text[r.doc_id])
        assert r.score == pytest.approx(score, rel=1e-6, abs=1e-12) and r.n_spans == spans and r.predicted == int(r.score >= 0.7)


def kept_twin(text):
    m = rules_twin(text)
    if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]:
        return False
    limits = {"dup_line_chars": repetition.LINE_LIMIT, "dup_mark_chars": repetition.MARK_LIMIT} | {f"dup_chars_{n}": limit for n, limit in repetition.LIMITS.items()}
    return all(m[c] <= limit * max(m["word_chars"], 1) for c, limit in limits.items())


def mixed_twin(rows):
    """(id, text) as often as the mix holds them, from (id, text, source) with ids of their own."""
    by, out = defaultdict(list), []
    for i, text, source in rows:
        by[source].append((hashlib.md5(f"{i}:1".encode()).hexdigest(), i, text, re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text or "")))
    sizes = {s: sum(len(w) for *_, w in rs) for s, rs in by.items()}
    for s, target in sizes_twin(sizes, (5, 2, 1), 1.5, 2.0).items():
        epochs, rest = divmod(math.floor(target), sizes[s]) if sizes[s] else (0, 0)
        for _, i, text, words in sorted(by[s], key=lambda r: r[:2]):
            cut = min(len(words), rest)
            rest -= cut
            out += [(i, text)] * (epochs if words else 0)
            if cut:
                out.append((i, text if cut == len(words) else "".join(words[:cut])))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_pipeline_twin(spark, sf):
    """Rows of run() from plain loops over all documents; only the fitted field and the hashes of its features are taken from the library."""
    docs = kit.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert len({i for i, _, _ in rows}) == len(rows)
    rows = [r for r in rows if kept_twin(r[1])]
    left = docs.filter(docs.doc_id.isin([i for i, _, _ in rows]))
    field = toxicity.train(left, kit.table(spark, sf, "labels"))
    rows = [r for r in rows if score_twin(field, r[1])[0] < toxicity.CUT]
    first = {i: c for i, _, c in components_twin([(i, t) for i, t, _ in rows])}
    rows = [r for r in rows if first[r[0]] == r[0]]
    lib, want = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")), Counter()
    for i, text in mixed_twin(rows):
        ids = lib.encode(text, add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False).encode()
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()] += 1
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want and len(want) > 50
