"""Toxicity by a linear-chain conditional random field over tokens.

Tokens have features: the word, its beginnings, its end, its shape and its pair with the word before. Those that
stand clearly more often in toxic than in other labelled documents get a weight; the others count as plain.
Only documents are labelled, so the labels of tokens are learned as hidden ones: a document is clean
when all its tokens are, toxic when at least one is, and the weights of features, transitions and start
ascend the likelihood of just that, with expectations over the whole chain (forward-backward). Scoring: each
token gets its marginal; the document's score is a logistic function of their sum and maximum, and tokens
with a marginal of one half or more are the spans.

Between tokens with evidence the field's matrix is constant, so runs of plain tokens are one matrix
power each: marginals stay exact and a document costs as many steps as it has tokens with evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import kit
from tracelake.plans.ship import map_arrow

#: Training is bounded: most documents of each class (in order of a hash of the id), and bytes of text from which on no more are taken.
SAMPLE_DOCS, SAMPLE_BYTES = 8000, 64 << 20
#: A feature needs so many toxic documents, and a lower bound of its log odds.
LEAST_DOCS, LEAST_ODDS = 5, 0.7
BEGINNINGS, END = (4, 5, 6), 4
CUT = 0.7

_LETTER = np.ones(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start, end, document of each letter run, and hashes of its features (0: none)."""
    kind = lambda k: np.uint64(0x5851F42D4C957F2D * k % 2**64)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    data = kit.LOWER[data]
    starts, ends, doc = kit.spans(data, offsets, _LETTER)
    values = data.astype(np.uint64)
    values += np.uint64(1)
    size = ends - starts
    out = [kit.rolling(values, starts, ends)]
    for k in BEGINNINGS:
        out.append(np.where(size > k, kit.rolling(values, starts, np.minimum(starts + k, ends)) ^ kind(k), np.uint64(0)))
    out.append(np.where(size > END, kit.rolling(values, np.maximum(ends - END, starts), ends) ^ kind(20), np.uint64(0)))
    upper = capitals[ends] - capitals[starts]
    shape = np.where(upper == size, 3, np.where(upper > 1, 2, upper)) * 8 + np.minimum(size // 3, 7)
    out.append(kit.mix(shape.astype(np.uint64) + kind(21)))
    pair = np.zeros(len(doc), np.uint64)
    if len(doc) > 1:
        pair[1:] = np.where(doc[1:] == doc[:-1], kit.mix(out[0][:-1] * np.uint64(3) + out[0][1:]) ^ kind(22), np.uint64(0))
    return starts, ends, doc, [*out, pair]


def held_out(ident: str) -> Column:
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Chains:
    """Documents as the field sees them: tokens in each, places of those with evidence, and their features.

    Documents are laid out by falling number of tokens with evidence, so the k-th of all are found by slices.
    """

    def __init__(self, n_tokens: np.ndarray, owner: np.ndarray, place: np.ndarray):
        self.n_docs = len(n_tokens)
        n_hits = np.bincount(owner, minlength=self.n_docs)
        self.by_hits = np.argsort(-n_hits, kind="stable")
        self.hits, self.count = n_hits[self.by_hits], n_tokens[self.by_hits]
        begin = np.cumsum(n_hits) - n_hits
        self.begin = begin[self.by_hits]
        self.place = place
        self.deepest = int(self.hits[0]) if self.n_docs else 0
        #: Documents with more than k tokens of evidence.
        self.active = np.searchsorted(-self.hits, -np.arange(self.deepest + 1), "left")


class Field:
    """Weights of a two-label chain, as log odds of the toxic label: features, a plain token, transitions, start."""

    def __init__(self, keys: np.ndarray | None = None, weights: np.ndarray | None = None):
        #: Sorted hashes of the features and their weights.
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.weights = np.zeros(len(self.keys)) if weights is None else weights
        #: Plain token, from 0 to 1, from 1 to 0, from 1 to 1 (from 0 to 0 is 0), start.
        self.chain = np.array([-4.0, -1.0, 0.0, 0.5, -1.0])
        self.doc_weights = np.array([-4.0, 0.0, 0.0])

    def found(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature) for every known feature of every token, in order of tokens."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens, found = [], []
        for h in hashes:
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[at] == h)
            tokens.append(hit)
            found.append(at[hit])
        token, feature = np.concatenate(tokens), np.concatenate(found)
        order = np.argsort(token, kind="stable")
        return token[order], feature[order]

    def _run(self, chains: Chains, emit: np.ndarray, chain: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Log of the sum over all labellings of each document (as laid out), and the marginals of tokens with evidence."""
        plain, start = np.exp(chain[0]), np.exp(chain[4])
        trans = np.exp(np.array([[0.0, chain[1]], [chain[2], chain[3]]]))
        # powers of the plain matrix M by its eigenvalues, without their scale: M^m = large^m (P + (small/large)^m Q)
        m = trans * np.array([1.0, plain])
        half, gap = (m[0, 0] + m[1, 1]) / 2, np.sqrt(((m[0, 0] - m[1, 1]) / 2) ** 2 + m[0, 1] * m[1, 0])
        large, small = half + gap, half - gap
        p = (m - small * np.eye(2)) / (large - small)
        q = np.eye(2) - p
        scale = np.log(large)
        first = lambda v, k: v @ p + ((small / large) ** k)[:, None] * (v @ q)
        last = lambda v, k: v @ p.T + ((small / large) ** k)[:, None] * (v @ q.T)
        n, hits, count, place, begin = chains.n_docs, chains.hits, chains.count, chains.place, chains.begin
        e = np.exp(np.clip(emit, -30, 30))
        two = lambda x: np.stack([np.ones(len(x)), x], 1)
        log_z = np.zeros(n)
        forward = np.ones((len(e), 2))
        state = np.tile(np.array([1.0, start * plain]), (n, 1))
        at_place = np.zeros(n, np.int64)
        for k in range(chains.deepest):
            some = chains.active[k]
            at = begin[:some] + k
            if k:
                gone = place[at] - at_place[:some] - 1
                v = first(state[:some], gone) @ trans
            else:
                gone = np.maximum(place[at] - 1, 0)
                v = np.where((place[at] > 0)[:, None], first(state[:some], gone) @ trans, np.array([1.0, start]))
            v = v * two(e[at])
            total = v.sum(1)
            log_z[:some] += np.log(total) + gone * scale
            state[:some] = forward[at] = v / total[:, None]
            at_place[:some] = place[at]
        tail = np.where(hits > 0, count - 1 - at_place, np.maximum(count - 1, 0))
        log_z += np.where(count > 0, np.log(first(state, tail).sum(1)) + tail * scale, 0.0)
        if not back:
            return log_z, None
        backward = np.ones((len(e), 2))
        for k in range(chains.deepest - 1, -1, -1):
            some, more = chains.active[k], chains.active[k + 1] if k + 1 < chains.deepest else 0
            at = begin[:some] + k
            v = last(np.ones((some, 2)), count[:some] - 1 - place[at])
            if more:
                nxt = at[:more] + 1
                v[:more] = last((backward[nxt] * two(e[nxt])) @ trans.T, place[nxt] - place[at[:more]] - 1)
            backward[at] = v / v.sum(1, keepdims=True)
        both = forward * backward
        return log_z, both[:, 1] / both.sum(1)

    def emission(self, token: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Log odds of n tokens with evidence by their features."""
        return self.chain[0] + np.bincount(token, self.weights[feature], n)

    def marginals(self, hashes: list[np.ndarray], doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens with evidence, and their marginals of being toxic."""
        token, feature = self.found(hashes)
        hit, which = np.unique(token, return_inverse=True)
        count = np.bincount(doc, minlength=n_docs)
        first = np.cumsum(count) - count
        chains = Chains(count, doc[hit], hit - first[doc[hit]])
        return hit, self._run(chains, self.emission(which, feature, len(hit)), self.chain, True)[1]

    def score(self, hit_doc: np.ndarray, p: np.ndarray, n_docs: int) -> np.ndarray:
        z = self.doc_features(hit_doc, p, n_docs) @ self.doc_weights
        return 1 / (1 + np.exp(-z))

    @staticmethod
    def doc_features(hit_doc: np.ndarray, p: np.ndarray, n_docs: int) -> np.ndarray:
        most = np.zeros(n_docs)
        np.maximum.at(most, hit_doc, p)
        return np.stack([np.ones(n_docs), np.log1p(np.bincount(hit_doc, p, n_docs)), most], 1)

    def fit_chain(self, chains: Chains, token: np.ndarray, feature: np.ndarray, toxic: np.ndarray, rounds: int = 45) -> None:
        """Ascends (by Adam) the likelihood that clean documents have no toxic token and toxic ones at least one."""
        n, toxic = len(chains.place), toxic[chains.by_hits]
        owner = np.empty(n, np.int64)
        owner[np.concatenate([np.arange(b, b + h) for b, h in zip(chains.begin, chains.hits, strict=True)]).astype(np.int64)] = np.repeat(np.arange(chains.n_docs), chains.hits)
        share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))

        def likelihood(chain: np.ndarray, weights: np.ndarray) -> float:
            log_z = self._run(chains, chain[0] + np.bincount(token, weights[feature], n), chain, False)[0]
            return float((share * np.where(toxic, np.log(-np.expm1(-np.maximum(log_z, 1e-9))), -log_z)).sum())

        theta = np.concatenate([self.chain, self.weights])
        start = theta.copy()
        mean, square = np.zeros(len(theta)), np.zeros(len(theta))
        slope = np.zeros(len(theta))
        for k in range(rounds):
            chain, weights = theta[:5], theta[5:]
            log_z, p = self._run(chains, chain[0] + np.bincount(token, weights[feature], n), chain, True)
            pull = share * np.where(toxic, 1 / np.expm1(np.clip(log_z, 1e-6, 500)), -1.0)
            slope[5:] = np.bincount(feature, (pull[owner] * p)[token], len(weights))
            if k % 4 == 0:
                for i in range(5):
                    step = np.zeros(5)
                    step[i] = 1e-3
                    slope[i] = (likelihood(chain + step, weights) - likelihood(chain - step, weights)) / 2e-3
            held = slope - 1e-4 * (theta - start)
            mean, square = 0.9 * mean + 0.1 * held, 0.99 * square + 0.01 * held**2
            theta = np.clip(theta + 0.1 * (mean / (1 - 0.9 ** (k + 1))) / (np.sqrt(square / (1 - 0.99 ** (k + 1))) + 1e-8), -12, 12)
            theta[5:] = np.maximum(theta[5:], 0.0)
        self.chain, self.weights = theta[:5], theta[5:]

    def fit_docs(self, x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 60) -> None:
        """Logistic regression of the documents' labels by Newton steps, lightly held back; each document stands for share of them."""
        w = np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-x @ w))
            slope = x.T @ (share * (y - p)) - 0.5 * w
            curve = (x * (share * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
            w = w + np.linalg.solve(curve, slope)
        self.doc_weights = w


def _counts():
    """(feature, toxic documents with it, other documents with it) for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist(), bool)
            for i, _, data, offsets in kit.text_slices(batch.column("text")):
                _, _, doc, hashes = features(data, offsets)
                feature, owner = np.concatenate(hashes), np.tile(doc, len(hashes))
                if not len(feature):
                    continue
                order = np.lexsort((owner, feature))
                feature, owner = feature[order], owner[order]
                first = np.concatenate([[True], (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])])
                feature, owner = feature[first], owner[first]
                start = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
                key, n = feature[start], np.diff(np.append(start, len(feature)))
                bad = np.add.reduceat(toxic[i + owner].astype(np.int64), start)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(bad), pa.array(n - bad)], ["feature", "bad", "good"])

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id") -> Field:
    """A field from the labelled rows whose crc32(ident) mod 3 is not 1.

    Of each class the documents first in order of a hash of the id are used, at most SAMPLE_DOCS, and none after
    SAMPLE_BYTES of text; all features and tokens of these count. Scores hold for the share of the classes among
    all eligible rows; features compare shares within each class, which the sample keeps. Null ids and null labels are
    left out, an id labelled twice has its higher label, repeated documents count once, null texts are
    empty. Without rows of both classes the field finds nothing toxic.
    """
    known = labels.select(F.col(ident).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null").filter(~held_out("id"))
    known = kit.stage(known.groupBy("id").agg(F.max("toxic").alias("toxic")))
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("id is not null")
    sizes = kit.sized_join(rows.select("id", F.octet_length("text").alias("size")), known, "id", "inner")
    sizes = kit.stage(sizes.groupBy("id", "toxic").agg(F.max("size").alias("size")))
    eligible = {r["toxic"]: r["count"] for r in sizes.groupBy("toxic").count().collect()}
    ranked = []
    for c in (0, 1):
        first = sizes.filter(F.col("toxic") == c).withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(SAMPLE_DOCS)
        before = F.coalesce(F.sum("size").over(Window.orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked.append(first.withColumn("before", before).filter(F.col("before") < SAMPLE_BYTES).select("id", "toxic"))
    chosen = kit.stage(ranked[0].union(ranked[1]))
    sample = kit.stage(kit.sized_join(rows, chosen, "id", "inner").groupBy("id", "toxic").agg(F.max("text").alias("text")))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Field()
    counts = map_arrow(sample.select("text", F.col("toxic").cast("boolean").alias("toxic")), _counts(), "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    sure = F.log(bad / (sizes[1] + 1)) - F.log(good / (sizes[0] + 1)) - 2 * F.sqrt(1 / bad + 1 / good)
    words = counts.filter((F.col("bad") >= LEAST_DOCS) & (F.col("feature") != 0)).withColumn("sure", sure).filter(F.col("sure") >= LEAST_ODDS).toPandas()  # features of the bounded sample
    keys = words["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    field = Field(keys[order], words["sure"].to_numpy(float)[order])
    if not len(keys):
        return field
    found = field.found

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in kit.text_slices(batch.column("text")):
                _, _, doc, hashes = features(data, offsets)
                token, feature = found(hashes)
                count, at = np.bincount(doc, minlength=j - i), np.searchsorted(doc, np.arange(j - i + 1))
                cut = np.searchsorted(token, at)
                parts = lambda x, at=cut: pa.array([x[a:b].astype("<i4").tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
                own = token - at[doc[token]] if len(token) else token
                yield pa.record_batch([batch.column("id").slice(i, j - i), batch.column("toxic").slice(i, j - i), pa.array(count), parts(own), parts(feature)], ["id", "toxic", "tokens", "places", "features"])

    # the tokens with evidence of the bounded sample
    got = sorted(map_arrow(sample.select(F.col("id").cast("string"), "toxic", "text"), evidence, "id string, toxic int, tokens long, places binary, features binary").collect(), key=lambda r: r["id"])
    places = [np.frombuffer(r["places"], "<i4").astype(np.int64) for r in got]
    tokens = np.array([r["tokens"] for r in got], np.int64)
    begin = np.cumsum(tokens) - tokens
    hit, token = np.unique(np.concatenate([p + b for p, b in zip(places, begin, strict=True)]), return_inverse=True)
    feature = np.concatenate([np.frombuffer(r["features"], "<i4").astype(np.int64) for r in got])
    owner = np.searchsorted(begin + tokens, hit, "right")
    toxic = np.array([r["toxic"] for r in got], bool)
    chains = Chains(tokens, owner, hit - begin[owner])
    field.fit_chain(chains, token, feature, toxic)
    p = field._run(chains, field.emission(token, feature, len(hit)), field.chain, True)[1]
    field.fit_docs(Field.doc_features(owner, p, len(got)), toxic.astype(float), np.where(toxic, eligible[1] / sizes[1], eligible[0] / sizes[0]))
    return field


def score_toxicity(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """df with score (0 to 1), predicted (1 if score >= CUT) and spans (start, end in bytes, marginal).

    Null and empty texts get the score of a text without evidence and no spans. Columns named like the
    new ones are replaced; all others and all rows are kept. An empty table stays empty.
    """
    new = ["score", "predicted", "spans"]
    df = kit.without(df, *new)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in kit.text_slices(batch.column(text)):
                starts, ends, doc, hashes = features(data, offsets)
                hit, p = field.marginals(hashes, doc, j - i)
                score = field.score(doc[hit], p, j - i)
                tagged = hit[p >= 0.5]
                base = offsets[doc[tagged]]
                rows: list[list] = [[] for _ in range(j - i)]
                for d, a, b, m in zip(doc[tagged].tolist(), (starts[tagged] - base).tolist(), (ends[tagged] - base).tolist(), p[p >= 0.5].tolist(), strict=True):
                    rows[d].append({"start": a, "end": b, "marginal": m})
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(rows, span)], [*batch.schema.names, *new])

    made = df.selectExpr("*", "cast(0 as double) score", "0 predicted", "cast(array() as array<struct<start:bigint,end:bigint,marginal:double>>) spans")
    return map_arrow(df, run, made.schema)
