"""N-gram Jaccard join by signature trees.

Documents are sets of distinct word shingles. Two link when 100 * |A & B| >= percent * |A | B|.

1. Equal sets are one class; only classes go on.
2. A pair that links shares a token among the ``n - need + 1`` rarest of either set, in any
   order of tokens that all sets use. So every class goes, with its whole set, to the blocks of
   those tokens; a token's block is named by the smallest class that posts it, which lets all
   tokens of a group of near copies fall into a few blocks. The order puts tokens that stand
   in many documents last, so that common passages open no block.
3. In a block, a signature tree is built: leaves are bitmaps of hashed tokens, about two bits a
   token, nodes hold the OR of their bitmaps and the range of sizes. A dual traversal goes down
   pairs of nodes and drops those whose sizes are too far apart or whose greatest possible overlap
   is too small; pairs of nodes already known to be one component are dropped as well. Sets that
   may link with none leave the block; the others' whole sets are fetched, and a second traversal
   compares what arrives at the leaves exactly.
4. A block with many tokens is split into chunks of bounded size that all hold its pivot.
   After the first components are known, only members outside the block's largest component
   are sent on to the other chunks, so a large group of near copies costs its rows once; a
   chunk takes what it is sent in pieces of bounded size.
5. Components are found by hooking and pointer jumping on tables; nothing is collected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import kit
from tracelake.plans.ship import map_arrow

#: Tokens in one task's block at most, before its pivot is added (8 bytes each).
BLOCK_TOKENS = 1 << 21
BLOCK_SETS = 4096
#: Tokens of one look at a partition, in which a token is counted, and its least count.
LOOK, OFTEN = 1 << 22, 2
#: Fixed bound of the list of frequent tokens that orders prefixes; it only affects speed.
FREQUENT = 1 << 17
#: Sets that post a token, from which on its blocks come from counts by size instead of a window over the token.
HOT = 1 << 20
#: Copies of a set seen in one task before further ones are salted, and the salts.
COPIES, SALTS = 8, 251
FANOUT = 8


# --- sets ------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice: tokens, bounds, set ids."""
    data = kit.LOWER[data]
    starts, ends, doc = kit.spans(data, offsets)
    n_docs = len(offsets) - 1
    hashes = kit.word_hashes(data, starts, ends)
    first, tokens = kit.window_hashes(hashes, doc, words)
    owner = doc[first]
    count = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate([[0], np.cumsum(count)])
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        tokens = np.concatenate([tokens, kit.rolling(hashes, begin[few], begin[few + 1])])
        owner = np.concatenate([owner, few])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    if len(tokens):
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])
        tokens, owner = tokens[new], owner[new]
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(kit.mix(tokens + np.uint64(0x51ED2701)), dtype=np.uint64)])
    ids = kit.mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ (np.diff(bounds).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    return tokens, bounds, ids.view(np.int64)


def _scan(words: int):
    """Per document (kind 0): row key, id, set id, set size, salt; (kind 1): tokens that one look saw often, with their count.

    The salt is 0 for the first copies of a set in a task, so that others can be joined by (set, salt).
    """
    schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("doc", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("salt", pa.int32())])

    def often(looked: list[np.ndarray]) -> pa.RecordBatch | None:
        token, count = np.unique(np.concatenate(looked), return_counts=True)
        keep = count >= OFTEN
        token, count = token[keep].view(np.int64), count[keep]
        none, zero = pa.nulls(len(token), pa.int64()), np.zeros(len(token), np.int32)
        return pa.record_batch([pa.array(zero + 1), none, none, pa.array(token), pa.array(count), pa.array(zero)], schema=schema) if len(token) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked, size, seen = [], 0, Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows, ids = batch.column("row"), batch.column("doc")
            for i, j, data, offsets in kit.text_slices(batch.column("text")):
                tokens, bounds, sid = shingle_sets(data, offsets, words)
                n = np.diff(bounds)
                fresh, salt = np.zeros(j - i, bool), np.zeros(j - i, np.int32)
                for k, s in enumerate(sid.tolist()):
                    before = seen[s]
                    seen[s] = before + 1
                    fresh[k] = not before
                    if before >= COPIES:
                        salt[k] = 1 + (part + before // 256) % SALTS
                yield pa.record_batch([pa.array(np.zeros(j - i, np.int32)), rows.slice(i, j - i), ids.slice(i, j - i), pa.array(sid), pa.array(n), pa.array(salt)], schema=schema)
                looked.append(tokens[np.repeat(fresh, n)])
                size += len(looked[-1])
                if size >= LOOK:
                    if (out := often(looked)) is not None:
                        yield out
                    looked, size, seen = [], 0, Counter()
        if looked and (out := often(looked)) is not None:
            yield out

    return run


def _prefixes(text: str, words: int, percent: int, frequent: np.ndarray, rank: np.ndarray, hot: int):
    """(token, n, most, sid, hot) for the rarest n - need + 1 tokens of every set, once per set and task.

    most is the size of the largest set that can link with this one and share none of its earlier tokens;
    hot tells tokens known to stand in so many sets or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in kit.text_slices(batch.column(text)):
                tokens, bounds, sid = shingle_sets(data, offsets, words)
                n = np.diff(bounds)
                fresh = np.zeros(len(n), bool)
                for k, s in enumerate(sid.tolist()):
                    if s not in seen:
                        seen.add(s)
                        fresh[k] = True
                owner = np.repeat(np.arange(len(n)), n)
                tokens, owner = tokens[fresh[owner]], owner[fresh[owner]]
                if not len(tokens):
                    continue
                often = np.zeros(len(tokens), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    often = np.where(frequent[at] == tokens, rank[at], 0)
                    order = np.lexsort((tokens, often, owner))
                    tokens, owner, often = tokens[order], owner[order], often[order]
                start = np.searchsorted(owner, np.arange(len(n)))
                place = np.arange(len(tokens)) - start[owner]
                keep = place <= n[owner] - -(-percent * n[owner] // 100)
                size = n[owner[keep]]
                # were this the first token shared with a set of m tokens, size - place >= need of (size + m) tokens
                most = (100 + percent) * (size - place[keep]) // percent - size
                yield pa.record_batch([pa.array(tokens[keep].view(np.int64)), pa.array(size), pa.array(most), pa.array(sid[owner[keep]]), pa.array(often[keep] >= hot)], ["token", "n", "most", "sid", "hot"])

    return run


def _bitmaps(text: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in kit.text_slices(batch.column(text)):
                tokens, bounds, sid = shingle_sets(data, offsets, words)
                sets = [tokens[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                maps = [bitmap(x, width(len(x))).tobytes() for x in sets]
                least = np.array([x[0] if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(sid), pa.array(least), pa.array(maps, pa.binary())], ["sid", "least", "bits"])

    return run


def _sets(text: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in kit.text_slices(batch.column(text)):
                tokens, bounds, sid = shingle_sets(data, offsets, words)
                at = pa.py_buffer((bounds * 8).astype(np.int64))
                sets = pa.Array.from_buffers(pa.large_binary(), len(sid), [None, at, pa.py_buffer(np.ascontiguousarray(tokens))]).cast(pa.binary())
                yield pa.record_batch([pa.array(sid), sets], ["sid", "tokens"])

    return run


# --- one block ---------------------------------------------------------------------------


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens."""
    return 1 << int(np.clip((2 * n - 1).bit_length(), 9, 16))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that fewer low bits of the tokens would have given."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class SignatureTree:
    """Sets of a block below nodes with OR-combined bitmaps and size ranges.

    Sets are laid out by their smallest token, so near copies share nodes.
    """

    def __init__(self, sizes: np.ndarray, least: np.ndarray, bitmaps: list[np.ndarray]):
        self.order = np.lexsort((sizes, least))
        words = min(map(len, bitmaps))
        leaf = np.stack([folded(bitmaps[k], words) for k in self.order.tolist()])
        low = high = sizes[self.order]
        #: Tokens of a set beyond its number of bits: they share a bit with another one.
        spare = low - np.bitwise_count(leaf).sum(1).astype(np.int64)
        self.levels = [(leaf, low, high, spare)]
        while len(self.levels[-1][0]) > 1:
            leaf, low, high, spare = self.levels[-1]
            cut = np.arange(0, len(leaf), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(leaf, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut)))

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node the component that all its sets have, or -1."""
        out = [label[self.order]]
        for _ in self.levels[1:]:
            cut = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], cut), np.maximum.reduceat(out[-1], cut)
            out.append(np.where(low == high, low, -1))
        return out


def dual_pairs(a: SignatureTree, b: SignatureTree, labels, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (set of a, set of b) that the dual traversal doesn't rule out, unlinked as labels() now has it."""
    top = max(len(a.levels), len(b.levels)) - 1
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if len(i) > 4096:
            stack += [(k, i[c : c + 4096], j[c : c + 4096]) for c in range(0, len(i), 4096)][::-1]
            continue
        la, lb = labels()
        ua, ub = la[min(k, len(a.levels) - 1)], lb[min(k, len(b.levels) - 1)]
        (bits_a, low_a, high_a, spare_a), (bits_b, low_b, high_b, spare_b) = level(a, k), level(b, k)
        keep = ((ua[i] < 0) | (ua[i] != ub[j])) & (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
        if same:
            keep &= i <= j if k else i < j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        shared = np.bitwise_count(bits_a[i] & bits_b[j]).sum(1).astype(np.int64) + np.minimum(spare_a[i], spare_b[j])
        most = np.minimum(shared, np.minimum(high_a[i], high_b[j]))
        keep = (100 + percent) * most >= percent * (low_a[i] + low_b[j])
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not k:
            yield a.order[i], b.order[j]
            continue
        down = lambda t, x: (FANOUT * x[:, None] + np.arange(FANOUT) if k < len(t.levels) else np.repeat(x[:, None], 1, 1))
        ci, cj = down(a, i), down(b, j)
        wide = (len(i), ci.shape[1], cj.shape[1])
        ci, cj = np.broadcast_to(ci[:, :, None], wide).ravel(), np.broadcast_to(cj[:, None, :], wide).ravel()
        keep = (ci < len(level(a, k - 1)[0])) & (cj < len(level(b, k - 1)[0]))
        stack.append((k - 1, ci[keep], cj[keep]))


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y

    def labels(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def may_link(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int) -> bool:
    """Whether sets of n and m tokens with bitmaps a and b can link."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    # every bit that the other one lacks is a token that isn't shared
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return (100 + percent) * most >= percent * (n + m)


class Block:
    """Sets of a block: sizes, smallest tokens, bitmaps, and the test that two of them have to pass."""

    def __init__(self, sizes, least, bitmaps, test):
        self.sizes, self.least, self.bitmaps, self.test = np.array(sizes, np.int64), np.array(least, np.uint64), bitmaps, test

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], percent: int) -> Block:
        return cls([len(s) for s in sets], [s[0] for s in sets], [bitmap(s, width(len(s))) for s in sets], lambda x, y: linked(sets[x], sets[y], percent))

    @classmethod
    def of_bitmaps(cls, sizes: list[int], least: list[int], bitmaps: list[np.ndarray], percent: int) -> Block:
        return cls(sizes, least, bitmaps, lambda x, y: may_link(bitmaps[x], sizes[x], bitmaps[y], sizes[y], percent))

    def tree(self, first: int, end: int) -> SignatureTree:
        return SignatureTree(self.sizes[first:end], self.least[first:end], self.bitmaps[first:end])

    def links(self, percent: int, known: np.ndarray | None = None, senders: int = 0) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Links that, with the known components, connect all sets that pass the test, and the labels they give.

        The first ``senders`` sets are compared with the others, and with nothing else; 0: all with all.
        """
        n, out = len(self.sizes), []
        forest = _Forest(n)
        if known is not None:
            first: dict[int, int] = {}
            for k, label in enumerate(known.tolist()):
                forest.join(first.setdefault(label, k), k)
        a = self.tree(0, senders or n)
        b = self.tree(senders, n) if senders else a
        cache: list = [-1, None]

        def labels():
            if cache[0] != len(out):
                every = forest.labels()
                cache[:] = [len(out), (a.uniform(every[:senders]), b.uniform(every[senders:])) if senders else (u := a.uniform(every), u)]
            return cache[1]

        for i, j in dual_pairs(a, b, labels, percent, not senders):
            for x, y in zip(i.tolist(), (j + senders).tolist(), strict=True):
                if forest.root(x) != forest.root(y) and self.test(x, y):
                    forest.join(x, y)
                    out.append((x, y))
        return out, forest.labels()


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal leading columns, as tuples, of a partition sorted by them."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _candidates(percent: int):
    """(block, sub, sid): parts of each block in which sets may link, by their bitmaps alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), rows in _grouped(batches, 1):
            one = list({r[0]: r for r in rows}.values())
            if len(one) < 2:
                continue
            maps = [np.frombuffer(r[3], np.uint64) for r in one]
            _, labels = Block.of_bitmaps([r[1] for r in one], [r[2] & 0xFFFFFFFFFFFFFFFF for r in one], maps, percent).links(percent)
            count = np.bincount(labels, minlength=len(one))
            stay = np.flatnonzero(count[labels] > 1)
            if len(stay):
                ids = np.array([r[0] for r in one])
                yield pa.record_batch([pa.array(np.full(len(stay), block)), pa.array(ids[labels[stay]]), pa.array(ids[stay])], ["block", "sub", "sid"])

    return run


def _exact(percent: int):
    """Links of all parts of blocks in a partition sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 3):
            once = dict(rows)  # a pivot may stand twice
            if len(once) < 2:
                continue
            ids, sets = np.array(list(once)), [np.frombuffer(x, np.uint64) for x in once.values()]
            found, _ = Block.of_sets(sets, percent).links(percent)
            if found:
                at = np.array(found)
                yield pa.record_batch([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])

    return run


def _crossed(percent: int, piece: int):
    """Links between a chunk's own sets and those it is sent, which follow them in the partition, piece by piece."""

    def meet(own: dict, sent: dict) -> pa.RecordBatch | None:
        if not own or not sent:
            return None
        rows = [*sent.items(), *own.items()]
        sets = [np.frombuffer(tokens, np.uint64) for _, (tokens, _) in rows]
        found, _ = Block.of_sets(sets, percent).links(percent, np.array([label for _, (_, label) in rows]), len(sent))
        if not found:
            return None
        ids, at = np.array([sid for sid, _ in rows]), np.array(found)
        return pa.record_batch([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, sent, size = None, {}, {}, 0
        for batch in batches:
            for *key, is_sent, sid, tokens, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at or len(sent) >= piece or size >= 8 * BLOCK_TOKENS:
                    if (made := meet(own, sent)) is not None:
                        yield made
                    sent, size = {}, 0
                    if key != at:
                        at, own = key, {}
                if is_sent:
                    size += len(tokens)
                (sent if is_sent else own)[sid] = (tokens, label)
        if (made := meet(own, sent)) is not None:
            yield made

    return run


# --- Spark -------------------------------------------------------------------------------


def _hooked(edges: DataFrame, turn: int) -> DataFrame:
    """(node, root) of a contraction: every node goes to its neighbour of the lowest priority below its own, then on to where that leads.

    Priorities are hashes of node and turn, so at most half of the nodes are roots in the mean, whatever their ids,
    and ways to a root are short; each round doubles the steps that have been gone.
    """
    priority = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("at"))
    least = edges.groupBy("a").agg(F.min(priority("b")).alias("near")).select(F.col("a").alias("node"), "near")
    up = kit.stage(least.select("node", F.when(F.col("near") < priority("node"), F.col("near.at")).otherwise(F.col("node")).alias("root")))
    while True:
        ahead = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = kit.stage(up.join(ahead, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        up = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return up


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component; nodes without a link are absent.

    Each turn contracts the graph to its roots and goes on with the links between different ones until none is left:
    about the logarithm of the largest component in turns, and what is settled is not looked at again.
    """
    edges = kit.stage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    turns: list[DataFrame] = []
    while not edges.isEmpty():
        turns.append(_hooked(edges, len(turns)))
        left, right = (turns[-1].select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        edges = kit.stage(edges.join(left, "a").join(right, "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    if not turns:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = turns.pop()
    while turns:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("far"))
        found = kit.stage(turns.pop().join(later, "root", "left").select("node", F.coalesce("far", "root").alias("root")))
    labels = found.groupBy("root").agg(F.min("node").alias("label"))
    return kit.stage(found.join(kit.sized(kit.stage(labels)), "root").select("node", "label"))


def _blocks(posted: DataFrame, percent: int, any_hot: bool) -> DataFrame:
    """(block, sid, n): sets that may link by a token they post, in blocks named by one of their sets."""
    # a token's sets by size: where all before are too small, or have it too late, no pair across can link by it
    by_size = Window.partitionBy("token").orderBy("n", "sid")
    reach = F.max("most").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(reach < F.col("n"), F.lit(True))
    runs = posted.filter("not hot").withColumn("start", start)
    first = F.max(F.when(F.col("start"), F.struct("n", "sid"))).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumns({"first": first, "alone": F.col("start") & F.coalesce(F.col("most") < F.lead("n").over(by_size), F.lit(True))})
    blocks = runs.filter("not alone").select(F.col("first.sid").alias("block"), "sid", "n")
    if any_hot:
        # sizes that link lie in one cell or in neighbours, so a block takes a cell's sets and those of the next one
        cell = F.floor(F.log(F.col("n").cast("double")) / (max(math.log(100 / percent), 1e-3) * 1.0001)).cast("int")
        celled = posted.filter("hot").select("token", cell.alias("cell"), "sid", "n")
        named = kit.stage(celled.groupBy("token", "cell").agg(F.min("sid").alias("block")))
        both = celled.withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") - 1)))
        blocks = blocks.unionByName(both.join(kit.sized(named), ["token", "cell"]).select("block", "sid", "n"))
    return blocks.distinct()


def jaccard_components(df: DataFrame, text: str = "text", ident: str = "doc_id", words: int = 5, percent: int = 75, row: str | None = None) -> DataFrame:
    """(ident, n_shingles, class_id, component_id), one row per input row.

    Texts without words and null texts have no shingles and link with nothing: their ids are their own.
    Repeated rows are repeated in the result. A null id stays null and links as any other; class_id and
    component_id are the smallest ids that aren't null, or null where there is none. An empty table gives
    an empty result. Other columns are not looked at, but for row: a column of unique long keys of a staged
    df, which is staged with such a key otherwise.
    """
    docs = df.select(F.col(ident).cast("long").alias("doc"), F.col(text).alias("text"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    docs = docs if row else kit.stage(docs)
    scanned = kit.stage(map_arrow(docs, _scan(words), "kind int, row long, doc long, sid long, n long, salt int"))
    members = scanned.filter("kind = 0").drop("kind")
    classes = kit.stage(members.filter("n > 0").groupBy("sid").agg(F.min("row").alias("row"), F.min("doc").alias("class_id")))
    top = scanned.filter("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).filter("n > 3").orderBy(F.desc("n"), "sid").limit(FREQUENT).toPandas()
    frequent = top["sid"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    prefixes = _prefixes("text", words, percent, frequent[order], top["n"].to_numpy(np.int64)[order], HOT)
    posted = map_arrow(docs.select("text"), prefixes, "token long, n long, most long, sid long, hot boolean")
    blocks = kit.stage(_blocks(posted, percent, bool(len(top)) and int(top["n"].max()) >= HOT))

    size = blocks.groupBy("block").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets")).filter("sets > 1")
    size = kit.stage(size.select("block", F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("sets") / BLOCK_SETS)).cast("int").alias("chunks")))
    # a large block is spread by a salt: first its few (block, salt) pairs get its size, then its rows
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int"))
    placed = kit.stage(blocks.join(blocks.select("block", "salt").distinct().join(kit.sized(size), "block"), ["block", "salt"]).drop("salt"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """The text of one document of each class."""
        chosen = kit.stage(classes.join(wanted.select("sid").distinct(), "sid", "left_semi").select("row"))
        return kit.sized_join(docs, chosen, "row", "left_semi")

    # bitmaps first; a split block goes on whole
    small = placed.filter("chunks = 1")
    bits = map_arrow(texts_of(small).select("text"), _bitmaps("text", words), "sid long, least long, bits binary")
    ready = kit.sized_join(bits, small, "sid", "inner").select("block", "sid", "n", "least", "bits").repartition("block").sortWithinPartitions("block", "sid")
    near = map_arrow(ready, _candidates(percent), "block long, sub long, sid long").withColumn("chunks", F.lit(1))
    near = kit.stage(near.unionByName(placed.filter("chunks > 1").select("block", F.col("block").alias("sub"), "sid", "chunks")))

    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    own = F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")
    sets = map_arrow(texts_of(near).select("text"), _sets("text", words), "sid long, tokens binary")
    rows = near.withColumn("chunk", F.explode(F.when(F.col("sid") == F.col("block"), every).otherwise(F.array(own))))
    part = ["block", "sub", "chunk"]
    ready = kit.sized_join(sets, rows.select(*part, "sid"), "sid", "inner").select(*part, "sid", "tokens").repartition(*part).sortWithinPartitions(*part, "sid")
    links = kit.stage(map_arrow(ready, _exact(percent), "a long, b long"))
    labels = components(links)

    split = near.filter("chunks > 1")
    if not split.isEmpty():
        named = kit.stage(split.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid")))
        main = named.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        rest = kit.stage(named.join(kit.sized(kit.stage(main)), "block").withColumn("sent", F.col("label") != F.col("main")).drop("main"))
        sent = rest.filter("sent").select("block", "sub", F.explode(every).alias("chunk"), "sent", "sid", "label")
        stay = rest.select("block", "sub", own.alias("chunk"), F.lit(False).alias("sent"), "sid", "label")
        ready = stay.join(kit.sized(kit.stage(rest.filter("sent").select("block").distinct())), "block", "left_semi").unionByName(sent).join(sets, "sid")
        # own sets first, then those sent
        ready = ready.select(*part, "sent", "sid", "tokens", "label").repartition(*part).sortWithinPartitions(*part, "sent", "sid")
        labels = components(links.unionByName(kit.stage(map_arrow(ready, _crossed(percent, BLOCK_SETS), "a long, b long"))))

    # components are named by the smallest of their classes' ids; copies of one set are spread by their salts
    classes = classes.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    names = classes.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = classes.join(names, "label").select("sid", "class_id", "component_id")
    salted = members.filter("n > 0").select("sid", "salt").distinct().join(named, "sid")
    full = members.filter("n > 0").join(salted, ["sid", "salt"], "left")
    empty = members.filter("n = 0").withColumns({"class_id": F.col("doc"), "component_id": F.col("doc")})
    return full.select("doc", "n", "class_id", "component_id").unionByName(empty.select("doc", "n", "class_id", "component_id")).select(
        F.col("doc").alias(ident), F.col("n").alias("n_shingles"), "class_id", "component_id"
    )
