"""Byte-level BPE encoding and decoding by a segment tree over adjacent pair ranks.

The tree's leaves hold, for each place of a piece, the rank of the pair that begins there; the root
is the leftmost pair of the lowest rank. A merge changes three leaves and their paths to the root,
so a piece of n bytes costs n log n however long it is. Pieces come from the tokenizer's own
pattern, and a piece met before is looked up. Short new pieces are merged together: numpy holds a
tree for each and makes one merge in every piece at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import kit
from tracelake.plans.ship import map_arrow

#: Pieces kept for a task; beyond that it starts afresh.
KEPT_PIECES = 100_000
#: Bytes of the pieces that are merged together; longer ones are merged alone.
SHORT = 65
#: The byte-level pattern, a fixed value of the format; \s is Unicode white space there.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(
    r"\s", r"\p{White_Space}"
).replace(r"\S", r"\P{White_Space}")
_NONE = 1 << 62
_PLACE = 32


def _byte_signs() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A tokenizers JSON file of a byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs = _byte_signs()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(signs[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.first = {signs[s]: i for s, i in vocab.items() if len(s) == 1}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.first_ids = np.array([self.first[b] for b in range(256)], np.int64)
        pair_keys = np.array([a << 20 | b for a, b in self.rank], np.int64)
        order = np.argsort(pair_keys)
        self.pair_keys, self.pair_ranks = pair_keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.made_ids = np.array(self.made, np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it can't be merged; -1 stands for no token."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of pieces of 2 to SHORT bytes, one tree of as many leaves for each."""
        leaves = 1 << max(max(map(len, pieces)) - 2, 0).bit_length()
        wide = leaves + 2  # the last place stands for the end
        rows = len(pieces)
        ids = np.full((rows, wide), -1, np.int64)
        lengths = np.array(list(map(len, pieces)))
        ids[np.arange(wide) < lengths[:, None]] = self.first_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        none = 1 << 40
        found = self.ranks_of(ids[:, :leaves], ids[:, 1 : leaves + 1])
        tree = np.full((rows, 2 * leaves), none, np.int64)
        tree[:, leaves:] = np.where(found >= 0, found << 8 | np.arange(leaves), none)
        for i in range(leaves - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        after = np.tile(np.minimum(np.arange(1, wide + 1), wide - 1), (rows, 1))
        before = np.tile(np.arange(-1, wide - 1), (rows, 1))
        after[np.arange(rows), lengths - 1] = wide - 1
        ids_, tree_, after_, before_ = (x.ravel() for x in (ids, tree, after, before))
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            best = tree[live, 1]
            live, best = live[best < none], best[best < none]
            if not len(live):
                break
            at, root = live * wide, live * 2 * leaves
            i = best & 255
            j = after_[at + i]
            k = after_[at + j]
            h = before_[at + i]
            ids_[at + i], ids_[at + j] = self.made_ids[best >> 8], -1
            after_[at + i], before_[at + k] = k, i
            changed = [(j, np.full(len(live), -1)), (i, self.ranks_of(ids_[at + i], ids_[at + k])), (h, self.ranks_of(np.where(h >= 0, ids_[at + np.maximum(h, 0)], -1), ids_[at + i]))]
            for leaf, rank in changed:
                ok = np.flatnonzero((leaf >= 0) & (leaf < leaves))
                node, base = leaf[ok] + leaves, root[ok]
                tree_[base + node] = np.where(rank[ok] >= 0, rank[ok] << 8 | leaf[ok], none)
                for _ in range(leaves.bit_length() - 1):
                    node >>= 1
                    tree_[base + node] = np.minimum(tree_[base + 2 * node], tree_[base + 2 * node + 1])
        return [row[row >= 0] for row in ids]

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are not known yet."""
        if len(self.known) + len(pieces) > KEPT_PIECES:
            self.known.clear()
        groups: dict[int, list[str]] = {}
        for p in pieces:
            n = len(p.encode())
            if n == 1:
                self.known[p] = self.first_ids[p.encode()[0]].astype("<u4").tobytes()
            elif n > SHORT:
                self.known[p] = np.array(self.merge(p.encode()), "<u4").tobytes()
            else:
                groups.setdefault((n - 2).bit_length(), []).append(p)
        for same in groups.values():
            step = 320_000 >> (max(len(p.encode()) for p in same) - 1).bit_length()
            for c in range(0, len(same), step):
                part = same[c : c + step]
                self.known.update((p, found.astype("<u4").tobytes()) for p, found in zip(part, self.merge_many([p.encode() for p in part]), strict=True))

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        rank, made = self.rank, self.made
        size = 1 << max(n - 2, 0).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if (r := rank.get((ids[i], ids[i + 1]))) is not None:
                tree[size + i] = r << _PLACE | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i := i >> 1:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    return
                tree[i] = low

        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        while (best := tree[1]) != _NONE:
            i = best & ((1 << _PLACE) - 1)
            j = after[i]
            ids[i], ids[j] = made[best >> _PLACE], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                put(j, _NONE)
            r = rank.get((ids[i], ids[k])) if k >= 0 else None
            put(i, _NONE if r is None else r << _PLACE | i)
            if (h := before[i]) >= 0:
                r = rank.get((ids[h], ids[i]))
                put(h, _NONE if r is None else r << _PLACE | h)
        return [t for t in ids if t >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids as little-endian 32-bit integers; special tokens in a text are found as such."""
        parts = [self.split.split(t) if self.split and any(s in t for s in self.special) else [t] for t in texts]
        # odd places of a split text are special tokens
        pieces = [[self.pattern.findall(p) if not k % 2 else p for k, p in enumerate(ps)] for ps in parts]
        wanted = set().union(*(p for ps in pieces for p in ps[::2]))
        self.learn(wanted if len(self.known) + len(wanted) > KEPT_PIECES else wanted - self.known.keys())
        known = self.known
        return [b"".join([b"".join([known[x] for x in p]) if not k % 2 else np.array([self.special[p]], "<u4").tobytes() for k, p in enumerate(ps)]) for ps in pieces]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(4)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def _added(df: DataFrame, new: dict[str, pa.DataType], read: str, function) -> DataFrame:
    """df with new columns that function(tokenizer, values of a slice) gives from the column read."""
    df = kit.without(df, *new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in kit.byte_slices(batch.column(read)):
                part = batch.slice(i, j - i)
                made = function(part.column(read).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m, t) for m, t in zip(made, new.values(), strict=True))], [*batch.schema.names, *new])

    return map_arrow(df, run, df.withColumns({c: F.lit("" if t == pa.string() else b"") for c, t in new.items()}).schema)


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with ids: the token ids of the text as little-endian 32-bit integers in a binary column.

    Null and empty texts give no ids (an empty value). A column named like ids is replaced, all others
    and all rows are kept, repeated ones repeatedly; an empty table stays empty. Texts of any length are taken whole.
    """
    return _added(df, {ids: pa.binary()}, text, lambda texts: [tokenizer(path).encode([t or "" for t in texts])])


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for; null and empty ids give an empty text.

    Bytes that are no UTF-8 become replacement characters; an id outside the vocabulary is an error. A
    column named like decoded is replaced, all others and all rows are kept; an empty table stays empty.
    """
    return _added(df, {decoded: pa.string()}, ids, lambda coded: [[tokenizer(path).decode(c or b"") for c in coded]])


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """bpe_encode and bpe_decode of its ids in one pass, so that a task needs one worker with one vocabulary."""

    def both(texts: list[str | None]) -> list[list]:
        bpe = tokenizer(path)
        coded = bpe.encode([t or "" for t in texts])
        return [coded, [bpe.decode(c) for c in coded]]

    return _added(df, {ids: pa.binary(), decoded: pa.string()}, text, both)
