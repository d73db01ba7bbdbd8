"""Spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are ordered from the rarest of the vocabulary on. Its prefix is the three rarest (with all
that are as rare as the third), its pivots are two bigrams of the prefix that share no letter and are
rarest together, chosen by dynamic programming over places. One edit leaves one of two such bigrams whole, so of
two near words the one whose prefix ends first has a pivot in the other's prefix. The edit lies behind
that pivot or before it: the place from the start or from the end is the same, and so are all letters on that
side, which bound the candidates further. Candidates are verified by their edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import kit
from tracelake.llm.crc import crc32
from tracelake.plans.ship import map_arrow

#: Words have at least MIN_LETTERS letters and stand MIN_COUNT times or more; with fewer than 4 letters a word has no three bigrams.
MIN_LETTERS, MIN_COUNT = 5, 3
#: One run in TYPO of a document loses a letter, by its checksum.
TYPO = 97
#: A side of a bigram with at most so many letters, the bigram's included, is shared by many words.
SHORT = 4
#: The rank of places without a bigram.
PAD = np.iinfo(np.int64).max

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARKS = np.array([True, False])


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of letters A-Z, a-z and U+00C0 to U+00FF (two bytes, the first 0xC3)."""
    high = data == 0xC3
    inside = _LETTER[data] | high
    inside[1:] |= high[:-1]
    return kit.spans(inside.astype(np.uint8), offsets, _MARKS)


def _counted(values: pa.Array) -> pa.RecordBatch:
    found = values.value_counts()
    return pa.record_batch([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])


def _counting(letters: int, typo: int):
    def words(first: int, end: int, data: np.ndarray, offsets: np.ndarray, idents: list) -> Iterator[pa.RecordBatch]:
        data = kit.LOWER[data]
        starts, ends, doc = runs_of(data, offsets)
        if not len(doc):
            return
        begin = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in idents[first:end]], np.uint32)
        check = crc32(data, starts, ends, begin[doc]).astype(np.int64)
        changed = check % typo == 0
        shorter = []
        for s, e, h in zip(starts[changed].tolist(), ends[changed].tolist(), check[changed].tolist(), strict=True):
            run = data[s:e].tobytes().decode()
            at = h % len(run)
            shorter.append(run[:at] + run[at + 1 :])
        if shorter := [w for w in shorter if len(w) >= letters]:
            yield _counted(pa.array(shorter, pa.string()))
        ahead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        keep = ~changed & (ahead[ends] - ahead[starts] >= letters)
        starts, size = starts[keep], (ends - starts)[keep]
        new = np.cumsum(size) - size
        at = np.repeat(starts - new, size) + np.arange(int(size.sum()))
        offs = np.append(new, size.sum()).astype(np.int64)
        yield _counted(pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[at]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents = batch.column(0).to_pylist()
            for part in kit.text_slices(batch.column(1)):
                yield from words(*part, idents)

    return run


def vocabulary(docs: DataFrame, ident: str = "doc_id", text: str = "text", letters: int = MIN_LETTERS, least: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n): the words of all texts with at least that many letters and occurrences, in lower case (A-Z only).

    A run of letters whose checksum with the document's id is divisible by typo loses one letter. A null id
    counts as no text; null and empty texts have no words; repeated rows count again.
    """
    counted = map_arrow(docs.select(ident, text), _counting(letters, typo), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- grams -------------------------------------------------------------------------------


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words in rows, 0 behind the end, and lengths."""
    text = words.to_pylist()
    size = np.array([len(w) for w in text])
    flat = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.zeros((len(text), int(size.max())), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def _grams(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bigrams of the rows as numbers, PAD behind the end. Letters are below 256."""
    grams = letters[:, :-1] << 8 | letters[:, 1:]
    return np.where(np.arange(grams.shape[1]) < (size - 1)[:, None], grams, PAD)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        if len(batch):
            grams = _grams(*_letters(batch.column(0)))
            total += np.bincount(grams[grams != PAD], minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], ["gram", "n"])


def pivots_of(ranks: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Two places of each row whose bigrams are inside, don't overlap and have the smallest sum of ranks.

    Going over places, best[p] is the place of the smallest rank up to p; a pair that ends at p takes best[p - 2].
    """
    n, width = ranks.shape
    cost = np.where(inside, ranks, PAD // 4)
    rows = np.arange(n)
    best, pair, total = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.full(n, PAD)
    for p in range(2, width):
        best = np.where(cost[:, p - 2] < cost[rows, best], p - 2, best)
        new = cost[rows, best] + cost[:, p]
        better = new < total
        total = np.where(better, new, total)
        pair[better, 0], pair[better, 1] = best[better], p
    return pair


def _keys(word: str, place: int, size: int, short: int) -> Iterator[str]:
    """What a word of that many letters shares with this one if the bigram at place is whole in both: one of these.

    The edit is behind the bigram or before it, so one side is the same, bigram included. Where that is at most short
    letters, the other side is cut in two halves, of which the edit leaves one the same as well.
    """
    for side, part, rest in (("<", word[: place + 2], word[place + 2 :]), (">", word[place:], word[:place])):
        if len(part) > short:
            yield side + part
            continue
        far = size - len(part)
        near = far // 2
        first, last = rest[: far - near], rest[len(rest) - near :] if near else ""
        if side == "<":
            first, last = rest[:near], rest[len(rest) - (far - near) :]
        yield f"{side}{part}|{first}"
        yield f"{side}{part}||{last}"


def _entries(rank: np.ndarray, sizes: tuple[int, ...] | None, short: int):
    """Rows of the index (a word's prefix bigrams), or of the search (its pivots) in words that are longer by one of sizes.

    last is the rank at which the word's prefix ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            letters, size = _letters(batch.column(0))
            grams = _grams(letters, size)
            ranks = np.where(grams == PAD, PAD, rank[np.minimum(grams, (1 << 16) - 1)])
            last = np.sort(ranks, axis=1)[:, 2]
            chosen = ranks <= last[:, None]
            if sizes:
                pivots = pivots_of(ranks, chosen)
                chosen = np.zeros_like(chosen)
                np.put_along_axis(chosen, pivots, True, axis=1)
            words, at, keys, totals = batch.column(0).to_pylist(), [], [], []
            for w, p in zip(*(x.tolist() for x in np.nonzero(chosen)), strict=True):
                word = words[w]
                for more in sizes or (0,):
                    for key in _keys(word, p, len(word) + more, short):
                        at.append(w)
                        keys.append(key)
                        totals.append(len(word) + more)
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(totals, pa.int32()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(last[at])], ["key", "size", "word", "last"])

    return run


def _merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled and merged, never broadcast.

    Spark sizes staged words by their compressed file, and the entries of the index, several a word, as if they were the
    words: it would send tables through the driver that are far larger than its threshold.
    """
    return df.hint("merge")


def near_pairs(words: DataFrame, short: int = SHORT) -> DataFrame:
    """(word, near): pairs of words one insertion, deletion or replacement of a letter apart, both ways round.

    words is a staged column of distinct words of at least 4 letters, all below U+0100. The driver holds a
    count for every bigram of letters, 2**16 at most. A word has a bounded number of entries, and a word's
    partners are bounded by its letters; entries of common parts are left to the skew join.
    """
    counts = np.zeros(1 << 16, np.int64)
    for gram, n in map_arrow(words, _gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    order = np.lexsort((np.arange(1 << 16), counts))
    rank = np.empty(1 << 16, np.int64)
    rank[order] = np.arange(1 << 16)
    entries = lambda sizes: map_arrow(words, _entries(rank, sizes, short), "key string, size int, word string, last long").select(F.xxhash64("key", "size").alias("key"), "word", F.col("last").cast("int").alias("last"))
    index, search = entries(None).alias("i"), entries((-1, 0, 1)).alias("s")
    near = (F.col("s.last") <= F.col("i.last")) & (F.col("i.word") != F.col("s.word")) & (F.levenshtein(F.col("i.word"), F.col("s.word"), 1) == 1)
    found = index.join(_merged(search), (F.col("i.key") == F.col("s.key")) & near).select(F.col("s.word").alias("word"), F.col("i.word").alias("near"))
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of words (word, n), which is staged and has distinct words.

    form is the near word with the largest n (of equal ones the first by code points) if that is ratio times the
    word's n or more, else null; form_n is its n. root is where forms lead: n grows along them, so there are
    no rings. An empty table gives an empty result.
    """
    pairs = near_pairs(words.select("word"))
    counted = pairs.join(_merged(words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    joined = words.join(_merged(best), "word", "left")
    usable = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    formed = kit.stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usable, F.col("best.near")).alias("form"), F.when(usable, -F.col("best.minus")).alias("form_n")))
    # every round doubles the steps that root has gone
    roots = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = kit.stage(roots.join(_merged(ahead), "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return formed.join(_merged(roots.select("word", "root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """variants() of the vocabulary of docs."""
    return variants(kit.stage(vocabulary(docs, ident, text)))
