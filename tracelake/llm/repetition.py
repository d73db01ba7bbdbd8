"""Quality rules by repetition coverage.

Rolling hashes of n-grams of several lengths, computed in numpy for a slice of whole documents at a
time, mark the words inside n-grams that stand more than once in their document; the share of
characters in them, and in repeated lines, is held against fixed limits. The same is done for the
sequence of a document's marks alone (letters, digits and blanks left out), where boilerplate and
noise repeat themselves between words that don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import kit
from tracelake.plans.ship import map_arrow

#: Largest share of characters inside repeated n-grams, by n, and in repeated lines.
LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.30
#: Marks of an n-gram of them, and the largest share of characters inside repeated ones.
MARKS, MARK_LIMIT = 6, 0.06
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = np.zeros(256, bool)
MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
LINE_BREAK = np.zeros(256, bool)
LINE_BREAK[10] = True


def _repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key stands more than once in its document, and whether an equal one came before it."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = keys ^ kit.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    group = np.cumsum(new) - 1
    many, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    many[order], later[order] = (np.bincount(group) > 1)[group], ~new
    return many, later


def covered(tokens: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Whether each token lies in a window of so many that stands more than once in its document."""
    first, keys = kit.window_hashes(tokens, doc, length)
    hit = first[_repeated(keys, doc[first])[0]]
    if not len(hit):
        return np.zeros(len(doc), bool)
    edge = np.bincount(hit, minlength=len(doc) + 1) - np.bincount(hit + length, minlength=len(doc) + 1)
    return np.cumsum(edge)[: len(doc)] > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = tuple(LIMITS)) -> dict[str, np.ndarray]:
    """The counts of each document of a slice."""
    n = len(offsets) - 1
    starts, ends, doc = kit.spans(data, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    per_doc = lambda d, w=None: np.bincount(d, w, n).astype(np.int64)
    symbols = np.flatnonzero(SYMBOL[data])
    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, chars), "n_symbols": per_doc(np.searchsorted(offsets, symbols, "right") - 1)}
    hashes = kit.word_hashes(data, starts, ends)

    out["n_repeat_words"] = per_doc(doc[covered(hashes, doc, WINDOW)])
    for length in lengths:
        inside = covered(hashes, doc, length)
        out[f"dup_chars_{length}"] = per_doc(doc[inside], chars[inside])
    marks = np.flatnonzero(MARK[data])
    mark_doc = np.searchsorted(offsets, marks, "right") - 1
    out["dup_mark_chars"] = per_doc(mark_doc[covered(data[marks].astype(np.uint64) + np.uint64(1), mark_doc, MARKS)])
    # lines: whole bytes between line breaks; only those with a word count
    at, to, line_doc = kit.spans(data, offsets, LINE_BREAK)
    words_before = lambda x: np.searchsorted(starts, x)
    filled = words_before(to) > words_before(at)
    at, to, line_doc = at[filled], to[filled], line_doc[filled]
    later = _repeated(kit.word_hashes(data, at, to), line_doc)[1]
    out["n_dup_lines"] = per_doc(line_doc[later])
    in_words = np.concatenate([[0], np.cumsum(chars)])
    out["dup_line_chars"] = per_doc(line_doc[later], (in_words[words_before(to)] - in_words[words_before(at)])[later])
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base failed, kept) from the counts."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    chars = np.maximum(m["word_chars"], 1)
    good = (m["dup_line_chars"] <= LINE_LIMIT * chars) & (m["dup_mark_chars"] <= MARK_LIMIT * chars)
    for length, limit in LIMITS.items():
        good &= m[f"dup_chars_{length}"] <= limit * chars
    return failed, ~failed & good


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "dup_mark_chars", *(f"dup_chars_{n}" for n in LIMITS))


def repetition_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts of COUNTS (long) and base_failed, kept (boolean).

    Null and empty texts have counts of 0 and fail. Every other column and row is kept as it is;
    columns named like the new ones are replaced. An empty table stays empty.
    """
    df = kit.without(df, *COUNTS, "base_failed", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in kit.text_slices(batch.column(text)):
                m = measure(data, offsets)
                failed, kept = verdict(m)
                new = [*(pa.array(m[c]) for c in COUNTS), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], [*batch.schema.names, *COUNTS, "base_failed", "kept"])

    fields = df.select("*", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit(True).alias("base_failed"), F.lit(True).alias("kept")).schema
    return map_arrow(df, run, fields)
