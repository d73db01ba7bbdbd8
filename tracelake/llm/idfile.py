"""Token-id files coded by an adaptive context-mixing range coder.

A file is a row of segments; a segment holds whole documents (ids, lengths) and blocks of token ids.
Blocks are reset and checksummed on their own. A block lays its ids out in lanes, each a run of
consecutive ids with its own range coder; all lanes share one model and advance together, which lets
numpy code a step of every lane at once.

The model counts the ids coded so far by their two last ids (order 2), by the last one (order 1) and
alone (order 0), and is made anew when four times as many have been seen. An id's probability is the sum over the
orders of what each gives it, weighted by how often its context was seen and how many different ids followed. The
sums of a context's likeliest ids lie in one row of a table; an id outside that row is coded by the
rest of the row and then by the order-0 counts of ids that aren't in it.
"""

from __future__ import annotations

import ctypes
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import kit
from tracelake.plans.ship import map_arrow

MAGIC = b"TLI2"
LANES, STEPS = 4096, 256
BLOCK_IDS = LANES * STEPS
#: Bytes of text that are cut together.
CUT_BYTES = 1 << 21
#: Strings whose ids a worker keeps; beyond that it starts afresh. Those of up to SHORT bytes are kept as numbers.
KEPT_WORDS, SHORT = 1_000_000, 15
#: Ids of a row, and the least number of times that an order-2 context was seen to have one.
TOP, SEEN = 16, 4
#: Probabilities are parts of 2**SCALE; the table of order-2 rows has 2**HASH places.
SCALE, HASH = 20, 17
_ONE = 1 << SCALE
_LEAST = 1 << 10
#: Steps whose intervals are looked up together.
_AHEAD = 4
_EACH_BYTE = np.uint64(0x0101010101010101)
#: A lane writes words of 32 bits.
_BOTTOM, _WORD = np.uint64(1 << 32), np.uint64(32)


def _best(row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether each entry is among the TOP of its row by weight, the first of equal ones; rows are consecutive."""
    n = len(row)
    size = np.bincount(row)
    some = np.flatnonzero(size[row] > TOP)
    keep = np.ones(n, bool)
    if len(some):
        key = np.sort(row[some] << 42 | (_ONE - weight[some]) << 21 | np.arange(len(some)))  # no two are equal
        own = key >> 42
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep[some[key[place >= TOP] & (1 << 21) - 1]] = False
    return keep


def _counted(keys: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, their counts, the number of each one's group (key // group), and the groups' counts."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(keys)))
    keys = keys[first].astype(np.int64)
    of = keys // group
    own = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys, n, own, np.bincount(own, n).astype(np.int64)


class _Model:
    """What coder and decoder both know after some steps of a block. All arithmetic is on integers."""

    def __init__(self, seen: np.ndarray, vocabulary: int):
        """seen: the ids so far, one row a step."""
        self.vocabulary = vocabulary
        counts = np.bincount(seen.ravel(), minlength=vocabulary)
        self.plain = 1 + counts * (_ONE - 1) // max(1, seen.size)
        self.below = np.concatenate([[0], np.cumsum(self.plain)])
        self.total = int(self.below[-1])
        # order 1
        two = seen[:-1].ravel() * vocabulary + seen[1:].ravel()
        pairs, n, own, often = _counted(two.astype(np.uint32) if vocabulary <= 1 << 16 else two, vocabulary)
        kinds = np.bincount(own, minlength=len(often))
        context, ids = np.divmod(pairs, vocabulary)
        trust = np.minimum(_ONE * often // (often + kinds), _ONE - _LEAST)
        weight = np.maximum(trust[own] * n // often[own] + (_ONE - trust[own]) * self.plain[ids] // self.total, 1)
        keep = _best(own, weight)
        self.row = np.zeros(vocabulary, np.int32)
        self.row[context] = 1 + own
        rows, row_ids, row_weights = [1 + own[keep]], [ids[keep]], [weight[keep]]
        n_rows = 1 + len(often)
        # order 2: contexts seen often enough, mixed with the row of their last id
        self.place = np.zeros(1 << HASH, np.int32)
        self.key = np.full(n_rows, -1, np.int64)
        if len(seen) > 2:
            triples, m, own2, often2 = _counted(two[: -seen.shape[1]] * vocabulary + seen[2:].ravel(), vocabulary)
            use = often2[own2] >= SEEN
            triples, m, own2 = triples[use], m[use], (np.cumsum(often2 >= SEEN) - 1)[own2[use]]
            often2 = often2[often2 >= SEEN]
            known = np.zeros(len(often2), np.int64)
            known[own2] = triples // vocabulary
            trust2 = np.minimum(_ONE * often2 // (often2 + 2 * np.bincount(own2, minlength=len(often2))), _ONE - _LEAST)
            lower = known % vocabulary
            one = weight[np.searchsorted(pairs, triples % (vocabulary * vocabulary))]
            mine = trust2[own2] * m // often2[own2] + ((_ONE - trust2[own2]) * one >> SCALE)
            # the rows of the last ids, less the ids that have an entry already
            size1 = np.bincount(rows[0], minlength=n_rows)
            start1 = np.cumsum(size1) - size1
            size, start = size1[self.row[lower]], start1[self.row[lower]]
            base = np.repeat(np.arange(len(known)), size)
            at = np.arange(len(base)) - np.repeat(np.cumsum(size) - size - start, size)
            after, more_ids = triples % vocabulary, row_ids[0].take(at)
            mine_keys, more_keys = own2 * vocabulary + after, base * vocabulary + more_ids
            spot = np.searchsorted(mine_keys, more_keys)
            new = np.flatnonzero(np.append(mine_keys, -1).take(spot) != more_keys)
            base, spot = base.take(new), spot.take(new)
            more = ((_ONE - trust2.take(base)) * row_weights[0].take(at.take(new))) >> SCALE
            # where the entries of both stand in order
            old = np.arange(len(mine_keys)) + np.cumsum(np.bincount(spot, minlength=len(mine_keys)))[: len(mine_keys)]
            spot += np.arange(len(new))

            def merged(mine: np.ndarray, more: np.ndarray) -> np.ndarray:
                out = np.empty(len(mine) + len(more), np.int64)
                out[old], out[spot] = mine, more
                return out

            own2, after, mixed = merged(own2, base), merged(after, more_ids.take(new)), merged(np.clip(mine, 1, _ONE - 1), np.maximum(more, 1))
            best = _best(own2, mixed)
            rows.append(n_rows + own2[best])
            row_ids.append(after[best])
            row_weights.append(mixed[best])
            self.place[self.slot(known)] = n_rows + np.arange(len(known))
            self.key = np.concatenate([self.key, known])
            n_rows += len(known)
        rows, row_ids, row_weights = np.concatenate(rows), np.concatenate(row_ids), np.concatenate(row_weights)
        size = np.bincount(rows, minlength=n_rows)
        place = rows * TOP + np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)

        def table(values: np.ndarray, none: int) -> np.ndarray:
            out = np.full(n_rows * TOP, none, np.int32)
            out[place] = values
            return out

        def summed(values: np.ndarray, more: int) -> np.ndarray:
            out = np.zeros((n_rows, TOP + 1 + more), np.int32)
            np.cumsum(table(values, 0).reshape(n_rows, TOP), 1, out=out[:, 1 : TOP + 1])
            return out

        #: Of each row: ids in ascending order (vocabulary: none), edges of their intervals and of the rest's, the same ids' edges on the order-0
        #: line (counts taken out before each, and where each would begin on the line without those before it), and what is left of that line.
        self.ids = table(row_ids, vocabulary)
        self.id_rows = self.ids.reshape(n_rows, TOP)
        edges, taken = summed(row_weights, 1), summed(self.plain[row_ids], 0)
        edges[:, TOP + 1] = _ONE
        self.edge_rows = np.ascontiguousarray(edges[:, 1 : TOP + 1])
        self.edges, self.taken = edges.ravel(), taken.ravel()
        self.begin_rows = (self.below[self.id_rows] - taken[:, :-1]).astype(np.int32)
        self.left = self.total - taken[:, TOP].astype(np.int64)

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key * 0x2545F4914F6CDD1D & 0x7FFFFFFFFFFFFFFF) >> (63 - HASH)

    @staticmethod
    def rank(table: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the TOP ascending entries of each row are at most value."""
        least = table.take(row, 0) <= value.astype(np.int32)[:, None]  # a byte each, which a product adds up
        eight = least.view(np.uint64)
        return ((eight[:, 0] + eight[:, 1]) * _EACH_BYTE >> np.uint64(56)).view(np.int64)

    def rows_of(self, last2: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The row of each context: order 2 if it has one, else order 1, else the empty row 0."""
        key = last2 * self.vocabulary + last
        row = self.place.take(self.slot(key))
        return np.where(self.key.take(row) == key, row, self.row.take(last)).astype(np.int64)

    def intervals(self, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each id: start and width in its row, and in the order-0 line (width 0 if it is in the row) with its total."""
        slot = self.rank(self.id_rows, row, ids)  # ids up to this one
        inside = self.ids.take(row * TOP + np.maximum(slot - 1, 0)) == ids
        at = row * (TOP + 2) + np.where(inside, slot - 1, TOP)
        start = self.edges.take(at).astype(np.int64)
        rest = np.flatnonzero(~inside)
        start0, width0 = np.zeros((2, len(ids)), np.int64)
        start0[rest] = self.below.take(ids[rest]) - self.taken.take(row[rest] * (TOP + 1) + slot[rest])
        width0[rest] = self.plain.take(ids[rest])
        return start, self.edges.take(at + 1) - start, start0, width0, self.left.take(row)


def _carry(words: np.ndarray, at: np.ndarray) -> None:
    """Adds one to the words at each place; what passes 32 bits goes on to the word before."""
    words += np.bincount(at, minlength=len(words)).astype(np.uint64)
    over = np.flatnonzero(words >= _BOTTOM)
    while len(over):
        words[over] -= _BOTTOM
        words[over - 1] += np.uint64(1)
        over = over[words[over - 1] >= _BOTTOM] - 1


def _epochs(steps: int) -> list[tuple[int, int]]:
    edges = [0, 1]
    while edges[-1] < steps:
        edges.append(4 * edges[-1])
    return [(a, min(b, steps)) for a, b in zip(edges, edges[1:], strict=False) if a < steps]


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, -(-n // STEPS)))
    steps = -(-n // lanes)
    flat = np.zeros(lanes * steps, np.int64)
    flat[:n] = ids
    grid = np.ascontiguousarray(flat.reshape(lanes, steps).T)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    words, of = [], []  # words as they come, and their lanes
    count = np.zeros(lanes, np.int64)  # of a lane's words
    carries = []  # lanes whose low passed 64 bits, and their count then

    def carry(go: np.ndarray) -> None:
        if len(go):
            carries.append((go, count[go]))

    def settle(go: np.ndarray) -> None:
        if len(go):
            now = low[go]
            words.append((now >> _WORD).astype(np.uint32))
            of.append(go.astype(np.uint16))
            count[go] += 1
            low[go] = now << _WORD
            span[go] <<= _WORD

    before = np.concatenate([np.zeros((2, lanes), np.int64), grid])
    for a, b in _epochs(steps):
        model = _Model(grid[:a], vocabulary)
        for c in range(a, b, _AHEAD):
            d = min(c + _AHEAD, b)
            row = model.rows_of(before[c:d].ravel(), before[c + 1 : d + 1].ravel())
            parts = [x.reshape(d - c, lanes) for x in model.intervals(row, grid[c:d].ravel())]
            for start, width, start0, width0, total0 in zip(*parts, strict=True):
                unit = span >> np.uint64(SCALE)
                more = unit * start.view(np.uint64)
                low += more
                carry(np.flatnonzero(low < more))
                np.multiply(unit, width.view(np.uint64), out=span)
                settle(np.flatnonzero(span < _BOTTOM))
                if len(rest := np.flatnonzero(width0)):
                    unit = span[rest] // total0[rest].view(np.uint64)
                    more = unit * start0[rest].view(np.uint64)
                    low[rest] = now = low[rest] + more
                    carry(rest[now < more])
                    span[rest] = now = unit * width0[rest].view(np.uint64)
                    settle(rest[now < _BOTTOM])
    for half in (low >> _WORD, low & (_BOTTOM - np.uint64(1))):
        words.append(half.astype(np.uint32))
        of.append(np.arange(lanes, dtype=np.uint16))
    own = np.concatenate(of)
    at = count + 2
    values = np.concatenate(words)[np.argsort(own, kind="stable")].astype(np.uint64)
    if carries:  # what a lane has written so far is a number, to which one is added
        lane, n_before = map(np.concatenate, zip(*carries, strict=True))
        _carry(values, np.cumsum(at)[lane] - at[lane] + n_before - 1)
    words = values.astype("<u4").tobytes()
    raw = np.ascontiguousarray(ids, "<u4").tobytes()
    body = struct.pack("<IIII", n, lanes, vocabulary, len(words)) + at.astype("<u4").tobytes() + words
    return body + struct.pack("<II", zlib.crc32(raw), zlib.crc32(body))


def decode_block(data: memoryview) -> tuple[np.ndarray, int]:
    """Token ids and the length of the block in bytes."""
    n, lanes, vocabulary, size = struct.unpack_from("<IIII", data)
    end = 16 + 4 * lanes + size
    crc_ids, crc_body = struct.unpack_from("<II", data, end)
    if zlib.crc32(data[:end]) != crc_body:
        raise ValueError("damaged block")
    lengths = np.frombuffer(data, "<u4", lanes, 16).astype(np.int64)
    words = np.frombuffer(data, "<u4", size // 4, 16 + 4 * lanes).astype(np.uint64)
    at = np.cumsum(lengths) - lengths + 2
    code = words[at - 2] << _WORD | words[at - 1]  # less the coder's low
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def settle(go: np.ndarray) -> None:
        if len(go):
            place = at[go]
            code[go] = code[go] << _WORD | words.take(place)
            at[go] = place + 1
            span[go] <<= _WORD

    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), np.int64)
    last2 = last = np.zeros(lanes, np.int64)
    for a, b in _epochs(steps):
        model = _Model(grid[:a], vocabulary)
        plain_id = np.repeat(np.arange(vocabulary, dtype=np.int32), model.plain)
        for k in range(a, b):
            row = model.rows_of(last2, last)
            unit = span >> np.uint64(SCALE)
            slot = model.rank(model.edge_rows, row, code // unit)
            place = row * (TOP + 2) + slot
            first = model.edges.take(place).astype(np.int64)
            width = model.edges.take(place + 1) - first
            now = model.ids.take(row * TOP + slot, mode="clip").astype(np.int64)
            np.subtract(code, unit * first.view(np.uint64), out=code)
            np.multiply(unit, width.view(np.uint64), out=span)
            settle(np.flatnonzero(span < _BOTTOM))
            if len(rest := np.flatnonzero(slot == TOP)):
                own = row[rest]
                unit = span[rest] // model.left.take(own).view(np.uint64)
                left = code[rest]
                spot = (left // unit).view(np.int64)
                skipped = model.taken.take(own * (TOP + 1) + model.rank(model.begin_rows, own, spot))
                now[rest] = found = plain_id.take(spot + skipped)
                code[rest] = left - unit * (model.below.take(found) - skipped).view(np.uint64)
                span[rest] = wide = unit * model.plain.take(found).view(np.uint64)
                settle(rest[wide < _BOTTOM])
            grid[k] = now
            last2, last = last, now
    ids = np.ascontiguousarray(grid.T).ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("ids don't match their checksum")
    return ids, end + 8


def encode_segment(docs: list[int | None], lengths: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    known = np.array([d is not None for d in docs])
    head = struct.pack("<4sII", MAGIC, len(docs), -(-len(ids) // BLOCK_IDS))
    table = np.array([d or 0 for d in docs], "<i8").tobytes() + np.packbits(known).tobytes() + np.array(lengths, "<u8").tobytes()
    return b"".join([head, table, struct.pack("<I", zlib.crc32(table)), *(encode_block(ids[i : i + BLOCK_IDS], vocabulary) for i in range(0, len(ids), BLOCK_IDS))])


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of tokens, and all token ids."""
    magic, n, blocks = struct.unpack_from("<4sII", data)
    bits = -(-n // 8)
    table = data[12 : 12 + 16 * n + bits]
    if magic != MAGIC or zlib.crc32(table) != struct.unpack_from("<I", data, 12 + len(table))[0]:
        raise ValueError("no token-id segment")
    known = np.unpackbits(np.frombuffer(table, np.uint8, bits, 8 * n))[:n].astype(bool)
    docs = [d if k else None for d, k in zip(np.frombuffer(table, "<i8", n).tolist(), known.tolist(), strict=True)]
    lengths = np.frombuffer(table, "<u8", n, 8 * n + bits).astype(np.int64)
    view, at, ids = memoryview(data), 16 + len(table), []
    for _ in range(blocks):
        block, size = decode_block(view[at:])
        ids.append(block)
        at += size
    return docs, lengths, np.concatenate(ids) if ids else np.zeros(0, np.int64)


# --- the tokenizers library ----------------------------------------------------------------


#: Blanks and line feeds between, before and after words, figures, marks and letters of other scripts.
PROBE = " it's  one big\nworld, 12 345 (x)  \n\n \u00e9te\u0301 \u0301a \u4e2d \u6587 <a b> -- 's 'S \n. _ a_b\n"


def keeps_words_apart(library) -> bool:
    """Whether no piece of the tokenizer covers a space or line feed, and the strings between them have the ids of the whole (tried on PROBE)."""
    if library.pre_tokenizer is None or any(c in PROBE[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(PROBE) for c in " \n"):
        return False
    ids = lambda text: library.encode(text, add_special_tokens=False).ids
    return ids(PROBE) == [i for word in PROBE.replace("\n", " ").split(" ") for i in ids(word)]


#: The parts of a tokenizer whose pieces are known beforehand: letters, a figure, marks, each with an end of its own.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Kinds of bytes: blank (space, line feed), letter (ASCII, or of U+00C0 to U+00FF), figure, mark, and what only the library judges
#: (the apostrophe, as a piece may begin with it and go on with letters; control bytes; all other characters).
_BLANK, _LETTER, _FIGURE, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x0A]] = _BLANK
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _FIGURE
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x80:0xC0] = _KIND[0xC3] = _LETTER
_KIND[0x27] = _OTHER
_KINDS, _LOWERED = _KIND.tobytes(), kit.LOWER.tobytes()
#: The character that the ByteLevel part puts for each byte; the blank stays, as it parts pieces.
_CHARACTERS = np.arange(256, dtype="<u2")
_CHARACTERS[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = 256 + np.arange(0x21 + 0x22 + 1)
_CHARACTERS[0x20] = 0x20


def cuts_pieces(path: str) -> bool:
    """Whether the tokenizer of the file has exactly the parts for which strings can be cut into pieces before the library sees them."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, added = made["model"], made["added_tokens"]
    same = made["normalizer"] == _NORMAL and made["pre_tokenizer"] == _CUT and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>"
    plain = not (model["dropout"] or model["continuing_subword_prefix"] or model["unk_token"])
    return same and plain and made["post_processor"] is None and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in added)


def _pieces(data: np.ndarray, edges: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces of the texts begin and end (runs of blanks belong to none), whether each is plain, and the bytes with letters of plain ones lowered.

    whole: only blanks and edges of texts part pieces, and none is plain. Else a blank-separated string without _OTHER bytes and without <| is cut
    where its kind changes and at figures; these pieces are plain.
    """
    raw = data.tobytes()
    kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
    blank = kind == _BLANK
    cut = np.zeros(len(data) + 1, bool)
    np.not_equal(blank[1:], blank[:-1], out=cut[1:-1])
    cut[edges] = True
    low, plain = data, np.zeros(1, bool)
    if not whole:
        odd = kind == _OTHER
        after = data[1:]
        lead = data[:-1] == 0xC3
        odd[1:] |= (lead != ((after >= 0x80) & (after < 0xC0))) | (lead & ((after == 0x97) | (after == 0xB7)))  # so is a letter's second byte without its first
        odd[:-1] |= (data[:-1] == 0x3C) & (after == 0x7C)
        inner = (kind[1:] != kind[:-1]) | (kind[1:] == _FIGURE)
        low = np.frombuffer(bytearray(raw.translate(_LOWERED)), np.uint8)
        low[1 + np.flatnonzero(lead & (after >= 0x80) & (after < 0x9F))] += 0x20
        plain = np.ones(len(data), bool)
        if len(strange := np.flatnonzero(odd)):
            words = np.flatnonzero(cut)
            own = np.searchsorted(words, strange, "right") - 1
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            size = words[own + 1] - words[own]
            at = np.arange(size.sum()) + np.repeat(words[own] - np.cumsum(size) + size, size)  # bytes of the strings that have any
            plain[at], low[at] = False, data[at]
            inner &= plain[1:] & plain[:-1]
        cut[1:-1] |= inner
    at = np.flatnonzero(cut)
    first, end = at[:-1], at[1:]
    some = ~blank.take(first)
    first, end = first[some], end[some]
    return first, end, plain.take(first, mode="clip"), low


def _keys(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that hold the bytes of each string of at most SHORT bytes, and its length; for longer ones, what no short one has."""
    words = np.zeros(len(data) // 8 + 3, "<u8")
    words.view(np.uint8)[: len(data)] = data
    at, by = first >> 3, ((first & 7) << 3).view(np.uint64)
    one, two, three = words.take(at), words.take(at + 1), words.take(at + 2)
    back = np.uint64(63) - by
    size = np.minimum(length, SHORT + 1)
    key0 = (one >> by | two << np.uint64(1) << back) & _FIRST_BYTES.take(size)
    key1 = (two >> by | three << np.uint64(1) << back) & _MORE_BYTES.take(size) | (size << 56).view(np.uint64)
    return key0, key1


def _joined(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the strings, a blank after each, and where each begins (and the end)."""
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(begin[-1], 0x20, np.uint8)
    to = np.arange(begin[-1] - len(first)) + np.repeat(np.arange(len(first)), length)
    out[to] = data.take(to + np.repeat(first - begin[:-1], length))
    return out, begin


_FIRST_BYTES = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 2)], np.uint64)
_MORE_BYTES = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(SHORT + 1)] + [0], np.uint64)


def _listed(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [data[a:b].tobytes() for a, b in zip(first.tolist(), end.tolist(), strict=True)]


class LibraryEncoder:
    """Encodes with the tokenizers library, which sees each different string once.

    The strings are the tokenizer's pieces where its file has the parts that cuts_pieces knows (a blank-separated string with anything else
    in it than ASCII and letters up to U+00FF, or with an apostrophe, stays whole); blank-separated strings for other tokenizers whose
    pieces never reach over a space or line feed and which drop those; and whole texts for all others. Which it is, is told when this is built.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.by_words = keeps_words_apart(self.library)
        self.by_pieces = self.by_words and cuts_pieces(path)
        #: The same without the parts whose work on plain pieces is done before: they are lowered, and their bytes stand as _CHARACTERS.
        self.bare = Tokenizer.from_file(path)
        self.bare.no_padding()
        self.bare.no_truncation()
        self.bare.normalizer, self.bare.pre_tokenizer = None, WhitespaceSplit()
        #: A special token that stands between strings encoded together, and its id.
        self.mark = next(((t.content, i) for i, t in sorted(self.library.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip)), None)
        #: Ids that end a piece.
        self.ends = np.zeros(max(self.library.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.ends[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        #: The number of each known string of over SHORT bytes; those of the others stand in places that follow from their keys (0: none).
        self.long: dict[bytes, int] = {}
        self.places, self.count = np.zeros(1 << 13, np.int32), 1
        #: By number: the keys, where the string's ids begin in pool, and how many they are.
        self.key0, self.key1 = np.zeros((2, 1 << 12), np.uint64)
        self.start, self.size = np.zeros((2, 1 << 12), np.int64)
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0

    @property
    def known(self) -> dict[bytes, int]:
        """The number of each known string."""
        both = np.stack([self.key0, self.key1], 1).astype("<u8").view(np.uint8).reshape(-1, 16)
        return self.long | {both[n, : both[n, 15]].tobytes(): n for n in np.flatnonzero(self.key1[: self.count]).tolist()}

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """For each text its ids and the end id, as little-endian 32-bit integers."""
        out = []
        for _, _, ids, lengths in self.encode_column(pa.array(texts, pa.large_string()), end):
            until = np.cumsum(lengths).tolist()
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *until], until, strict=False)]
        return out

    def encode_column(self, column: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of the texts, each followed by the end id, how many each text has) of consecutive rows; null texts are empty."""
        if not self.by_words:
            for i, j in kit.byte_slices(column):
                each = [[*e.ids, end] for e in self.library.encode_batch_fast([t or "" for t in column.slice(i, j - i).to_pylist()], add_special_tokens=False)]
                yield i, j, np.array([x for ids in each for x in ids], np.uint32), np.array([len(ids) for ids in each])
            return
        for i, j, data, edges in kit.text_slices(column, CUT_BYTES):
            if not len(data):
                yield i, j, np.full(j - i, end, np.uint32), np.ones(j - i, np.int64)
                continue
            first, last, plain, low = _pieces(data, edges, not self.by_pieces)
            number = self.numbers(low, first, last, plain)
            size = self.size.take(number)
            until = np.concatenate([[0], np.cumsum(size)])
            ids = self.pool.take(np.arange(until[-1]) + np.repeat(self.start.take(number) - until[:-1], size))
            ended = until.take(np.searchsorted(first, edges))  # ids up to each edge of a text
            yield i, j, np.insert(ids, ended[1:], end), np.diff(ended) + 1

    def numbers(self, data: np.ndarray, first: np.ndarray, end: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The number of each string of data; new ones are learned."""
        if self.count > KEPT_WORDS:
            self.forget()
        length = end - first
        key0, key1 = _keys(data, first, length)
        number = self.find(key0, key1)
        long = np.flatnonzero(length > SHORT)
        strings = _listed(data, first[long], end[long])
        number[long] = [self.long.get(s, 0) for s in strings]
        if len(new := np.flatnonzero(number == 0)):
            new = new[np.lexsort((key1[new], key0[new]))]
            new = new[length[new] <= SHORT]
            one = new[np.concatenate([[True], (key0[new[1:]] != key0[new[:-1]]) | (key1[new[1:]] != key1[new[:-1]])])[: len(new)]]
            more = {s: k for s, k, n in zip(strings, long.tolist(), number[long].tolist(), strict=True) if not n}
            at = np.concatenate([one, np.array(list(more.values()), np.int64)])
            made = self.learn(data, first[at], end[at], plain[at])
            self.key0[made[: len(one)]], self.key1[made[: len(one)]] = key0[one], key1[one]
            self.put(made[: len(one)])
            self.long.update(zip(more, made[len(one) :].tolist(), strict=True))
            number[new] = self.find(key0[new], key1[new])
            number[long] = [self.long[s] for s in strings]
        return number

    def place(self, key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        mixed = (key0 ^ key0 >> np.uint64(32) ^ key1 * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.places).bit_length())).view(np.int64)

    def find(self, key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        """The number of each string by its keys, 0 for new ones."""
        at = self.place(key0, key1)
        number = self.places.take(at)
        go = np.flatnonzero((self.key0.take(number) != key0) | (self.key1.take(number) != key1))
        while len(go := go[number[go] > 0]):
            at[go] = next_ = at[go] + 1 & len(self.places) - 1
            number[go] = n = self.places.take(next_)
            go = go[(self.key0.take(n) != key0[go]) | (self.key1.take(n) != key1[go])]
        return number

    def put(self, number: np.ndarray) -> None:
        """Gives strings whose keys are set their places; at most every second one is taken."""
        if 2 * self.count > len(self.places):
            self.places = np.zeros(2 << (2 * self.count).bit_length(), np.int32)
            number = np.flatnonzero(self.key1[: self.count])
        at = self.place(self.key0[number], self.key1[number])
        while len(number):
            free = self.places.take(at) == 0
            self.places[at[free]] = number[free]
            lost = self.places.take(at) != number  # taken before, or by another one of these
            number, at = number[lost], at[lost] + 1 & len(self.places) - 1

    def learn(self, data: np.ndarray, first: np.ndarray, end: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The numbers of new strings, of which the library sees each once."""
        number = self.count + np.arange(len(first))
        self.count += len(first)
        while self.count > len(self.size):
            self.key0, self.key1, self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.key0, self.key1, self.start, self.size))
        learned = np.zeros(len(first), bool)
        pieces = np.flatnonzero(plain)
        text, begin = _joined(data, first[pieces], (end - first)[pieces])
        for i in range(0, len(pieces), 256):
            some = pieces[i : i + 256]
            learned[some] = self.learn_pieces(text[begin[i] : begin[i + len(some)]], number[some])
        rest = np.flatnonzero(~learned)
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            self.learn_words(_listed(data, first[some], end[some]), number[some])
        return number

    def keep(self, number: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """ids: those of all strings, one after the other."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.size[number] = sizes
        self.start[number] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def learn_pieces(self, text: np.ndarray, number: np.ndarray) -> bool:
        """Plain pieces with blanks behind them, in one text; whether each had ids with one at its end that ends a piece."""
        text = _CHARACTERS.take(text).tobytes().decode("utf-16-le")
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if fits := len(last) == len(number) and last[-1] == len(ids) - 1:
            self.keep(number, ids, np.diff(last, prepend=-1))
        return fits

    def learn_words(self, words: list[bytes], number: np.ndarray) -> None:
        texts = [w.decode() for w in words]
        apart = np.array([not self.mark or self.mark[0] in t for t in texts])
        if not apart.all():
            ids = np.array(self.library.encode_batch_fast([self.mark[0].join(t for t, alone in zip(texts, apart, strict=True) if not alone)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.mark[1])
            self.keep(number[~apart], np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1)
        if apart.any():
            each = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([t for t, alone in zip(texts, apart, strict=True) if alone], add_special_tokens=False)]
            self.keep(number[apart], np.concatenate(each), np.array([len(e) for e in each]))


@lru_cache(1)
def steady_heap() -> None:
    """Arrays come and go: what is freed inside a task stays with this worker (64 MiB at most at the heap's end), else every step touches new pages. ship gives it back after the task."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except AttributeError:  # another C library
        pass


@lru_cache(4)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_id_files(df: DataFrame, path: str, folder: str, end: int = 2, text: str = "text", ident: str = "doc_id") -> None:
    """Writes the token ids of all rows, in ascending order of ident, as segments in Parquet part files.

    Null ids come first; rows with one id follow each other by a hash of the text, repeated ones repeatedly. A null or empty text has the end
    id alone. An empty table gives files without segments. Other columns are not looked at. Columns of the
    files: part, seq, before (ids of the part before the segment), n_ids, segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        enc = encoder(path)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs, coded, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(coded)
            segment = encode_segment(docs, [len(c) for c in coded], ids, enc.vocabulary)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([len(ids)]), pa.array([segment], pa.binary())], ["part", "seq", "before", "n_ids", "segment"])

        for batch in batches:
            for i, j, ids, lengths in enc.encode_column(batch.column("text"), end):
                until = np.cumsum(lengths).tolist()
                for d, a, b in zip(batch.column("id").slice(i, j - i).to_pylist(), [0, *until], until, strict=False):
                    if docs and size + b - a > BLOCK_IDS:  # so a segment is one block, but for a long document
                        yield flush()
                        seq, before, docs, coded, size = seq + 1, before + size, [], [], 0
                    docs.append(d)
                    coded.append(ids[a:b])
                    size += b - a
        if docs:
            yield flush()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    # rows of one id (or none) are told apart by their texts' hashes, so that many of them can be cut
    ordered = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    map_arrow(ordered, run, "part int, seq int, before long, n_ids long, segment binary").write.parquet(folder)


def read_id_files(spark, folder: str, ident: str = "doc_id") -> DataFrame:
    """(ident, start, n_tokens, ids) of every document in the files; ids as little-endian 32-bit integers."""
    rows = spark.read.parquet(folder)
    sums = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each part file's partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    placed = kit.sized_join(rows, starts, "part", "inner").select((F.col("part_start") + F.col("before")).alias("start"), "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        for batch in batches:
            for start, segment in zip(batch.column("start").to_pylist(), batch.column("segment"), strict=True):
                docs, lengths, ids = decode_segment(segment.as_py())
                edges = np.concatenate([[0], np.cumsum(lengths)])
                raw = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(edges * 4), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(start + edges[:-1]), pa.array(lengths), raw.cast(pa.binary())], [ident, "start", "n_tokens", "ids"])

    return map_arrow(placed, run, f"`{ident}` long, start long, n_tokens long, ids binary")
