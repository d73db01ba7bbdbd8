import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tracelake.llm import bpe, idfile, queries

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a  b\n\n c", "<|endoftext|>x<|endoftext|>", "don't I'll 123 45.6 $%^", "\x1c\x1d a\x85b　c​d", "naïve café ÄÖÜ 日本語 한국어", "é à", "😀😀 👨‍👩‍👧", "\t\tx\r\ny\x0b\x0cz", "ab" * 3000,
    "ﬁ ẞ ΑΣ ς İI", "½ ²", " 's 'S x's", "<|startoftext|> <|ENDOFTEXT|>", "x" * 64 + " " + "y" * 65 + " " + "z" * 66,
]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_bpe_is_the_library(spark):
    own, lib = bpe.ByteBpe(BYTES), Tokenizer.from_file(BYTES)
    for text, raw in zip(ODD, own.encode(ODD), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids(raw) == want
        assert own.decode(raw) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_bpe_on_any_text(texts):
    own, lib = bpe.tokenizer(BYTES), Tokenizer.from_file(BYTES)
    assert [ids(r) for r in own.encode(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_one_tree_and_many_agree():
    own = bpe.tokenizer(BYTES)
    pieces = [p for p in (b"hello", b"abababab", b"the", bytes(range(33, 90)), b"  ") if len(p) > 1]
    assert [own.merge(p) for p in pieces] == [x.tolist() for p in pieces for x in own.merge_many([p])]


def test_op3_over_a_table(spark, docs, sf_dir):
    lib = Tokenizer.from_file(BYTES)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_bpe(spark, sf_dir).collect():
        e = lib.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()
    edges = bpe.bpe_encode(docs(*EDGES), BYTES).collect()
    assert len(edges) == len(EDGES) and all(bytes(r.ids) == b"" for r in edges if not r.text)
    assert bpe.bpe_encode(docs(*EDGES).limit(0), BYTES).count() == 0


def test_words_one_by_one_are_the_whole_text():
    own, lib = idfile.LibraryEncoder(WORDS), Tokenizer.from_file(WORDS)
    assert [ids(r) for r in own.encode(ODD, 2)] == [lib.encode(t, add_special_tokens=False).ids + [2] for t in ODD]


def test_library_encoder_of_pieces_with_blanks():
    """A tokenizer whose pieces hold blanks gets whole texts; the dealt one gets words."""
    own, lib = idfile.LibraryEncoder(BYTES), Tokenizer.from_file(BYTES)
    texts = ["hello big world", "", " a  b\n\nc ", "x" * 5000, "\u00e9t\u00e9 \u4e2d\u6587\n", idfile.PROBE]
    assert not own.by_words and idfile.LibraryEncoder(WORDS).by_words
    assert own.encode(texts, 2) == [np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]


def test_library_sees_each_piece_once():
    """Strings that share letters, figures and marks are learned by these; apostrophes, special tokens and other characters stay in whole strings."""
    own, lib = idfile.LibraryEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [f"{a}{b}{c}" for a in ("one", "Two", "d\u00e9j\u00e0", "<|", "it's") for b in ("", "!", "%%%", "7", "42", "_") for c in ("", "three", "\u00c4u\u00df", "\u00d7", "\u4e2d")]
    assert [ids(r) for r in own.encode([*texts, " ".join(texts), "\n".join(texts)], 2)] == [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in [*texts, " ".join(texts), "\n".join(texts)]]
    own.forget()
    plain = [f"{a}{b}" for a in ("alpha", "beta", "gamma") for b in ("!", "?", "%%%", "delta9", "9")]
    own.encode(plain, 2)
    assert own.known.keys() == {b"alpha", b"beta", b"gamma", b"!", b"?", b"%%%", b"9", b"alphadelta", b"betadelta", b"gammadelta"}
    assert not idfile.cuts_pieces(BYTES)


def test_pieces_of_either_case_are_learned_once():
    """Letters up to U+00FF are lowered before they are looked up; the library sees a plain piece without its normalizer and pattern."""
    own, lib = idfile.LibraryEncoder(WORDS), Tokenizer.from_file(WORDS)
    latin = "".join(map(chr, range(0xC0, 0x100)))
    texts = ["\u00c9T\u00c9 \u00e9t\u00e9 \u00c9t\u00e9", "stra\u00dfe STRA\u00dfE", " ".join(latin), latin.replace("\u00d7", "").replace("\u00f7", ""), "\u00c0" * 7, "\u00c0" * 8]
    assert [ids(r) for r in own.encode(texts, 2)] == [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    own.forget()
    own.encode(texts[:2], 2)
    assert own.known.keys() == {"\u00e9t\u00e9".encode(), "stra\u00dfe".encode()}


def test_known_strings_of_all_lengths():
    """Around the length up to which strings are kept as numbers, with bytes 0 at the end, over growing tables and after a new start."""
    own, lib = idfile.LibraryEncoder(WORDS), Tokenizer.from_file(WORDS)
    draw = np.random.default_rng(7)
    words = ["".join(draw.choice(list("abc\u00e9"), n)) for n in draw.integers(1, 20, 12_000)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)] + ["ab", "ab\0", "ab\0\0", "z" * 15, "z" * 16, "z" * 15 + "\0", "it's" + "z" * 20, "\n"]
    want = [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for _ in range(2):
        assert [ids(r) for r in own.encode(texts, 2)] == want  # the second time all are known
    assert len(set(own.known.values())) == len(own.known) == own.count - 1
    own.by_pieces = False  # blank-separated strings for other tokenizers
    own.forget()
    assert [ids(r) for r in own.encode(texts, 2)] == want


def test_ones_are_carried_to_the_words_before():
    full = 0xFFFFFFFF
    words = np.array([5, full, full, 7, full, 8], np.uint64)
    idfile._carry(words, np.array([2, 3, 3, 5]))
    assert words.tolist() == [6, 0, 0, 9, full, 9]
    # a block whose lanes pass 64 bits again and again
    x = np.random.default_rng(2).integers(0, 49_408, 60_000)
    assert (idfile.decode_block(memoryview(idfile.encode_block(x, 49_408)))[0] == x).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=700), st.integers(1, 4))
def test_blocks_round_trip(values, repeat):
    x = np.array(values * repeat, np.int64)
    if len(x):
        data = idfile.encode_block(x, 300)
        back, size = idfile.decode_block(memoryview(data + b"tail"))
        assert size == len(data) and (back == x).all()
        with pytest.raises(ValueError):
            idfile.decode_block(memoryview(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:]))


def test_prediction_compresses():
    x = np.tile(np.random.default_rng(1).integers(0, 40_000, 300), 300)
    assert len(idfile.encode_block(x, 49_408)) < 0.5 * len(x)


def test_segments_keep_documents():
    docs, lengths = [None, 5, 5, -3], [2, 0, 3, 1]
    x = np.arange(6)
    d, n, back = idfile.decode_segment(idfile.encode_segment(docs, lengths, x, 10))
    assert (d, n.tolist(), back.tolist()) == (docs, lengths, x.tolist())


def test_op5_files(spark, sf_dir):
    lib = Tokenizer.from_file(WORDS)
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op5_id_files(spark, sf_dir).collect()}
    start = 0
    for i, text in rows:
        e = np.array(lib.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(e) // 4, zlib.crc32(e))
        start += len(e) // 4


def test_mixing_beats_the_counts_of_single_ids(spark):
    own = idfile.encoder(WORDS)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    x = np.frombuffer(b"".join(own.encode(texts, 2)), "<u4").astype(np.int64)
    share = np.bincount(x)[np.unique(x)] / len(x)
    plain = -(share * np.log2(share)).sum() * len(x) / 8
    assert len(idfile.encode_block(x, own.vocabulary)) < 0.95 * plain


def test_probability_is_the_sum_over_the_orders():
    """Widths of a row against the weighted counts, computed one by one; rows and the rest fill the whole line."""
    seen = np.random.default_rng(3).zipf(1.5, (60, 40)).astype(np.int64) % 50
    m, v = idfile._Model(seen, 50), 50
    plain = [1 + int((seen == k).sum()) * ((1 << 20) - 1) // seen.size for k in range(v)]
    pairs = list(zip(seen[:-1].ravel().tolist(), seen[1:].ravel().tolist(), strict=True))
    triples = list(zip(seen[:-2].ravel().tolist(), seen[1:-1].ravel().tolist(), seen[2:].ravel().tolist(), strict=True))

    def two(b, x):
        after = [y for a, y in pairs if a == b]
        trust = len(after) / (len(after) + len(set(after)))
        return trust * after.count(x) / len(after) + (1 - trust) * plain[x] / sum(plain)

    for a, b in ((1, 1), (1, 2), (3, 1)):
        after = [y for p, q, y in triples if (p, q) == (a, b)]
        assert len(after) >= idfile.SEEN
        trust = len(after) / (len(after) + 2 * len(set(after)))
        row = m.rows_of(np.full(v, a), np.full(v, b))
        start, width, start0, width0, total0 = m.intervals(row, np.arange(v))
        listed = np.flatnonzero(width0 == 0)
        want = [trust * after.count(x) / len(after) + (1 - trust) * two(b, x) for x in listed]
        assert width[listed] / (1 << 20) == pytest.approx(want, abs=1e-4) and len(listed) == idfile.TOP
        line = sorted((int(s), int(w)) for s, w in zip(start[listed], width[listed], strict=True))
        assert [s for s, _ in line] == [sum(w for _, w in line[:k]) for k in range(len(line))]
        rest = np.flatnonzero(width0)
        line = sorted((int(s), int(w)) for s, w in zip(start0[rest], width0[rest], strict=True))
        assert [s for s, _ in line] == [sum(w for _, w in line[:k]) for k in range(len(line))] and sum(w for _, w in line) == total0[0]


def test_id_files_of_edges(spark, docs, tmp_path):
    lib = Tokenizer.from_file(WORDS)
    df = docs(*EDGES).withColumn("start", F.lit("x")).withColumn("seq", F.lit(1)).withColumn("part", F.lit("y"))
    idfile.write_id_files(df, WORDS, str(tmp_path / "a"))
    got = sorted(idfile.read_id_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    want = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in EDGES)
    assert sorted((str(r.doc_id), ids(r.ids)) for r in got) == want
    idfile.write_id_files(df.limit(0), WORDS, str(tmp_path / "b"))
    assert idfile.read_id_files(spark, str(tmp_path / "b")).count() == 0


def test_bpe_takes_clashing_names(docs):
    df = docs(*EDGES).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1)).withColumn("n_tokens", F.lit(2))
    rows = bpe.bpe_round_trip(df, BYTES).collect()
    assert len(rows) == len(EDGES) and all(r.decoded == (r.text or "") and r.n_tokens == 2 for r in rows)
    assert all(r.decoded == (r.text or "") for r in bpe.bpe_decode(bpe.bpe_encode(df, BYTES), BYTES).collect())
    assert len(queries.bpe_digests(df).collect()) == len(EDGES)
