import base64
import hashlib
import struct
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tracelake.llm import media, queries, warc


def test_text_comes_back(docs):
    packed = media.pack_media(docs(*EDGES))
    for r in media.read_media(packed.select("doc_id", "text", "media", "extra")).collect():
        raw = (r.text or "").encode()
        want = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.extra == "kept" and r.clips[0].first == 0 and r.clips[-1].end_ms == 40.0 * r.frames
    assert media.read_media(media.pack_media(docs(*EDGES).limit(0))).count() == 0


def test_any_huffman_table_is_read():
    rows = np.random.default_rng(1).integers(0, 256, (5, 192)).astype(np.uint8)
    frame = media.Frame(media.encode_frames(rows, [5])[0])
    fast = media.decode_frames([frame])[0]
    frame.even = False
    assert (media.decode_frames([frame])[0] == fast).all() and (fast == rows).all()


def baseline(planes, scales, width, height, across, restart=0):
    """A baseline frame of quantised blocks (rows of 64 in zigzag order) with codes of 9 bits, the first plane of across x across blocks a unit."""
    table = lambda kind: bytes([kind]) + bytes([0] * 8 + [255] + [0] * 7) + bytes(range(255))
    bits, out, last = "", b"", [0] * len(planes)

    def signed(n):
        size = abs(n).bit_length()
        return size, f"{n if n >= 0 else n + (1 << size) - 1:0{size}b}" if size else ""

    def flush():
        padded = bits + "1" * (-len(bits) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8)).replace(b"\xff", b"\xff\x00")

    units = len(planes[-1]) if len(planes) > 1 else len(planes[0])
    for unit in range(units):
        if restart and unit and unit % restart == 0:
            out += flush() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            bits, last = "", [0] * len(planes)
        for p, blocks in enumerate(planes):
            n = across * across if len(planes) > 1 and p == 0 else 1
            for block in blocks[unit * n : unit * n + n]:
                size, text = signed(int(block[0]) - last[p])
                last[p] = int(block[0])
                bits += f"{size:09b}{text}"
                run = 0
                for value in block[1:].tolist():
                    if not value:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + f"{0xF0:09b}", run - 16
                    size, text = signed(value)
                    bits, run = bits + f"{run * 16 + size:09b}{text}", 0
                bits += f"{0:09b}" if run else ""
    out += flush()
    parts = b"".join(bytes([p + 1, (across * 16 + across) if len(planes) > 1 and p == 0 else 0x11, 0]) for p in range(len(planes)))
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes(scales.tolist())) + media._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + parts) + media._segment(0xC4, table(0) + table(0x10))
    head += media._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + media._segment(0xDA, bytes([len(planes), *(x for p in range(len(planes)) for x in (p + 1, 0)), 0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize(("across", "restart", "colours"), [(1, 0, 1), (1, 2, 1), (2, 0, 3), (2, 3, 3)])
def test_baseline_frames_are_read(across, restart, colours):
    rng = np.random.default_rng(across + restart)
    width, height = 50, 37
    units = -(-width // (8 * across)), -(-height // (8 * across))
    wide, tall = units[0] * across, units[1] * across
    coded = np.where(rng.random((tall, wide, 64)) < 0.1, rng.integers(-20, 20, (tall, wide, 64)), 0)
    coded[..., 0] = rng.integers(-60, 60, (tall, wide))
    scales = rng.integers(1, 9, 64)
    # blocks of a unit follow each other, row by row
    order = [(y * across + dy, x * across + dx) for y in range(units[1]) for x in range(units[0]) for dy in range(across) for dx in range(across)]
    planes = [np.array([coded[p] for p in order])] + [np.where(rng.random((units[0] * units[1], 64)) < 0.05, 3, 0) for _ in range(colours - 1)]
    got = media.decode_frames([media.Frame(baseline(planes, scales, width, height, across, restart))])[0]
    zigzag = [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0)]
    assert [divmod(int(k), 8) for k in media._ZIGZAG[:10]] == zigzag
    want = np.zeros((8 * tall, 8 * wide))
    u = np.arange(8)
    basis = np.where(u == 0, np.sqrt(0.5), 1.0)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    for y in range(tall):
        for x in range(wide):
            f = np.zeros(64)
            f[media._ZIGZAG] = coded[y, x] * scales
            want[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis.T @ f.reshape(8, 8) @ basis / 4 + 128
    assert got.shape == (height, width) and np.abs(got.astype(int) - np.clip(np.rint(want[:height, :width]), 0, 255)).max() <= 1


def test_files_have_index_and_time():
    rows = np.zeros((40, 192), np.uint8)
    frames = media.encode_frames(rows, [16, 16, 8])
    us, back = media.read_avi(media.write_avi(frames, 16))
    assert us == 40_000 and back == frames
    whole = media.write_avi(frames, 16)
    assert media.read_avi(whole[: whole.index(b"idx1")]) == (40_000, frames)


def test_op6_over_a_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and r.feature


def test_clashing_media_columns(docs):
    df = docs(*EDGES).withColumn("media", F.lit("x")).withColumn("frames", F.lit("y")).withColumn("feature", F.lit(1))
    rows = media.read_media(media.pack_media(df)).collect()
    assert len(rows) == len(EDGES) and all(r.frames >= 1 and r.feature.startswith("frames=") for r in rows)


def test_shots_follow_the_histograms():
    a, b = np.eye(16)[0] * 100, np.eye(16)[9] * 100
    assert media.shots(np.array([a, a, a, b, b, b, a, a])) == [0, 3, 6]
    assert media.shots(np.array([a])) == [0]
    # cuts after the first frame, after shots of one frame, and in succession
    c = np.eye(16)[4] * 100
    assert media.shots(np.array([a, b])) == [0, 1] and media.shots(np.array([a, b, c, c, a])) == [0, 1, 2, 4]
    assert media.shots(np.array([a, a + b / 50, a, a + b / 50])) == [0]


def test_clips_are_rows(docs):
    read = media.read_media(media.pack_media(docs((1, "x" * 9000 + "ÿ" * 9000))).select("doc_id", "media"))
    rows = media.clip_rows(read).collect()
    assert rows[0].start_ms == 0 and all(a.end_ms == b.start_ms for a, b in zip(rows, rows[1:], strict=False))


PAGE = "<html lang=fr><head><title>A &amp; B</title><style>p{}</style></head><body><p>One  <b>two</b></p><!-- no --><script>x='</p>'</script><p>3 &lt; 4</p><a href='/z'>z</a></body></html>"


def test_derivatives_are_linked():
    source = warc.response(7, "http://x/", PAGE, "2020-01-01T00:00:00Z")
    head, _ = warc.parse(source)
    (k1, meta), (k2, text) = warc.derive(source)
    m, facts = warc.parse(meta)
    c, body = warc.parse(text)
    assert (k1, k2) == ("metadata", "conversion")
    assert m["warc-refers-to"] == c["warc-refers-to"] == head["warc-record-id"]
    assert c["warc-source-payload-digest"] == head["warc-payload-digest"] and c["warc-payload-digest"] == warc.digest(body)
    assert body.decode().split("\n") == ["One two", "3 < 4", "z"]
    assert b"title: A & B" in facts and b"outlink: /z" in facts and b"sourceDigestChecked: true" in facts and b"language: fr" in facts


class Reader(HTMLParser):
    """Text and links by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts, self.links, self.titles, self.lang = 0, [], [], [], None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"])
        if tag == "html" and self.lang is None:
            self.lang = attrs.get("lang") or ""
        if tag in ("script", "style", "noscript", "template", "head"):
            self.hidden += 1
        if tag == "title":
            self.in_title = True
        if tag in warc.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "head"):
            self.hidden -= 1
        if tag == "title":
            self.in_title = False
        if tag in warc.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.titles.append(data)
        elif not self.hidden:
            self.parts.append(data.replace("\n", " "))


def test_op10_against_the_standard_parser(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        page = pages[r.page_id]
        twin = Reader()
        twin.feed(page.html)
        twin.close()
        head, block = warc.parse(bytes(r.record))
        assert (r.refers_to, r.target_uri, r.content_length) == (head["warc-refers-to"], page.url, len(block))
        assert r.refers_to == warc.parse(warc.response(page.page_id, page.url, page.html, "1970-01-01T00:00:00Z"))[0]["warc-record-id"]
        assert r.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(page.html.encode()).digest()).decode()
        if r.record_type == "conversion":
            lines = [" ".join(x.split()) for x in "".join(twin.parts).split("\n")]
            assert block.decode() == "\n".join(x for x in lines if x)
        else:
            facts = [x.split(": ", 1) for x in block.decode().split("\r\n") if x]
            assert [v for k, v in facts if k == "outlink"] == twin.links
            assert dict(facts).get("title") == " ".join("".join(twin.titles).split()) and dict(facts)["language"] == (twin.lang or "")


@pytest.mark.parametrize("part", ["<a ", "<html ", "<title>", "<p ", "<!--", "<script ", "</script", "&#1", "<a href='", " \n", "<![", "<"])
def test_hostile_pages_take_linear_time(part):
    for tail in ("", ">", "-->"):
        began = time.process_time()
        warc.derive(warc.response(1, "u", part * (2_000_000 // len(part)) + tail, "1970-01-01T00:00:00Z"))
        assert time.process_time() - began < 30
    assert "\ufffd" in warc.read_page(f"<p>&#{'9' * 9000};").text


def test_record_ids_tell_pages_apart(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "x"), (1, "u", "<p>b", "x"), (1, "u", "<p>a", "x")], "page_id long, url string, html string, record string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 4


def test_pages_of_all_kinds(spark, sf_dir):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "a\r\nb: c", "<p>x"), (2, "a\r\nb: c", "<p>x")], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 8 and all("\r" not in r.target_uri for r in rows)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    assert queries.op10_warc(spark, sf_dir).count() == 2 * spark.read.parquet(f"{sf_dir}/pages.parquet").count()
