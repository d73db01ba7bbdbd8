"""AVI motion-JPEG columns: bytes stored as frames, frames read back, shots as timed clips.

Frames are written as 8-bit grey lossless JPEG (predictor 1), as nothing else gives bytes back; baseline frames
are read as well, their light alone. The writer's Huffman table gives a difference of
k bits a code of 9 - k bits, so every sample takes 9 bits and whole batches are coded by array
shifts; the reader takes such frames the same way and any other table code by code.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import kit
from tracelake.plans.ship import map_arrow

WIDTH, HEIGHT, FRAME_US = 192, 16, 40_000
BINS = 16
#: A shot ends where the histograms differ by more than the shot's mean difference plus SPREAD times
#: its deviation, and by FLOOR at least; before any frames were alike, by START.
SPREAD, FLOOR, START = 3.0, 0.05, 0.3
_SAMPLE_BITS = 9


def _difference_codes() -> np.ndarray:
    """The 9 bits of each difference from -255 to 255."""
    codes = []
    for d in range(-255, 256):
        k = abs(d).bit_length()
        prefix = ((1 << (8 - k)) - 1) << 1
        codes.append(prefix << k | (d if d >= 0 else d + (1 << k) - 1) & ((1 << k) - 1))
    return np.array(codes, np.uint16)


_CODE = _difference_codes()
_DIFFERENCE = np.zeros(512, np.int16)
_DIFFERENCE[_CODE] = np.arange(-255, 256)
_COUNTS = bytes([1] * 9 + [0] * 7)
_VALUES = bytes(range(8, -1, -1))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_header(height: int, width: int) -> bytes:
    return b"".join([
        b"\xff\xd8", _segment(0xC4, b"\x00" + _COUNTS + _VALUES),
        _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)), _segment(0xDA, bytes([1, 1, 0, 1, 0, 0])),
    ])


def encode_frames(rows: np.ndarray, heights: list[int]) -> list[bytes]:
    """JPEG frames of the given heights from consecutive rows of WIDTH samples."""
    first = np.cumsum([0, *heights])[:-1]
    x = rows.astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[first, 0] = x[first, 0] - 128
    v = _CODE[d + 255].reshape(-1, 8)
    out = np.empty((len(v), _SAMPLE_BITS), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = (v[:, j - 1] & ((1 << j) - 1)) << (8 - j) | v[:, j] >> (j + 1)
    out[:, 8] = v[:, 7] & 0xFF
    data, per_row = out.tobytes(), WIDTH * _SAMPLE_BITS // 8
    return [_frame_header(h, WIDTH) + data[f * per_row : (f + h) * per_row].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for f, h in zip(first.tolist(), heights, strict=True)]


#: Places of the 64 coefficients of a block, from low to high frequencies along the diagonals.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: Cosines by frequency and place, and the transform's scale.
_COSINES = np.cos(np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16) * np.where(np.arange(8) == 0, 0.125**0.5, 0.5)[:, None]


class _Bits:
    """Codes and integers of a scan, one after the other."""

    def __init__(self, scan: bytes):
        self.bits, self.at = "".join(f"{b:08b}" for b in scan), 0

    def code(self, codes: dict[str, int]) -> int:
        for length in range(1, 17):
            if (found := codes.get(self.bits[self.at : self.at + length])) is not None:
                self.at += length
                return found
        raise ValueError("damaged frame")

    def signed(self, size: int) -> int:
        """size bits, of which a leading 0 stands for a negative number."""
        value = int(self.bits[self.at : self.at + size] or "0", 2)
        self.at += size
        return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


class Frame:
    """A parsed intra frame: lossless grey, or baseline of which the first component (light) is taken."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG frame")
        at, self.tables, self.scales, self.restart, kind = 2, {}, {}, 0, None
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker in (0xC0, 0xC3):
                kind = marker
                bits, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if bits != 8 or marker == 0xC3 and parts != 1:
                    raise ValueError("only frames of 8 bits are read, lossless ones only in grey")
                #: Of each component: blocks across and down in a unit, and its scale table.
                self.parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)}
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.scales[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[129 if wide else 65 :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.order = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                self.predictor = body[1 + 2 * body[0]]
                break
            elif marker in range(0xC1, 0xD0):
                raise ValueError("only lossless and baseline frames are read")
        raw = data[at : data.rindex(b"\xff\xd9")]
        self.lossless, self.even = kind == 0xC3, False
        if self.lossless:
            if self.predictor != 1:
                raise ValueError("only predictor 1 is read")
            self.table = self.tables[self.order[0][1]]
            self.even = self.table == (_COUNTS, _VALUES) and self.width % 8 == 0
            self.scan = raw.replace(b"\xff\x00", b"\xff")
        else:
            self.scans = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", raw)]

    @staticmethod
    def codes(table: tuple[bytes, bytes]) -> dict[str, int]:
        out, code, k = {}, 0, 0
        for length, count in enumerate(table[0], 1):
            for _ in range(count):
                out[f"{code:0{length}b}"] = table[1][k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def differences(self) -> np.ndarray:
        """Differences of a lossless frame with any Huffman table, code by code."""
        codes, bits = self.codes(self.table), _Bits(self.scan)
        return np.array([bits.signed(bits.code(codes)) for _ in range(self.height * self.width)], np.int16).reshape(self.height, self.width)

    def light(self) -> np.ndarray:
        """Samples of the first component of a baseline frame."""
        first = next(iter(self.parts))
        many = len(self.order) > 1
        across, down = (max(p[k] for p in self.parts.values()) if many else 1 for k in (0, 1))
        units = [-(-self.width // (8 * across)), -(-self.height // (8 * down))]
        own = self.parts[first][:2] if many else (1, 1)
        blocks = np.zeros((units[1] * own[1], units[0] * own[0], 64), np.int64)
        tables = {t: self.codes(v) for t, v in self.tables.items()}
        per_scan = self.restart or units[0] * units[1]
        for unit in range(units[0] * units[1]):
            if unit % per_scan == 0:
                bits, last = _Bits(self.scans[unit // per_scan]), dict.fromkeys(self.parts, 0)
            for part, dc, ac in self.order:
                h, v = self.parts[part][:2] if many else (1, 1)
                for k in range(h * v):
                    block = np.zeros(64, np.int64)
                    last[part] += bits.signed(bits.code(tables[dc]))
                    block[0], at = last[part], 1
                    while at < 64:
                        run, size = divmod(bits.code(tables[16 + ac]), 16)
                        if not size and run < 15:
                            break
                        at += run
                        if size:
                            block[at] = bits.signed(size)
                        at += 1
                    if part == first:
                        blocks[unit // units[0] * v + k // h, unit % units[0] * h + k % h] = block
        placed = np.zeros_like(blocks)
        placed[..., _ZIGZAG] = blocks * self.scales[self.parts[first][2]]
        samples = np.einsum("ux,abuv,vy->abxy", _COSINES, placed.reshape(*blocks.shape[:2], 8, 8), _COSINES) + 128
        whole = np.clip(np.rint(samples), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * blocks.shape[0], 8 * blocks.shape[1])
        return whole[: self.height, : self.width]


def decode_frames(frames: list[Frame]) -> list[np.ndarray]:
    """Samples of each frame, as rows."""
    even = [f for f in frames if f.even]
    found: dict[int, np.ndarray] = {id(f): f.differences() for f in frames if f.lossless and not f.even}
    if even:
        b = np.frombuffer(b"".join(f.scan for f in even), np.uint8).reshape(-1, _SAMPLE_BITS).astype(np.uint16)
        v = np.empty((len(b), 8), np.uint16)
        for j in range(8):
            v[:, j] = (b[:, j] & ((1 << (8 - j)) - 1)) << (j + 1) | b[:, j + 1] >> (7 - j)
        d, at = _DIFFERENCE[v].ravel(), 0
        for f in even:
            found[id(f)] = d[at : at + f.height * f.width].reshape(f.height, f.width)
            at += f.height * f.width
    out = []
    for f in frames:
        if not f.lossless:
            out.append(f.light())
            continue
        d = found[id(f)].copy()
        d[:, 0] = np.cumsum(d[:, 0]) + 128
        out.append(np.cumsum(d, axis=1, dtype=np.int16).astype(np.uint8))
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], height: int) -> bytes:
    """A RIFF AVI of one motion-JPEG stream with its index."""
    most = max(map(len, frames))
    main = struct.pack("<14I", FRAME_US, most * 1_000_000 // FRAME_US, 0, 0x10, len(frames), 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    offsets = np.cumsum([4, *map(len, chunks)])[:-1].tolist()
    index = b"".join(struct.pack("<4sIII", b"00dc", 0x10, o, len(f)) for o, f in zip(offsets, frames, strict=True))
    body = b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index)
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Microseconds a frame, and the frames that the index names, or that stand in the file if it has none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    frame_us, movi, index, at = FRAME_US, None, [], 12
    end = min(8 + struct.unpack_from("<I", data, 4)[0], len(data))
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            frame_us = struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi, movi_end = at + 8, min(at + 8 + size, end)
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, k) for k in range(at + 8, at + 8 + size, 16)]
        at += 8 + size + size % 2
    if movi is None:
        raise ValueError("no frames")
    if not index:
        frames, at = [], movi + 4
        while at + 8 <= movi_end:
            name, size = struct.unpack_from("<4sI", data, at)
            if name == b"LIST":  # a record list: its chunks follow
                at += 12
                continue
            if name[2:] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
        return frame_us, frames
    # offsets count from the list's type, or from the file in some writers
    base = movi if data[movi + index[0][2] : movi + index[0][2] + 4] == index[0][0] else 0
    return frame_us, [data[base + o + 8 : base + o + 8 + n] for name, _, o, n in index if name[2:] in (b"dc", b"db")]


def shots(histograms: np.ndarray) -> list[int]:
    """First frame of each shot.

    A shot of one frame has no differences of its own: those of earlier shots stand in for them, then START.
    """
    first = [0]
    own, earlier = np.zeros(3), np.zeros(3)  # differences, their sum, sum of squares
    step = np.abs(np.diff(histograms / np.maximum(histograms.sum(1, keepdims=True), 1), axis=0)).sum(1) / 2
    for k, d in enumerate(step.tolist(), 1):
        n, total, squares = own if own[0] else earlier
        limit = max(FLOOR, total / n + SPREAD * max(squares / n - (total / n) ** 2, 0.0) ** 0.5) if n else START
        if d > limit:
            first.append(k)
            earlier += own
            own = np.zeros(3)
        else:
            own += (1, d, d * d)
    return first


def pack_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with media: the text's UTF-8 bytes, filled with blanks to a positive multiple of WIDTH, as an AVI.

    Null texts count as empty. A column named like media is replaced, all others and all rows are kept.
    An empty table stays empty.
    """
    df = kit.without(df, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in kit.text_slices(batch.column(text)):
                sizes = np.diff(offsets)
                rows = np.maximum(1, -(-sizes // WIDTH))
                start = np.concatenate([[0], np.cumsum(rows)])
                canvas = np.full(int(start[-1]) * WIDTH, 32, np.uint8)
                place = np.arange(len(data)) + np.repeat(start[:-1] * WIDTH - offsets[:-1], sizes)
                canvas[place] = data
                heights = [[HEIGHT] * (r // HEIGHT) + [r % HEIGHT] * (r % HEIGHT > 0) for r in rows.tolist()]
                frames, at, out = encode_frames(canvas.reshape(-1, WIDTH), [h for hs in heights for h in hs]), 0, []
                for hs in heights:
                    out.append(write_avi(frames[at : at + len(hs)], hs[0]))
                    at += len(hs)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(out, pa.binary())], [*batch.schema.names, media])

    return map_arrow(df, run, df.withColumn(media, F.lit(b"")).schema)


_READ = "frames long, clips array<struct<first:int,start_ms:double,end_ms:double>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df less media, with what its AVI holds: frames, timed clips, and digests of the samples and of the file.

    Frames are lossless (8-bit grey) or baseline JPEG, of which the light is taken; other coding (progressive) is an error, as is
    a damaged file. A null media gives nulls. Columns named like the new ones are replaced; others and all
    rows are kept, repeated ones repeatedly. An empty table stays empty.
    """
    new = [f.split(" ")[0] for f in ("frames", "clips", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")]
    df = kit.without(df, *new)
    kept = [c for c in df.columns if c != media]
    schema = df.select(*kept).schema
    from pyspark.sql import types as T

    fields = T.StructType([*schema.fields, *T._parse_datatype_string(_READ).fields])
    clip = pa.list_(pa.struct([("first", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64())]))
    types = [pa.int64(), clip, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def describe(files: list[bytes | None]) -> list[tuple]:
        opened = [read_avi(f) if f is not None else (0, []) for f in files]
        pictures = decode_frames([Frame(x) for _, frames in opened for x in frames])
        out, at = [], 0
        for file, (frame_us, frames) in zip(files, opened, strict=True):
            if file is None:
                out.append((None,) * 8)
                continue
            own = pictures[at : at + len(frames)]
            at += len(frames)
            payload = b"".join(p.tobytes() for p in own)
            histograms = np.array([np.bincount(p.ravel() >> 4, minlength=BINS) for p in own])
            first = shots(histograms)
            ms = frame_us / 1000
            clips = [{"first": a, "start_ms": a * ms, "end_ms": b * ms} for a, b in zip(first, [*first[1:], len(own)], strict=True)]
            feature = f"frames={len(own)};cuts={','.join(map(str, first[1:]))};grey={','.join(map(str, histograms.sum(0).tolist()))}"
            out.append((len(own), clips, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([0, *(len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(media))])
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + kit.SLICE, "right")) - 1)
                part = batch.slice(i, j - i)
                rows = describe(part.column(media).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True))], [*kept, *new])
                i = j

    return map_arrow(df.select(*kept, media), run, fields)


def clip_rows(read: DataFrame, ident: str = "doc_id") -> DataFrame:
    """One row for each clip of read_media's result; rows without media have none, repeated rows repeat, an empty table stays empty."""
    return read.select(ident, F.posexplode("clips").alias("clip", "c")).select(ident, "clip", "c.first", "c.start_ms", "c.end_ms")
