"""AVI motion-JPEG media columns: bytes to AVI, and AVI to timed clips.

Reading follows the RIFF index to the frames, decodes each as baseline JPEG (one or three components; the luma counts;
frames without Huffman tables have the standard's)
and cuts the film into shots where the histogram difference of neighbouring frames stands out from those around it.
Writing keeps bytes without loss in the format's unit, the quantised coefficient: with quantisers of 1, byte b is the
coefficient of size 8 whose extra bits are b; 64 bytes make a block, each block is a restart interval of its own.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIDE, BLOCK, FPS, AT_ONCE = 64, 64, 25, 256
BINS, NEAR, SPREADS, LEAST = 32, 8, 3.0, 0.1


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Raster place of each coefficient in zigzag order."""
    cells = sorted(((x + y, x if (x + y) % 2 == 0 else y, y * 8 + x) for y in range(8) for x in range(8)))
    return np.array([c[2] for c in cells])


@lru_cache(maxsize=1)
def inverse_dct() -> np.ndarray:
    """64 zigzag coefficients to 64 pixels, as a matrix."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.einsum("vy,ux->vuyx", basis, basis).reshape(64, 64)[zigzag()].astype(np.float32)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


@lru_cache(maxsize=16)
def _jpeg_head(width: int, height: int) -> bytes:
    one_code = lambda kind: _segment(0xC4, bytes([kind, 1, *[0] * 15, 8]))  # noqa: E731  symbol 8 by the code 0
    frame = _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + _segment(0xDB, bytes([0] + [1] * 64)) + frame + one_code(0) + one_code(0x10) + _segment(0xDD, b"\0\1") + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _coded(units: np.ndarray, frame_blocks: int) -> list[bytes]:
    """The entropy-coded data of frames of frame_blocks blocks from bytes, 64 a block."""
    bits = np.unpackbits(units.reshape(-1, 1), axis=1)
    nine = np.concatenate([np.zeros((len(bits), 1), np.uint8), bits], axis=1)
    blocks = np.packbits(nine.reshape(-1, BLOCK * 9), axis=1)
    n = len(blocks)
    k = np.arange(n) % frame_blocks
    data = np.concatenate([blocks, np.full((n, 1), 0xFF, np.uint8), (0xD0 + k % 8).astype(np.uint8)[:, None]], axis=1)
    copies = 1 + (data == 0xFF)
    copies[:, -2:] = 1
    copies[k == frame_blocks - 1, -2:] = 0
    ends = np.cumsum(copies.reshape(-1))
    out = np.repeat(data.reshape(-1), copies.reshape(-1))
    out[ends[copies.reshape(-1) == 2] - 1] = 0  # the byte stuffed after 0xFF
    marks = [0, *ends.reshape(n, -1)[frame_blocks - 1 :: frame_blocks, -1].tolist()]
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(marks, marks[1:], strict=False)]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """payload (a multiple of 64 bytes) as an AVI of gray motion-JPEG frames 64 pixels wide; a last frame is filled with 0."""
    rows = SIDE // 8
    height = min(SIDE, 8 * max(1, -(-len(payload) // (BLOCK * rows))))
    frame_blocks = rows * height // 8
    size = BLOCK * frame_blocks
    head, frames = _jpeg_head(SIDE, height), []
    for at in range(0, len(payload), size * AT_ONCE):
        part = payload[at : at + size * AT_ONCE]
        part += b"\0" * (-len(part) % size)
        frames += [head + x + b"\xff\xd9" for x in _coded(np.frombuffer(part, np.uint8), frame_blocks)]
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, SIDE, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, height, 1, 8, b"MJPG", SIDE * height, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"bytes=%d\0" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def read_riff(media: bytes) -> dict:
    """fps, payload bytes (None if not noted) and the places (from, to) of the video frames of an AVI.

    The frames come from the index; without one, or where it points nowhere, from the chunks themselves.
    """
    data = memoryview(media)
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    out, index, movi, walked = {"fps": float(FPS), "payload": None}, [], 0, []
    lists = [(12, len(data))]
    while lists:
        for name, a, b in _chunks(data, *lists.pop()):
            if name in (b"LIST", b"RIFF"):  # long files go on in further RIFF chunks, which the index doesn't cover
                movi = a if data[a : a + 4] == b"movi" and not movi else movi
                lists.append((a + 4, b))
            elif name == b"strh" and media[a : a + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, a + 20)
                out["fps"] = rate / scale if scale and rate else out["fps"]
            elif name == b"ICMT" and (m := re.match(rb"bytes=(\d+)", bytes(data[a:b]))):
                out["payload"] = int(m[1])
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, i) for i in range(a, b - 15, 16)]
            elif name[2:] in (b"dc", b"db"):
                walked.append((a, b))
    listed = []
    for name, _, at, size in index:
        if name[2:] in (b"dc", b"db"):
            at += 0 if media[at : at + 4] == name else movi  # from the start of the file, or of the list
            if media[at : at + 4] == name:
                listed.append((at + 8, at + 8 + size))
    out["frames"] = listed if len(listed) >= len(walked) else sorted(walked)
    return out


# The typical Huffman tables of the JPEG standard (ITU-T T.81, annex K.3), which motion-JPEG may leave out. By
# table: the numbers of codes by length, and the symbols of the codes shorter than 16 bits; the rest follow in rising order.
TYPICAL = {
    0x00: ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: ("0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125", "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: ("0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119", "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


@lru_cache(maxsize=1)
def typical_codes() -> dict[int, dict[tuple[int, int], int]]:
    out = {}
    for name, (counts, short) in TYPICAL.items():
        symbols = bytes.fromhex(short)
        every = sorted([0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]) if name & 0x10 else []
        out[name] = Jpeg.table(bytes(map(int, counts.split())), symbols + bytes(x for x in every if x not in symbols))
    return out


class Jpeg:
    """The head of a baseline JPEG: everything before the coded data, which starts at `start`."""

    def __init__(self, data: bytes):
        self.quant, self.codes, self.restart, at = {}, dict(typical_codes()), 0, 2
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide, body16 = body[0] >> 4, body[1:]
                    self.quant[body[0] & 15] = np.frombuffer(body16[: 64 << wide], ">u2" if wide else np.uint8).astype(np.float32)
                    body = body16[64 << wide :]
            elif marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    self.codes[body[0]] = self.table(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                self.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("only baseline JPEG frames are read")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                self.scan = {body[i]: (body[i + 1] >> 4, 0x10 | body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)}
                self.start = at
                break
        lone = {(1, 0): 8}
        self.even = len(self.parts) == 1 and self.restart == 1 and all(self.codes.get(k) == lone for k in self.scan[self.parts[0][0]])

    @staticmethod
    def table(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
        out, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                out[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def luma(self, coded: bytes) -> np.ndarray:
        """Quantised coefficients in zigzag order of the first component's blocks, by rows of blocks."""
        hs, vs = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        across, down = -(-self.width // (8 * hs)), -(-self.height // (8 * vs))
        _, h0, v0, _ = self.parts[0]
        out = np.zeros((down * v0, across * h0, 64), np.int32)
        for k, piece in enumerate(re.split(rb"\xff[\xd0-\xd7]", coded)):
            bits = "".join(f"{b:08b}" for b in piece.replace(b"\xff\x00", b"\xff"))
            at, before = 0, [0] * len(self.parts)
            first = k * self.restart
            for mcu in range(first, min(across * down, first + self.restart) if self.restart else across * down):
                for c, (name, h, v, _) in enumerate(self.parts):
                    dc, ac = (self.codes[x] for x in self.scan[name])
                    for y in range(v):
                        for x in range(h):
                            block, at = self.block(bits, at, dc, ac)
                            before[c] = block[0] = block[0] + before[c]
                            if c == 0:
                                out[mcu // across * v0 + y, mcu % across * h0 + x] = block
        return out[: -(-self.height // 8), : -(-self.width // 8)].reshape(-1, 64)

    @staticmethod
    def block(bits: str, at: int, dc: dict, ac: dict) -> tuple[list[int], int]:
        out, k = [0] * 64, 0
        while k < 64:
            codes, length, code = (ac if k else dc), 0, 0
            while (length, code) not in codes:
                if length == 16 or at >= len(bits):
                    raise ValueError("damaged JPEG data")
                code, length, at = code << 1 | (bits[at] == "1"), length + 1, at + 1
            symbol = codes[length, code]
            size = symbol & 15
            if k:
                if symbol == 0:
                    break
                k += symbol >> 4
            if size:
                extra, at = int(bits[at : at + size] or "0", 2), at + size
                if k < 64:
                    out[k] = extra if extra >> (size - 1) else extra - (1 << size) + 1
            k += 1
        return out, at


def decode_frames(media: bytes, places: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units, histograms) of up to AT_ONCE frames at a time, in order: units are the size-8 extra bits of the luma coefficients."""
    head, jpeg = b"\0", None
    lot: list[bytes] = []  # frames of one head, each coefficient of nine bits

    def alike():
        bits = np.unpackbits(np.frombuffer(b"".join(lot).replace(b"\xff\x00", b"\xff"), np.uint8)).reshape(-1, 9)
        units = np.packbits(bits[:, 1:], axis=1).reshape(len(lot), -1, 64)
        c = units.astype(np.float32)
        c -= 255 * (units < 128)
        lot.clear()
        return units, seen(c)

    def seen(c: np.ndarray) -> np.ndarray:
        pixels = (c * jpeg.quant[jpeg.parts[0][3]]).reshape(-1, 64) @ inverse_dct() + np.float32(128)
        bins = (np.clip(np.rint(pixels), 0, 255).astype(np.int64) * BINS // 256).reshape(len(c), -1)
        return np.bincount((bins + BINS * np.arange(len(c))[:, None]).reshape(-1), minlength=BINS * len(c)).reshape(-1, BINS)

    for a, b in places:
        frame = media[a:b]
        if not frame.startswith(head):
            if lot:
                yield alike()
            jpeg = Jpeg(frame)
            head = frame[: jpeg.start]
        end = frame.rfind(b"\xff\xd9")
        data = frame[jpeg.start : end if end > 0 else len(frame)]
        if jpeg.even:
            lot.append(b"".join(re.split(rb"\xff[\xd0-\xd7]", data)))
            if len(lot) == AT_ONCE:
                yield alike()
        else:
            c = jpeg.luma(data)
            yield np.where(c > 0, c, c + 255).astype(np.uint8)[None], seen(c.astype(np.float32)[None])
    if lot:
        yield alike()


def shots(histograms: np.ndarray) -> list[int]:
    """First frames of the shots. A cut's difference (half the L1 distance) is LEAST at least and exceeds the mean of the
    NEAR differences on either side by SPREADS times their standard deviation."""
    share = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    d = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    n = len(d)
    sums, squares = (np.concatenate([[0], np.cumsum(x)]) for x in (d, d * d))
    lo, hi = np.maximum(np.arange(n) - NEAR, 0), np.minimum(np.arange(n) + NEAR + 1, n)
    m = np.maximum(hi - lo - 1, 1)
    mean = (sums[hi] - sums[lo] - d) / m
    spread = np.sqrt(np.maximum((squares[hi] - squares[lo] - d * d) / m - mean * mean, 0))
    return [0, *(np.nonzero((d >= LEAST) & (d > mean + SPREADS * spread + 1e-9))[0] + 1).tolist()]


_CLIPS = "array<struct<first:int,frames:int,start_s:double,end_s:double,luma:double>>"
_CLIP = pa.struct([("first", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("luma", pa.float64())])


def inspect(media: bytes) -> dict:
    """What decode_avi() returns of one AVI."""
    riff = read_riff(media)
    digest, tail, left, hists = hashlib.sha256(), b"", riff["payload"], []
    total = 0
    for units, h in decode_frames(media, riff["frames"]):
        part = units.tobytes() if left is None else units.tobytes()[: max(0, left - total)]
        digest.update(part)
        tail, total = (tail + part)[-64:], total + len(part)
        hists.append(h)
    hist = np.concatenate(hists) if hists else np.zeros((0, BINS), np.int64)
    starts = shots(hist) if len(hist) else []
    level = (np.arange(BINS) + 0.5) * (256 / BINS)
    clips = []
    for a, b in zip(starts, [*starts[1:], len(hist)], strict=True):
        s = hist[a:b].sum(axis=0)
        clips.append({"first": a, "frames": b - a, "start_s": round(a / riff["fps"], 6), "end_s": round(b / riff["fps"], 6), "luma": round(float(s @ level) / max(int(s.sum()), 1), 3)})
    return {"payload_bytes": total, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "clips": clips, "error": None}


def encode_avi(df: DataFrame, data: str = "data", out: str = "media") -> DataFrame:
    """df with the binary column data replaced by column out: data, filled with 0 to a positive multiple of 64, as AVI.

    Null counts as empty. Whole values are kept, of any length that a row may have.
    """
    rest = [c for c in df.columns if c not in (data, out)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema) + f", `{out}` binary"

    def run(batches):
        for b in batches:
            column, media, first, held = b.column(len(rest)), [], 0, 0
            for i in range(b.num_rows):
                raw = column[i].as_py() or b""
                media.append(write_avi(raw + b"\0" * (-len(raw) % BLOCK or BLOCK * (not raw))))
                held += len(media[-1])
                if held > 8_000_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(first, len(media)) for k in range(len(rest))), pa.array(media, pa.binary())], [*rest, out])
                    media, first, held = [], i + 1, 0

    return df.select(*rest, data).mapInArrow(run, schema)


def decode_avi(df: DataFrame, media: str = "media") -> DataFrame:
    """df's other columns with media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, clips and error.

    The payload is the luma units read back, as far as the file notes its length; clips are the shots in order. Of
    media that can't be read, error says why and the rest is null; null media give nulls. Clashing columns are replaced.
    """
    made = {"media_bytes": pa.int64(), "media_sha256": pa.string(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "clips": pa.list_(_CLIP), "error": pa.string()}
    rest = [c for c in df.columns if c != media and c not in made]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)
    schema += f"{', ' if rest else ''}media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, clips {_CLIPS}, error string"

    def run(batches):
        for b in batches:
            rows = []
            for value in b.column(len(rest)):
                raw = value.as_py()
                row = dict.fromkeys(made)
                if raw is not None:
                    row |= {"media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()}
                    try:
                        row |= inspect(raw)
                    except (ValueError, IndexError, KeyError, struct.error, AttributeError) as e:
                        row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            found = [pa.array([r[k] for r in rows], t) for k, t in made.items()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(rest))), *found], [*rest, *made])

    return df.select(*rest, media).mapInArrow(run, schema)


def clip_rows(decoded: DataFrame) -> DataFrame:
    """A row for each clip of decode_avi(): its columns but clips, with clip (from 0) and the clip's fields."""
    rest = [c for c in decoded.columns if c != "clips"]
    return decoded.select(*rest, F.posexplode("clips").alias("clip", "_c")).select(*rest, "clip", "_c.*")


def op10_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("data"))
    found = decode_avi(encode_avi(docs))
    line = lambda c: F.format_string("%d+%d@%.3f-%.3f:%.3f", c.first, c.frames, c.start_s, c.end_s, c.luma)
    feature = F.array_join(F.transform("clips", line), ";")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.size("clips").alias("n_clips"))
