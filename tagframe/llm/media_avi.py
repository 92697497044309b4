"""Media columns: AVI files of motion-JPEG frames, read back, cut into shots.

Bytes are stored as the 8-bit samples of grey frames, WIDTH x HEIGHT each. A frame is an intra-coded JPEG of the lossless
process (SOF3, left predictor, Huffman-coded differences), so what is read back is what was stored. Decoding walks the
RIFF index, takes out byte stuffing, and reads one code of every frame at a time, all frames of a slice side by side.

A shot ends where the difference of two frames' histograms exceeds the mean of the last differences in the shot by
so many standard deviations, so the threshold follows the material.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
FPS = 25
#: Shot detection: histogram bins, frames that a threshold looks back on, deviations above the mean, least difference.
LEVELS, BACK, DEVIATIONS, FLOOR = 32, 8, 3.0, 0.25

#: Code length in bits of each difference category 0 to 8; codes follow in canonical order.
LENGTHS = (4, 4, 4, 3, 3, 3, 3, 3, 3)
LONGEST = max(LENGTHS) + 8


def _codes() -> tuple[list[int], list[int]]:
    """(categories in order of their codes, code of each category)."""
    order = sorted(range(len(LENGTHS)), key=lambda c: (LENGTHS[c], c))
    code, last, codes = 0, LENGTHS[order[0]], [0] * len(LENGTHS)
    for c in order:
        code <<= LENGTHS[c] - last
        last, codes[c] = LENGTHS[c], code
        code += 1
    return order, codes


_ORDER, _CODES = _codes()


def _jpeg_head() -> bytes:
    counts = bytes(LENGTHS.count(n) for n in range(1, 17))
    dht = struct.pack(">HHB", 0xFFC4, 3 + 16 + len(_ORDER), 0) + counts + bytes(_ORDER)
    sof = struct.pack(">HHBHHB", 0xFFC3, 11, 8, HEIGHT, WIDTH, 1) + bytes((1, 0x11, 0))
    sos = struct.pack(">HHB", 0xFFDA, 8, 1) + bytes((1, 0, 1, 0, 0))
    return b"\xff\xd8" + dht + sof + sos


HEAD = np.frombuffer(_jpeg_head(), np.uint8)

# differences -255..255: their code with extra bits, and its length
_DIFF = np.arange(-255, 256)
_CAT = np.array([int(abs(d)).bit_length() for d in _DIFF])
_LEN = np.array(LENGTHS)[_CAT] + _CAT
_WORD = (np.array(_CODES)[_CAT] << _CAT) | np.where(_DIFF < 0, _DIFF + (1 << _CAT) - 1, _DIFF)
#: The same code as it lies in three bytes from each bit of the first.
_AT_BIT = (_WORD[:, None] << (24 - _LEN[:, None] - np.arange(8))).astype(np.float64).ravel()


def _table() -> tuple[np.ndarray, np.ndarray]:
    """For each LONGEST bits that can come next: the difference, and how many bits it took."""
    diff, used = np.zeros(1 << LONGEST, np.int16), np.zeros(1 << LONGEST, np.uint8)
    for d, word, n in zip(_DIFF, _WORD, _LEN, strict=True):
        start = int(word) << (LONGEST - int(n))
        diff[start : start + (1 << (LONGEST - int(n)))] = d
        used[start : start + (1 << (LONGEST - int(n)))] = n
    return diff, used


_TO_DIFF, _TO_USED = _table()


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, FRAME) samples -> the bytes of all JPEG frames one after the other, and each frame's length."""
    n = len(samples)
    grid = samples.reshape(n, HEIGHT, WIDTH).astype(np.int16)
    diff = np.empty_like(grid)
    diff[:, :, 1:] = grid[:, :, 1:] - grid[:, :, :-1]
    diff[:, 1:, 0] = grid[:, 1:, 0] - grid[:, :-1, 0]
    diff[:, 0, 0] = grid[:, 0, 0] - 128
    at = (diff.reshape(n, FRAME) + np.int16(255)).astype(np.int64)
    each = _LEN[at]
    ends = np.cumsum(each, 1)
    bits = ends[:, -1]
    size = (bits + 7) // 8
    first = np.concatenate(([0], np.cumsum(size)))
    start = (ends - each + first[:-1, None] * 8).ravel()
    # the codes that begin in one byte share no bit, so their sum is that byte and the two after it
    words = np.bincount(start >> 3, _AT_BIT[(at.ravel() << 3) | (start & 7)], minlength=first[-1]).astype(np.uint32)
    scan = words >> 16
    scan[1:] += (words[:-1] >> 8) & 255
    scan[2:] += words[:-2] & 255
    scan = scan.astype(np.uint8)
    scan[first[1:] - 1] |= ((1 << (-bits % 8)) - 1).astype(np.uint8)  # ones up to the byte's end
    # a zero byte after each 0xFF, then head and end of image around each frame's scan
    stuffed = np.flatnonzero(scan == 255) + 1
    extra = np.bincount(np.searchsorted(first[1:], stuffed - 1, "right"), minlength=n)
    scan = np.insert(scan, stuffed, 0)
    scan_size = size + extra
    length = scan_size + len(HEAD) + 2
    out = np.empty(int(length.sum()), np.uint8)
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    out[begin[:, None] + np.arange(len(HEAD))] = HEAD
    out[begin + length - 2], out[begin + length - 1] = 0xFF, 0xD9
    inner = np.repeat(begin + len(HEAD) - np.concatenate(([0], np.cumsum(scan_size)))[:-1], scan_size) + np.arange(len(scan))
    out[inner] = scan
    return out, length


def decode_frames(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The samples of the JPEG frames at begin, of those lengths, in data."""
    head = data[begin[:, None] + np.arange(len(HEAD))]
    if len(begin) and not (head == HEAD).all():
        raise ValueError("not a frame of this kind")
    size = length - len(HEAD) - 2
    first = np.concatenate(([0], np.cumsum(size)))
    scan = data[np.repeat(begin + len(HEAD) - first[:-1], size) + np.arange(first[-1])]
    gone = np.flatnonzero((scan[1:] == 0) & (scan[:-1] == 255)) + 1
    first = first - np.searchsorted(gone, first, "left")
    scan = np.concatenate((np.delete(scan, gone), np.zeros(4, np.uint8))).astype(np.uint32)
    at = first[:-1] * 8
    diff = np.empty((FRAME, len(begin)), np.int16)
    window = (scan[:-2] << 16) | (scan[1:-1] << 8) | scan[2:]
    down, mask = 24 - LONGEST, (1 << LONGEST) - 1
    for k in range(FRAME):
        bits = (window[at >> 3] >> (down - (at & 7)).astype(np.uint32)) & mask
        diff[k] = _TO_DIFF[bits]
        at = at + _TO_USED[bits]
    diff = diff.T.reshape(-1, HEIGHT, WIDTH)
    left = np.cumsum(diff[:, :, 0], 1, dtype=np.int16) + np.int16(128)
    diff[:, :, 0] = left
    return np.cumsum(diff, 2, dtype=np.int16).astype(np.uint8).reshape(-1, FRAME)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """One AVI file: header, the frames as 00dc chunks in a movi list, idx1."""
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    size = np.array([len(f) for f in frames], np.int64)
    at = 4 + np.concatenate(([0], np.cumsum(8 + size + (size & 1))))[:-1]
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, at, size
    movi = b"movi" + b"".join([_chunk(b"00dc", f) for f in frames])
    body = b"AVI " + hdrl + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def frame_places(avi: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of each video frame of an AVI file, as its RIFF index names them."""
    if len(avi) < 12 or avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, b""
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = avi[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    rows = np.frombuffer(index, "<u4").reshape(-1, 4)
    rows = rows[rows[:, 0] == int.from_bytes(b"00dc", "little")].astype(np.int64)
    return (movi or 0) + rows[:, 2] + 8, rows[:, 3]


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """[first, last + 1) frames of each shot, by adaptive histogram differences."""
    n = len(frames)
    if not n:
        return []
    levels = (frames >> np.uint8(3)).astype(np.int64) + np.arange(n)[:, None] * LEVELS
    histogram = np.bincount(levels.ravel(), minlength=n * LEVELS).reshape(n, LEVELS)
    d = (np.abs(histogram[1:] - histogram[:-1]).sum(1) / (2.0 * FRAME)).tolist()
    cuts, start, last = [0], 0, []
    for k, x in enumerate(d, 1):
        if len(last) >= 2:
            mean = sum(last) / len(last)
            if x > max(FLOOR, mean + DEVIATIONS * (sum((y - mean) ** 2 for y in last) / len(last)) ** 0.5):
                cuts.append(k)
                last = []
                continue
        last = [*last[1 - BACK :], x]
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def payloads(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of each text with spaces up to a positive multiple of FRAME: (all bytes, offsets, unpadded sizes)."""
    data, offsets = utf8(text)
    size = np.diff(offsets)
    padded = np.maximum(1, -(-size // FRAME)) * FRAME
    first = np.concatenate(([0], np.cumsum(padded)))
    out = np.full(int(first[-1]), 32, np.uint8)
    out[np.repeat(first[:-1] - offsets[:-1], size) + np.arange(len(data))] = data
    return out, first, size


def encode_column(text: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """An AVI file for each text, and the texts' unpadded sizes."""
    data, first, size = payloads(text)
    coded, length = encode_frames(data.reshape(-1, FRAME))
    coded, ends = coded.tobytes(), np.cumsum(length).tolist()
    starts, count = [0, *ends], (first // FRAME).tolist()
    return [write_avi([coded[starts[k] : starts[k + 1]] for k in range(a, b)]) for a, b in zip(count, count[1:], strict=False)], size


def decode_column(files: list[bytes]) -> list[np.ndarray]:
    """The frames of each AVI file, all decoded together."""
    places = [frame_places(f) for f in files]
    first = np.concatenate(([0], np.cumsum([len(f) for f in files]))).astype(np.int64)
    begin = np.concatenate([p + o for (p, _), o in zip(places, first, strict=False)]) if files else np.zeros(0, np.int64)
    length = np.concatenate([n for _, n in places]) if files else begin
    frames = decode_frames(np.frombuffer(b"".join(files), np.uint8), begin, length)
    return np.split(frames, np.cumsum([len(p) for p, _ in places])[:-1]) if files else []


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        files, size = encode_column(batch["text"])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def _decoded(files: list[bytes]) -> list[tuple[np.ndarray | None, str | None]]:
    """The frames of each file; of one that cannot be read, why not."""
    try:
        return [(frames, None) for frames in decode_column(files)]
    except (ValueError, IndexError, struct.error) as e:
        return [(None, str(e) or type(e).__name__)] if len(files) == 1 else [x for f in files for x in _decoded([f])]


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", 1 << 20):
        files = batch["media"].to_pylist()
        ids, n_bytes, rows = batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), []
        for i, n, media, (frames, reason) in zip(ids, n_bytes, files, _decoded(files), strict=True):
            if frames is None:
                rows.append({"doc_id": i, "n_bytes": n, "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "reason": reason})
                continue
            payload, cuts = frames.tobytes(), shots(frames)
            rows.append(
                {
                    "doc_id": i,
                    "n_bytes": n,
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                    "clips": [{"clip": k, "first_frame": a, "frames": b - a, "start_s": a / FPS, "end_s": b / FPS} for k, (a, b) in enumerate(cuts)],
                }
            )
        yield pa.RecordBatch.from_pylist(rows, _CLIP_ARROW)


_CLIP_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    + [("clips", pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))), ("reason", pa.string())]
)
CLIP_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, clips array<struct<clip:int,first_frame:int,frames:int,start_s:double,end_s:double>>, reason string"


def store_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media: one AVI file per row.

    Null and empty texts give one frame of spaces. Repeated rows stay, other columns are ignored, empty tables stay empty.
    """
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id bigint, n_bytes bigint, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> the payload's and file's digests, and the shots as an array of timed clips.

    Rows whose media is null give no row. Bytes that are no such AVI file have no payload and no clips, but a reason.
    """
    return media.select("doc_id", "n_bytes", "media").where("media IS NOT NULL").mapInArrow(_clips, CLIP_SCHEMA)


def timed_clips(media: DataFrame) -> DataFrame:
    """One row per clip: doc_id, clip, first_frame, frames, start_s, end_s."""
    return read_media(media).select("doc_id", F.inline("clips"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_media(table(spark, sf_dir, "documents")))
    clips = F.concat_ws(",", F.transform("clips", lambda c: c.first_frame.cast("string")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.lit("shots="), F.size("clips"), F.lit(";starts="), clips).alias("feature"))
