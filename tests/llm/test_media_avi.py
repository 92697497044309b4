import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tagframe.llm import media_avi as a

TEXTS = ["", None, "a", "é" * 500, "\x7f\x00" * 400, "x" * 192, "x" * 193, "ÿ" * 7, "word " * 5000]


def padded(text):
    b = (text or "").encode()
    return b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))


def test_round_trip_is_exact():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (50, a.FRAME), dtype=np.uint8)
    data, size = a.encode_frames(noise)
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    assert (a.decode_frames(data, begin, size) == noise).all()
    files, n = a.encode_column(pa.array(TEXTS))
    assert [f.tobytes() for f in a.decode_column(files)] == [padded(t) for t in TEXTS]
    assert n.tolist() == [len((t or "").encode()) for t in TEXTS]


def test_files_are_riff_avi_of_lossless_jpeg():
    (f,), _ = a.encode_column(pa.array(["hello"]))
    assert f[:4] == b"RIFF" and struct.unpack_from("<I", f, 4)[0] == len(f) - 8 and f[8:12] == b"AVI " and b"MJPG" in f and b"idx1" in f
    place, size = a.frame_places(f)
    assert f[place[0] : place[0] + 2] == b"\xff\xd8" and f[place[0] + size[0] - 2 : place[0] + size[0]] == b"\xff\xd9" and b"\xff\xc3" in f
    with pytest.raises(ValueError):
        a.frame_places(b"no file")


def test_shots_follow_histograms():
    dark, light = np.full((10, a.FRAME), 10, np.uint8), np.full((10, a.FRAME), 200, np.uint8)
    assert a.shots(np.concatenate([dark, light, dark])) == [(0, 10), (10, 20), (20, 30)]
    assert a.shots(dark) == [(0, 10)] and a.shots(dark[:0]) == []


def test_frames(docs, no_docs):
    rows = {r.doc_id: r for r in a.read_media(a.store_media(docs)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in rows.items():
        p = padded(texts[i])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[i] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert sum(c.frames for c in r.clips) * 192 == len(p)
    assert rows[1].media_sha256 == rows[2].media_sha256
    assert a.timed_clips(a.store_media(docs)).where("end_s <= start_s").count() == 0
    assert a.store_media(docs).count() == docs.count() and a.read_media(a.store_media(no_docs)).count() == 0


def test_files_that_cannot_be_read_have_a_reason(spark):
    good = a.store_media(spark.createDataFrame([(1, "some text " * 50)], "doc_id bigint, text string")).first()
    rows = [(1, good.n_bytes, good.media), (2, 5, b"no avi"), (3, 5, bytes(good.media[:12])), (4, 5, bytes(good.media).replace(b"\xff\xd8", b"\xff\xd9")), (5, 5, bytes(good.media[:-40]))]
    out = {r.doc_id: r for r in a.read_media(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert out[1].reason is None and out[1].payload_sha256 and len(out) == 5
    assert out[2].reason and out[2].payload_sha256 is None and out[2].clips is None and out[4].reason
    assert {r.doc_id for r in a.timed_clips(spark.createDataFrame(rows[:2], "doc_id bigint, n_bytes bigint, media binary")).collect()} == {1}
