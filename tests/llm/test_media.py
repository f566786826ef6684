import hashlib
import struct
import zlib

import numpy as np
import pytest

from driftwell.llm import media
from tests.llm.data import docs, odd_docs


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def test_documents_as_media(spark):
    df = odd_docs(spark)
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))
    got = sorted(media.documents_as_media(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.payload_sha256))
    want = sorted(((n, i, hashlib.sha256(padded(t)).hexdigest(), len(t.encode()), len(padded(t)), zlib.crc32(padded(t)[-32:])) for n, i, t in texts))
    assert [(r.doc_id is None, r.doc_id or 0, r.payload_sha256, r.n_bytes, r.payload_bytes, r.tail_crc32) for r in got] == want
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
    assert media.documents_as_media(docs(spark, [])).count() == 0


@pytest.mark.parametrize("frames", [1, 2, 63, 64, 65, 128, 129, 1000])
def test_round_trip(frames):
    payload = np.random.default_rng(frames).integers(0, 256, frames * media.FRAME, dtype=np.uint8).tobytes()
    (track,) = media.read_tracks(data := media.raw_container(payload))
    assert media.payload_of(data, track) == payload
    assert (track.codec, track.width, track.duration, len(track.sizes)) == ("raw ", 24, frames, frames)
    assert track.keys.nonzero()[0].tolist() == list(range(0, frames, media.KEY_EVERY))


def test_other_layouts_are_read():
    """Different sample sizes, chunks out of place, 64-bit offsets and boxes, no sync table."""
    payload = bytes(range(60))
    sizes, where = [10, 20, 5, 25], [30, 0]
    full = media.full_box
    stbl = media.box(
        b"stbl", full(b"stsd", 0, struct.pack(">I", 1), media.box(b"abcd", bytes(8))), full(b"stts", 0, struct.pack(">IIIII", 2, 3, 5, 1, 7)),
        full(b"stsc", 0, struct.pack(">I", 1), struct.pack(">III", 1, 2, 1)), full(b"stsz", 0, struct.pack(">II", 0, 4), struct.pack(">4I", *sizes)),
        full(b"co64", 0, struct.pack(">I", 2), struct.pack(">QQ", 0, 0)),
    )
    head = media.box(b"mdia", full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 10, 22, 0, 0)), full(b"hdlr", 0, struct.pack(">I4s", 0, b"soun"), bytes(13)), media.box(b"minf", stbl))
    moov = media.box(b"moov", media.box(b"trak", head))
    first = len(moov) + 16
    moov = moov.replace(struct.pack(">IQQ", 2, 0, 0), struct.pack(">IQQ", 2, first + where[0], first + where[1]))
    data = moov + struct.pack(">I4sQ", 1, b"mdat", 76) + payload
    (track,) = media.read_tracks(data)
    assert (track.codec, track.timescale, track.duration, track.keys.all()) == ("abcd", 10, 22, True)
    assert media.payload_of(data, track) == payload[30:60] + payload[:30]


def trak(number, handler, codec, sizes, chunks, keys=None, rate=10):
    """A track whose samples lie in one chunk each, at the places in ``chunks``."""
    full, n = media.full_box, len(sizes)
    entry = media.box(codec, bytes(24), struct.pack(">HH", 16, 8), bytes(50)) if handler == b"vide" else media.box(codec, bytes(28))
    tables = [
        full(b"stsd", 0, struct.pack(">I", 1), entry), full(b"stts", 0, struct.pack(">III", 1, n, 2) if n else bytes(4)),
        full(b"stsc", 0, struct.pack(">IIII", 1, 1, 1, 1) if n else bytes(4)), full(b"stsz", 0, struct.pack(">II", 0, n), struct.pack(f">{n}I", *sizes)),
        full(b"stco", 0, struct.pack(">I", n), struct.pack(f">{n}I", *chunks)),
    ]
    if keys is not None:
        tables.append(full(b"stss", 0, struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)))
    return media.box(
        b"trak", full(b"tkhd", 7, struct.pack(">III", 0, 0, number), bytes(68)),
        media.box(b"mdia", full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, rate, 0, 0, 0)), full(b"hdlr", 0, struct.pack(">I4s", 0, handler), bytes(13)), media.box(b"minf", media.box(b"stbl", *tables))),
    )


def test_each_track_has_its_own_tables(spark):
    """Audio first: its samples keep their own keyframes, and the columns describe the video."""
    payload = bytes(range(100))
    make = lambda at: media.box(b"moov", trak(1, b"soun", b"mp4a", [10, 20], [at, at + 50]), trak(2, b"vide", b"avc1", [5, 7, 9], [at + 70, at + 10, at + 80], [1, 3]))
    at = len(make(0)) + 8
    data = make(at) + media.box(b"mdat", payload)
    sound, video = media.read_tracks(data)
    assert (sound.number, sound.codec, sound.keys.tolist(), sound.duration) == (1, "mp4a", [True, True], 4)
    assert (video.number, video.codec, video.width, video.height, video.keys.tolist()) == (2, "avc1", 16, 8, [True, False, True])
    assert media.payload_of(data, sound) == payload[:10] + payload[50:70]
    assert media.payload_of(data, video) == payload[70:75] + payload[10:17] + payload[80:89]
    row = media.media_features(spark.createDataFrame([(1, data)], "id int, media binary"), "media", ["id"]).first()
    assert (row.status, row.codec, row.n_samples, row.keyframe_offsets, row.keyframe_sizes) == ("ok", "avc1", 3, [at + 70, at + 80], [5, 9])
    assert [(t.track, t.handler, t.n_samples, t.payload_bytes) for t in row.tracks] == [(1, "soun", 2, 30), (2, "vide", 3, 21)]


def test_movie_fragments():
    """Runs with sizes, flags and durations of their own, and one that takes everything from its defaults."""
    full = media.full_box
    mvex = media.box(b"mvex", full(b"trex", 0, struct.pack(">5I", 1, 1, 4, 6, 0x10000)), full(b"trex", 0, struct.pack(">5I", 2, 1, 3, 5, 0)))
    moov = media.box(b"moov", trak(1, b"vide", b"avc1", [], []), trak(2, b"soun", b"mp4a", [], []), mvex)

    def moof(video_at, sound_at):
        video = media.box(b"traf", full(b"tfhd", 0x20000, struct.pack(">I", 1)), full(b"trun", 0x305, struct.pack(">IiI", 2, video_at, 0), struct.pack(">4I", 7, 11, 8, 12)), full(b"trun", 0, struct.pack(">I", 1)))
        sound = media.box(b"traf", full(b"tfhd", 0x20010, struct.pack(">II", 2, 4)), full(b"trun", 0x1, struct.pack(">Ii", 3, sound_at)))
        return media.box(b"moof", video, sound)

    size = len(moof(0, 0))
    payload = bytes(range(41))
    piece = moof(size + 8, size + 8 + 29) + media.box(b"mdat", payload)
    data = moov + piece + piece
    video, sound = media.read_tracks(data)
    assert video.sizes.tolist() == [11, 12, 6] * 2 and video.keys.tolist() == [True, False, False] * 2
    assert (video.duration, sound.duration) == (2 * (7 + 8 + 4), 2 * 3 * 3) and sound.keys.all()
    assert media.payload_of(data, video) == payload[:29] * 2 and media.payload_of(data, sound) == payload[29:41] * 2
    for cut in (data[:-1], data.replace(struct.pack(">4I", 7, 11, 8, 12), struct.pack(">4I", 7, 1 << 30, 8, 12))):
        with pytest.raises(ValueError):
            media.read_tracks(cut)


def test_broken_files(spark):
    good = media.raw_container(bytes(576))
    rows = [(0, None), (1, b""), (2, good[:200]), (3, b"\x00\x00\x00\x02mdat"), (4, good), (5, good[:-100])]
    df = spark.createDataFrame(rows, "id long, media binary")
    got = {r.id: r for r in media.media_features(df, "media", ["id"]).collect()}
    assert got[0].status == "missing" and got[4].status == "ok"
    assert all(got[i].status.startswith("broken") for i in (1, 2, 3, 5))
