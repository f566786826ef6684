"""ISO media containers in a binary column: write raw frames, walk boxes, decode sample tables.

A container is a tree of boxes (length, four-letter type, content). The sample tables of a track say where each
sample lies and which samples are sync samples, so codec, duration and the byte ranges of keyframes come from the
index alone; payload bytes are never decoded for them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.rows import arrow_map, stored, utf8

SIDE = 24
FRAME = SIDE * SIDE
TIMESCALE = 25
KEY_EVERY = 12
FRAMES_PER_CHUNK = 64
# Boxes that hold only boxes (ISO/IEC 14496-12), fixed values.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"])


class Track(NamedTuple):
    number: int
    codec: str
    handler: str
    width: int
    height: int
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray


# ---- writing -------------------------------------------------------------------------------------------------


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, flags: int, *content: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *content)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def raw_container(payload: bytes) -> bytes:
    """A one-track file of 24 x 24 frames of 8-bit samples holding ``payload``, a positive multiple of 576 bytes."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError("payload must be whole frames")
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] if chunks > 1 else []
    if chunks == 1 or last != FRAMES_PER_CHUNK:
        runs.append((chunks, last, 1))
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", SIDE, SIDE),
        struct.pack(">IIIH", 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1),
    )
    start = np.arange(chunks, dtype=np.int64) * (FRAME * FRAMES_PER_CHUNK)

    def index(first: int, wide: bool) -> bytes:
        where = (start + first).astype(">u8" if wide else ">u4").tobytes()
        tables = box(
            b"stbl",
            full_box(b"stsd", 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, struct.pack(">III", 1, frames, 1)),
            full_box(b"stss", 0, struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", 0, struct.pack(">II", FRAME, frames)),
            full_box(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), where),
        )
        media = box(
            b"mdia",
            full_box(b"mdhd", 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, frames, 0x55C4, 0), version=1),
            full_box(b"hdlr", 0, struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"),
            box(
                b"minf",
                full_box(b"vmhd", 1, bytes(8)),
                box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1))),
                tables,
            ),
        )
        head = full_box(
            b"tkhd", 7, struct.pack(">QQIIQ", 0, 0, 1, 0, frames), bytes(16), MATRIX,
            struct.pack(">II", SIDE << 16, SIDE << 16), version=1,
        )
        movie = full_box(
            b"mvhd", 0, struct.pack(">QQIQIH", 0, 0, TIMESCALE, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24),
            struct.pack(">I", 2), version=1,
        )
        return box(b"moov", movie, box(b"trak", head, media))

    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    wide = len(payload) > (1 << 32) - (1 << 24)
    # The index has the same length wherever it points, so its place is known before its content.
    first = len(kind) + len(index(0, wide)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return kind + index(first, wide) + box(b"mdat", payload)


# ---- reading -------------------------------------------------------------------------------------------------


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, box start, content start, content end) of each box, parents first. A box that leaves its parent is an error."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("cut box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("cut box header")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError("box leaves its parent")
        here = (*path, kind)
        yield here, start, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, here)
        start += size


def table(data: bytes, start: int, end: int, kind: str, columns: int = 1, skip: int = 4) -> np.ndarray:
    """The counted table of a full box."""
    (n,) = struct.unpack_from(">I", data, start + skip)
    found = np.frombuffer(data, kind, count=n * columns, offset=start + skip + 4)
    if start + skip + 4 + found.nbytes > end:
        raise ValueError("table leaves its box")
    return found.astype(np.int64).reshape(n, columns)


class Run(NamedTuple):
    """Samples that a movie fragment adds to a track."""

    durations: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    offsets: np.ndarray


def read_tracks(data: bytes) -> list[Track]:
    """Every track with its sample tables decoded to one offset, size and keyframe flag per sample.

    Boxes belong to the ``trak`` that holds them. Samples of movie fragments follow those of the movie's own tables.
    """
    traks: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    runs: dict[int, list[Run]] = {}
    moof = after = 0
    head: tuple = ()
    for path, box_start, start, end in walk(data):
        kind = path[-1]
        if path == (b"moov", b"trak"):
            traks.append({})
        elif path[:2] == (b"moov", b"trak"):
            traks[-1].setdefault(kind, (start, end))
        elif path == (b"moov", b"mvex", b"trex"):
            number, _, *given = struct.unpack_from(">5I", data, start + 4)
            defaults[number] = tuple(given)
        elif path == (b"moof",):
            moof = after = box_start
        elif path == (b"moof", b"traf"):
            head = ()
        elif path == (b"moof", b"traf", b"tfhd"):
            head = fragment_head(data, start, defaults, moof, after)
            after = head[1]
        elif path == (b"moof", b"traf", b"trun"):
            if not head:
                raise ValueError("trun without tfhd")
            run = fragment_run(data, start, end, head, after)
            after = int(run.offsets[-1] + run.sizes[-1]) if len(run.sizes) else after
            runs.setdefault(head[0], []).append(run)
    if not traks:
        raise ValueError("no trak box")
    return [track_of(data, boxes, runs) for boxes in traks]


def fragment_head(data: bytes, start: int, defaults: dict, moof: int, after: int) -> tuple:
    """(track, base offset, default duration, size, flags) of a ``tfhd``: its own values, else those of ``trex``."""
    flags, number = struct.unpack_from(">II", data, start)
    duration, size, sample_flags = defaults.get(number, (0, 0, 0))
    # Without a base of its own a fragment starts at its moof, or where the data of the one before it ended.
    at, base = start + 8, moof if flags & 0x20000 else after
    if flags & 0x1:
        (base,) = struct.unpack_from(">Q", data, at)
        at += 8
    at += 4 if flags & 0x2 else 0
    given = []
    for bit, value in ((0x8, duration), (0x10, size), (0x20, sample_flags)):
        if flags & bit:
            (value,) = struct.unpack_from(">I", data, at)
            at += 4
        given.append(value)
    return number, base, *given


def fragment_run(data: bytes, start: int, end: int, head: tuple, after: int) -> Run:
    """The samples of a ``trun``; without an offset they follow the run before it."""
    flags, n = struct.unpack_from(">II", data, start)
    _, base, duration, size, sample_flags = head
    at, first = start + 8, after
    if flags & 0x1:
        first = base + struct.unpack_from(">i", data, at)[0]
        at += 4
    first_flags = None
    if flags & 0x4:
        (first_flags,) = struct.unpack_from(">I", data, at)
        at += 4
    present = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if at + 4 * n * len(present) > end or n > len(data):
        raise ValueError("run leaves its box")
    rows = np.frombuffer(data, ">u4", n * len(present), at).astype(np.int64).reshape(n, len(present))
    column = lambda bit, value: rows[:, present.index(bit)] if bit in present else np.full(n, value, np.int64)
    sizes, marks = column(0x200, size), column(0x400, sample_flags).copy()
    if first_flags is not None and n:
        marks[0] = first_flags
    # Bit 16 of a sample's flags says that it is no sync sample.
    return Run(column(0x100, duration), sizes, marks & 0x10000 == 0, first + np.cumsum(sizes) - sizes)


def track_of(data: bytes, found: dict[bytes, tuple[int, int]], runs: dict[int, list[Run]]) -> Track:
    """One track from the boxes of its ``trak`` and the runs of its fragments."""
    for needed in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz"):
        if needed not in found:
            raise ValueError(f"no {needed.decode()} box")
    number = 0
    if b"tkhd" in found:
        at, _ = found[b"tkhd"]
        (number,) = struct.unpack_from(">I", data, at + (20 if data[at] else 12))
    at, _ = found[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
    handler = data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12].decode("latin-1")
    at, _ = found[b"stsd"]
    codec = data[at + 12 : at + 16].decode("latin-1")
    width, height = struct.unpack_from(">HH", data, at + 40) if handler == "vide" else (0, 0)

    offsets, sizes = own_samples(data, found)
    n = len(sizes)
    keys = np.ones(n, bool)
    if b"stss" in found:
        keys[:] = False
        keys[table(data, *found[b"stss"], ">u4")[:, 0] - 1] = True
    steps = table(data, *found[b"stts"], ">u4", 2)
    lasting = int((steps[:, 0] * steps[:, 1]).sum())
    # Fragments name their track; a track without a number has none.
    own = runs.get(number, ())
    if own:
        offsets, sizes, keys = (np.concatenate([x, *(getattr(r, c) for r in own)]) for x, c in ((offsets, "offsets"), (sizes, "sizes"), (keys, "keys")))
        lasting += sum(int(r.durations.sum()) for r in own)
    if len(offsets) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("sample leaves the file")
    return Track(number, codec, handler, width, height, timescale, lasting or duration, offsets, sizes, keys)


def own_samples(data: bytes, found: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of the samples in a track's own tables."""
    at, end = found[b"stsz"]
    size, n = struct.unpack_from(">II", data, at + 4)
    if size * n > len(data):
        raise ValueError("sample leaves the file")
    sizes = np.full(n, size, np.int64) if size else table(data, at, end, ">u4", skip=8)[:, 0]
    if not n:
        return sizes, sizes
    if b"co64" not in found and b"stco" not in found:
        raise ValueError("no stco box")
    where = table(data, *found[b"co64"], ">u8")[:, 0] if b"co64" in found else table(data, *found[b"stco"], ">u4")[:, 0]
    runs = table(data, *found[b"stsc"], ">u4", 3)
    length = np.diff(np.append(runs[:, 0] - 1, len(where)))
    in_chunk = np.repeat(runs[:, 1], length)
    if in_chunk.sum() != n or len(in_chunk) != len(where):
        raise ValueError("chunks do not hold the samples")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(in_chunk) - in_chunk
    return before + np.repeat(where - before[np.minimum(first, n - 1)], in_chunk), sizes


def main_track(tracks: list[Track]) -> Track:
    """The first video track, else the first track."""
    return next((t for t in tracks if t.handler == "vide"), tracks[0])


def payload_of(data: bytes, track: Track) -> bytes:
    """All sample bytes in decoding order; neighbouring samples are read as one range."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts = track.offsets[np.concatenate([[0], breaks])]
    stops = ends[np.concatenate([breaks - 1, [len(ends) - 1]])]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), stops.tolist()))


# ---- operators -----------------------------------------------------------------------------------------------


def text_media(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys``, n_bytes and ``media``: each whole text as a raw 8-bit frame file.

    A text's UTF-8 bytes are padded with 255 to a positive multiple of 576. NULL and empty texts give one frame of
    padding. Equal texts give equal files. Other columns of ``df`` are left out; repeated rows stay.
    """
    names = [f"k{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], utf8(F.col(text)).alias("raw"))
    fields = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names)

    def build(rows: pa.Table) -> dict:
        raw = rows["raw"].to_pylist()
        padded = [r + b"\xff" * (FRAME - len(r) % FRAME if len(r) % FRAME or not r else 0) for r in raw]
        return {n: rows[n] for n in names} | {"n_bytes": [len(r) for r in raw], "media": [raw_container(p) for p in padded]}

    made = arrow_map(slim, build, f"{fields}, n_bytes long, media binary")
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n_bytes", "media")


FEATURES = """status string, codec string, width int, height int, timescale long, duration long, n_samples long,
    keyframe_offsets array<long>, keyframe_sizes array<long>, media_bytes long, media_sha256 string,
    payload_bytes long, payload_sha256 string, tail_crc32 long"""
TRACKS = """array<struct<track: long, handler: string, codec: string, width: int, height: int, timescale: long, duration: long,
    n_samples: long, payload_bytes: long, keyframe_offsets: array<long>, keyframe_sizes: array<long>>>"""


def features_of(data: bytes | None) -> dict:
    if data is None:
        return {"status": "missing"}
    base = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        tracks = read_tracks(data)
    except (ValueError, struct.error, IndexError, RecursionError) as bad:
        return base | {"status": f"broken: {bad}"}
    track = main_track(tracks)
    payload = payload_of(data, track)
    return base | {
        "tracks": [
            {
                "track": t.number, "handler": t.handler, "codec": t.codec, "width": t.width, "height": t.height, "timescale": t.timescale,
                "duration": t.duration, "n_samples": len(t.sizes), "payload_bytes": int(t.sizes.sum()),
                "keyframe_offsets": t.offsets[t.keys].tolist(), "keyframe_sizes": t.sizes[t.keys].tolist(),
            }
            for t in tracks
        ],
        "status": "ok", "codec": track.codec, "width": track.width, "height": track.height, "timescale": track.timescale,
        "duration": track.duration, "n_samples": len(track.sizes), "keyframe_offsets": track.offsets[track.keys],
        "keyframe_sizes": track.sizes[track.keys], "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
    }


def media_features(df: DataFrame, media: str, keys: list[str]) -> DataFrame:
    """``keys`` and what the container's index says: codec, size, duration, keyframe byte ranges, digests.

    ``tracks`` has one entry per track, samples of movie fragments included; the other columns are of the first video
    track, or of the first track where there is no video. NULL gives status ``missing`` and bytes that are no container ``broken: ...`` with NULL features; neither fails.
    """
    names = [f"k{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(media).alias("raw"))
    fields = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names)
    columns = [part.split()[0] for part in FEATURES.split(",")] + ["tracks"]

    def read(rows: pa.Table) -> dict:
        found = [features_of(r) for r in rows["raw"].to_pylist()]
        return {n: rows[n] for n in names} | {c: [f.get(c) for f in found] for c in columns}

    made = arrow_map(slim, read, f"{fields}, {FEATURES}, tracks {TRACKS}")
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *columns)


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Store every document as a media file, read the stored files back, one row of features per document."""
    files = stored(text_media(docs, "text", ["doc_id"]), "media")
    read = media_features(files, "media", ["doc_id", "n_bytes"])
    ranges = F.transform(
        F.arrays_zip("keyframe_offsets", "keyframe_sizes"),
        lambda k: F.concat_ws("+", k["keyframe_offsets"].cast("string"), k["keyframe_sizes"].cast("string")),
    )
    feature = F.concat_ws(
        ";", "status", F.trim("codec"), F.concat_ws("x", "width", "height"),
        F.concat_ws("/", "duration", "timescale"), F.size("keyframe_offsets").cast("string"), F.md5(F.concat_ws(",", ranges)),
    )
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        feature.alias("feature"),
    )
