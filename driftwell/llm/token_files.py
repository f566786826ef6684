"""Token ids in files of fixed-width bit-packed blocks.

A file is a row of blocks, a directory and a trailer. Every id takes the bits that the largest id of the vocabulary
needs. A block holds ``BLOCK`` ids (the last one fewer), its place is known from the directory, and unpacking is a few
numpy shifts over whole words, so any range of ids is read by touching only its blocks. The directory also holds
each document's key and the place of its first id.

Files are written by Spark's own file writer (one record is one file), so a lost task leaves nothing behind and any
store that Spark reaches will do; they are read back with the ``binaryFile`` source.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.bpe import read_model
from driftwell.llm.presplit import PieceCoder, as_strings, byte_letters, spans, special_ids, sure_letters
from driftwell.llm.rows import arrow_map, give_back, kept, stored, utf8, work_path
from driftwell.session import small_side

MAGIC = b"bitpack1"
BLOCK = 1 << 16
# Ids in one file: about 8 MB at 16 bits. Bounds a worker's memory on both ways.
FILE_IDS = 1 << 22
# Bytes of texts encoded at once.
BATCH = 4 << 20
# Pieces encoded in one call. The library needs about a kilobyte for each token of a call, and longer calls take longer a piece.
JOINED = 64
# bits, ids, blocks, documents, part, piece, directory bytes
TRAILER = struct.Struct("<IQQQQQQ8s")


def id_bits(vocabulary: int) -> int:
    """Least bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` with ``bits`` bits each, lowest bit first. 64 ids fill ``bits`` words of 64 bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    n = len(ids)
    rows = -(-n // 64)
    lanes = np.zeros((rows, 64), np.uint64)
    lanes.reshape(-1)[:n] = ids
    words = np.zeros((rows, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    rows = -(-n // 64)
    raw = np.zeros(rows * bits * 8, np.uint8)
    used = -(-n * bits // 8)
    raw[:used] = np.frombuffer(data, np.uint8, used)
    words = raw.view("<u8").reshape(rows, bits)
    lanes = np.empty((rows, 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        lanes[:, j] = value & mask
    return lanes.reshape(-1)[:n]


def make_file(ids: np.ndarray, keys: Sequence[int | None], starts: np.ndarray, bits: int, part: int = 0, piece: int = 0) -> bytes:
    """One file: packed blocks, directory (block offsets; per document key, NULL flag and first id), trailer."""
    return _sealed([pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)], len(ids), keys, starts, bits, part, piece)


def _sealed(blocks: list[bytes], n: int, keys: Sequence[int | None], starts: np.ndarray, bits: int, part: int, piece: int) -> bytes:
    """Packed blocks of ``n`` ids with their directory and trailer."""
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    directory = b"".join([
        offsets.tobytes(),
        np.array([0 if k is None else k for k in keys], "<i8").tobytes(),
        np.array([k is None for k in keys], "u1").tobytes(),
        np.asarray(starts).astype("<u8").tobytes(),
    ])
    trailer = TRAILER.pack(bits, n, len(blocks), len(keys), part, piece, len(directory), MAGIC)
    return b"".join([*blocks, directory, trailer])


class TokenFile(NamedTuple):
    """A read file. ``ids`` reads any range of it."""

    data: memoryview
    bits: int
    n: int
    part: int
    piece: int
    offsets: np.ndarray
    keys: list
    starts: np.ndarray

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (not included): only the blocks that hold them are unpacked."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        found = [
            unpack(self.data[int(self.offsets[b]) : int(self.offsets[b + 1])], min(BLOCK, self.n - b * BLOCK), self.bits)
            for b in range(first, last + 1)
        ]
        return np.concatenate(found)[start - first * BLOCK : stop - first * BLOCK]


def open_file(data: bytes) -> TokenFile:
    """Read trailer and directory. The line end that the file writer adds behind the trailer is not part of it."""
    end = data.rfind(MAGIC)
    if end < 0 or end + len(MAGIC) < TRAILER.size:
        raise ValueError("no token file")
    at = end + len(MAGIC) - TRAILER.size
    bits, n, blocks, docs, part, piece, size, _ = TRAILER.unpack_from(data, at)
    at -= size
    offsets = np.frombuffer(data, "<u8", blocks + 1, at)
    at += offsets.nbytes
    keys = np.frombuffer(data, "<i8", docs, at)
    missing = np.frombuffer(data, "u1", docs, at + 8 * docs)
    starts = np.frombuffer(data, "<u8", docs, at + 9 * docs)
    named = [None if m else k for k, m in zip(keys.tolist(), missing.tolist())]
    return TokenFile(memoryview(data), bits, n, part, piece, offsets, named, np.append(starts, n).astype(np.int64))


def library_coder(model: str) -> PieceCoder:
    """The tokenizers library's coder, kept by a worker while it encodes: each distinct piece is encoded once."""
    return kept(f"library {hash(model)}", partial(_library_coder, model))


def _library_coder(model: str) -> PieceCoder:
    # A task has one core; the library's own threads would take others'.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spell = tokenizer.id_to_token
    opens = np.array([(spell(i) or "").startswith(byte_letters()[32]) for i in range(_vocabulary(model))])
    line = tokenizer.encode("\n", add_special_tokens=False).ids

    # The letters of each byte, but for the line feed, which parts the words of a call.
    letters = np.array([ord(c) for c in byte_letters()], "<u4")
    letters[10] = 10
    merged = tokenizer.model.tokenize

    def pieces(found: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters are what the splitting pattern leaves whole: they go to the library's model without it."""
        word = np.fromiter(map(sure_letters, found), bool, len(found))
        if not word.any():
            return patterned(found, spaced)
        ids, counts = words([p for p, w in zip(found, word.tolist()) if w], spaced)
        if word.all():
            return ids, counts
        others, sizes = patterned([p for p, w in zip(found, word.tolist()) if not w], spaced)
        # Both kinds back in their order.
        order = np.argsort(np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)]))
        sizes = np.concatenate([counts, sizes])
        starts = np.cumsum(sizes) - sizes
        return np.concatenate([ids, others])[spans(starts[order], sizes[order])], sizes[order]

    def words(found: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        lead = " " if spaced else ""
        raw = np.frombuffer((lead + f"\n{lead}".join(found)).encode(), np.uint8)
        flat, counts = array("I"), array("q")
        # Tokens go at once: many of them held would keep the garbage collector busy.
        for word in letters[raw].tobytes().decode("utf-32-le").split("\n"):
            tokens = merged(word)
            counts.append(len(tokens))
            for token in tokens:
                flat.append(token.id)
        return np.array(flat, np.uint32), np.array(counts, np.int64)

    def patterned(found: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces in one call. A label that begins with a space begins a piece; others get a line feed between two."""
        flat, counts = [], []
        for i in range(0, len(found), JOINED):
            part = found[i : i + JOINED]
            joined = " " + " ".join(part) if spaced else "\n" + "\n".join(part)
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            heads = np.flatnonzero(opens[ids] if spaced else ids == line[0])
            if len(heads) == len(part) and (spaced or len(line) == 1):
                counts.append(np.diff(np.append(heads, len(ids))) - (0 if spaced else 1))
                flat.append(ids if spaced else np.delete(ids, heads))
            else:
                each = [e.ids for e in tokenizer.encode_batch([" " + p for p in part] if spaced else part, add_special_tokens=False)]
                counts.append(np.array([len(e) for e in each], np.int64))
                flat.append(np.array([x for e in each for x in e], np.uint32))
        return np.concatenate(flat), np.concatenate(counts)

    def whole(text: str) -> np.ndarray:
        # The fast call keeps no offsets, of which a long text has many.
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    return PieceCoder(pieces, whole, list(special_ids(model)))


def write_token_files(df: DataFrame, text: str, key: str, path: str, folder: str, end_id: int = 0, file_ids: int = FILE_IDS) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``key`` under ``folder``.

    NULL keys come first and rows of one key in the order of their texts' hash and text. NULL texts count as empty. Rows are
    dealt by range of (key, text hash), so one key may hold a third of all rows, and a range may take several
    files; part and piece in the trailer give the order of the files. An empty table writes no token file.
    """
    model = df.sparkSession.sparkContext.broadcast(read_model(path))
    vocabulary = _vocabulary(read_model(path))
    bits = id_bits(max(vocabulary, end_id + 1))
    raw = utf8(F.col(text))
    slim = df.select(F.col(key).cast("long").alias("key"), raw.alias("raw"), F.xxhash64(raw).alias("tie"))
    dealt = slim.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "raw")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(model.value)
        part, piece = TaskContext.get().partitionId(), 0
        made = FileMaker(bits, part, piece)
        for batch in batches:
            step = max(1, math.ceil(batch.num_rows / max(1, math.ceil(batch.nbytes / BATCH))))
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                ids, offsets = coder.encode_flat(as_strings(rows["raw"]))
                made.add(rows["key"].to_pylist(), np.insert(ids, offsets[1:], end_id), np.diff(offsets) + 1)
                # What a step freed would else stay with the worker, beside what the next one takes.
                give_back()
                if made.n >= file_ids:
                    yield made.batch()
                    piece += 1
                    made = FileMaker(bits, part, piece)
        if made.keys:
            yield made.batch()
        del made
        give_back()

    files = dealt.select("key", "raw").mapInArrow(write, "file binary")
    # The text writer copies bytes as they are; one record per file and a line end behind it.
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


class FileMaker:
    """A file that grows: ids are packed as soon as they fill a block, so that a worker holds few of them unpacked."""

    def __init__(self, bits: int, part: int, piece: int):
        self.bits, self.part, self.piece, self.n = bits, part, piece, 0
        self.keys: list = []
        self.blocks: list[bytes] = []
        self.counts: list[np.ndarray] = []
        self.rest = np.zeros(0, np.uint32)

    def add(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> None:
        """The ids of some documents in a row."""
        self.keys += keys
        self.counts.append(counts)
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // BLOCK * BLOCK
        self.blocks += [pack(ids[i : i + BLOCK], self.bits) for i in range(0, full, BLOCK)]
        self.rest = ids[full:].copy()

    def batch(self) -> pa.RecordBatch:
        """The whole file as one record."""
        sizes = np.concatenate(self.counts)
        last = [pack(self.rest, self.bits)] if len(self.rest) else []
        made = _sealed(self.blocks + last, self.n, self.keys, np.cumsum(sizes) - sizes, self.bits, self.part, self.piece)
        return pa.record_batch([pa.array([made], pa.binary())], names=["file"])


def _vocabulary(model: str) -> int:
    import json

    spec = json.loads(model)
    return 1 + max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])]])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under ``folder``.

    ``start`` counts the ids of all documents before it, over the files in their order: a total per file, summed up
    over the files (one row each), is added to the place inside the file.
    """
    files = spark.read.format("binaryFile").load(folder).where(F.col("length") > 0).select("content")

    def read(rows: pa.Table) -> dict:
        out: dict = {c: [] for c in ("doc_id", "part", "piece", "inside", "n_tokens", "ids_crc32")}
        for data in rows["content"].to_pylist():
            file = open_file(data)
            bounds = file.starts.tolist()
            for d, key in enumerate(file.keys):
                out["doc_id"].append(key)
                out["inside"].append(bounds[d])
                out["n_tokens"].append(bounds[d + 1] - bounds[d])
            out["part"] += [file.part] * len(file.keys)
            out["piece"] += [file.piece] * len(file.keys)
            out["ids_crc32"] += _checksums(file)
        return out

    found = arrow_map(files, read, "doc_id long, part long, piece long, inside long, n_tokens long, ids_crc32 long", piece=32 << 20)
    found = stored(found, "token-rows")
    totals = found.groupBy("part", "piece").agg(F.sum("n_tokens").alias("_ids"))
    earlier = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", "piece", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_before"))
    return found.join(small_side(before), ["part", "piece"]).select(
        "doc_id", (F.col("_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def _checksums(file: TokenFile, step: int = 16 * BLOCK) -> list[int]:
    """CRC-32 of each document's ids as unsigned 32-bit integers, unpacking a few blocks at a time."""
    found, bounds, at, held, offset = [], file.starts.tolist(), 0, b"", 0
    for start, stop in zip(bounds, bounds[1:]):
        crc = 0
        while start < stop:
            if start >= offset + len(held) // 4:
                offset = at = start // BLOCK * BLOCK
                held = file.ids(at, at + step).astype("<u4").tobytes()
            upto = min(stop, offset + len(held) // 4)
            crc = zlib.crc32(memoryview(held)[4 * (start - offset) : 4 * (upto - offset)], crc)
            start = upto
        found.append(crc)
    return found


def documents_as_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Write all documents as token files, read the files back, one row per document."""
    folder = work_path(docs.sparkSession, "tokens")
    write_token_files(docs, "text", "doc_id", path, folder)
    return read_token_files(docs.sparkSession, folder)
