"""Near-duplicate texts: b-bit MinHash signatures, a multi-index Hamming join and confirmation on full sets.

A text's set is its distinct word shingles (as 64-bit hashes). Its signature has some cells, each one byte of a minimum
over the set. Two sets with similarity J differ in a cell with probability about 1 - J, so sets at the threshold lie
within a distance (of differing cells) that all but one pair in 100 000 keeps.

All pairs of signatures within that distance are found by the pigeonhole principle: with more than half as many chunks
as allowed errors, some chunk has one differing cell at most. Every chunk is therefore indexed under each choice of one
cell left out, and texts that meet under one key (a bucket) are candidates.

What is wanted are the classes, not the pairs, so no bucket is ever expanded into its pairs:

* texts with one set are one node;
* in each bucket all nodes are compared with one hub component; what is confirmed is merged, the hub leaves the
  bucket, and a few such rounds settle nearly every bucket;
* what is left of a bucket is cut into blocks, and blocks are compared two by two, inside tasks that hold two blocks
  at most and give back a spanning forest of the links they confirm.

A comparison first checks lengths and signature distance; only nodes that pass are joined with their full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.graphs import components
from driftwell.llm.rows import arrow_map, grouped_map, stored, utf8

BLOCK = 256
HUB_ROUNDS = 3
BROADCAST_ROWS = 200_000

_LOWER = bytes(i + 32 if 65 <= i <= 90 else 32 if 9 <= i <= 13 else i for i in range(256))
_PIECE = 1 << 20


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


_BYTE = _odd(256, 1)
_STEP = np.uint64(0x9E3779B97F4A7C17)
_BACK = np.uint64(pow(0x9E3779B97F4A7C17, -1, 1 << 64))
_PLACE = _odd(64, 2)
_SHORT = _odd(64, 3)
_CELL = _odd(256, 4)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(max(n, _PIECE), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of lowered bytes: a polynomial over random byte values, modulo 2**64."""
    word = data != 32
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and how many words each text has.

    Bytes are taken about a megabyte at a time, cut at white space, so one huge text needs no huge arrays.
    """
    flat = b" ".join([*raws, b""]).translate(_LOWER)
    bounds = np.cumsum([0, *[len(r) + 1 for r in raws]])
    hashes, starts, at = [], [], 0
    while at < len(flat):
        end = len(flat) if len(flat) - at <= _PIECE else flat.rfind(b" ", at, at + _PIECE) + 1
        if end <= at:
            end = flat.find(b" ", at) + 1 or len(flat)
        h, s = _hash_piece(np.frombuffer(flat, np.uint8, end - at, at))
        hashes.append(h)
        starts.append(s + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.diff(np.searchsorted(s, bounds))


class Scheme(NamedTuple):
    """Shingle length in words, least similarity in percent, and how signatures are compared."""

    size: int
    percent: int
    cells: int
    distance: int
    chunks: int


def scheme(size: int, percent: int, cells: int = 64, lost: float = 1e-5) -> Scheme:
    """The least distance that sets at the threshold exceed with probability ``lost`` at most; one error per chunk."""
    differ = (1 - percent / 100) * 255 / 256
    distance, within = -1, 0.0
    while 1 - within > lost and distance < cells:
        distance += 1
        within += math.comb(cells, distance) * differ**distance * (1 - differ) ** (cells - distance)
    return Scheme(size, percent, cells, distance, distance // 2 + 1)


def shingle_sets(raws: Sequence[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, without words none."""
    h, counts = word_hashes(raws)
    n_all = max(0, len(h) - size + 1)
    runs = np.zeros(n_all, np.uint64)
    for j in range(size):
        runs += h[j : j + n_all] * _PLACE[j]
    runs = mix(runs)
    found, at = [], 0
    for n in counts.tolist():
        if n >= size:
            found.append(np.unique(runs[at : at + n - size + 1]))
        elif n:
            found.append(mix((h[at : at + n] * _SHORT[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            found.append(h[:0])
        at += n
    return found


def signature(hashes: np.ndarray, cells: int) -> bytes:
    """One byte per cell of the minimum over the set under each of ``cells`` multiplications."""
    least = np.full(cells, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 8192):
        least = np.minimum(least, (hashes[i : i + 8192, None] * _CELL[:cells]).min(axis=0))
    return (mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def index_keys(s: Scheme) -> list[tuple[int, ...]]:
    """The cells that each index entry keeps: every chunk with each choice of the allowed errors left out."""
    errors = s.distance // s.chunks
    bounds = [round(i * s.cells / s.chunks) for i in range(s.chunks + 1)]
    keys: list[tuple[int, ...]] = []
    for start, stop in zip(bounds, bounds[1:]):
        keys += combinations(range(start, stop), max(0, stop - start - errors))
    return keys


def bucket_keys(cells: np.ndarray, keys: list[tuple[int, ...]]) -> np.ndarray:
    """(texts, keys): a 64-bit key per index entry, of the entry's number and the cells it keeps."""
    out = np.empty((len(cells), len(keys)), np.int64)
    for i, kept in enumerate(keys):
        value = np.full(len(cells), i + 1, np.uint64)
        for c in kept:
            value = mix(value * np.uint64(257) + cells[:, c].astype(np.uint64) + np.uint64(1))
        out[:, i] = value.view(np.int64)
    return out


def sketches(df: DataFrame, text: str, keys: Sequence[str], s: Scheme) -> DataFrame:
    """``keys``, tie (hash of the text), n_shingles, digest of the set (NULL if empty) and cells for each text."""
    names = [f"k{i}" for i in range(len(keys))]
    raw = utf8(F.col(text))
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], raw.alias("raw"), F.xxhash64(raw).alias("tie"))
    fields = "".join(f"{n} {slim.schema[n].dataType.simpleString()}, " for n in names)

    def run(rows: pa.Table) -> dict:
        sets = shingle_sets(rows["raw"].to_pylist(), s.size)
        return {n: rows[n] for n in names} | {
            "tie": rows["tie"],
            "n_shingles": [len(x) for x in sets],
            "digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets],
            "cells": [signature(x, s.cells) if len(x) else None for x in sets],
        }

    made = arrow_map(slim, run, f"{fields}tie long, n_shingles long, digest binary, cells binary")
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "tie", "n_shingles", "digest", "cells")


def bucket_rows(nodes: DataFrame, s: Scheme) -> DataFrame:
    """(key, node) for buckets with two nodes or more."""
    keys = index_keys(s)

    def run(rows: pa.Table) -> dict:
        cells = np.frombuffer(b"".join(rows["cells"].to_pylist()), np.uint8).reshape(-1, s.cells)
        return {"node": rows["node"], "keys": list(bucket_keys(cells, keys))}

    keyed = arrow_map(nodes.select("node", "cells"), run, "node long, keys array<long>").select(F.explode("keys").alias("key"), "node")
    # Counted apart and joined back, so that a bucket with very many nodes is never one task's group.
    shared = keyed.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a != _b").select("key")
    return keyed.join(shared, "key").select("key", "node")




def passing(
    s: Scheme, n: np.ndarray, cells: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in ``left``, in ``right``) and distance of the pairs that lengths and signatures allow and labels do not join."""
    a, b = n[left][:, None], n[right][None, :]
    ok = (100 * np.minimum(a, b) >= s.percent * np.maximum(a, b)) & (label[left][:, None] != label[right][None, :])
    i, j = np.nonzero(ok)
    if not len(i):
        return i, j, i
    distance = np.concatenate([
        (cells[left[i[k : k + 65536]]] != cells[right[j[k : k + 65536]]]).sum(axis=1) for k in range(0, len(i), 65536)
    ])
    near = distance <= s.distance
    return i[near], j[near], distance[near]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet the threshold, counted on the full sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _arrays(rows: pa.Table) -> tuple[np.ndarray, ...]:
    side, node, label, n = (rows[c].to_numpy() for c in ("side", "node", "label", "n"))
    cells = np.frombuffer(b"".join(rows["cells"].to_pylist()), np.uint8).reshape(len(node), -1)
    return side, node, label, n, cells


def _survivors(s: Scheme, rows: pa.Table) -> dict | None:
    """Rows of a group that have a partner which lengths and signatures allow."""
    side, node, label, n, cells = _arrays(rows)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    i, j, _ = passing(s, n, cells, label, left, right)
    if not len(i):
        return None
    kept = np.concatenate([left[np.unique(i)], right[np.unique(j)]])
    return {c: rows[c].to_numpy()[kept] for c in ("g1", "g2", "g3", "side", "node", "label")}


def _confirmed(s: Scheme, rows: pa.Table) -> dict | None:
    """Confirmed links of a group, closest signatures first, without those between labels that are joined already."""
    side, node, label, n, cells = _arrays(rows)
    sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    i, j, distance = passing(s, n, cells, label, left, right)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out: dict = {"a": [], "b": []}
    for p in np.argsort(distance, kind="stable").tolist():
        x, y = int(left[i[p]]), int(right[j[p]])
        rx, ry = root(int(label[x])), root(int(label[y]))
        if rx != ry and similar(sets[x], sets[y], s.percent):
            parent[max(rx, ry)] = min(rx, ry)
            out["a"].append(int(label[x]))
            out["b"].append(int(label[y]))
    return out if out["a"] else None


_PAIRED = "g1 long, g2 long, g3 long, side int, node long, label long"


def confirm(paired: DataFrame, nodes: DataFrame, sets: DataFrame, s: Scheme) -> DataFrame:
    """(a, b): linked labels among the groups (g1, g2, g3) of ``paired``, side 0 against side 1."""
    light = paired.join(nodes.select("node", "n", "cells"), "node")
    kept = stored(grouped_map(light, ["g1", "g2", "g3"], partial(_survivors, s), _PAIRED), "near-kept")
    full = kept.join(sets, "node")
    return stored(grouped_map(full, ["g1", "g2", "g3"], partial(_confirmed, s), "a long, b long").distinct(), "near-links")


def _blocks(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(BLOCK))).cast("long")


def hub_groups(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups that compare, in every bucket, one hub component with all other nodes; and the bucket rows left after.

    ``members`` has key, node, label, weight (higher becomes hub). The hub's nodes and the others that meet it in
    any bucket are gathered under the hub's label and cut into blocks, so each pair of nodes is compared once.
    """
    hubs = members.groupBy("key").agg(
        F.max(F.struct("weight", "label")).alias("h"), F.min("label").alias("_a"), F.max("label").alias("_b")
    )
    hubs = hubs.where("_a != _b").select("key", F.col("h.label").alias("hub"))
    met = stored(members.join(hubs, "key").withColumn("side", F.when(F.col("label") == F.col("hub"), 0).otherwise(1)), "near-met")
    rows = stored(met.select("hub", "node", "label", "side").distinct(), "near-sides")
    counts = rows.groupBy("hub").agg(
        _blocks(F.count(F.when(F.col("side") == 0, 1))).alias("b0"), _blocks(F.count(F.when(F.col("side") == 1, 1))).alias("b1")
    )
    placed = rows.join(counts, "hub")
    own = F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))
    other = F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0"))
    placed = placed.withColumns({"mine": F.pmod(F.xxhash64("node"), own), "others": other})
    placed = placed.withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    paired = placed.select(
        F.col("hub").alias("g1"),
        F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("theirs")).alias("g2"),
        F.when(F.col("side") == 0, F.col("theirs")).otherwise(F.col("mine")).alias("g3"),
        F.col("side").cast("int").alias("side"), "node", "label",
    )
    return paired, met.where("side = 1").select("key", "node")


def bucket_groups(members: DataFrame) -> DataFrame:
    """Groups that compare all nodes of each bucket with each other, as pairs of blocks."""
    sized = members.groupBy("key").agg(
        _blocks(F.count(F.lit(1))).alias("b"), F.min("label").alias("_a"), F.max("label").alias("_b")
    ).where("_a != _b").select("key", "b")
    placed = members.join(sized, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("b")))
    zero = F.lit(0).cast("long")
    pairs = F.concat(
        F.transform(F.sequence(F.col("mine"), F.col("b") - 1), lambda j: F.struct(F.col("mine").alias("g2"), j.alias("g3"), F.lit(0).alias("side"))),
        F.transform(F.sequence(zero, F.col("mine")), lambda i: F.struct(i.alias("g2"), F.col("mine").alias("g3"), F.lit(1).alias("side"))),
    )
    return placed.select("key", "node", "label", F.explode(pairs).alias("p")).select(
        F.col("key").alias("g1"), "p.g2", "p.g3", "p.side", "node", "label"
    )


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after merging the linked labels."""
    roots = components(links, "a", "b")
    merged = labels.join(roots.withColumnRenamed("node", "label"), "label", "left")
    return stored(merged.select("node", F.coalesce("root", "label").alias("label")), "near-labels")


def near_classes(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], s: Scheme) -> DataFrame:
    """(node, label): nodes linked directly or through others share a label. Nodes that meet no other are left out.

    ``nodes`` has node, n, cells; ``sets_of(ids)`` gives node, n, cells, hashes for a table of nodes.
    """
    members = stored(bucket_rows(nodes, s), "near-buckets")
    degree = members.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    degree = stored(degree, "near-degree")
    labels = degree.select("node", F.col("node").alias("label"))
    if not degree.limit(1).count():
        return labels
    sets = stored(sets_of(degree.select("node")), "near-sets")

    def with_labels(rows: DataFrame) -> DataFrame:
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        known = labels.join(sizes, "label").join(degree, "node").select("node", "label", F.struct("size", "degree").alias("weight"))
        return rows.join(known, "node")

    for _ in range(HUB_ROUNDS):
        paired, left = hub_groups(with_labels(members))
        links = confirm(paired, nodes, sets, s)
        if links.limit(1).count():
            labels = relabelled(labels, links)
        members = left
        if not members.limit(1).count():
            return labels
    links = confirm(bucket_groups(with_labels(members)), nodes, sets, s)
    return relabelled(labels, links) if links.limit(1).count() else labels


def near_groups(df: DataFrame, text: str, key: str, s: Scheme) -> DataFrame:
    """id, tie (hash of the text), n_shingles, digest, component_id and first_tie for every row of ``df``.

    ``component_id`` is the smallest key reachable and ``first_tie`` the text hash of the row that has it, which tells
    rows of one key with different texts apart. Rows with one set of shingles are one class from the start, so any
    number of copies costs nothing further.
    """
    sketch = stored(sketches(df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "text", ["id"], s), "near-sketch")
    grouped = sketch.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tie")).alias("first"),
        F.first("n_shingles").alias("n"),
        F.first("cells").alias("cells"),
    )
    classes = stored(
        grouped.select("digest", F.col("first.id").alias("id"), F.col("first.tie").alias("tie"), "n", "cells").withColumn(
            "node", F.monotonically_increasing_id()
        ),
        "near-classes",
    )

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "node").select("node", "digest", F.coalesce("id", F.lit(-1)).alias("id"), "tie", "n", "cells")
        wanted = stored(wanted, "near-wanted")
        # A text travels only if the wanted rows are too many to send to every executor.
        small = wanted.select(F.count(F.lit(1))).first()[0] <= BROADCAST_ROWS
        raw = utf8(F.col(text))
        texts = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(raw).alias("tie"), raw.alias("raw"))
        slim = wanted.select("id", "tie").distinct()
        found = texts.join(F.broadcast(slim) if small else slim, ["id", "tie"]).select("raw")

        def run(rows: pa.Table) -> dict:
            sets = shingle_sets(rows["raw"].to_pylist(), s.size)
            return {
                "digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets],
                "hashes": [x.tobytes() for x in sets],
            }

        hashed = arrow_map(found, run, "digest binary, hashes binary").dropDuplicates(["digest"])
        return wanted.select("node", "digest", "n", "cells").join(hashed, "digest").select("node", "n", "cells", "hashes")

    labels = near_classes(classes.select("node", "n", "cells"), sets_of, s)
    first = F.struct(F.col("id").isNull().alias("last"), "id", "tie")
    known = classes.join(labels, "node", "left").select("digest", first.alias("first"), F.coalesce("label", "node").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("first"))
    named = known.select("digest", "label").join(least, "label")
    named = stored(named.select("digest", F.col("first.id").alias("component_id"), F.col("first.tie").alias("first_tie")), "near-named")
    alone = F.col("digest").isNull()
    return sketch.drop("cells").join(named, "digest", "left").withColumns({
        "component_id": F.when(alone, F.col("id")).otherwise(F.col("component_id")),
        "first_tie": F.when(alone, F.col("tie")).otherwise(F.col("first_tie")),
    })


def near_duplicates(df: DataFrame, text: str, key: str, s: Scheme) -> DataFrame:
    """``key``, n_shingles, component_id (smallest key reachable) and kept (the key is its component's) for every row.

    NULL and empty texts have no shingles and stand alone. A NULL key has no order: its row joins its class and shows
    the class's smallest key, NULL if there is none. Repeated rows stay and agree. Other columns are left out.
    """
    return near_groups(df, text, key, s).select(
        F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def without_near_duplicates(df: DataFrame, text: str, key: str, s: Scheme) -> DataFrame:
    """The rows of ``df`` with all its columns, one of each group: the one with the smallest key (then text hash).

    Texts without words are in no group and all stay. What leaves is sent to the rows, not the texts to it, while
    it is few enough.
    """
    groups = near_groups(df, text, key, s).where(F.col("digest").isNotNull())
    first = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("tie") == F.col("first_tie"))
    seen = stored(groups.groupBy("id", "tie").agg(F.count(F.lit(1)).alias("rows"), F.min(first).alias("first")), "near-seen")
    leaving = seen.where(~F.col("first")).select(F.col("id").alias("_id"), F.col("tie").alias("_tie"))
    # A first row that is there several times: the whole row is grouped, and only for these.
    several = seen.where(F.col("first") & (F.col("rows") > 1)).select(F.col("id").alias("_id"), F.col("tie").alias("_tie"))

    def met(side: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        small = side.select(F.count(F.lit(1))).first()[0] <= BROADCAST_ROWS
        same = rows["_key"].eqNullSafe(side["_id"]) & (rows["_hash"] == side["_tie"])
        return rows.join(F.broadcast(side) if small else side, same, how)

    # The whole row as one column, so that no name of ``df`` can clash.
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(key).cast("long").alias("_key"), F.xxhash64(utf8(F.col(text))).alias("_hash"))
    staying = met(leaving, "left_anti", rows)
    if several.limit(1).count():
        once = met(several, "left_semi", staying).dropDuplicates(["_key", "_hash"])
        staying = met(several, "left_anti", staying).unionByName(once)
    return staying.select("row.*")


def document_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document: three words, 85 percent."""
    return near_duplicates(docs, "text", "doc_id", scheme(3, 85))
