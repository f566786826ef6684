"""BPE encoding and decoding with a deterministic tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. It starts as one state
with an arc to itself for each byte. A merge (u, v) -> uv is applied as a gadget: the state that all u-arcs lead to
is copied without its v-arc, u-arcs are led to the copy (u can no longer be followed by v), and every state with a
u-arc gets a uv-arc to where v led. All arcs of one label lead to one state, so the automaton has one state per merge
at most, and a state is named by its label.

The arcs of a state are all labels but those that gadgets took away. What was taken is one table of gadgets (label,
label -> time), and per label the parts along which it was handed on, so an arc is a few look-ups in integer tables
instead of a row of a quadratic one. A second table moves over bytes: after each byte it gives the longest label that
ends there, and each label names the next shorter one. A piece has exactly one accepted sequence, and its prefixes'
sequences are accepted too, so the last label of every prefix is the longest one whose arc exists. Many pieces are
walked at once, byte by byte. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.presplit import PATTERN, PieceCoder, as_strings, byte_letters, cut_up, spans, special_ids
from driftwell.llm.rows import arrow_map, as_text, kept, utf8

# Distinct pieces kept by a worker; what is forgotten is found again.
WORDS_KEPT = 200_000
# Pieces of up to so many bytes are walked many at once, longer ones one by one.
LONG = 64
# Odd multiplier that spreads pairs of labels over the table of gadgets.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Numbers:
    """A fixed table from whole numbers to whole numbers, looked up for many at once."""

    def __init__(self, entries: dict[int, int], missing: int):
        bits = max(4, (4 * len(entries)).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, missing, np.int32)
        for key, value in entries.items():
            at = ((key * int(SPREAD)) & (1 << 64) - 1) >> 64 - bits
            while self.keys[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.values[at] = key, value

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = (keys.astype(np.uint64) * SPREAD >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.missing)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & self.mask
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Automaton:
    """Tables made by successive merge gadgets over a byte-level vocabulary.

    All arcs of a label lead to one state, so a state is named by its label. ``copies`` holds every gadget: that the
    state of u was copied without its v-arc, and when. The state of a label made of (x, y) started as the state of y at
    that time, so what it lacks are its own copies and, back along the right parts, those made before each was joined.
    """

    def __init__(self, model: str):
        spec = json.loads(model)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        vocab: dict[str, int] = spec["vocab"]
        letters = byte_letters()
        as_byte = {letter: b for b, letter in enumerate(letters)}
        self.size = max(vocab.values(), default=-1) + 1
        self.labels: list[bytes] = [b""] * self.size
        self.copies: dict[int, int] = {}
        # Per label: (part, time before which its copies or arcs count), from the whole label along its right or left parts.
        self.rights: list[tuple[tuple[int, int], ...]] = [()] * self.size
        self.lefts: list[tuple[tuple[int, int], ...]] = [()] * self.size
        self.ids: dict[bytes, int] = {}
        self.never = len(merges)
        for letter in letters:
            if letter in vocab:
                i = vocab[letter]
                self.labels[i] = bytes([as_byte[letter]])
                self.ids[self.labels[i]] = i
                self.rights[i] = self.lefts[i] = ((i, self.never),)
        for time, (u, v) in enumerate(merges):
            self._merge(time, vocab[u], vocab[v], vocab[u + v], bytes(as_byte[c] for c in u + v))
        self._compile()

    def _merge(self, time: int, u: int, v: int, uv: int, label: bytes) -> None:
        self.labels[uv] = label
        # A part without arcs, or parts that cannot follow each other by now, never meet: the merge adds nothing.
        if not self.rights[u] or not self.rights[v] or not self._follows(u, v):
            return
        self.rights[uv] = ((uv, self.never), *[(p, min(t, time)) for p, t in self.rights[v]])
        self.lefts[uv] = ((uv, self.never), *[(p, min(t, time)) for p, t in self.lefts[u]])
        self.copies[u * self.size + v] = time
        self.ids[label] = uv

    def _follows(self, a: int, b: int) -> bool:
        copies, size = self.copies, self.size
        for w, had in self.lefts[b]:
            for u, before in self.rights[a]:
                made = copies.get(u * size + w)
                # A copy takes arcs that exist by its time; the label made at that very time is not led through it.
                if made is not None and made < before and made <= had:
                    return False
        return True

    def _compile(self) -> None:
        """Integer tables: moves over bytes, longest and next shorter labels, parts of labels, gadgets."""
        nodes, moves, depth = {b"": 0}, {}, [0]
        for label in sorted(self.ids, key=len):
            for n in range(1, len(label) + 1):
                if label[:n] not in nodes:
                    moves[nodes[label[: n - 1]] << 8 | label[n - 1]] = len(nodes)
                    nodes[label[:n]] = len(nodes)
                    depth.append(n)
        self.moves = Numbers(moves, -1)
        self.longest = np.full(len(nodes), -1, np.int32)
        for label, number in self.ids.items():
            self.longest[nodes[label]] = number
        self.length = np.array([len(x) for x in self.labels] + [0], np.int64)
        # Where no byte leads on, the walk goes on from the longest proper ending that is a beginning of a label.
        self.fall = np.zeros(len(nodes), np.int32)
        self.shorter = np.full(self.size + 1, -1, np.int32)
        edges = np.array([(key >> 8, key & 255, node) for key, node in moves.items()], np.int64).reshape(-1, 3)
        depths = np.array(depth, np.int64)[edges[:, 2]]
        for d in range(1, int(depths.max(initial=0)) + 1):
            parent, byte, node = edges[depths == d].T
            if d > 1:
                self.fall[node] = self._step(self.fall[parent].astype(np.int64), byte)
            behind, own = self.longest[self.fall[node]], self.longest[node]
            self.shorter[own[own >= 0]] = behind[own >= 0]
            self.longest[node] = np.where(own >= 0, own, behind)
        for name, parts in (("right", self.rights), ("left", self.lefts)):
            counts = np.array([len(p) for p in parts], np.int64)
            flat = np.array([x for p in parts for x in p], np.int32).reshape(-1, 2)
            setattr(self, name, (np.cumsum(counts) - counts, counts, flat[:, 0].copy(), flat[:, 1].copy()))
        self.gadgets = Numbers(self.copies, self.never)
        # What the tables hold is not held twice.
        del self.rights, self.lefts, self.copies, self.ids

    def _step(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The longest beginning of a label that ends with the next byte, for many walks at once."""
        at = nodes.copy()
        out = self.moves.get(at << 8 | bytes_)
        rest = np.flatnonzero((out < 0) & (at > 0))
        while len(rest):
            at[rest] = self.fall[at[rest]]
            out[rest] = self.moves.get(at[rest] << 8 | bytes_[rest])
            rest = rest[(out[rest] < 0) & (at[rest] > 0)]
        return np.maximum(out, 0).astype(np.int64)

    def has_arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each label may follow in the state of the same place."""
        (r_at, r_n, r_part, r_time), (l_at, l_n, l_part, l_time) = self.right, self.left
        rights, lefts = r_n[states], l_n[labels]
        counts = rights * lefts
        owner = np.repeat(np.arange(len(states)), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        left = l_at[labels][owner] + place // rights[owner]
        right = r_at[states][owner] + place % rights[owner]
        made = self.gadgets.get(r_part[right].astype(np.int64) * self.size + l_part[left])
        taken = (made < r_time[right]) & (made <= l_time[left])
        ok = np.ones(len(states), bool)
        ok[owner[taken]] = False
        return ok

    def encode_many(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The one accepted label sequence of each piece: all ids one piece after the other, and their counts."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(pieces), np.uint8)
        # last[starts + j] is the last label of the piece's first j + 1 bytes.
        last = np.full(len(text), -1, np.int64)
        for k in order[: int((lengths > LONG).sum())]:
            self._walk(text, last, int(starts[k]), int(lengths[k]))
        few = order[int((lengths > LONG).sum()) :]
        node = np.zeros(len(few), np.int64)
        ends = np.searchsorted(-lengths[few], -np.arange(LONG + 1), side="left")
        for j in range(int(lengths[few[0]]) if len(few) else 0):
            # Pieces longer than j: they come first.
            n = int(ends[j])
            here = starts[few[:n]]
            node = self._step(node[:n], text[here + j].astype(np.int64))
            self._settle(last, here, np.full(n, j, np.int64), self.longest[node].astype(np.int64))
        counts = np.zeros(len(pieces), np.int64)
        # Back from the ends: every step takes one label off each unfinished piece.
        left, found = np.flatnonzero(lengths > 0), []
        place = starts + lengths - 1
        while len(left):
            label = last[place[left]]
            if (label < 0).any():
                raise ValueError("the vocabulary does not spell these bytes")
            found.append((left, label))
            counts[left] += 1
            place[left] -= self.length[label]
            left = left[place[left] >= starts[left]]
        out = np.empty(int(counts.sum()), np.uint32)
        at = np.cumsum(counts) - 1
        for step, (which, label) in enumerate(found):
            out[at[which] - step] = label
        return out, counts

    def _settle(self, last: np.ndarray, here: np.ndarray, j: np.ndarray, label: np.ndarray) -> None:
        """Set the last label of each prefix ending at ``here + j``: the longest whose arc exists."""
        open_ = np.flatnonzero(label >= 0)
        while len(open_):
            begin = j[open_] - self.length[label[open_]]
            ok = begin < 0
            inner = np.flatnonzero(~ok)
            before = last[here[open_[inner]] + begin[inner]]
            fits = before >= 0
            fits[fits] = self.has_arcs(before[fits], label[open_[inner[fits]]])
            ok[inner] = fits
            done = open_[ok]
            last[here[done] + j[done]] = label[done]
            open_ = open_[~ok]
            label[open_] = self.shorter[label[open_]]
            open_ = open_[label[open_] >= 0]

    def _walk(self, text: np.ndarray, last: np.ndarray, start: int, length: int) -> None:
        """One long piece, byte by byte."""
        raw, longest, shorter, size = text[start : start + length].tolist(), self.longest, self.shorter, self.length
        ends, node, known, moved = [-1] * length, 0, {}, {}
        for j, byte in enumerate(raw):
            key = node << 8 | byte
            if key not in moved:
                moved[key] = int(self._step(np.array([node]), np.array([byte]))[0])
            node = moved[key]
            label = int(longest[node])
            while label >= 0:
                begin = j - int(size[label])
                if begin < 0:
                    break
                before = ends[begin]
                if before >= 0:
                    arc = known.get((before, label))
                    if arc is None:
                        arc = known[before, label] = bool(self.has_arcs(np.array([before]), np.array([label]))[0])
                    if arc:
                        break
                label = int(shorter[label])
            ends[j] = label
        last[start : start + length] = ends

    def encode(self, piece: bytes) -> list[int]:
        """The one accepted token sequence that spells ``piece``."""
        return self.encode_many([piece])[0].tolist()


class Bpe:
    """Whole texts to ids and back, as a byte-level tokenizer file describes."""

    def __init__(self, model: str):
        self.automaton = Automaton(model)
        self.special = special_ids(model)
        labels = self.automaton.labels
        del self.automaton.labels
        for text, number in self.special.items():
            labels.extend([b""] * (number + 1 - len(labels)))
            labels[number] = text.encode()
        self.sizes = np.array([len(x) for x in labels], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(labels), np.uint8)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.finder = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.coder = PieceCoder(self.pieces, self.whole_ids, longest_first, WORDS_KEPT)

    def _parts(self, pieces: Sequence[str], lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens behind ``lead``, and their counts; equal parts are walked once."""
        number: dict[str, int] = {}
        find = PATTERN.findall
        cut = [[lead + p] if p.isascii() and p.isalpha() else find(lead + p) for p in pieces]
        places = np.array([number.setdefault(w, len(number)) for parts in cut for w in parts], np.int64)
        ids, counts = self.automaton.encode_many([w.encode() for w in number])
        starts = np.cumsum(counts) - counts
        bounds = np.cumsum([0, *map(len, cut)])
        each = counts[places]
        return ids[spans(starts[places], each)], np.diff(np.concatenate([[0], np.cumsum(each)])[bounds])

    def pieces(self, pieces: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        return self._parts(pieces, " " if spaced else "")

    def whole_ids(self, text: str) -> np.ndarray:
        parts = self.finder.split(text) if self.finder else [text]
        made = [np.array([self.special[p]], np.uint32) if i % 2 else self._parts([p])[0] for i, p in enumerate(parts)]
        return np.concatenate(made)

    def whole(self, text: str) -> bytes:
        return self.whole_ids(text).astype("<u4").tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.coder.encode(texts)

    def emit(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the labels of many texts' ids, and the place of each text's first byte (and of the end)."""
        sizes = self.sizes[ids]
        return self.spelled[spans(self.begins[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])[offsets]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        return self.emit(numbers, np.array([0, len(numbers)]))[0].tobytes().decode("utf-8", "replace")


def bpe_of(model: str) -> Bpe:
    """The compiled automaton, kept by a worker while it encodes."""
    return kept(hashlib.sha256(model.encode()).hexdigest(), partial(Bpe, model))


def read_model(path: str) -> str:
    """A tokenizer file's content, read by the driver and sent along with the tasks (a few MB whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def code_texts(df: DataFrame, text: str, keys: Sequence[str], path: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keys``, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` also ``ids`` (as 32-bit integers) or ``decoded``.

    NULL and empty texts have no ids and decode to the empty text. Bytes that are no UTF-8 count as U+FFFD. Repeated rows
    stay; other columns are left out; an empty table gives an empty one.
    """
    model = df.sparkSession.sparkContext.broadcast(read_model(path))
    names = [f"k{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], utf8(F.col(text)).alias("raw"))
    fields = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names)
    extra = "".join(f", {c} {kind}" for c, kind in (("ids", "binary"), ("decoded", "string")) if c in keep)

    def code(rows: pa.Table) -> dict:
        bpe = bpe_of(model.value)
        numbers, offsets = bpe.coder.encode_flat(as_strings(rows["raw"].combine_chunks()))
        spelled, ends = bpe.emit(numbers, offsets)
        ids = cut_up(numbers.astype("<u4"), offsets)
        decoded = [as_text(d) for d in cut_up(spelled, ends)]
        out = {n: rows[n] for n in names} | {
            "n_tokens": np.diff(offsets),
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
        }
        return out | {"ids": ids, "decoded": decoded}

    made = arrow_map(slim, code, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}", keeps=True)
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *made.columns[len(names) :])
