"""Splitting texts before byte-level BPE, and encoding each distinct piece once.

Merges never cross the borders that the splitting pattern sets, so a text's ids are those of its pieces in a row.
The pattern always sets a border before white space that follows other characters. A text in which no two white
space characters touch can therefore be cut at its spaces and line feeds alone, which is much cheaper than the
pattern, and the pieces ("word,", "word") repeat. Any other text goes through the whole pattern.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The splitting pattern of byte-level BPE: a fixed value of the format.
PATTERN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", regex.V0
)
# Anything that any Unicode version may call white space, but for a line feed at the beginning (RE2 syntax).
_BLANK = r"\x0B-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
INNER_BLANK = rf"(?s)^.+[\x09\x0A{_BLANK}]|^[\x09{_BLANK}]"
# Marks that stand behind a letter as one piece of their own, however many.
MARKS = string.punctuation
# Distinct pieces kept by a worker; older ones are forgotten, which costs time and changes nothing.
PIECES_KEPT = 400_000


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, others from 256 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in itself}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


def special_ids(model: str) -> dict[str, int]:
    """Texts of the added tokens in a tokenizer file, which are found before the pattern is applied."""
    return {t["content"]: t["id"] for t in json.loads(model).get("added_tokens", [])}


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all members of many ranges, one range after the other."""
    shift = starts - (np.cumsum(counts) - counts)
    return np.arange(int(counts.sum()), dtype=np.int64) + np.repeat(shift, counts)


def sure_letters(text: str) -> bool:
    """Whether all characters are letters, and such as any Unicode version calls letters."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0500")


def as_strings(raw: pa.Array) -> pa.Array:
    """Bytes as texts; what is no UTF-8 counts as U+FFFD."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.string())


def cut_up(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The bytes of each stretch of ``flat``."""
    raw, bounds = flat.tobytes(), (flat.itemsize * offsets).tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


class Shelf:
    """Id sequences one after the other in one array that grows by doubling."""

    def __init__(self):
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.counts = np.empty(1 << 14, np.int64)
        self.rows = 0

    @staticmethod
    def _room(held: np.ndarray, wanted: int) -> np.ndarray:
        return held if wanted <= len(held) else np.concatenate([held, np.empty(max(len(held), wanted - len(held)), held.dtype)])

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Sequences of ``counts`` ids; a count of -1 marks a place without a sequence."""
        sizes = np.maximum(counts, 0)
        self.ids = self._room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        rows = self.rows + len(counts)
        self.starts, self.counts = self._room(self.starts, rows), self._room(self.counts, rows)
        self.starts[self.rows : rows] = self.used + np.cumsum(sizes) - sizes
        self.counts[self.rows : rows] = counts
        self.rows, self.used = rows, self.used + len(ids)


class PieceCoder:
    """Ids of whole texts, from ``pieces`` (ids of many pieces) and ``whole`` (ids of any text).

    ``pieces(found, spaced)`` gets pieces without white space, which stand behind a space that belongs to them if
    ``spaced``, and gives all their ids with the count of each. Texts with special tokens go through ``whole``.
    """

    def __init__(
        self,
        pieces: Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]],
        whole: Callable[[str], np.ndarray],
        specials: Sequence[str],
        kept: int = PIECES_KEPT,
    ):
        self.pieces, self.whole, self.specials, self.most = pieces, whole, list(specials), kept
        self.space, self.line = whole(" "), whole("\n")
        self._forget()

    def _forget(self) -> None:
        # Keyed by the text behind a space, or from a line feed on.
        self.shelf, self.place = Shelf(), {"": 0, "\n": 1}
        # Runs of marks behind a letter.
        self.ends: dict[str, int] = {}
        self.shelf.add(np.concatenate([self.space, self.line]), np.array([len(self.space), len(self.line)]))

    def _add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        at = self.shelf.rows
        self.shelf.add(ids, counts)
        self.place.update(zip(keys, range(at, at + len(keys))))

    def _learn(self, new: list[str]) -> None:
        """Keys not yet known: a mark behind a letter is cut off, and each distinct rest is encoded once."""
        if not new:
            return
        odd = pc.match_substring_regex(pa.array(new, pa.string()), INNER_BLANK).to_numpy(zero_copy_only=False)
        if odd.any():
            self._add([k for k, o in zip(new, odd) if o], np.zeros(0, np.uint32), np.full(int(odd.sum()), -1))
            new = [k for k, o in zip(new, odd) if not o]
        place, ended, cores, runs = self.place, [], [], []
        behind_space: dict[str, None] = {}
        behind_line: dict[str, None] = {}
        for k in new:
            core = k.rstrip(MARKS)
            if len(core) == len(k) or not core or not sure_letters(core[-1]):
                core = k
            else:
                ended.append(k)
                cores.append(core)
                runs.append(k[len(core) :])
            if core not in place:
                (behind_line if core[0] == "\n" else behind_space)[core] = None
        if behind_space:
            self._add(list(behind_space), *self.pieces(list(behind_space), True))
        if behind_line:
            ids, counts = self.pieces([k[1:] for k in behind_line], False)
            begins = np.cumsum(counts) - counts
            self._add(list(behind_line), np.insert(ids, np.repeat(begins, len(self.line)), np.tile(self.line, len(begins))), counts + len(self.line))
        if ended:
            for run in dict.fromkeys(runs):
                if run not in self.ends:
                    ids = self.whole(run)
                    self.ends[run] = self.shelf.rows
                    self.shelf.add(ids, np.array([len(ids)]))
            at = np.empty(2 * len(ended), np.int64)
            at[::2] = np.fromiter(map(place.__getitem__, cores), np.int64, len(cores))
            at[1::2] = np.fromiter(map(self.ends.__getitem__, runs), np.int64, len(runs))
            counts = self.shelf.counts[at]
            self._add(ended, self.shelf.ids[spans(self.shelf.starts[at], counts)], counts.reshape(-1, 2).sum(axis=1))

    def _special(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for mark in self.specials:
            found |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        return found

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the place of each text's first id (and of the end)."""
        if len(self.place) > self.most:
            self._forget()
        # Every text is led by a line feed, which is no part of it and parts its first piece from those behind a space.
        cut = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        listed = pc.split_pattern(cut, " ")
        coded = listed.flatten().dictionary_encode()
        # Much faster than to_pylist, which makes an Arrow scalar of each.
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = self.place
        self._learn([k for k in keys if k not in place])
        at = np.fromiter(map(place.__getitem__, keys), np.int64, len(keys))[coded.indices.to_numpy()]
        starts, counts = self.shelf.starts[at], self.shelf.counts[at]
        bounds = listed.offsets.to_numpy().astype(np.int64) - listed.offsets[0].as_py()
        first, end = bounds[:-1], bounds[1:] - 1
        # Two spaces or line feeds touch where a lone one (places 0 and 1) is not at an end of its text.
        inner = at <= 1
        inner[end] = False
        inner[first] &= at[first] == 0
        plain = ~self._special(texts)
        unknown = inner | (counts < 0)
        if unknown.any():
            within = np.concatenate([[0], np.cumsum(unknown)])
            plain &= within[bounds[1:]] == within[bounds[:-1]]
        if not plain.all():
            sizes = np.diff(bounds)
            use = np.repeat(plain, sizes)
            starts, counts = starts[use], counts[use]
            bounds = np.concatenate([[0], np.cumsum(sizes[plain])])
            first = bounds[:-1]
        lead = len(self.line)
        starts[first] += lead
        counts[first] -= lead
        ids = self.shelf.ids[spans(starts, counts)]
        offsets = np.concatenate([[0], np.cumsum(counts)])[bounds]
        if plain.all():
            return ids, offsets
        made, seen = [], 0
        values = texts.to_pylist()
        for i, simple in enumerate(plain.tolist()):
            if simple:
                made.append(ids[offsets[seen] : offsets[seen + 1]])
                seen += 1
            else:
                made.append(self.whole(values[i]))
        return np.concatenate(made), np.cumsum([0, *map(len, made)])

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        ids, offsets = self.encode_flat(pa.array(texts, pa.string()))
        return cut_up(ids.astype("<u4"), offsets)
