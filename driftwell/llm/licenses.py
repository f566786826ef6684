"""License scan: phrase matches and an exact set-containment join of word windows with license templates.

A document matches a template if at least ``threshold`` of the template's distinct words stand in a window of
consecutive words, which is longer than the template by the same measure; blank lines and line ends are no borders.
Templates of at most SHORT distinct words need all of them, in a window as long as the template.

Only a text that holds enough of a template's words anywhere can have such a window, so whole texts are blocks of a
set-containment join first, and windows slide over those that pass. Words are ordered by how many paragraphs of the
whole corpus hold them, rarest first. If a block holds o words of a template, then one of the template's first
|T| - o + 1 words is also among the block's first |B| - o + 1 words (prefix filter), the block has at least o words
(length filter), and from the place of the first common word at most 1 + min(words left in either) can be common
(position filter). What passes is counted in full, so nothing is missed and nothing is guessed. Words in no template
cannot be common and are dropped from blocks first.

The templates are a fixed list, so their index travels with the tasks; documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.rows import arrow_map, utf8

THRESHOLD = 0.8
SHORT = 12

# Phrases and the labels they stand for.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The usual notices of public licenses, and short statements.
TEMPLATES = {
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so""",
    "apache-2-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "bsd-notice": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""",
    "lgpl-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
your option) any later version.""",
    "mpl-2-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "isc-notice": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "cc-by-nc-notice": """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International
License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/""",
    "cc-by-sa-notice": """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.
To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/""",
    "unlicense-notice": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
    "released-mit": "Released under the MIT License.",
    "gpl-statement": "licensed under the GNU General Public License",
    "lgpl-statement": "licensed under the GNU Lesser General Public License",
    "agpl-statement": "licensed under the GNU Affero General Public License",
    "bsd-statement": "licensed under the BSD License",
    "mpl-statement": "licensed under the Mozilla Public License",
    "cc-by-statement": "Licensed under CC BY 4.0",
    "cc-by-sa-statement": "Licensed under CC BY-SA",
    "cc-by-nc-statement": "Licensed under CC BY-NC",
}

# Words are runs of a-z (A-Z lowered), 0-9 and non-ASCII bytes; all other ASCII parts them. Line feeds stay for blocks.
_KEPT = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 or i == 10 else 32 for i in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_KEPT).split()


def blocks_of(raw: bytes) -> list[set[bytes]]:
    """Distinct words of each paragraph. Only truly blank lines part paragraphs (punctuation lines do not)."""
    return [set(words_of(p)) for p in re.split(rb"\n[ \t\r]*\n", raw)]


def phrase_places(words: Sequence[bytes], phrases: Mapping[str, str]) -> tuple[list[int], set[str]]:
    """Word numbers at which a phrase starts (one entry per phrase and place) and the labels found."""
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        at = line.find(wanted)
        while at >= 0:
            places.append(line.count(b" ", 0, at))
            labels.add(label)
            at = line.find(wanted, at + 1)
    return places, labels


class Template(NamedTuple):
    label: str
    words: tuple[int, ...]  # word numbers in the global order, ascending
    needed: int
    window: int  # consecutive words in which the needed ones must stand


class TemplateIndex:
    """Templates over globally ordered words, and the places of their prefix words."""

    def __init__(self, templates: Mapping[str, str], frequency: Mapping[bytes, int], threshold: float, short: int = 0):
        sets = {label: set(words_of(text.encode())) for label, text in templates.items()}
        known = sorted(set().union(*sets.values()), key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(known)}
        self.vocabulary = frozenset(known)
        self.templates = []
        for label, s in sorted(sets.items()):
            length = len(words_of(templates[label].encode()))
            share = 1.0 if len(s) <= short else threshold
            needed, window = max(1, math.ceil(share * len(s) - 1e-9)), math.ceil(length / share - 1e-9)
            if s:
                self.templates.append(Template(label, tuple(sorted(self.order[w] for w in s)), needed, window))
        self.named = {t.label: t for t in self.templates}
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(self.templates):
            for j, w in enumerate(template.words[: len(template.words) - template.needed + 1]):
                self.prefix[w].append((t, j))
        self.least = min((t.needed for t in self.templates), default=0)

    def matches(self, block: set[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that ``block`` contains to the threshold."""
        common = self.vocabulary & block
        if len(common) < max(1, self.least):
            return []
        ranks = sorted(self.order[w] for w in common)
        have = frozenset(ranks)
        found, seen = [], set()
        for i, w in enumerate(ranks):
            for t, j in self.prefix.get(w, ()):
                if t in seen:
                    continue
                # The first common prefix word settles the pair: prefixes are ascending in one order.
                seen.add(t)
                template = self.templates[t]
                o, size = template.needed, len(template.words)
                if len(ranks) < o or i > len(ranks) - o or 1 + min(len(ranks) - i - 1, size - j - 1) < o:
                    continue
                overlap = sum(x in have for x in template.words)
                if overlap >= o:
                    found.append((template.label, overlap / size))
        return found


    def windows(self, words: Sequence[bytes]) -> list[tuple[str, int, float]]:
        """(label, place, containment) of each template and stretch of ``words`` with a window that matches: its best window."""
        made = []
        candidates = self.matches(set(words))
        if not candidates:
            return made
        hits = [(i, self.order[w]) for i, w in enumerate(words) if w in self.vocabulary]
        for label, _ in candidates:
            template = self.named[label]
            mine = frozenset(template.words)
            inside: deque[tuple[int, int]] = deque()
            held: Counter[int] = Counter()
            end, best, place = -1, 0, 0
            for i, w in hits:
                if w not in mine:
                    continue
                inside.append((i, w))
                held[w] += 1
                while i - inside[0][0] >= template.window:
                    gone = inside.popleft()[1]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                if len(held) < template.needed:
                    continue
                # Windows that overlap the stretch so far belong to it.
                if best and inside[0][0] > end:
                    made.append((label, place, best / len(mine)))
                    best = 0
                end = i
                if len(held) > best:
                    best, place = len(held), inside[0][0]
            if best:
                made.append((label, place, best / len(mine)))
        return made


def block_frequency(df: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Blocks of the whole table that hold each word of ``vocabulary``; the driver gets one row per such word."""

    def count(rows: pa.Table) -> dict:
        seen: Counter[bytes] = Counter()
        for raw in rows["raw"].to_pylist():
            for block in blocks_of(raw):
                seen.update(vocabulary & block)
        return {"word": list(seen), "blocks": list(seen.values())}

    counted = arrow_map(df.select(utf8(F.col(text)).alias("raw")), count, "word binary, blocks long")
    return {bytes(w): n for w, n in counted.groupBy("word").agg(F.sum("blocks")).collect()}


def scan_licenses(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``keys``, n_words, places, base_labels, matches (label, word number, containment) for each row.

    NULL and empty texts have no words, no places and no matches. Repeated rows stay; other columns are left out.
    """
    vocabulary = frozenset().union(*(words_of(t.encode()) for t in templates.values()))
    index = TemplateIndex(templates, block_frequency(df, text, vocabulary), threshold, SHORT)
    names = [f"k{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], utf8(F.col(text)).alias("raw"))
    fields = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names)

    def scan(rows: pa.Table) -> dict:
        out: dict = {n: rows[n] for n in names} | {"n_words": [], "places": [], "base_labels": [], "matches": []}
        for raw in rows["raw"].to_pylist():
            words = words_of(raw)
            places, labels = phrase_places(words, phrases)
            out["n_words"].append(len(words))
            out["places"].append(sorted(places))
            out["base_labels"].append(sorted(labels))
            out["matches"].append([
                {"label": label, "place": at, "containment": c} for label, at, c in index.windows(words)
            ])
        return out

    made = arrow_map(
        slim,
        scan,
        f"{fields}, n_words long, places array<long>, base_labels array<string>, "
        "matches array<struct<label: string, place: long, containment: double>>",
    )
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n_words", "places", "base_labels", "matches")


def document_licenses(docs: DataFrame) -> DataFrame:
    """One digest row per document. The score is the best containment of a matched template, 1 for a phrase, else 0."""
    found = scan_licenses(docs, "text", ["doc_id"])
    every = F.array_sort(F.array_union("base_labels", F.array_distinct(F.col("matches.label"))))
    best = F.array_max(F.concat(F.array(F.when(F.size("places") > 0, 1.0).otherwise(0.0)), F.col("matches.containment")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        best.alias("score"),
    )
