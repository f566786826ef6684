import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import licenses
from tests.llm.data import docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    ws = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_odd_documents(spark):
    df = odd_docs(spark)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.document_licenses(df).collect()), key=str)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=str)
    assert licenses.document_licenses(docs(spark, [])).count() == 0


def test_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = licenses.document_licenses(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_notices_are_found(spark):
    rows = [(i, f"intro words\n\n{t}\n\nand then code", "en", "s") for i, t in enumerate(licenses.TEMPLATES.values())]
    rows.append((99, "CC BY-NC and cc by nc cc by nc; Apache License, Version 2", "en", "s"))
    got = {r.doc_id: r for r in licenses.document_licenses(docs(spark, rows)).collect()}
    for i, label in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    assert (got[99].n_base, got[99].base_labels) == (4, "apache-2,cc-by-nc")


VOCABULARY = [f"w{i}" for i in range(12)]


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sets(st.sampled_from(VOCABULARY), min_size=1, max_size=8), min_size=1, max_size=5),
    st.sets(st.sampled_from(VOCABULARY + ["other", "more"])),
    st.dictionaries(st.sampled_from(VOCABULARY), st.integers(0, 9)),
    st.sampled_from([0.3, 0.5, 0.8, 1.0]),
)
def test_filters_lose_nothing(templates, block, frequency, threshold):
    named = {f"t{i}": " ".join(sorted(t)) for i, t in enumerate(templates)}
    index = licenses.TemplateIndex(named, {w.encode(): n for w, n in frequency.items()}, threshold)
    want = {
        (f"t{i}", len(t & block) / len(t)) for i, t in enumerate(templates) if len(t & block) >= max(1, math.ceil(threshold * len(t) - 1e-9))
    }
    assert set(index.matches({w.encode() for w in block})) == want


@pytest.mark.parametrize("text, n", [("a\n\nb", 2), ("a\n \t\nb\nc", 2), ("a.\n...\nb", 1)])
def test_blocks(text, n):
    assert len(licenses.blocks_of(text.encode())) == n


def test_words_must_stand_together(spark):
    notice = licenses.TEMPLATES["apache-2-notice"].split()
    prose = "plain words of some other text".split()
    scattered = [w for n in notice for w in [n, *prose]]
    rows = [
        (1, "Released on Monday. " + "x " * 300 + "This work is licensed under the GNU General Public License, version 3.", "en", "s"),
        (2, " ".join(scattered), "en", "s"),
        (3, " ".join(prose * 50 + notice[:9] + ["indeed"] + notice[9:] + prose * 50), "en", "s"),
        (4, "\n\n".join(["Title", *[" ".join(notice[i : i + 6]) for i in range(0, len(notice), 6)], "code"]), "en", "s"),
        (5, "Released under the Apache License; licensed under the GNU Lesser General Public License.", "en", "s"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.document_licenses(docs(spark, rows)).collect()}
    assert got[1] == ("gpl-statement", 1.0)
    assert got[2] == ("", 0.0)
    assert all("apache-2-notice" in got[i][0].split(",") and got[i][1] == 1.0 for i in (3, 4))
    assert got[5] == ("lgpl-statement", 1.0)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from(VOCABULARY), min_size=1, max_size=8), min_size=1, max_size=4),
    st.lists(st.sampled_from(VOCABULARY + ["other", "more"]), max_size=40),
    st.sampled_from([0.5, 0.8, 1.0]),
    st.sampled_from([0, 3]),
)
def test_windows_lose_nothing(templates, text, threshold, short):
    index = licenses.TemplateIndex({f"t{i}": " ".join(t) for i, t in enumerate(templates)}, {}, threshold, short)
    want = {}
    for i, t in enumerate(templates):
        share = 1.0 if len(set(t)) <= short else threshold
        size = math.ceil(len(t) / share - 1e-9)
        best = max((len(set(text[a : a + size]) & set(t)) for a in range(len(text))), default=0)
        if best >= max(1, math.ceil(share * len(set(t)) - 1e-9)):
            want[f"t{i}"] = best / len(set(t))
    got = {}
    for label, at, c in index.windows([w.encode() for w in text]):
        got[label] = max(got.get(label, 0), c)
        assert 0 <= at < len(text)
    assert got == want
