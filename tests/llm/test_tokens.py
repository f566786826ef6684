import hashlib
import json
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftwell.llm import bpe, presplit, token_files
from tests.llm.data import docs, odd_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ODD = [
    "", " ", "  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", "a\tb", "a \tb", "\t \tb", "a  b", "a   b", " a", "a ", "a\n\nb", "a \n b", "\r\n", "a\r\nb c",
    "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>", "don't we'll I'M 'sword ''s", "1234 5678a9", "a b c", " wide", "日本語 テキスト",
    "\U0001f469‍\U0001f4bb é é", "ſK", "=" * 300 + " end", "aaaaaaaaaaa aaaa", "\x00 \x1c \x85z", "​ ﻿ x", "a\nb\nc d", "\nstart", "end\n",
]


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(bpe.read_model(PATH))


def want(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_automaton_agrees_with_the_library(coder):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices("abcdeéß \n\t'.,1 tion the", k=rng.randint(1, 300))) for _ in range(400)]
    got = coder.encode(texts)
    for t, ids in zip(texts, got):
        assert array("I", ids).tolist() == want(t), repr(t)
        assert coder.decode(ids) == LIBRARY.decode(want(t), skip_special_tokens=False)


def test_library_coder_agrees_with_the_library():
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices("abcdeéß \n\t'.,1 tion the", k=rng.randint(1, 300))) for _ in range(400)]
    small = token_files.library_coder(bpe.read_model(PATH))
    for _ in range(2):
        assert [array("I", i).tolist() for i in small.encode(texts)] == [want(t) for t in texts]


def test_every_character_is_split_alike(coder):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 37 == 0)]
    for i in range(0, len(letters), 200):
        text = "".join(f"a{c}b {c}{c} {c}1{c} " for c in letters[i : i + 200])
        assert array("I", coder.whole(text)).tolist() == want(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(text):
    coder = bpe.bpe_of(bpe.read_model(PATH))
    ids = coder.encode([text])[0]
    assert array("I", ids).tolist() == want(text) and coder.decode(ids) == text


def plain_merges(merges, word):
    """Merging by rank, leftmost first."""
    parts = list(word)
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        pair = merges[best[0]]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_automaton_of_random_merges(data):
    """Random merge lists, also with merges that can never happen."""
    tokens, merges = ["a", "b", "c"], []
    for _ in range(data.draw(st.integers(1, 14))):
        pair = (data.draw(st.sampled_from(tokens)), data.draw(st.sampled_from(tokens)))
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    model = json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges]}})
    automaton = bpe.Automaton(model)
    for word in data.draw(st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=8)):
        assert [tokens[i] for i in automaton.encode(word.encode())] == plain_merges(merges, word)


def test_code_texts(spark):
    df = odd_docs(spark)
    got = sorted(map(tuple, bpe.code_texts(df, "text", ["doc_id"], PATH).collect()), key=str)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    rows = []
    for r in df.collect():
        ids = want(r.text or "")
        rows.append((r.doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((r.text or "").encode())))
    assert got == sorted(rows, key=str)
    assert bpe.code_texts(docs(spark, []), "text", ["doc_id"], PATH).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 5, 8, 11, 16, 17, 23, 31, 32])
def test_packing(bits):
    for n in (0, 1, 63, 64, 65, 1_000):
        ids = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        packed = token_files.pack(ids, bits)
        assert len(packed) == -(-n * bits // 8)
        assert (token_files.unpack(packed, n, bits) == ids).all()
    assert [token_files.id_bits(v) for v in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def test_random_access():
    ids = np.random.default_rng(1).integers(0, 1 << 17, 3 * token_files.BLOCK + 77).astype(np.uint32)
    file = token_files.open_file(token_files.make_file(ids, [4, None], np.array([0, 70_000]), 17, 2, 5) + b"\n")
    assert (file.part, file.piece, file.keys, file.starts.tolist()) == (2, 5, [4, None], [0, 70_000, len(ids)])
    for a, b in ((0, 1), (5, 70_000), (token_files.BLOCK - 1, token_files.BLOCK + 1), (len(ids) - 3, len(ids)), (9, 9), (0, len(ids))):
        assert (file.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        token_files.open_file(b"nothing")


@pytest.mark.parametrize("file_ids", [token_files.FILE_IDS, 50])
def test_token_files(spark, file_ids):
    df = odd_docs(spark)
    folder = token_files.work_path(spark, "tokens")
    token_files.write_token_files(df.repartition(3), "text", "doc_id", PATH, folder, file_ids=file_ids)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    ids = {}
    for r in df.collect():
        ids.setdefault(r.doc_id, []).append(zlib.crc32(np.array(want(r.text or "") + [0], "<u4").tobytes()))
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        ids[r.doc_id].remove(r.ids_crc32)
    assert not any(ids.values())


def test_empty_table(spark):
    assert token_files.documents_as_tokens(docs(spark, []), PATH).count() == 0


def test_pieces_are_forgotten(coder):
    small = presplit.PieceCoder(coder.pieces, coder.whole_ids, coder.special, 4)
    for i in range(20):
        texts = [f"kept number{i} and, then {i}.", "kept"]
        assert [array("I", x).tolist() for x in small.encode(texts)] == [want(t) for t in texts]
        assert len(small.place) <= 4 + 12


def test_long_pieces_are_walked_alone(coder):
    rng = random.Random(6)
    for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 400):
        piece = "".join(rng.choices("abetionrs", k=n))
        assert coder.automaton.encode(piece.encode()) == want(piece)


def test_texts_that_are_no_utf8():
    raw = presplit.as_strings(pa.array([b"ok", b"bad \xff\xfe end", b""]))
    assert raw.to_pylist() == ["ok", "bad \ufffd\ufffd end", ""]


def test_a_growing_file_holds_little_and_is_the_file_made_at_once():
    rng = np.random.default_rng(8)
    made, parts, counts = token_files.FileMaker(17, 3, 2), [], []
    for n in (5, 0, 3 * token_files.BLOCK, 1, token_files.BLOCK - 6, 70_000):
        sizes = np.diff(np.sort(np.concatenate([[0], rng.integers(0, n + 1, 4), [n]])))
        ids = rng.integers(0, 1 << 17, n).astype(np.uint32)
        made.add([None, *range(4)], ids, sizes)
        parts.append(ids)
        counts.append(sizes)
        assert len(made.rest) < token_files.BLOCK and made.rest.base is None and made.n == sum(map(len, parts))
    sizes = np.concatenate(counts)
    whole = token_files.make_file(np.concatenate(parts), [None, *range(4)] * 6, np.cumsum(sizes) - sizes, 17, 3, 2)
    assert made.batch()["file"][0].as_py() == whole


def test_words_go_to_the_model_without_the_pattern(monkeypatch):
    seen, real = [], Tokenizer

    class Watched:
        def __init__(self, model):
            self.inner = real.from_str(model)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **settings):
            seen.extend(texts)
            return self.inner.encode_batch_fast(texts, **settings)

    monkeypatch.setattr("tokenizers.Tokenizer", type("Watching", (), {"from_str": Watched}))
    coder = token_files._library_coder(bpe.read_model(PATH))
    del seen[:]
    found = ["plain", "don't", "äpfel", "x1", "Ωмега", "日本", "ét", "ª"]
    for spaced in (True, False):
        ids, counts = coder.pieces(found, spaced)
        ends = np.cumsum(counts)
        got = [ids[e - c : e].tolist() for c, e in zip(counts, ends)]
        assert got == [want(" " + p if spaced else p) for p in found]
    assert not any(p in t for p in ("plain", "äpfel", "Ωмега", "ª") for t in seen)


def test_words_before_marks_are_encoded_once():
    asked = []
    inner = token_files.library_coder(bpe.read_model(PATH))

    def pieces(found, spaced):
        asked.extend(found)
        return inner.pieces(found, spaced)

    small = presplit.PieceCoder(pieces, inner.whole, inner.specials)
    texts = ["word word, word&&& word*** word!'. it's' ,, '", "word?!\nword\nline$$$ don't!! a-' x'\"s <|endoftext word|>", "Ã± Ã±... 日本。 日本,"]
    assert [array("I", x).tolist() for x in small.encode(texts)] == [want(t) for t in texts]
    assert [p for p in asked if p.startswith(("word", "line", "don't"))] == ["word", "don't", "word", "line"]
