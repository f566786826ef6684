import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import graphs, near_text, near_vectors
from tests.llm.data import docs, odd_docs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size=3, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    edges = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    label = classes(len(rows), edges)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, len(s), least.get(c), i == least.get(c)) for (i, _), c, s in zip(rows, label, sets)), key=str)


def family(n, length, edits, seed):
    """A base text, ``n`` edited copies, and copies of copies."""
    rng, pool = random.Random(seed), words(4_000, seed)
    base = rng.choices(pool, k=length)
    out = []
    for _ in range(n):
        w = list(rng.choice(out) if out and rng.random() < 0.3 else base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        out.append(w)
    return [" ".join(w) for w in out]


def test_odd_documents(spark):
    df = odd_docs(spark)
    got = sorted(map(tuple, near_text.document_duplicates(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    assert near_text.document_duplicates(docs(spark, [])).count() == 0
    nothing = docs(spark, [(1, None, None, None), (2, " ", None, None)])
    assert sorted(map(tuple, near_text.document_duplicates(nothing).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("size, percent", [(3, 85)])
def test_families_of_near_copies(spark, size, percent):
    """Hot groups of copies and near copies around the threshold, chains, and texts that share a passage."""
    texts = family(150, 120, 9, 1) + family(60, 40, 3, 2) + family(30, 300, 20, 3) + ["the same text for all of these " * 3] * 50
    passage = " ".join(words(60, 9))
    texts += [passage + " " + " ".join(words(80, 100 + i)) for i in range(80)]
    rows = list(enumerate(texts))
    random.Random(0).shuffle(rows)
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = near_text.near_duplicates(df, "text", "doc_id", near_text.scheme(size, percent)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, size, percent)


def test_block_route_alone_is_exact(spark, monkeypatch):
    monkeypatch.setattr(near_text, "HUB_ROUNDS", 0)
    monkeypatch.setattr(near_text, "BLOCK", 16)
    rows = list(enumerate(family(90, 80, 7, 5)))
    got = near_text.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows]), "text", "doc_id", near_text.scheme(3, 85)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_pigeonhole_loses_no_pair_within_the_distance():
    rng = np.random.default_rng(2)
    for s in (near_text.scheme(3, 85), near_text.scheme(5, 80, cells=96)):
        keys = near_text.index_keys(s)
        for _ in range(200):
            a = rng.integers(0, 256, s.cells, dtype=np.uint8)
            b = a.copy()
            at = rng.choice(s.cells, s.distance, replace=False)
            b[at] ^= 1
            both = near_text.bucket_keys(np.stack([a, b]), keys)
            assert (both[0] == both[1]).any()


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    texts = [b"One  two\tTHREE", b"", b"   ", "é ü one two three".encode(), b"x" * 5_000, b"a b " * 900]
    whole, counts = near_text.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(near_text, "_PIECE", 64)
    pieces, _ = near_text.word_hashes(texts)
    distinct = {w.lower() for t in texts for w in t.split()}
    assert (whole == pieces).all() and whole[0] == whole[5] and len(set(whole.tolist())) == len(distinct)


def test_one_row_of_each_group_stays(spark):
    texts = family(40, 60, 3, 7)
    rows = [(i % 30, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[3]), (50, ""), (51, None), (None, None)]
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    kept = near_text.without_near_duplicates(df, "text", "doc_id", near_text.scheme(3, 85))
    assert kept.columns == df.columns
    sets = [shingles(t, 3) for _, t in rows]
    label = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    groups = {c for c, s in zip(label, sets) if s}
    got = kept.collect()
    assert sum(bool(r.text) for r in got) == len(groups) and sum(not r.text for r in got) == 3


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300) if i % 20] + [(500, 500 + i) for i in range(1, 90)] + [(rng.randrange(1_000, 1_200), rng.randrange(1_000, 1_200)) for _ in range(60)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = classes(1_300, edges)
    assert got == {i: label[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert graphs.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("node", "id", "sim", "root", "links")})


def brute_vectors(rows):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v, _ in rows]
    unit = [np.array(v) / np.linalg.norm(v) if good else None for (_, v, _), good in zip(rows, ok)]
    linked = lambda i, j: ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.9
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if linked(i, j)]
    label = classes(len(rows), edges)
    least, links = {}, [0] * len(rows)
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    for (i, _, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((r[0], n, least.get(c), r[0] == least.get(c)) for r, n, c in zip(rows, links, label)), key=str)


def test_odd_vectors(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, 0.0], 0),
        (8, [2.0, 0.0], 1), (9, [1.0, 0.0], 2), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 0), (11, [-1.0, 0.0], 0), (None, [1.0, 0.1], 0), (None, [0.0, 1.0], 0), (12, [-0.0, 1.0], 0),
    ]
    got = sorted(map(tuple, near_vectors.near_vectors(vectors(spark, rows), "embedding", "vec_id").collect()), key=str)
    assert got == brute_vectors(rows)
    assert near_vectors.embedding_duplicates(vectors(spark, [])).count() == 0


def test_clusters_among_random_vectors(spark):
    """A hot clique of near copies, pairs, exact copies and a chain among vectors that are near nothing."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 32))
    hot = rng.normal(size=32)
    x[:200] = hot + rng.normal(size=(200, 32)) * 0.12
    for i in range(200, 260, 2):
        x[i + 1] = x[i] + rng.normal(size=32) * 0.2
    x[260:290] = x[260]
    for i in range(290, 310):
        x[i + 1] = x[i] + rng.normal(size=32) * 0.33
    rows = [(int(i), x[i].tolist(), 0) for i in rng.permutation(900)]
    got = sorted(map(tuple, near_vectors.embedding_duplicates(vectors(spark, rows)).collect()), key=str)
    want = brute_vectors(rows)
    right = sum(a == b for a, b in zip(got, want))
    assert right / len(want) >= 0.99 and sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)


def test_tight_groups_linked_with_each_other(spark):
    """Groups whose lists are full of their own members, linked at 0.92 in a chain, and one that stays apart."""
    rng = np.random.default_rng(8)

    def turned(v, cosine):
        r = rng.normal(size=v.size)
        r -= r @ v * v
        return cosine * v + math.sqrt(1 - cosine**2) * r / np.linalg.norm(r)

    def group(centre, n):
        return [turned(centre, 0.9995) for _ in range(n)]

    unit = lambda: (lambda r: r / np.linalg.norm(r))(rng.normal(size=32))
    first = unit()
    second = turned(first, 0.92)
    third = turned(second, 0.92)
    x = group(first, 15) + group(second, 15) + group(third, 200) + group(unit(), 40) + [unit() for _ in range(400)]
    rows = [(int(i), x[i].tolist(), 0) for i in rng.permutation(len(x))]
    got = sorted(map(tuple, near_vectors.embedding_duplicates(vectors(spark, rows)).collect()), key=str)
    assert got == brute_vectors(rows)


def test_lone_pairs_are_found(spark, monkeypatch):
    """Pairs just above the threshold among vectors that link with nothing; the few sampled ones hardly have links."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(9_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 600, 2):
        r = rng.normal(size=48)
        r -= r @ x[i] * x[i]
        x[i + 1] = 0.901 * x[i] + math.sqrt(1 - 0.901**2) * r / np.linalg.norm(r)
    monkeypatch.setattr(near_vectors, "AUDIT", 5)
    monkeypatch.setattr(near_vectors, "ROUNDS", 1)
    rows = [(int(i), x[i].tolist(), 0) for i in rng.permutation(len(x))]
    got = near_vectors.embedding_duplicates(vectors(spark, rows)).collect()
    found = sum(r.n_links for r in got)
    print("links found of 600:", found)
    assert 0.985 * 600 <= found <= 600 and not any(r.n_links for r in got if r.vec_id >= 600)


def test_audit_is_never_empty(spark):
    """Searches that find too little are told, though no vector of the table has a link."""
    x = np.eye(30)
    nodes = spark.createDataFrame([(i, 30, bytearray(x[i].tobytes())) for i in range(30)], "node long, dim int, vec binary")
    assert near_vectors.true_links(nodes.withColumn("weight", F.lit(1))) == {}
    planted = near_vectors.planted_partners(near_vectors.audit_sample(nodes))
    made = {r.node: np.frombuffer(bytes(r.vec)) for r in planted.collect()}
    assert len(made) == 30 and all(0.9 <= v @ x[-1 - i] < 0.90001 for i, v in made.items())
    found = spark.createDataFrame([(-1 - i, i, 0.9) for i in range(24)], near_vectors._NEAR)
    assert near_vectors.planted_recall(planted, found) == 0.8
    assert near_vectors.tree_count(0) == near_vectors.TREES
    for bits in (8, 11, 14, 17):
        share = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - share) ** near_vectors.tree_count(bits) >= 0.99
