import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import rules
from tests.llm.data import docs, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(repeated),
    }


def test_counts_by_brute_force():
    rng = random.Random(1)
    texts = ["", " ", "\n", "a", "one two three four five", "a b c d e a b c d e", "x\ny\nx\n x\n\nx", "é\u00a0ß # *$%&|<>", "a " * 50, "\x00\x1c \x85"]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", "dd ", "é", "#", "\t", "\r\n"], k=rng.randint(1, 120))) for _ in range(300)]
    made = rules.text_counts([t.encode() for t in texts])
    assert set(made) == set(rules.COUNTS)
    for i, t in enumerate(texts):
        assert {k: int(made[k][i]) for k in brute("")} == brute(t), repr(t)


def test_windows_whose_keys_collide(monkeypatch):
    ids, of = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9]), np.zeros(11, np.int64)
    want = [True] * 10 + [False]
    assert rules.repeated_words(ids, of).tolist() == want
    # All windows get one key.
    monkeypatch.setattr(rules, "SPREAD", np.uint64(0))
    assert rules.repeated_words(ids, of).tolist() == want


@pytest.mark.parametrize("seed", range(5))
def test_planted_conjunctions_are_found(seed):
    rng = np.random.default_rng(seed)
    x = {"symbols_per_word": rng.random(3_000), "upper_share": rng.random(3_000), "words": rng.integers(1, 500, 3_000).astype(float)}
    y = (x["symbols_per_word"] > 0.7) & (x["upper_share"] > 0.5) | (x["words"] <= 40)
    found = rules.learn_rules(x, y, rng.random(3_000) < 1 / 3, 0.9)
    hit = np.zeros(3_000, bool)
    for r in found:
        hit |= rules.covers(r, x, 3_000)
    assert found and (hit == y).mean() > 0.985
    assert all(c.ratio in x for r in found for c in r)


def test_growing_and_pruning_by_brute_force():
    rng = np.random.default_rng(3)
    x = {"words": rng.integers(0, 12, 60).astype(float), "upper_share": rng.integers(0, 7, 60) / 7}
    y = (x["words"] > 6) ^ (rng.random(60) < 0.1)
    rule = rules.grow_rule(x, y)
    p0, n0 = y.sum(), (~y).sum()

    def gain(c):
        held = rules.covers((c,), x, 60)
        p, n = (held & y).sum(), (held & ~y).sum()
        return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else -np.inf

    cuts = [rules.Condition(k, above, (a + b) / 2) for k, v in x.items() for a, b in zip(np.unique(v), np.unique(v)[1:]) for above in (True, False)]
    assert gain(rule[0]) == pytest.approx(max(map(gain, cuts)))
    assert rules.covers(rule, x, 60)[~y].sum() == 0
    worth = lambda r: (lambda h: ((h & y).sum() - (h & ~y).sum()) / h.sum())(rules.covers(r, x, 60))
    pruned = rules.prune_rule(rule, x, y)
    assert worth(pruned) == max(worth(rule[: i + 1]) for i in range(len(rule)))


def test_nothing_to_learn():
    x, part = {"words": np.arange(9.0)}, np.arange(9) % 3 == 0
    for y in (np.zeros(9, bool), np.ones(9, bool)):
        assert rules.learn_rules(x, y, part) == []
    assert rules.learn_rules({"words": np.zeros(0)}, np.zeros(0, bool), np.zeros(0, bool)) == []


def test_expression_agrees_with_the_rules(spark):
    df = rules.counted(odd_docs(spark), "text", {"doc_id": "doc_id"})
    found = [(rules.Condition("words", False, 1.5), rules.Condition("upper_share", True, 0.25)), (rules.Condition("words", True, 20.5),)]
    rows = df.select("*", *[F.expr(e).alias(f"r_{n}") for n, e in rules.RATIOS.items()], rules.verdict(found).alias("rule")).collect()
    for r in rows:
        x = {n: np.array([r[f"r_{n}"]]) for n in rules.RATIOS}
        assert r.rule == next((i for i, rule in enumerate(found, 1) if rules.covers(rule, x, 1)[0]), 0)
    assert {r.rule for r in rows} == {0, 1, 2}


def test_held_out_documents(spark):
    """The list of some labels agrees with the other labels on documents that the base lets through."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    learn = labels.where("doc_id % 2 = 0")
    out = rules.document_quality(spark.read.parquet(f"{d}/documents.parquet"), learn).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = out.where("not base_failed").groupBy("quality", "kept").count().collect()
    counts = {(r.quality, r.kept): r["count"] for r in rows}
    assert counts.get((1, False), 0) <= 0.002 * counts[1, True]
    assert counts[0, False] > 0.9 * (counts[0, False] + counts.get((0, True), 0))


def test_odd_documents_and_labels(spark):
    labels = spark.createDataFrame([(None, 0, 1), (5, 1, 0), (5, 0, 0), (5, 1, 0), (3, None, None), (9, 7, 0)], "doc_id long, quality int, toxic int")
    df = odd_docs(spark)
    got = rules.document_quality(df, labels.withColumn("kept", F.lit(1))).collect()
    assert len(got) == df.count()
    want = Counter((r.doc_id, *brute(r.text).values()) for r in df.collect())
    assert Counter((r.doc_id, *[r[c] for c in brute("")]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    empty = docs(spark, [])
    assert rules.document_quality(empty, labels).count() == 0
    assert rules.document_quality(df, labels.limit(0)).count() == df.count()
