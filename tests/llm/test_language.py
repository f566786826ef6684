import numpy as np
import pytest

from driftwell.llm import language
from tests.llm.data import docs, odd_docs


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.collect()}
    rows = language.document_languages(df).collect()
    assert len(rows) == len(truth)
    held = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 100 and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    again = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.document_languages(df).collect()}
    assert again == {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in rows}


def test_odd_documents(spark):
    df = odd_docs(spark)
    rows = language.document_languages(df).collect()
    assert len(rows) == df.count()
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        text = texts.get(r.doc_id) or ""
        if r.doc_id not in (None, 5) and not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id not in (None, 5):
            assert r.lang_pred == "en"
    assert language.document_languages(docs(spark, [])).count() == 0
    unlabelled = docs(spark, [(1, "some words", None, "s")])
    assert [tuple(r)[2:] for r in language.document_languages(unlabelled).collect()] == [("und", 0.0)]


def test_windows_cover_every_place():
    wide = max(language.WIDTHS)
    for n in (0, 1, wide, language.WINDOW, language.WINDOW + 1, 1_000):
        raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        windows, of, held = language.cut_windows([b"xy", raw, b"z"])
        own = windows[of == 1]
        grams = {bytes(w[i : i + wide].astype(np.uint8)) for w in own for i in range(language.WINDOW - wide + 1) if (w[i : i + wide] < 256).all()}
        assert grams == {raw[i : i + wide] for i in range(n - wide + 1)}
        assert held[of == 0].tolist() == [2] and held[of == 2].tolist() == [1]


def test_gradient_step_learns_and_labels_are_no_input():
    rng = np.random.default_rng(0)
    make = lambda letters: "".join(rng.choice(list(letters), 120)).encode()
    texts = [make("abc ") for _ in range(60)] + [make("xyz ") for _ in range(60)]
    net = language.train(texts, ["left"] * 60 + ["right"] * 60)
    assert language.predict(net, [make("abc "), make("xyz "), b"", None, b"12 34"])[0] == ["left", "right", "und", "und", "und"]


def tiny(seed, languages=3):
    rng = np.random.default_rng(seed)
    k, wide = language.FILTERS * len(language.WIDTHS), max(language.WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(wide) < w, language.EMBED)[:, None].repeat(language.FILTERS, 1) for w in language.WIDTHS], 1).astype(float)
    embed = rng.normal(size=(257, language.EMBED))
    embed[language.PAD] = 0
    values = {
        "embed": embed, "filters": rng.normal(size=(wide * language.EMBED, k)) * mask, "bias": rng.normal(size=k),
        "out": rng.normal(size=(k, languages)), "out_bias": rng.normal(size=languages),
    }
    return values, mask


def naive(values, window):
    """Log probabilities of one window by plain loops over filters, places and bytes."""
    pooled = []
    for f in range(language.FILTERS * len(language.WIDTHS)):
        width, answers = language.WIDTHS[f // language.FILTERS], []
        for place in range(len(window) - max(language.WIDTHS) + 1):
            total = 0.0
            for j in range(width):
                for e in range(language.EMBED):
                    total += values["embed"][window[place + j], e] * values["filters"][j * language.EMBED + e, f]
            answers.append(total)
        pooled.append(max(0.0, max(answers) + values["bias"][f]))
    logits = [sum(p * values["out"][i, c] for i, p in enumerate(pooled)) + values["out_bias"][c] for c in range(len(values["out_bias"]))]
    return np.array(logits) - np.log(np.exp(logits).sum())


def test_network_by_plain_loops():
    values, _ = tiny(1)
    windows = np.random.default_rng(2).integers(0, 257, (4, 20)).astype(np.int16)
    net = language.Network(["a", "b", "c"], *[values[n] for n in ("embed", "filters", "bias", "out", "out_bias")])
    assert language.log_probabilities(net, windows) == pytest.approx(np.array([naive(values, w) for w in windows]))


def test_gradients_by_finite_differences():
    values, mask = tiny(3)
    rng = np.random.default_rng(4)
    w, y, weight = rng.integers(0, 256, (6, 12)), rng.integers(0, 3, 6), rng.random(6)
    _, grads = language.loss_and_gradients(values, mask, w, y, weight)
    for name, value in values.items():
        for _ in range(25):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "embed":
                at = (w[rng.integers(0, 6), rng.integers(0, 12)], at[1])
            if name == "filters" and not mask[at]:
                assert grads[name][at] == 0
                continue
            kept, step = value[at], 1e-6
            value[at] = kept + step
            up = language.loss_and_gradients(values, mask, w, y, weight)[0]
            value[at] = kept - step
            down = language.loss_and_gradients(values, mask, w, y, weight)[0]
            value[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-6), (name, at)


def test_every_language_of_the_sample_is_learned(spark):
    """More languages than two hundred: each has a place in the network."""
    rows = [(i, f"text of {i % 260}", f"l{i % 260:03}", None) for i in range(1_300)]
    net = language.fit(docs(spark, rows), "text", "lang", "doc_id", texts=520, windows=1)
    assert len(net.languages) > 240
