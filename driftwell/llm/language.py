"""Language identification by a byte convolutional network, trained and applied with numpy.

A window of bytes is embedded, filters of several widths slide over it, each filter keeps its largest answer (max
pooling) and a softmax over the pooled answers gives the languages. A text is cut into fixed-length windows that
overlap by the widest filter, all windows of a batch are applied together, and a text's prediction is the mean of
its windows' log probabilities, weighted by their bytes. Whole texts are read, whatever their length.

Only text and label are learned from, and only text is used to predict. The training sample is bounded by parameters;
the network is a few kilobytes and travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.rows import arrow_map, as_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
PAD = 256
# Bounds of the training sample: texts over all languages (at least one of each, so no more languages than that, the most
# frequent ones), and windows of each text.
SAMPLE_TEXTS = 4_000
SAMPLE_WINDOWS = 3
EPOCHS = 10
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
# Windows whose convolution is computed at once; keeps the working arrays inside the cache.
AT_ONCE = 128


class Network(NamedTuple):
    languages: list[str]
    embed: np.ndarray  # (257, EMBED); the last row, padding, stays zero
    filters: np.ndarray  # (widest * EMBED, all filters); zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def patches(windows: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """(windows, places, widest * EMBED): the embedded bytes under a filter at each place."""
    wide = max(WIDTHS)
    x = embed[windows]
    n, length, d = x.shape
    strides = x.strides
    view = np.lib.stride_tricks.as_strided(x, (n, length - wide + 1, wide * d), (strides[0], strides[1], strides[2]))
    return np.ascontiguousarray(view)


def log_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    found = np.empty((len(windows), len(net.languages)), np.float64)
    for i in range(0, len(windows), AT_ONCE):
        x = patches(windows[i : i + AT_ONCE], net.embed)
        pooled = (x @ net.filters).max(axis=1) + net.bias
        logits = (np.maximum(pooled, 0) @ net.out + net.out_bias).astype(np.float64)
        logits -= logits.max(axis=1, keepdims=True)
        found[i : i + AT_ONCE] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return found


def cut_windows(raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (padded), the text of each, and how many bytes of it each holds."""
    step = WINDOW - max(WIDTHS) + 1
    lengths = np.array([len(r) for r in raws], np.int64)
    counts = np.maximum(1, -(-np.maximum(lengths - (max(WIDTHS) - 1), 1) // step))
    of = np.repeat(np.arange(len(raws)), counts)
    inside = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    flat = np.frombuffer(b"".join(raws) + bytes(WINDOW), np.uint8)
    starts = (np.cumsum(lengths) - lengths)[of] + inside
    held = np.minimum(lengths[of] - inside, WINDOW)
    places = np.arange(WINDOW)
    windows = np.full((len(of), WINDOW), PAD, np.int16)
    for i in range(0, len(of), 4096):
        part = slice(i, i + 4096)
        taken = flat[np.minimum(starts[part, None] + places, len(flat) - 1)].astype(np.int16)
        windows[part] = np.where(places < held[part, None], taken, PAD)
    return windows, of, np.maximum(held, 1)


def train(texts: Sequence[bytes], labels: Sequence[str], epochs: int = EPOCHS, seed: int = 5) -> Network | None:
    """Fit by Adam on windows of ``texts``. None without labels. Same input, same network.

    Each window is also shown cut short, so that short texts are known.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    cut = [t[: int(n)].translate(_LOWER) for t, n in zip(texts, rng.integers(8, 64, len(texts)))]
    full = [t[:WINDOW].translate(_LOWER) for t in texts]
    windows, of, _ = cut_windows(full + cut)
    numbers = {name: i for i, name in enumerate(languages)}
    y = np.array([numbers[name] for name in labels] * 2)[of]
    wide, d, k, c = max(WIDTHS), EMBED, FILTERS * len(WIDTHS), len(languages)
    mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), d)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
    embed = rng.normal(0, 0.5, (257, d)).astype(np.float32)
    embed[PAD] = 0
    values = {
        "embed": embed,
        "filters": (rng.normal(0, 1 / np.sqrt(wide * d), (wide * d, k)) * mask).astype(np.float32),
        "bias": np.zeros(k, np.float32),
        "out": rng.normal(0, 0.1, (k, c)).astype(np.float32),
        "out_bias": np.zeros(c, np.float32),
    }
    first = {n: np.zeros_like(v) for n, v in values.items()}
    second = {n: np.zeros_like(v) for n, v in values.items()}
    # Languages count alike, however many windows each has.
    weight = (len(y) / (c * np.bincount(y, minlength=c).clip(1)))[y].astype(np.float32)
    step = 0
    for epoch in range(epochs):
        rate = 4e-3 * (1 - epoch / epochs) + 2e-4
        order = rng.permutation(len(y))
        for at in range(0, len(order), AT_ONCE):
            rows = order[at : at + AT_ONCE]
            w = windows[rows]
            _, grads = loss_and_gradients(values, mask, w, y[rows], weight[rows])
            step += 1
            for name, value in values.items():
                first[name] = 0.9 * first[name] + 0.1 * grads[name]
                second[name] = 0.99 * second[name] + 0.01 * grads[name] ** 2
                value -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
    return Network(languages, *[values[n].astype(np.float32) for n in ("embed", "filters", "bias", "out", "out_bias")])


def loss_and_gradients(values: dict, mask: np.ndarray, w: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted mean cross entropy of windows ``w`` with labels ``y``, and its gradient by each group of parameters."""
    n, (wide, d, k) = len(w), (max(WIDTHS), EMBED, FILTERS * len(WIDTHS))
    x = patches(w, values["embed"])
    h = x @ values["filters"]
    top = h.argmax(axis=1)
    pooled = np.take_along_axis(h, top[:, None, :], 1)[:, 0] + values["bias"]
    r = np.maximum(pooled, 0)
    logits = r @ values["out"] + values["out_bias"]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    loss = float(((np.log(p.sum(axis=1)) - logits[np.arange(n), y]) * weight).mean())
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    g = p * (weight / n)[:, None]
    back = (g @ values["out"].T) * (pooled > 0)
    # Max pooling sends a filter's gradient to one place of the window.
    seen = x[np.arange(n)[:, None], top]
    at_byte = np.take_along_axis(w[:, None, :].repeat(k, 1), top[:, :, None] + np.arange(wide), 2).reshape(-1)
    to_embed = (back[:, :, None] * values["filters"].T[None]).reshape(-1, d)
    grads = {
        "embed": np.stack([np.bincount(at_byte, to_embed[:, j], 257) for j in range(d)], 1).astype(values["embed"].dtype),
        "filters": np.einsum("nf,nfk->kf", back, seen) * mask,
        "bias": back.sum(0),
        "out": r.T @ g,
        "out_bias": g.sum(0),
    }
    grads["embed"][PAD] = 0
    return loss, grads


def predict(net: Network | None, raws: Sequence[bytes | None]) -> tuple[list[str], list[float]]:
    """Language and score (mean probability of that language over the text's bytes) of each text."""
    names, scores = [UNKNOWN] * len(raws), [0.0] * len(raws)
    known = [i for i, r in enumerate(raws) if r and net is not None and LETTER.search(as_text(r))]
    if not known:
        return names, scores
    windows, of, held = cut_windows([raws[i].translate(_LOWER) for i in known])
    log_p = log_probabilities(net, windows)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    total = np.add.reduceat(held, starts)[:, None]
    best = (np.add.reduceat(log_p * held[:, None], starts) / total).argmax(axis=1)
    mean = np.add.reduceat(np.exp(log_p) * held[:, None], starts) / total
    for j, i in enumerate(known):
        names[i] = net.languages[best[j]]
        scores[i] = float(min(1.0, mean[j, best[j]]))
    return names, scores


def held_out(key: Column) -> Column:
    """The fold that training never sees: CRC-32 of the key as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(True))


def fit(df: DataFrame, text: str, label: str, key: str, texts: int = SAMPLE_TEXTS, windows: int = SAMPLE_WINDOWS) -> Network | None:
    """Train on a sample of the labelled rows outside the held-out fold.

    The sample has about ``texts`` rows spread evenly over the labels, chosen by a hash of the key, and ``windows`` slices of each. The driver receives no more than that.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h")
    )
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(texts).collect()
    if not counts:
        return None
    each = max(1, texts // len(counts))
    scale = 1 << 30
    # Half as many again as needed, so that the hash leaves enough; the surplus goes below.
    shares = {r["label"]: min(scale, int(1.5 * each / r["count"] * scale) + 1) for r in counts}
    share = F.element_at(F.create_map(*[F.lit(v) for pair in shares.items() for v in pair]), F.col("label"))
    spare = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    slices = F.array(*[F.substr("text", (F.pmod(F.xxhash64(F.col("h"), F.lit(i)), spare) + 1).cast("int"), F.lit(WINDOW)) for i in range(windows)])
    chosen = (
        rows.where(F.pmod("h", F.lit(scale)) < share)
        .select("label", "h", slices.alias("slices"))
        .orderBy("h")
        .limit(3 * texts)
        .collect()
    )
    taken: dict[str, int] = {}
    samples, labels = [], []
    for row in sorted(chosen, key=lambda r: (r["h"], r["label"], r["slices"])):
        if taken.get(row["label"], 0) < each:
            taken[row["label"]] = taken.get(row["label"], 0) + 1
            for piece in row["slices"]:
                if piece and LETTER.search(piece):
                    samples.append(piece.encode())
                    labels.append(row["label"])
    return train(samples, labels)


def identify(df: DataFrame, text: str, keys: Sequence[str], net: Network | None) -> DataFrame:
    """``keys``, lang_pred and score for each whole text of ``df``.

    A NULL text, one without any letter, or a missing network gives ``und`` with score 0. Repeated rows stay, other
    columns are left out, an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    names = [f"k{i}" for i in range(len(keys))]
    # A text that is also a key travels once.
    source = names[list(keys).index(text)] if text in keys else "raw"
    raw = [] if text in keys else [F.col(text).alias("raw")]
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *raw)
    fields = "".join(f"{n} {slim.schema[n].dataType.simpleString()}, " for n in names)

    def run(rows: pa.Table) -> dict:
        found, scores = predict(shared.value, rows[source].cast(pa.binary()).to_pylist())
        return {n: rows[n] for n in names} | {"lang_pred": found, "score": scores}

    made = arrow_map(slim, run, f"{fields}lang_pred string, score double")
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "lang_pred", "score")


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    net = fit(docs, "text", "lang", "doc_id")
    return identify(docs, "text", ["doc_id"], net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
