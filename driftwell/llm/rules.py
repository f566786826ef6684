"""Quality rules: text statistics, and a decision list over them learned from labels.

Statistics are counts of a whole text, so they are exact and no part of a text is left out. A decision list is an ordered
list of rules; a rule is a conjunction of thresholds on ratios of counts, and a text that meets a rule is rejected. The
list is learned by sequential covering: a rule grows by the threshold with the largest information gain on two thirds of
the examples until it covers no good one, is pruned from its end on the other third, and what it covers is taken out. A
rule that is not precise enough on the pruning examples ends the search. The list is emitted as one ordered Spark
conditional expression, so applying it stays inside generated code.

Learning reads a bounded sample of labelled rows (``SAMPLE``); statistics are counted for every row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.rows import arrow_map, stored, utf8

# Labelled rows that a list is learned from, at most: those with the least hash of their key.
SAMPLE = 20_000
# A rule must be this precise on the pruning examples, and stand on so many examples of growing and pruning.
PRECISION = 0.97
SUPPORT = 5
# Thresholds tried for a ratio in one step: quantiles of the rows that the rule still covers.
CUTS = 64
WINDOW = 5
# Odd multiplier that mixes the words of a window.
SPREAD = np.uint64(0x9E3779B97F4A7C15)

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_marks", "n_ended_lines",
)
# Ratios of counts; a denominator of zero counts as one.
RATIOS: dict[str, str] = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "ended_line_share": "n_ended_lines / greatest(n_lines, 1)",
}


def _table(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


SPACE = _table(b" \t\n\x0b\x0c\r")
SYMBOL = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
LETTER = UPPER | _table(bytes(range(97, 123)))
DIGIT = _table(b"0123456789")
MARK = _table(b"!?")
# The first byte of a character.
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def repeated_words(ids: np.ndarray, of: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``window`` consecutive words that its text (``of``) holds twice or more."""
    n = len(ids) - window + 1
    covered = np.zeros(len(ids), bool)
    if n <= 0:
        return covered
    starts = np.flatnonzero(of[:n] == of[window - 1 :])
    if not len(starts):
        return covered
    # Windows of one text with equal words get equal keys; equal keys are compared word by word.
    mixed = of[starts].astype(np.uint64) + np.uint64(1)
    for k in range(window):
        mixed = (mixed ^ ids[starts + k].astype(np.uint64)) * SPREAD
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    sorted_, at = mixed[order], starts[order]
    twin = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    same = of[at[twin]] == of[at[twin + 1]]
    for k in range(window):
        same &= ids[at[twin] + k] == ids[at[twin + 1] + k]
    if same.all():
        found = np.concatenate([at[twin], at[twin + 1]])
    else:
        # Different windows share a key: settle by the windows themselves.
        rows = np.stack([of[starts], *[ids[starts + k] for k in range(window)]], 1)
        _, group, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        found = starts[counts[group.reshape(-1)] > 1]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + window, -1)
    return np.cumsum(edges[:-1]) > 0


def text_counts(raws: Sequence[bytes]) -> dict[str, np.ndarray]:
    """The counts ``COUNTS`` of each text."""
    lengths = np.array([len(r) for r in raws], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.frombuffer(b"".join(raws), np.uint8) if bounds[-1] else np.zeros(0, np.uint8)

    def per_text(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marks)])[bounds])

    inside = ~SPACE[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[bounds[:-1][lengths > 0]] = inside[bounds[:-1][lengths > 0]]
    out = {
        "n_words": per_text(begins),
        "word_chars": per_text(inside & LEAD[flat]),
        "n_symbols": per_text(SYMBOL[flat]),
        "n_letters": per_text(LETTER[flat]),
        "n_upper": per_text(UPPER[flat]),
        "n_digits": per_text(DIGIT[flat]),
        "n_marks": per_text(MARK[flat]),
    }
    # All words as one array, numbered by their bytes.
    packed = np.cumsum(inside) - inside
    heads = packed[begins]
    offsets = np.append(heads, inside.sum()).astype(np.int64)
    data = np.ascontiguousarray(flat[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(heads) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(raws)), out["n_words"])
    out["n_repeat_words"] = np.bincount(of[repeated_words(ids, of)], minlength=len(raws))
    lines = [[x for x in (y.strip() for y in r.split(b"\n")) if x] for r in raws]
    whole = [[x for x in r.split(b"\n") if x.strip()] if len(a) > 1 else a for r, a in zip(raws, lines)]
    out["n_lines"] = np.array([len(a) for a in lines], np.int64)
    out["n_dup_lines"] = np.array([len(a) - len(set(a)) for a in whole], np.int64)
    out["n_ended_lines"] = np.array([sum(x[-1:] in b".!?" for x in a) for a in lines], np.int64)
    return out


def counted(df: DataFrame, text: str, keys: Mapping[str, str]) -> DataFrame:
    """``keys`` (new name -> column) and the counts of every whole text; NULL texts count as empty."""
    slim = df.select(*[F.col(c).alias(n) for n, c in keys.items()], utf8(F.col(text)).alias("_raw"))
    fields = "".join(f"`{n}` {slim.schema[n].dataType.simpleString()}, " for n in keys)

    def run(rows: pa.Table) -> dict:
        return {n: rows[n] for n in keys} | text_counts(rows["_raw"].to_pylist())

    return arrow_map(slim, run, fields + ", ".join(f"{c} long" for c in COUNTS))


class Condition(NamedTuple):
    ratio: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{RATIOS[self.ratio]} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: Mapping[str, np.ndarray], size: int) -> np.ndarray:
    found = np.ones(size, bool)
    for c in rule:
        found &= (x[c.ratio] > c.threshold) == c.above
    return found


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information gained on the positives that stay covered."""
    return p * (np.log2(p.clip(1) / (p + n).clip(1)) - np.log2(p0 / (p0 + n0)))


def grow_rule(x: Mapping[str, np.ndarray], y: np.ndarray) -> Rule:
    """Add the best threshold until no negative example is covered or nothing is gained."""
    rule: list[Condition] = []
    held = np.arange(len(y))
    while len(held) and not y[held].all():
        p0, n0 = int(y[held].sum()), int((~y[held]).sum())
        best: tuple[float, Condition] | None = None
        for name, values in x.items():
            v = values[held]
            order = np.argsort(v, kind="stable")
            sorted_, positive = v[order], np.cumsum(y[held][order])
            # Places where the value changes; thresholds lie halfway, so that rounding decides nothing.
            steps = np.flatnonzero(sorted_[1:] > sorted_[:-1])
            if not len(steps):
                continue
            steps = steps[np.unique(np.linspace(0, len(steps) - 1, min(CUTS, len(steps))).astype(int))]
            low_p, low = positive[steps], steps + 1
            low_n = low - low_p
            for above, p, n in ((True, p0 - low_p, n0 - low_n), (False, low_p, low_n)):
                gains = np.where(p > 0, _gain(p, n, p0, n0), -np.inf)
                at = int(np.argmax(gains))
                if gains[at] > 1e-9 and (best is None or gains[at] > best[0] + 1e-9):
                    best = float(gains[at]), Condition(name, above, float((sorted_[steps[at]] + sorted_[steps[at] + 1]) / 2))
        if best is None:
            break
        rule.append(best[1])
        held = held[covers((best[1],), {best[1].ratio: x[best[1].ratio][held]}, len(held))]
    return tuple(rule)


def prune_rule(rule: Rule, x: Mapping[str, np.ndarray], y: np.ndarray) -> Rule:
    """The beginning of the rule that tells positives from negatives best, the shorter one on ties."""
    best, kept = -2.0, rule
    for size in range(1, len(rule) + 1):
        found = covers(rule[:size], x, len(y))
        p, n = int((found & y).sum()), int((found & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-12:
            best, kept = worth, rule[:size]
    return kept


def learn_rules(x: Mapping[str, np.ndarray], y: np.ndarray, part: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """An ordered list of rules for the rows with ``y``; ``part`` is true for the examples that rules are pruned on.

    Without positive or negative examples the list is empty. Same examples in the same order, same list.
    """
    rules: list[Rule] = []
    grow, prune = np.flatnonzero(~part), np.flatnonzero(part)
    pick = lambda at: {k: v[at] for k, v in x.items()}
    while y[grow].any() and not y[grow].all():
        rule = prune_rule(grow_rule(pick(grow), y[grow]), pick(prune), y[prune])
        if not rule:
            break
        in_grow, in_prune = covers(rule, pick(grow), len(grow)), covers(rule, pick(prune), len(prune))
        right, all_ = int((in_prune & y[prune]).sum()), int(in_prune.sum())
        if int((in_grow & y[grow]).sum()) < SUPPORT or right < SUPPORT or right < precision * all_:
            break
        rules.append(rule)
        grow, prune = grow[~in_grow], prune[~in_prune]
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The number (from 1) of the first rule that a row of counts meets, else 0, as one ordered conditional expression."""
    branches = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i}" for i, rule in enumerate(rules, 1))
    return F.expr(f"CASE {branches} ELSE 0 END" if branches else "0")


def fit_rules(counts: DataFrame, key: str, labels: DataFrame, label_key: str, label: str, sample: int = SAMPLE) -> list[Rule]:
    """Learn the list that rejects rows labelled 0, from at most ``sample`` labelled keys.

    Labels that are not 0 or 1, NULL keys and keys with both labels are left out; of rows with one key the one with the least
    counts is taken. Without labels of both kinds the list is empty, so that every row is kept.
    """
    own = labels.select(F.col(label_key).alias("_key"), F.col(label).cast("int").alias("_label"))
    own = own.where("_key is not null and _label in (0, 1)").groupBy("_key").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other"))
    known = own.where("_label = _other").select("_key", "_label", F.xxhash64("_key").alias("_order"))
    # At most ``sample`` narrow rows, whatever the tables hold.
    picked = F.broadcast(known.orderBy("_order", "_key").limit(sample))
    rows = counts.join(picked, counts[key] == F.col("_key")).groupBy("_key", "_order", "_label").agg(F.min(F.struct(*COUNTS)).alias("_counts"))
    found = rows.select("_order", "_key", "_label", "_counts.*").select("_order", "_key", "_label", *[F.expr(e).alias(n) for n, e in RATIOS.items()])
    taken = found.toPandas().sort_values(["_order", "_key"])
    x = {n: taken[n].to_numpy(float) for n in RATIOS}
    return learn_rules(x, taken["_label"].to_numpy() == 0, taken["_order"].to_numpy() % 3 == 0)


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, rule (the number of the rule that rejects, else 0) of every document.

    NULL and empty texts have no words and fail the base. Repeated rows stay, whatever their key; columns of other names are
    not read. Without usable labels only the base decides. An empty table gives an empty one.
    """
    counts = stored(counted(docs, "text", {"doc_id": "doc_id"}), "quality")
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    # What the base rejects needs no rule.
    rules = fit_rules(counts.where(~failed), "doc_id", labels, "doc_id", "quality")
    judged = counts.withColumns({"base_failed": failed, "rule": verdict(rules)})
    return judged.withColumn("kept", F.expr("NOT base_failed AND rule = 0"))
