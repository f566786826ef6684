"""Selection by repeated model fits: shadow features and recursive elimination."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.numbers import sql_name
from driftwell.operators.models import assemble
from driftwell.operators.ordering import dense_numbers
from driftwell.operators.selection import Selector
from driftwell.session import written_table

# Partitions of training rows: at least so many, and so many rows in one.
LEAST_PARTS = 8
ROWS_IN_PART = 200_000
# Trials that run beside each other.
TRIALS_AT_ONCE = 4


def numbered_vectors(df: DataFrame, label: str, features: Sequence[str], seed: int) -> tuple[DataFrame, int]:
    """(row, label, x) and the number of rows, numbered in the order of a keyed hash of their content.

    The numbers do not depend on partitions or batches: only rows that are equal in everything could change places.
    """
    values = F.expr(f"array({', '.join(f'CAST({sql_name(c)} AS DOUBLE)' for c in features)})")
    rows = df.select(F.col(label).cast("double").alias("label"), values.alias("x"))
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), "label", "x"))
    # Dealing by range looks at the rows twice: what they are made of is read once.
    numbered = dense_numbers(written_table(hashed), ["_h", "label", "x"], "row").drop("_h")
    return numbered, numbered.count()


def permutation(rows: int, draw: np.random.Generator) -> tuple[int, int]:
    """Factor and shift of a one-to-one map of row numbers, factor * row + shift modulo ``rows``."""
    most = max(2, min(rows, (1 << 62) // max(rows, 1)))
    factor = int(draw.integers(1, most))
    while math.gcd(factor, rows) != 1:
        factor += 1
    return factor, int(draw.integers(0, max(rows, 1)))


def with_shadows(vectors: DataFrame, rows: int, places: Sequence[int], seed: int) -> DataFrame:
    """(label, features): the values at ``places`` of every row, and a copy of each column in another order of the rows.

    Each shadow keeps its column's values and loses its link to the label and to the other columns: column j of row r goes to
    the row that column j's own permutation names, wherever it lies. Rows are dealt by number, so the same rows train
    the same model whatever their partitions were.
    """
    draw = np.random.default_rng([seed, len(places)])
    moves = [permutation(rows, draw) for _ in places]
    cells = ", ".join(f"named_struct('target', ({a}L * row + {b}L) % {max(rows, 1)}L, 'place', {j}, 'value', x[{p}])" for j, (p, (a, b)) in enumerate(zip(places, moves)))
    moved = vectors.select(F.expr(f"inline(array({cells}))"))
    shadows = moved.groupBy(F.col("target").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s"))
    own = F.expr(f"array({', '.join(f'x[{p}]' for p in places)})")
    both = vectors.join(shadows, "row").select("row", "label", F.concat(own, F.col("s.value")).alias("x"))
    parts = max(LEAST_PARTS, math.ceil(rows / ROWS_IN_PART))
    dealt = both.repartition(parts, F.expr(f"row div {math.ceil(max(rows, 1) / parts)}")).sortWithinPartitions("row")
    return dealt.select("label", array_to_vector("x").alias("features"))


def binomial_tail(hits: int, trials: int) -> float:
    """P(X >= hits) for a fair coin."""
    return sum(math.comb(trials, k) for k in range(hits, trials + 1)) / 2.0 ** trials


def _significant(p_values: dict[str, float], alpha: float, trials: int) -> set[str]:
    """Names that pass a false-discovery step-up test and a Bonferroni bound over the trials."""
    ordered = sorted(p_values, key=p_values.get)
    passed = 0
    for i, name in enumerate(ordered, start=1):
        if p_values[name] <= alpha * i / len(ordered):
            passed = i
    return {n for n in ordered[:passed] if p_values[n] <= alpha / trials}


def next_decision(trial: int, most: int, hits: Mapping[str, int], names: set[str], alpha: float) -> int:
    """The first trial after ``trial`` that can settle any of ``names``, whatever the trials up to it find; ``most`` if none can.

    A name's smallest p-value there is the one it gets if all trials from now on agree with its longer side.
    """
    sides = {max(hits[c], trial - hits[c]) for c in names}
    for later in range(trial + 1, most):
        if min(binomial_tail(side + later - trial, later) for side in sides) <= alpha / later:
            return later
    return most


@dataclass
class BorutaSelector(Selector):
    """Keeps features that beat the best shadow feature more often than chance.

    Trials before the next possible decision use the same columns, so they run beside each other, ``at_once`` at a time, and give
    what they give one after the other.
    """

    max_iter: int = 10
    trees: int = 500
    depth: int = 6
    alpha: float = 0.05
    seed: int = 42
    at_once: int = TRIALS_AT_ONCE
    selected: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    ranking: dict[str, int] = field(default_factory=dict)
    confirmed: set[str] = field(default_factory=set)
    tentative: set[str] = field(default_factory=set)

    def fit(self, df: DataFrame, label: str, features: Sequence[str]) -> BorutaSelector:
        names = list(features)
        vectors, rows = numbered_vectors(df, label, names, self.seed)
        best_shadows: list[float] = []
        hits = dict.fromkeys(names, 0)
        history: dict[str, list[float]] = {c: [] for c in names}
        open_names, rejected = set(names), set()
        self.confirmed = set()
        trial = 0
        while trial < self.max_iter and open_names:
            # Rejected columns take no further part, neither themselves nor as shadows.
            active = [c for c in names if c not in rejected]
            last = next_decision(trial, self.max_iter, hits, open_names, self.alpha)
            for importance in self._importances(vectors, rows, [names.index(c) for c in active], range(trial + 1, last + 1)):
                best_shadow = importance[len(active):].max()
                best_shadows.append(float(best_shadow))
                for c, value in zip(active, importance[: len(active)]):
                    history[c].append(float(value))
                    if value > best_shadow:
                        hits[c] += 1
            trial = last
            better = _significant({c: binomial_tail(hits[c], trial) for c in open_names}, self.alpha, trial)
            worse = _significant({c: binomial_tail(trial - hits[c], trial) for c in open_names}, self.alpha, trial)
            self.confirmed |= better
            rejected |= worse - better
            open_names -= better | worse
        # What stays undecided counts as weak support if it beats the shadows' usual best one.
        usual = float(np.median(best_shadows)) if best_shadows else math.inf
        self.tentative = {c for c in open_names if history[c] and float(np.median(history[c])) > usual}
        self.scores = {c: float(np.mean(v)) if v else 0.0 for c, v in history.items()}
        self.ranking = self._ranking(names)
        self.selected = [c for c in names if c in self.confirmed]
        return self

    def _importances(self, vectors: DataFrame, rows: int, places: Sequence[int], trials: Sequence[int]) -> list[np.ndarray]:
        """Importances of the columns at ``places`` and of their shadows, for each trial in order."""
        def one(trial: int) -> np.ndarray:
            training = with_shadows(vectors, rows, places, self.seed + trial).persist()
            forest = RandomForestClassifier(
                numTrees=self.trees, maxDepth=self.depth, featureSubsetStrategy="sqrt", seed=self.seed + trial
            )
            importance = forest.fit(training).featureImportances.toArray()
            training.unpersist()
            return importance

        with ThreadPoolExecutor(max(1, min(self.at_once, len(trials)))) as pool:
            return list(pool.map(inheritable_thread_target(vectors.sparkSession)(one), trials))

    def _ranking(self, names: Sequence[str]) -> dict[str, int]:
        """1 for confirmed, 2 for weakly supported, the others from 3 by mean importance."""
        others = sorted(
            (c for c in names if c not in self.confirmed and c not in self.tentative),
            key=lambda c: (-self.scores[c], c),
        )
        ranks = dict.fromkeys(self.confirmed, 1) | dict.fromkeys(self.tentative, 2)
        return ranks | {c: 3 + i for i, c in enumerate(others)}

    def report(self, df: DataFrame) -> DataFrame:
        """(feature, rank, support, weak_support), best first."""
        rows = [(c, r, int(c in self.confirmed), int(c in self.tentative)) for c, r in self.ranking.items()]
        frame = df.sparkSession.createDataFrame(rows, "feature string, rank int, support int, weak_support int")
        return frame.orderBy(F.col("support").desc(), F.col("weak_support").desc(), "rank", "feature")


@dataclass
class RfeSelector(Selector):
    """Drops the least important features of a boosted model, ``step`` at a time."""

    n_features: int = 50
    step: int = 10
    trees: int = 500
    depth: int = 6
    learning_rate: float = 0.05
    seed: int = 42
    selected: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, label: str, features: Sequence[str]) -> RfeSelector:
        left = list(features)
        while len(left) > self.n_features:
            training = assemble(df, left, F.col(label).cast("double").alias("label")).persist()
            learner = GBTClassifier(maxIter=self.trees, maxDepth=self.depth, stepSize=self.learning_rate, seed=self.seed)
            importance = learner.fit(training).featureImportances.toArray()
            training.unpersist()
            self.scores = {c: float(v) for c, v in zip(left, importance)}
            drop = min(self.step, len(left) - self.n_features)
            worst = set(sorted(left, key=lambda c: (self.scores[c], c))[:drop])
            left = [c for c in left if c not in worst]
        self.selected = left
        return self


@dataclass
class BorutaRfeSelector(Selector):
    """Shadow-feature selection, then elimination or a cut by support, weak support, rank and name."""

    boruta: BorutaSelector = field(default_factory=BorutaSelector)
    rfe: RfeSelector | None = None
    n_features: int = 40
    selected: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, label: str, features: Sequence[str]) -> BorutaRfeSelector:
        self.boruta.fit(df, label, features)
        self.scores = self.boruta.scores
        if self.rfe is not None:
            kept = self.boruta.selected or list(features)
            self.selected = self.rfe.fit(df, label, kept).selected
        else:
            top = self.boruta.report(df).limit(self.n_features).collect()
            self.selected = [r["feature"] for r in top]
        return self

    def stages(self, df: DataFrame) -> DataFrame:
        """(stage, feature, rank): what each stage kept."""
        kept = {"boruta": self.boruta.selected, "rfe": self.rfe.selected if self.rfe else []}
        rows = [(stage, c, i) for stage, names in kept.items() for i, c in enumerate(names, start=1)]
        return df.sparkSession.createDataFrame(rows, "stage string, feature string, rank int")
