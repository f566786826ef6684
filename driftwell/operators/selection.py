"""Feature selection: importance, mRMR, components, domain rules, external rankings and fills to a budget.

Rows stay on the executors. What reaches the driver is one number per feature or per feature pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.functions.labels import group_priority, semantic_group
from driftwell.functions.numbers import double_sql, sql_name
from driftwell.operators.evidence import InformationValue
from driftwell.operators.models import assemble
from driftwell.operators.profile import MissingRateFilter, cards_signature, feature_cards, feature_metadata, vector_correlation

# Fixed values of the importance forest and of the redundancy floor.
FOREST_TREES = 128
FOREST_FEATURE_SHARE = "0.15"
FOREST_SPLIT_SHARE = 0.01
REDUNDANCY_FLOOR = 0.05


class Selector:
    """``fit`` on training rows sets ``selected`` in order; ``transform`` keeps these columns.

    ``stage`` says where it runs: on raw columns ("before" preprocessing), on prepared columns ("after"),
    or on both ("both": ``fit`` sees raw columns, ``refine`` sees prepared ones).
    """

    stage = "after"
    # Whether ``fit`` reads its rows once, so that nothing is won by keeping them prepared for it.
    reads_once = False
    selected: list[str]
    scores: dict[str, float]

    def fit(self, df: DataFrame, label: str, features: Sequence[str]) -> Selector:
        raise NotImplementedError

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *[sql_name(c) for c in self.selected])


# ---- Importance and mRMR ----

def forest_importance(
    df: DataFrame, label: str, features: Sequence[str], repeats: int = 1, seed: int = 42,
    trees: int = FOREST_TREES, depth: int = 10,
) -> dict[str, float]:
    """Mean forest importance per feature over ``repeats`` seeds.

    Both children of a split hold at least half the split share of the rows, which is what a least node
    size for splitting amounts to.
    """
    training = forest_rows(df, label, features).persist()
    try:
        return grown_importance(training, features, repeats, seed, trees, depth)
    finally:
        training.unpersist()


def forest_rows(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    return assemble(df, features, F.col(label).cast("double").alias("label"))


def grown_importance(
    training: DataFrame, features: Sequence[str], repeats: int, seed: int, trees: int, depth: int = 10
) -> dict[str, float]:
    """``forest_importance`` of assembled rows."""
    total = np.zeros(len(features))
    for i in range(repeats):
        forest = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, featureSubsetStrategy=FOREST_FEATURE_SHARE,
            minWeightFractionPerNode=FOREST_SPLIT_SHARE / 2, seed=seed + i,
        )
        total += forest.fit(training).featureImportances.toArray()
    return {c: float(v) for c, v in zip(features, total / repeats)}


def by_score(scores: dict[str, float]) -> list[str]:
    """Highest first, equal scores by name."""
    return sorted(scores, key=lambda c: (-scores[c], c))


def greedy_mrmr(scores: dict[str, float], features: Sequence[str], correlation: np.ndarray, k: int) -> list[str]:
    """Pick k features by importance over mean absolute correlation with those picked.

    Works on the feature-by-feature matrix. A column without a correlation (constant) cannot be scored and
    is only picked when nothing else remains.
    """
    order = by_score(scores)
    place = {c: i for i, c in enumerate(features)}
    strength = np.abs(correlation)
    picked = [order[0]]
    summed = strength[place[order[0]]].copy()
    left = order[1:]
    while left and len(picked) < k:
        redundancy = np.array([summed[place[c]] / len(picked) for c in left])
        value = np.array([scores[c] for c in left]) / np.maximum(redundancy, REDUNDANCY_FLOOR)
        best = left[0] if np.isnan(value).all() else left[int(np.nanargmax(value))]
        picked.append(best)
        left.remove(best)
        summed = summed + strength[place[best]]
    return picked


@dataclass
class MrmrSelector(Selector):
    """Top-k by forest importance (``rf``) or by importance against redundancy (``mrmr``)."""

    reads_once = True
    k: int = 20
    method: str = "mrmr"
    repeats: int = 1
    seed: int = 42
    trees: int = FOREST_TREES
    selected: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, label: str, features: Sequence[str]) -> MrmrSelector:
        if self.method not in ("rf", "mrmr"):
            raise ValueError(f"unsupported method: {self.method}")
        if self.k >= len(features):
            self.selected = list(features)
            return self
        # The forest and the correlations read the same rows.
        training = forest_rows(df, label, features).persist()
        try:
            self.scores = grown_importance(training, features, self.repeats, self.seed, self.trees)
            if self.method == "rf":
                self.selected = by_score(self.scores)[: self.k]
            else:
                self.selected = greedy_mrmr(self.scores, features, vector_correlation(training, "features"), self.k)
        finally:
            training.unpersist()
        return self


# ---- Components ----

def components_for_share(ratios: Sequence[float], share: float) -> int:
    """Fewest components whose cumulative explained share reaches ``share``."""
    reached = 0.0
    for i, r in enumerate(ratios):
        reached += r
        if reached >= share - 1e-12:
            return i + 1
    return len(ratios)


@dataclass
class PcaSelector(Selector):
    """Principal components ``PC1..PCk``; a share asks for as many as explain it.

    Vectors are centred first. The largest loading of each component is made positive, so signs do not
    depend on the solver.
    """

    n_components: int | float = 20
    features: list[str] = field(default_factory=list)
    selected: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    centre: np.ndarray | None = None
    loadings: np.ndarray | None = None

    def fit(self, df: DataFrame, label: str, features: Sequence[str]) -> PcaSelector:
        self.features = list(features)
        means = df.agg(F.count(F.lit(1)).alias("rows"), *[F.expr(f"avg({sql_name(c)}) AS m{i}") for i, c in enumerate(features)]).first()
        self.centre = np.array([means[f"m{i}"] for i in range(len(features))])
        limit = max(1, min(len(features), means["rows"]))
        asked = limit if isinstance(self.n_components, float) else max(1, min(int(self.n_components), limit))
        fitted = PCA(k=asked, inputCol="features", outputCol="pc").fit(assemble(self._centred(df), self.features))
        ratios = fitted.explainedVariance.toArray()
        if isinstance(self.n_components, float):
            asked = components_for_share(ratios, self.n_components)
        matrix = fitted.pc.toArray()[:, :asked]
        signs = np.sign(matrix[np.abs(matrix).argmax(axis=0), range(asked)])
        self.loadings = matrix * np.where(signs == 0, 1.0, signs)
        self.selected = [f"PC{i + 1}" for i in range(asked)]
        self.scores = {n: float(r) for n, r in zip(self.selected, ratios)}
        return self

    def _centred(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *[
            F.expr(f"{sql_name(c)} - {double_sql(m)} AS {sql_name(c)}") for c, m in zip(self.features, self.centre)
        ])

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """Components as plain sums of products."""
        cells = ", ".join(f"{sql_name(c)} - {double_sql(m)}" for c, m in zip(self.features, self.centre))
        staged = df.select(*keep, F.expr(f"array({cells}) AS _v"))

        def component(i: int) -> Column:
            weights = F.expr(f"array({', '.join(double_sql(w) for w in self.loadings[:, i])})")
            products = F.zip_with(F.col("_v"), weights, lambda a, b: a * b)
            return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

        return staged.select(*keep, *[component(i).alias(n) for i, n in enumerate(self.selected)])

    def explained(self, df: DataFrame) -> DataFrame:
        """(component, explained_share, cumulative_share)."""
        total, rows = 0.0, []
        for name in self.selected:
            total += self.scores[name]
            rows.append((name, self.scores[name], total))
        return df.sparkSession.createDataFrame(rows, "component string, explained_share double, cumulative_share double")


# ---- Rankings and budgets ----

def ordered_unique(ranking: DataFrame, feature: str = "feature", position: str = "rank") -> DataFrame:
    """First position of every feature, renumbered from 1."""
    first = ranking.groupBy(F.col(feature).alias("feature")).agg(F.min(position).alias("first"))
    return renumbered(first, "first")


def renumbered(df: DataFrame, *order: str) -> DataFrame:
    """(feature, rank) by the given columns. A feature list is small, so one task numbers it."""
    return df.select("feature", F.row_number().over(Window.orderBy(*order, "feature")).alias("rank"))


def validated_ranking(ranking: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unknown) features of an external ranking, each in ranking order."""
    unique = ordered_unique(ranking)
    names = candidates.select("feature")
    known = unique.join(names, "feature", "left_semi")
    unknown = unique.join(names, "feature", "left_anti")
    return renumbered(known, "rank"), renumbered(unknown, "rank")


def fill_to_budget(tiers: Sequence[DataFrame], budget: int) -> DataFrame:
    """Merge ordered feature lists by tier: first occurrence wins, cut at the budget.

    Each tier is (feature, rank). The result is (feature, rank).
    """
    stacked = None
    for i, tier in enumerate(tiers):
        part = tier.select("feature", F.struct(F.lit(i).alias("tier"), F.col("rank").cast("long").alias("place")).alias("place"))
        stacked = part if stacked is None else stacked.unionByName(part)
    best = stacked.groupBy("feature").agg(F.min("place").alias("place"))
    return renumbered(best.orderBy("place", "feature").limit(budget), "place")


def with_budget_flags(ranking: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Membership columns: is the rank within each named budget?"""
    return ranking.withColumns({name: F.col("rank") <= budget for name, budget in budgets.items()})


# Membership columns of a ranking log and their budgets.
RANKING_BUDGETS = {
    "selected_for_lr_top20": 20,
    "selected_for_catboost_top40": 40,
    "candidate_for_lr_hybrid": 60,
    "candidate_for_catboost_hybrid": 100,
}


def keep_last(log: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Newest row per key set; missing keys are equal to each other."""
    others = [c for c in log.columns if c not in (*keys, sequence)]
    newest = F.max_by(F.struct(*others), F.col(sequence)).alias("newest")
    return log.groupBy(*keys).agg(F.max(sequence).alias(sequence), newest).select(*keys, sequence, "newest.*")


RANKING_KEYS = ("scope", "fold_id", "feature_name", "metadata_signature", "prompt_hash")


def merge_ranking_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append a ranking log; a feature ranked again under the same key replaces the old row."""
    stacked = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return keep_last(stacked, RANKING_KEYS, "_turn").drop("_turn").select(*new.columns)


def domain_rule_ranking(metadata: DataFrame, budget: int) -> DataFrame:
    """(feature, rank): best group first, then least missing, most rows, name."""
    ranked = metadata.withColumn("priority", group_priority(F.col("semantic_group")))
    order = [F.col("priority").desc(), F.col("missing_rate").asc(), F.col("non_null_count").desc(), F.col("feature")]
    top = ranked.orderBy(*order).limit(budget)
    return top.select("feature", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def _names(ranking: DataFrame) -> list[str]:
    return [r["feature"] for r in sorted(ranking.collect(), key=lambda r: r["rank"])]


@dataclass
class DomainRuleSelector(Selector):
    """Expert-style order from the metadata alone."""

    stage = "before"
    budget: int = 40
    descriptions: DataFrame | None = None
    selected: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, label: str, features: Sequence[str]) -> DomainRuleSelector:
        metadata = feature_metadata(df, features, self.descriptions)
        self.selected = _names(domain_rule_ranking(metadata, self.budget))
        return self


Ranker = Callable[[DataFrame, str], DataFrame]
# What a ranker may report next to (feature, rank).
RANKING_FACTS = {
    "reason": "string", "cache_hit": "boolean", "prompt_tokens": "long", "completion_tokens": "long", "total_tokens": "long",
}


@dataclass
class StoredRankings:
    """A ranker that asks another one only for keys it has not stored yet.

    Rankings are a Parquet table partitioned by key, so a lookup reads one partition.
    """

    path: str
    ranker: Ranker

    def __call__(self, cards: DataFrame, key: str) -> DataFrame:
        spark = cards.sparkSession
        schema = "feature string, rank int, " + ", ".join(f"{n} {t}" for n, t in RANKING_FACTS.items())
        folder = f"{self.path}/ranking_key={key}"
        known = self._read(spark, folder, schema)
        # An interrupted write leaves a folder without rows: ask again.
        if known is not None and not known.isEmpty():
            return known.withColumn("cache_hit", F.lit(True))
        made = with_facts(self.ranker(cards, key)).select("feature", "rank", *RANKING_FACTS)
        made.withColumn("cache_hit", F.lit(False)).write.mode("overwrite").parquet(folder)
        return self._read(spark, folder, schema)

    @staticmethod
    def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
        try:
            return spark.read.schema(schema).parquet(folder)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise


def with_facts(ranking: DataFrame) -> DataFrame:
    """Missing facts as NULL; a ranker that does not say so was really asked."""
    absent = {n: F.lit(None).cast(t) for n, t in RANKING_FACTS.items() if n not in ranking.columns}
    filled = ranking.withColumns(absent) if absent else ranking
    return filled.withColumns({
        "rank": F.col("rank").cast("int"), "cache_hit": F.coalesce(F.col("cache_hit").cast("boolean"), F.lit(False)),
        **{n: F.col(n).cast("long") for n in ("prompt_tokens", "completion_tokens", "total_tokens")},
    })


@dataclass
class RankingSelector(Selector):
    """Selection by an outside ranking of feature cards.

    ``ranker(cards, key)`` returns (feature, rank) and may add the facts above; it sees one text line per
    feature, never rows. Unknown names are set aside, missing places are filled in column order. The key
    covers the cards, the target rate, the filters, the scope, the fold and the prompt and settings names.
    """

    stage = "before"
    ranker: Ranker | None = None
    ranking_budget: int = 100
    feature_budget: int | None = None
    max_missing_rate: float = 0.95
    iv_options: dict | None = None
    descriptions: DataFrame | None = None
    prompt_version: str = ""
    config_hash: str = ""
    scope: str = "fold"
    fold_id: int | None = None
    selected: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    ranked: list[str] = field(default_factory=list)
    invalid: list[str] = field(default_factory=list)
    signature: str = ""
    prompt_hash: str = ""
    answer: DataFrame | None = None

    def set_context(self, scope: str, fold_id: int | None) -> None:
        self.scope, self.fold_id = scope, fold_id

    def fit(self, df: DataFrame, label: str, features: Sequence[str]) -> RankingSelector:
        candidates = MissingRateFilter(self.max_missing_rate).fit(df, features).selected
        if not candidates:
            raise ValueError("the missing-rate filter removed every feature")
        if self.iv_options is not None:
            candidates = InformationValue(**self.iv_options).fit(df, label, candidates).selected
            if not candidates:
                raise ValueError("the information-value filter removed every feature")
        cards = feature_cards(feature_metadata(df, candidates, self.descriptions))
        # One line per feature.
        cards = df.sparkSession.createDataFrame(cards.collect(), cards.schema)
        target_mean = df.agg(F.avg(label)).first()[0]
        filters = f"max_missing_rate={self.max_missing_rate};iv={self.iv_options}"
        self.signature = cards_signature(cards, target_mean, filters).first()["metadata_signature"]
        asked = "\n".join([self.prompt_version, str(self.ranking_budget), self.signature])
        self.prompt_hash = hashlib.sha256(asked.encode()).hexdigest()
        parts = [self.signature, self.scope, str(self.fold_id), self.prompt_hash, self.config_hash]
        key = hashlib.sha256("\n".join(parts).encode()).hexdigest()
        self.answer = with_facts(self.ranker(cards, key))
        spark = df.sparkSession
        names = spark.createDataFrame([(c, i + 1) for i, c in enumerate(candidates)], "feature string, rank int")
        known, unknown = validated_ranking(self.answer, names)
        self.invalid = _names(unknown)
        self.ranked = _names(fill_to_budget([known, names], self.ranking_budget))
        self.selected = self.ranked[: self.feature_budget or self.ranking_budget]
        return self

    def log(self, spark: SparkSession) -> DataFrame:
        """Ranking log of the last fit: rank, reason, keys, budget memberships and call facts per feature."""
        ranks = spark.createDataFrame([(c, i + 1) for i, c in enumerate(self.ranked)], "feature_name string, rank int")
        facts = self.answer.groupBy("feature").agg(F.max("reason").alias("llm_reason"))
        call = ("cache_hit", "prompt_tokens", "completion_tokens", "total_tokens")
        # The facts of a call are the same on all its rows.
        row = self.answer.agg(*[F.max(c).alias(c) for c in call]).first()
        types = RANKING_FACTS
        logged = ranks.join(facts, ranks["feature_name"] == facts["feature"], "left").drop("feature").withColumns({
            "scope": F.lit(self.scope), "fold_id": F.lit(self.fold_id).cast("int"),
            "metadata_signature": F.lit(self.signature), "prompt_version": F.lit(self.prompt_version),
            "prompt_hash": F.lit(self.prompt_hash), "config_hash": F.lit(self.config_hash),
            "shared_pool_size": F.lit(self.ranking_budget), **{c: F.lit(row[c]).cast(types[c]) for c in call},
            "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        })
        return with_budget_flags(logged, RANKING_BUDGETS)


@dataclass
class RankedThenStatistical(Selector):
    """A broad outside ranking first, then a statistical selector on the prepared candidates."""

    stage = "both"
    ranking: RankingSelector | None = None
    statistical: Selector | None = None
    final_budget: int = 20
    selected: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    candidates: list[str] = field(default_factory=list)

    def set_context(self, scope: str, fold_id: int | None) -> None:
        self.ranking.set_context(scope, fold_id)

    def log(self, spark: SparkSession) -> DataFrame:
        return self.ranking.log(spark)

    def fit(self, df: DataFrame, label: str | None, features: Sequence[str]) -> RankedThenStatistical:
        if label is None:
            raise ValueError("a target is required")
        self.candidates = self.ranking.fit(df, label, features).selected
        self.selected = self.candidates
        return self

    def refine(self, df: DataFrame, label: str, features: Sequence[str]) -> RankedThenStatistical:
        self.statistical.fit(df, label, features)
        self.scores = self.statistical.scores
        self.selected = _budgeted([self.statistical.selected, self.candidates, list(features)], features, self.final_budget)
        return self


@dataclass
class StableCoreFill(Selector):
    """Features that bootstrapped mRMR keeps picking, filled up from an outside ranking."""

    stage = "both"
    ranking: RankingSelector | None = None
    final_budget: int = 40
    bootstraps: int = 5
    fraction: float = 0.8
    stability: float = 0.8
    seed: int = 42
    trees: int = FOREST_TREES
    selected: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    candidates: list[str] = field(default_factory=list)
    core: list[str] = field(default_factory=list)
    frequency: DataFrame | None = None

    def set_context(self, scope: str, fold_id: int | None) -> None:
        self.ranking.set_context(scope, fold_id)

    def log(self, spark: SparkSession) -> DataFrame:
        return self.ranking.log(spark)

    def fit(self, df: DataFrame, label: str | None, features: Sequence[str]) -> StableCoreFill:
        if label is None:
            raise ValueError("a target is required")
        self.candidates = self.ranking.fit(df, label, features).ranked
        self.selected = list(features)
        return self

    def refine(self, df: DataFrame, label: str, features: Sequence[str]) -> StableCoreFill:
        k = min(self.final_budget, len(features))
        log = []
        for i in range(self.bootstraps):
            sample = df.sample(withReplacement=True, fraction=self.fraction, seed=self.seed + i)
            picked = MrmrSelector(k, "mrmr", seed=self.seed + i, trees=self.trees).fit(sample, label, features).selected
            log += [(i + 1, c, r) for r, c in enumerate(picked, start=1)]
        picks = df.sparkSession.createDataFrame(log, "iteration int, feature string, rank int")
        self.frequency = core_frequency(picks, self.bootstraps)
        rows = self.frequency.collect()
        self.core = [r["feature"] for r in rows if r["selection_frequency"] >= self.stability][: self.final_budget]
        frequent = [r["feature"] for r in rows]
        self.selected = _budgeted([self.core, self.candidates, frequent, list(features)], features, self.final_budget)
        return self


def core_frequency(picks: DataFrame, iterations: int) -> DataFrame:
    """(feature, selection_count, mean_rank, selection_frequency) over bootstraps, steadiest first."""
    return (
        picks.groupBy("feature")
        .agg(F.count("iteration").alias("selection_count"), F.avg("rank").alias("mean_rank"))
        .withColumn("selection_frequency", F.col("selection_count") / F.lit(float(iterations)))
        .orderBy(F.col("selection_frequency").desc(), "mean_rank", "feature")
    )


def _budgeted(tiers: Sequence[Sequence[str]], allowed: Sequence[str], budget: int) -> list[str]:
    """Driver form of ``fill_to_budget`` for name lists already at hand."""
    known = set(allowed)
    return [c for c in dict.fromkeys(c for tier in tiers for c in tier) if c in known][:budget]


def selection_rows(
    df: DataFrame, selected: Sequence[str], scores: dict[str, float], selector: str, fold: int | None
) -> DataFrame:
    """Selection log of one fit: rank, score and semantic group per feature."""
    rows = [(fold, selector, c, r, scores.get(c)) for r, c in enumerate(selected, start=1)]
    log = df.sparkSession.createDataFrame(rows, "fold_id int, selector string, feature_name string, rank int, score double")
    return log.select(
        "fold_id", "selector", "feature_name", F.col("feature_name").alias("feature"),
        semantic_group(F.col("feature_name")).alias("semantic_group"), "rank", "score",
    )


def hybrid_trace(ranking: DataFrame, final: DataFrame) -> DataFrame:
    """Which ranked features survived: outer rank against final rank, both (feature, rank)."""
    kept = final.select("feature", F.col("rank").alias("hybrid_rank"))
    return ranking.join(kept, "feature", "left").select(
        F.col("rank").alias("llm_rank"),
        F.col("feature").alias("feature_name"),
        F.col("hybrid_rank").isNotNull().alias("survived_hybrid"),
        "hybrid_rank",
    )
