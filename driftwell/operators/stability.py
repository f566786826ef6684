"""How much feature selection agrees across folds.

Input is a long selection log with one row per (run keys, fold, feature). A run's selection is at most
folds x features, so each run becomes one row of sets and pairs of folds are compared inside it with
array functions: no self-join, no rows per pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.labels import semantic_group
from driftwell.functions.numbers import share
from driftwell.operators.joins import spread_join
from driftwell.operators.ordering import ROWS_PER_BUCKET, bucket_edges, running_totals
from driftwell.session import single_row, small_side, written_table

# Fixed value: a feature is stable when picked in at least this share of the folds.
STABLE_SHARE = 0.8


def fold_sets(log: DataFrame, keys: Sequence[str] = (), fold: str = "fold_id", item: str = "feature_name") -> DataFrame:
    """One row per run with ``sets``: the item sets in fold order.

    A fold whose items are all missing still counts, with an empty set.
    """
    per_fold = log.groupBy(*keys, fold).agg(F.array_sort(F.collect_set(item)).alias("items"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(fold).alias("fold"), "items")))
    return per_fold.groupBy(*keys).agg(ordered.alias("folds")).withColumn(
        "sets", F.transform("folds", lambda x: x["items"])
    )


def fold_pairs(items: Column, value) -> Column:
    """Array of ``value(left, right)`` over the unordered pairs of an array."""
    return F.flatten(
        F.transform(
            items,
            lambda left, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda right: value(left, right)),
        )
    )


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all; two empty sets are equal, so 1."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(share(F.size(F.array_intersect(left, right)), union))


def array_mean(values: Column) -> Column:
    """Mean of the non-missing elements, NULL when there is none."""
    kept = F.filter(values, lambda x: x.isNotNull())
    return share(F.aggregate(kept, F.lit(0.0), lambda total, x: total + x), F.size(kept))


def array_deviation(values: Column) -> Column:
    """Sample deviation of the non-missing elements, NULL for fewer than two."""
    kept = F.filter(values, lambda x: x.isNotNull())
    mean = array_mean(values)
    squares = F.aggregate(kept, F.lit(0.0), lambda total, x: total + (x - mean) * (x - mean))
    return F.when(F.size(kept) > 1, F.sqrt(squares / (F.size(kept) - 1)))


def pairwise_jaccard(sets: Column) -> Column:
    """Mean over fold pairs; NULL below two folds."""
    return array_mean(fold_pairs(sets, jaccard))


def kuncheva(sets: Column, total: Column) -> Column:
    """Mean consistency over pairs of equal, non-empty, incomplete sets, corrected for chance."""
    def consistency(left: Column, right: Column) -> Column:
        k = F.size(left).cast("double")
        shared = F.size(F.array_intersect(left, right)).cast("double")
        usable = (F.size(left) > 0) & (F.size(left) == F.size(right)) & (k != total)
        return F.when(usable, F.try_divide(shared * total - k * k, k * (total - k)))

    return F.when(total > 1, array_mean(fold_pairs(sets, consistency)))


def nogueira(log: DataFrame, total: int | str, keys: Sequence[str] = (), fold: str = "fold_id",
             item: str = "feature_name") -> DataFrame:
    """Stability of selection indicators: 1 for equal sets, about 0 for chance, one row per run.

    ``total`` is the number of candidate features, or the log column that holds it. NULL below two folds
    or without features; 1 when every candidate is selected.
    """
    p = F.lit(float(total)) if isinstance(total, int) else F.col(total).cast("double")
    picks = log.select(*keys, fold, item, p.alias("_p")).distinct()
    runs = picks.groupBy(*keys).agg(
        F.count_distinct(fold).cast("double").alias("m"), F.count(item).alias("picked"), F.max("_p").alias("p")
    )
    # Frequencies need the number of folds, so counts per feature are turned into power sums first:
    # sum f(1-f) = sum(c)/m - sum(c^2)/m^2.
    sums = (
        picks.where(F.col(item).isNotNull())
        .groupBy(*keys, item)
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*keys)
        .agg(F.sum("c").alias("c1"), F.sum(F.col("c") * F.col("c")).alias("c2"))
    )
    if keys:
        both = runs.join(sums, list(keys), "left")
    else:
        both = single_row(runs, sums)
    m, size = F.col("m"), F.col("picked") / F.col("m")
    observed = (m / (m - 1)) * (F.col("c1") / m - F.col("c2") / (m * m)) / F.col("p")
    expected = (size / F.col("p")) * (1 - size / F.col("p"))
    value = (
        F.when((m < 2) | (F.col("p") <= 1) | F.coalesce(F.col("c1") == 0, F.lit(True)), None)
        .when((size <= 0) | (size >= F.col("p")), F.lit(1.0))
        .otherwise(1 - F.try_divide(observed, expected))
    )
    return both.select(*keys, value.cast("double").alias("nogueira_stability"))


def set_stability(log: DataFrame, total: int, keys: Sequence[str] = (), fold: str = "fold_id",
                  item: str = "feature_name") -> DataFrame:
    """Mean pairwise Jaccard and Kuncheva per run."""
    sets = fold_sets(log, keys, fold, item)
    return sets.select(
        *keys,
        pairwise_jaccard(F.col("sets")).alias("mean_pairwise_jaccard"),
        kuncheva(F.col("sets"), F.lit(float(total))).alias("kuncheva_stability"),
    )


def _frequency(log: DataFrame, item: str, keys: Sequence[str], fold: str, extra: dict[str, Column]) -> DataFrame:
    found = log.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(
        F.count_distinct(fold).alias("selection_count"), *[c.alias(n) for n, c in extra.items()]
    )
    if keys:
        folds = log.groupBy(*keys).agg(F.count_distinct(fold).alias("total_folds"))
        counted = found.join(folds, list(keys))
    else:
        counted = found.withColumn("total_folds", log.agg(F.count_distinct(fold)).scalar())
    ordered = counted.withColumn("selection_frequency", share(F.col("selection_count"), F.col("total_folds")))
    return ordered.select(*keys, item, "selection_count", "total_folds", "selection_frequency", *extra)


def selection_frequency(log: DataFrame, keys: Sequence[str] = (), fold: str = "fold_id") -> DataFrame:
    """Share of folds that picked each feature, with mean rank and score where given."""
    def mean_of(name: str) -> Column:
        return F.avg(F.col(name).cast("string").try_cast("double")) if name in log.columns else F.max(F.lit(None).cast("double"))

    extra = {"mean_rank_if_available": mean_of("rank"), "mean_score_if_available": mean_of("score")}
    return _frequency(log, "feature_name", keys, fold, extra)


def with_semantic_group(log: DataFrame) -> DataFrame:
    if "semantic_group" in log.columns:
        return log
    return log.withColumn("semantic_group", semantic_group(F.col("feature_name")))


def group_frequency(log: DataFrame, keys: Sequence[str] = (), fold: str = "fold_id") -> DataFrame:
    """Share of folds in which each semantic group is represented."""
    return _frequency(with_semantic_group(log), "semantic_group", keys, fold, {})


def most_frequent_first(frequency: DataFrame, item: str = "feature_name") -> DataFrame:
    return frequency.orderBy(F.col("selection_frequency").desc(), F.col("selection_count").desc(), item)


def jaccard_with_previous(log: DataFrame, keys: Sequence[str] = (), fold: str = "fold_id",
                          item: str = "feature_name") -> DataFrame:
    """(fold, jaccard_similarity) against the last earlier fold that picked anything; NULL for the first."""
    sets = fold_sets(log, keys, fold, item)
    folds = F.col("folds")
    rows = F.transform(
        folds,
        lambda x, i: F.struct(
            x["fold"].alias("fold"),
            x["items"].alias("items"),
            F.try_element_at(
                F.filter(F.slice(folds, F.lit(1), i), lambda y: F.size(y["items"]) > 0), F.lit(-1)
            )["items"].alias("before"),
        ),
    )
    return sets.select(*keys, F.explode(rows).alias("r")).select(
        *keys,
        F.col("r.fold").alias(fold),
        F.size("r.items").alias("selected_features"),
        F.when(F.col("r.before").isNotNull(), jaccard(F.col("r.items"), F.col("r.before"))).alias("jaccard_similarity"),
    )


# ---- Rank agreement ----

def average_rank(log: DataFrame, value: str, keys: Sequence[str], output: str = "rank", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Descending rank of ``value`` within the keys; equal values share their mean rank.

    Counted per distinct value first, so ties of any size are one row. A hot key is cut into buckets of value, and a hot
    value finds its rank without travelling.
    """
    present = log.where(F.col(value).isNotNull())
    counted = written_table(present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    edges = bucket_edges(counted, [value], rows_per_bucket)[value]
    placed = running_totals(counted, list(keys), value, ["_n"], edges, descending=True)
    ranked = placed.select(*keys, value, "_n", (F.col("cum__n") - (F.col("_n") - 1) / 2.0).alias(output))
    return spread_join(log, ranked, [*keys, value], "_n").select(*log.columns, output)


def rank_pairs(log: DataFrame, keys: Sequence[str], fold: str) -> DataFrame:
    """(keys, left, right, x, y): ranks of a feature in two folds, for every pair of a run's folds and every feature that
    either ranks. A feature missing on one side ranks after its last. ``left`` and ``right`` are places in fold order."""
    ranked = log.where(F.col("rank").isNotNull() & F.col("feature_name").isNotNull())
    unique = ranked.groupBy(*keys, fold, "feature_name").agg(F.max(F.col("rank").cast("double")).alias("rank"))
    folds = rank_folds(unique, keys, fold)
    # A feature has a rank per fold at most, a run a row of folds.
    held = unique.groupBy(*keys, "feature_name").agg(F.map_from_entries(F.collect_list(F.struct(fold, "rank"))).alias("ranks"))
    joined = held.join(small_side(folds), list(keys)) if keys else held.join(F.broadcast(folds))
    sides = F.transform(
        "folds",
        lambda f, i: F.struct(
            i.alias("place"), F.try_element_at(F.col("ranks"), f["fold"]).alias("own"), (f["worst"] + 1).alias("last")
        ),
    )
    pairs = fold_pairs(
        F.col("sides"),
        lambda a, b: F.struct(
            a["place"].alias("left"), b["place"].alias("right"), F.coalesce(a["own"], a["last"]).alias("x"),
            F.coalesce(b["own"], b["last"]).alias("y"), (a["own"].isNotNull() | b["own"].isNotNull()).alias("there"),
        ),
    )
    cells = joined.withColumn("sides", sides).select(*keys, F.explode(pairs).alias("p"))
    return cells.where("p.there").select(*keys, "p.left", "p.right", "p.x", "p.y")


def rank_folds(ranked: DataFrame, keys: Sequence[str], fold: str) -> DataFrame:
    """One row per run: its folds in order, with the last rank of each."""
    worst = ranked.groupBy(*keys, fold).agg(F.max("rank").alias("worst"))
    return worst.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(fold).alias("fold"), "worst"))).alias("folds"))


def kendall_by_inversions(pairs: DataFrame, by: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(by, kendall_tau): (concordant - discordant) / (concordant + discordant) of (x, y); ties count for neither.

    Discordant pairs are the inversions of y in the order of x. Two numbers are in wrong order if and only if, at the first
    bit where they differ, the earlier has 1 and the later 0. So each row counts, per bit, the ones before it among the rows
    that agree in all higher bits: a running total per (group, bit, higher bits), cut into buckets of place. That is rows times
    bits, whatever the number of pairs.
    """
    by = list(by)
    grid = written_table(pairs.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n")))

    # A row stands in one bucket per bit, of which there are few dozen.
    edges = bucket_edges(grid, ["x", "y"], max(1, rows_per_bucket // 32))

    def dense(column: str) -> DataFrame:
        values = grid.groupBy(*by, column).agg(F.sum("n").alias(f"{column}_rows"), F.lit(1).alias("one"))
        return running_totals(values, by, column, ["one"], edges[column]).select(*by, column, f"{column}_rows", F.col("cum_one").alias(f"{column}_place"))

    xs, ys = dense("x"), dense("y")
    most = max(1, ys.agg(F.max("y_place")).first()[0] or 1)
    bits = most.bit_length()
    numbered = grid.join(xs.drop("x_rows"), [*by, "x"]).join(ys.drop("y_rows"), [*by, "y"])
    placed = written_table(numbered.select(*by, "n", (F.col("x_place") * (most + 1) + F.col("y_place")).alias("place"), F.col("y_place").alias("y")))
    place_edges = bucket_edges(placed, ["place"], max(1, rows_per_bucket // 32))["place"] if edges["x"] or edges["y"] else []
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda b: F.struct(b.alias("bit"), F.call_function("shiftright", F.col("y"), b + 1).alias("high"), F.call_function("shiftright", F.col("y"), b).bitwiseAND(1).alias("one")),
    )
    spread = placed.select(*by, "n", "place", F.explode(levels).alias("l")).select(
        *by, "n", "place", "l.bit", "l.high", "l.one", (F.col("n") * F.col("l.one")).alias("ones")
    )
    counted = running_totals(spread, [*by, "bit", "high"], "place", ["ones"], place_edges)
    wrong = counted.groupBy(*by).agg(F.sum(F.when(F.col("one") == 0, F.col("n") * F.col("cum_ones")).otherwise(0)).cast("double").alias("wrong"))

    def ties(frame: DataFrame, rows: str) -> DataFrame:
        pairs_of = F.col(rows).cast("double") * (F.col(rows) - 1) / 2
        return frame.groupBy(*by).agg(F.sum(pairs_of).alias(f"{rows}_ties"), F.sum(rows).cast("double").alias(f"{rows}_all"))

    sums = wrong.join(ties(grid, "n"), by).join(ties(xs, "x_rows"), by).join(ties(ys, "y_rows"), by)
    untied = F.col("n_all") * (F.col("n_all") - 1) / 2 - F.col("x_rows_ties") - F.col("y_rows_ties") + F.col("n_ties")
    return sums.select(*by, F.try_divide(untied - 2 * F.col("wrong"), untied).alias("kendall_tau"))


def spearman_of(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, spearman): correlation of x and y; NULL below two rows or without spread."""
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.expr(e)).alias(n) for n, e in (("a", "x"), ("b", "y"), ("aa", "x * x"), ("bb", "y * y"), ("ab", "x * y"))]
    )
    left, right = F.expr("n * aa - a * a"), F.expr("n * bb - b * b")
    value = F.try_divide(F.expr("n * ab - a * b"), F.sqrt(left) * F.sqrt(right))
    return sums.select(*by, F.when((F.col("n") >= 2) & (left > 0) & (right > 0), value).alias("spearman"))


def rank_stability(log: DataFrame, keys: Sequence[str] = (), fold: str = "fold_id", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Spearman and Kendall agreement of the ranks over fold pairs: (metric, mean_value, std_value, n_pairs).

    The log has (fold, feature_name, rank). Rows are features times fold pairs, and no run is one row or task.
    """
    keys = list(keys)
    pairs = written_table(rank_pairs(log, keys, fold))
    by = [*keys, "left", "right"]
    measured = kendall_by_inversions(pairs, by, rows_per_bucket).join(spearman_of(pairs, by), by)
    metrics = ("spearman", "kendall_tau")
    values = measured.groupBy(*keys).agg(*[
        F.struct(F.avg(m).alias("mean_value"), F.stddev_samp(m).alias("std_value"), F.count(m).cast("int").alias("n_pairs")).alias(m) for m in metrics
    ])
    # Runs with one fold have no pairs, and a row without values.
    named = F.col("rank").isNotNull() & F.col("feature_name").isNotNull()
    runs = log.where(named).select(*keys).distinct() if keys else log.where(named).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows")
    found = runs.join(values, keys, "left") if keys else runs.join(F.broadcast(values))
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}.mean_value"), F.col(f"{m}.std_value"), F.coalesce(f"{m}.n_pairs", F.lit(0)).alias("n_pairs")) for m in metrics
    ])
    return found.select(*keys, F.inline(cells))


# ---- Bundle ----

def stability_bundle(log: DataFrame, total: int, rankings: DataFrame | None = None) -> DataFrame:
    """All stability numbers of one run in one row.

    ``rankings`` (fold_id, feature_name, rank), when given, replaces the selection's own ranks.
    """
    log = with_semantic_group(log)
    sets = fold_sets(log)
    groups = fold_sets(log, item="semantic_group")
    mean_size = lambda c: F.floor(array_mean(F.transform(c, lambda s: F.size(s).cast("double"))))
    own = sets.select(
        kuncheva(F.col("sets"), F.lit(float(total))).alias("kuncheva_stability"),
        pairwise_jaccard(F.col("sets")).alias("mean_pairwise_jaccard"),
        mean_size(F.col("sets")).alias("_size"),
    )
    grouped = groups.select(
        pairwise_jaccard(F.col("sets")).alias("semantic_group_jaccard"), mean_size(F.col("sets")).alias("_groups")
    )
    stable = lambda frame: frame.agg(F.count_if(F.col("selection_frequency") >= STABLE_SHARE)).scalar()
    ranks = rank_stability(log if rankings is None else rankings)
    rank = lambda metric, column: F.max(F.when(F.col("metric") == metric, F.col(column)))
    rank_row = ranks.agg(
        rank("spearman", "mean_value").alias("spearman_rank_stability_mean"),
        rank("spearman", "std_value").alias("spearman_rank_stability_std"),
        rank("kendall_tau", "mean_value").alias("kendall_rank_stability_mean"),
        rank("kendall_tau", "std_value").alias("kendall_rank_stability_std"),
    )
    joined = single_row(own, grouped, nogueira(log, total), rank_row)
    counted = joined.withColumns({
        "stable_feature_count_80": stable(selection_frequency(log)),
        "stable_semantic_group_count_80": stable(group_frequency(log)),
        "total_candidate_feature_count": F.lit(int(total)),
        "rbo_rank_stability_mean": F.lit(None).cast("double"),
        "rbo_rank_stability_std": F.lit(None).cast("double"),
    }).withColumns({
        "stable_feature_ratio_80": share(F.col("stable_feature_count_80"), F.col("_size")),
        "semantic_group_stable_ratio_80": share(F.col("stable_semantic_group_count_80"), F.col("_groups")),
    })
    return counted.select(*STABILITY_COLUMNS)


# Columns of the bundle, in order.
STABILITY_COLUMNS = [
    "nogueira_stability", "kuncheva_stability", "mean_pairwise_jaccard", "semantic_group_jaccard",
    "stable_feature_count_80", "stable_feature_ratio_80", "stable_semantic_group_count_80",
    "semantic_group_stable_ratio_80", "total_candidate_feature_count",
    "spearman_rank_stability_mean", "spearman_rank_stability_std",
    "kendall_rank_stability_mean", "kendall_rank_stability_std",
    "rbo_rank_stability_mean", "rbo_rank_stability_std",
]


# ---- Overlap of two runs ----

def fold_overlap(left: DataFrame, right: DataFrame, fold: str = "fold_id", item: str = "feature_name") -> DataFrame:
    """Feature overlap of two runs in the folds that both have."""
    def picks(log: DataFrame, flag: str) -> DataFrame:
        return log.select(fold, item).distinct().withColumn(flag, F.lit(True))

    shared_folds = left.select(fold).distinct().join(right.select(fold).distinct(), fold)
    both = picks(left, "_l").join(picks(right, "_r"), [fold, item], "full").join(shared_folds, fold, "left_semi")
    named = F.col(item).isNotNull()
    counted = both.groupBy(fold).agg(
        F.count_if(F.col("_l") & named).alias("left_feature_count"),
        F.count_if(F.col("_r") & named).alias("right_feature_count"),
        F.count_if(F.col("_l") & F.col("_r") & named).alias("intersection_count"),
        F.count_if(named).alias("union_count"),
    )
    ratio = share(F.col("intersection_count"), F.col("union_count"))
    return counted.withColumn("jaccard_similarity", F.coalesce(ratio, F.lit(1.0)))
