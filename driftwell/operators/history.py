"""History tables to one row per key: mass aggregation, named aggregation, joins, domain features."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.numbers import (
    WHOLE, finite, finite_floats, nan_to_null, numeric_columns, positive_flag, quoted, safe_ratio, share, sql_name, string_columns,
)
from driftwell.operators.binning import column_chunks, long_form
from driftwell.operators.ordering import ROWS_PER_BUCKET, bucket_edges, running_totals
from driftwell.session import written_table

# Key names of the history tables and the statistics of the mass aggregation.
APPLICANT = "SK_ID_CURR"
BUREAU_KEY = "SK_ID_BUREAU"
KEY_PREFIX = "SK_ID"
FEW_VALUES = ("MEAN", "SUM")
MANY_VALUES = ("MIN", "MAX", "MEAN", "SUM", "VAR")
# Feature tables with more columns than this are packed for joining.
PACKED_FROM = 8
# Histories that are built beside each other.
HISTORIES_AT_ONCE = 3
# Groups that are looked at first for three different values of a column.
FIRST_GROUPS = 500

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class AggregationPlan:
    """What the profile pass found: number columns by spread, and text levels to one-hot."""

    two_valued: tuple[str, ...]
    many_valued: tuple[str, ...]
    levels: tuple[tuple[str, tuple[str | None, ...]], ...] = ()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> AggregationPlan:
        saved = json.loads(text)
        levels = tuple((c, tuple(values)) for c, values in saved["levels"])
        return cls(tuple(saved["two_valued"]), tuple(saved["many_valued"]), levels)


def profile_for_aggregation(df: DataFrame, key: str, categorical: str = "ignore") -> AggregationPlan:
    """Which statistics each column gets: columns with at most two distinct values get mean and sum only.

    One pass with a three-bin adaptive histogram per column. It merges the closest bins first, so equal values end up
    together and three separate bins prove three values. Only bins that lie within rounding of each other
    leave it open; those columns are counted exactly.
    """
    columns = [c for c in numeric_columns(df, {key}) if not c.startswith(KEY_PREFIX)]
    many: set[str] = set()
    unsure: list[str] = []
    for chunk in column_chunks(columns):
        bins = F.transform(F.histogram_numeric("value", F.lit(3)), lambda b: b["x"]).alias("points")
        found = long_form(df, chunk).where(F.col("value").isNotNull()).groupBy("slot").agg(bins)
        for row in found.collect():
            points = sorted(set(row["points"]))
            if len(points) > 2:
                close = any(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(points, points[1:]))
                (unsure.append if close else many.add)(chunk[row["slot"]])
    many |= _more_than_two(df, unsure)
    return AggregationPlan(
        tuple(c for c in columns if c not in many), tuple(c for c in columns if c in many), _text_levels(df, key, categorical)
    )


def _text_levels(df: DataFrame, key: str, categorical: str) -> tuple[tuple[str, tuple[str | None, ...]], ...]:
    if categorical == "onehot":
        return tuple((c, tuple(_levels(df, c))) for c in string_columns(df, {key}))
    if categorical not in ("ignore", "map"):
        raise ValueError(f"unknown categorical mode {categorical!r}: use 'ignore', 'onehot' or 'map'")
    return ()


def _more_than_two(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns with a value that is neither the least nor the greatest."""
    if not columns:
        return set()
    ends = df.agg(*[f(finite(quoted(c))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("z", F.max))]).first()
    return _beyond(df, {c: (ends[f"a{i}"], ends[f"z{i}"]) for i, c in enumerate(columns)})


def _levels(df: DataFrame, column: str) -> list[str | None]:
    """Distinct levels of a text column: as many as the result gets columns. ``map`` does without them."""
    rows = df.select(quoted(column).alias("level")).where(F.col("level").isNotNull()).distinct().collect()
    return [*sorted(r["level"] for r in rows), None]


def level_counts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, feature, level, rows): how often each key has each level of each text column; a missing level is NULL.

    Rows are counted before the shuffle, so neither a hot key nor a hot level travels.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), quoted(c).cast("string").alias("level")) for c in columns])
    long = df.where(F.col(key).isNotNull()).select(key, F.explode(cells).alias("cell"))
    return long.groupBy(key, F.col("cell.feature").alias("feature"), F.col("cell.level").alias("level")).agg(F.count(F.lit(1)).alias("rows"))


def level_maps(df: DataFrame, key: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """One-hot sums without a column per level: a map of level to rows per key and text column, and its missing rows.

    A level's mean is its rows over ``{prefix}_ROWS``. A map holds the levels of one key, however many the table has.
    """
    counted = level_counts(df, key, columns)
    made = []
    for c in columns:
        own = F.col("feature") == c
        entries = F.collect_list(F.when(own & F.col("level").isNotNull(), F.struct("level", "rows")))
        made += [
            F.map_from_entries(F.array_sort(entries)).alias(f"{prefix}_{c}_LEVELS"),
            F.coalesce(F.sum(F.when(own & F.col("level").isNull(), F.col("rows"))), F.lit(0)).alias(f"{prefix}_{c}_MISSING"),
        ]
    rows = F.sum(F.when(F.col("feature") == columns[0], F.col("rows"))).alias(f"{prefix}_ROWS")
    return counted.groupBy(key).agg(rows, *made)


STATISTIC_SQL = {
    "MIN": "min({0})", "MAX": "max({0})", "MEAN": "avg({0})", "SUM": "coalesce(sum({0}), 0)", "VAR": "var_samp({0})",
}


def _statistics(column: str, prefix: str, names: Sequence[str]) -> list[Column]:
    return [F.expr(STATISTIC_SQL[s].format(sql_name(column))).alias(f"{prefix}_{column}_{s}") for s in names]


def _level_statistics(levels: Sequence[tuple[str, tuple[str | None, ...]]], prefix: str) -> list[Column]:
    made = []
    for c, values in levels:
        for level in values:
            hit = F.when(quoted(c).eqNullSafe(F.lit(level).cast("string")), 1).otherwise(0)
            label = "nan" if level is None else level
            made += [F.avg(hit).alias(f"{prefix}_{c}_{label}_MEAN"), F.coalesce(F.sum(hit), F.lit(0)).alias(f"{prefix}_{c}_{label}_SUM")]
    return made


def mass_aggregate(
    df: DataFrame,
    key: str,
    prefix: str,
    categorical: str = "ignore",
    plan: AggregationPlan | None = None,
) -> DataFrame:
    """Every number column to ``{prefix}_{column}_{STAT}`` per key, in one hash aggregation.

    All statistics merge, so a hot key is reduced before the shuffle. Rows without a key are left out. NaN and
    infinities are missing, as they are for the plan. Text columns are ignored, one-hot counted (``onehot``: two columns for
    each level) or counted into a map of levels (``map``, see ``level_maps``).
    """
    df = finite_floats(df)
    result = _planned(df, key, prefix, plan) if plan else _in_one_pass(df, key, prefix, _text_levels(df, key, categorical))
    texts = string_columns(df, {key})
    return result.join(level_maps(df, key, texts, prefix), key) if categorical == "map" and texts else result


def gathered(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by key, so that a task aggregates few groups; rows are much narrower than the statistics of a group.

    Dealt by a hash of the key and not by the key itself: Spark may then divide what a hot key fills, and the
    aggregation still merges before its own shuffle.
    """
    near = f"_near_{uuid.uuid4().hex[:8]}"
    return df.withColumn(near, F.xxhash64(key)).hint("rebalance", near).drop(near)


def _planned(df: DataFrame, key: str, prefix: str, plan: AggregationPlan) -> DataFrame:
    order = {c: i for i, c in enumerate(df.columns)}
    wanted = sorted(
        [(c, FEW_VALUES) for c in plan.two_valued] + [(c, MANY_VALUES) for c in plan.many_valued],
        key=lambda item: order[item[0]],
    )
    aggregates = [a for c, names in wanted for a in _statistics(c, prefix, names)] + _level_statistics(plan.levels, prefix)
    keyed = df.where(F.col(key).isNotNull())
    if not aggregates:
        return keyed.select(key).distinct()
    return gathered(keyed, key).groupBy(key).agg(*aggregates)


def _in_one_pass(df: DataFrame, key: str, prefix: str, levels: Sequence[tuple[str, tuple[str | None, ...]]]) -> DataFrame:
    """Aggregate and find out which statistics each column gets, reading ``df`` once.

    All statistics are written per key, and their sums over the keys tell whether a column has more than two values: for
    values between a and b, the sum of (x - a)(b - x) is 0 if and only if all are a or b. It follows from the count, the sum and the
    sum of squares. Where rounding leaves it open, that column alone is looked at again. Columns that show three values in
    the first groups need no sums.
    """
    columns = [c for c in numeric_columns(df, {key}) if not c.startswith(KEY_PREFIX)]
    aggregates = [a for c in columns for a in _statistics(c, prefix, MANY_VALUES)] + _level_statistics(levels, prefix)
    if not aggregates:
        return df.where(F.col(key).isNotNull()).select(key).distinct()
    extra = []
    for i, c in enumerate(columns):
        square = f"CAST({sql_name(c)} AS DOUBLE) * CAST({sql_name(c)} AS DOUBLE)"
        extra += [F.expr(f"count({sql_name(c)})").alias(f"_n{i}"), F.expr(f"sum({square})").alias(f"_q{i}")]
    # Rows without a key have values too; their group is left out below.
    used = df.select(key, *[quoted(c) for c in dict.fromkeys([*columns, *[c for c, _ in levels]])])
    grouped = gathered(used, key).groupBy(key).agg(*aggregates, *extra)
    seen: dict = {}
    many: set[str] = set()
    if columns:
        grouped = written_table(grouped)
        many = _proven(grouped, prefix, columns)
    left = [(i, c) for i, c in enumerate(columns) if c not in many]
    if left:
        parts = {"n": "sum(_n{i})", "s": "sum(CAST({s} AS DOUBLE))", "q": "sum(_q{i})", "a": "min(CAST({a} AS DOUBLE))", "b": "max(CAST({b} AS DOUBLE))"}
        named = [
            F.expr(sql.format(i=i, s=sql_name(f"{prefix}_{c}_SUM"), a=sql_name(f"{prefix}_{c}_MIN"), b=sql_name(f"{prefix}_{c}_MAX"))).alias(f"{part}{i}")
            for i, c in left for part, sql in parts.items()
        ]
        seen = grouped.agg(*named).first().asDict()
    settled = {c: _settled(df, c, {p: seen[f"{p}{i}"] for p in "nsqab"}) for i, c in left}
    many |= {c for c, found in settled.items() if found is True}
    unsure = {c: (seen[f"a{i}"], seen[f"b{i}"]) for i, c in left if settled[c] is None}
    many |= _beyond(df, unsure)
    wanted = [f"{prefix}_{c}_{s}" for c in columns for s in (MANY_VALUES if c in many else FEW_VALUES)]
    named_levels = [f"{prefix}_{c}_{'nan' if v is None else v}_{s}" for c, values in levels for v in values for s in FEW_VALUES]
    return grouped.where(F.col(key).isNotNull()).select(key, *[quoted(c) for c in [*wanted, *named_levels]])


def _proven(grouped: DataFrame, prefix: str, columns: Sequence[str]) -> set[str]:
    """Columns of which the first groups already show three values. The others are open: all groups have to be asked."""
    ends = [quoted(f"{prefix}_{c}_{s}") for c in columns for s in ("MIN", "MAX")]
    rows = grouped.select(*ends).limit(FIRST_GROUPS).collect()
    seen = [{v for row in rows for v in row[2 * i : 2 * i + 2]} - {None} for i in range(len(columns))]
    return {c for c, values in zip(columns, seen) if len(values) > 2}


def _settled(df: DataFrame, column: str, seen: Mapping[str, float | int | None]) -> bool | None:
    """Whether a column has more than two values, None where rounding leaves it open."""
    n, total, squares, low, high = (seen[p] for p in "nsqab")
    if not n or low == high:
        return False
    size = max(abs(low), abs(high))
    between = (low + high) * total - squares - n * low * high
    if between > 1e-6 * n * size * size:
        return True
    whole = isinstance(df.schema[column].dataType, WHOLE)
    # Whole numbers whose squares add up without rounding.
    if whole and n * size * size < 2.0**53:
        return (int(low) + int(high)) * int(total) - int(squares) - n * int(low) * int(high) != 0
    return None


def _beyond(df: DataFrame, ends: Mapping[str, tuple[float, float]]) -> set[str]:
    """Columns with a value that is neither of their two ends."""
    if not ends:
        return set()
    counts = [
        F.count_if((finite(quoted(c)) != F.lit(low)) & (finite(quoted(c)) != F.lit(high))).alias(f"n{i}")
        for i, (c, (low, high)) in enumerate(ends.items())
    ]
    found = df.agg(*counts).first()
    return {c for i, c in enumerate(ends) if found[f"n{i}"] > 0}


# pandas names of the aggregate functions a caller may ask for.
NAMED_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "var": F.var_samp,
    "std": F.stddev_samp,
    "count": F.count,
    "nunique": F.count_distinct,
}


def named_aggregate(df: DataFrame, key: str, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{output: (column, function)}`` per key. Medians do not merge, so all of them are picked by rank together."""
    unknown = sorted({fn for _, fn in spec.values()} - {*NAMED_FUNCTIONS, "median"})
    if unknown:
        raise ValueError(f"unknown aggregate functions: {unknown}")
    keyed = df.where(F.col(key).isNotNull())
    merging = [NAMED_FUNCTIONS[fn](quoted(c)).alias(out) for out, (c, fn) in spec.items() if fn != "median"]
    result = keyed.groupBy(key).agg(*merging) if merging else keyed.select(key).distinct()
    medians = {out: c for out, (c, fn) in spec.items() if fn == "median"}
    if medians:
        result = result.join(grouped_medians(keyed, key, medians), key, "left")
    return result.select(key, *spec)


def grouped_medians(df: DataFrame, key: str, outputs: Mapping[str, str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact medians of several columns per key (output -> column), reading ``df`` once.

    Values are counted in the long form and ranked by (key, column, value bucket), so that no task holds the values of a
    hot key.
    """
    columns = list(dict.fromkeys(outputs.values()))
    counted = written_table(
        long_form(df, columns, key).where(F.col("value").isNotNull()).groupBy(key, "slot", "value").agg(F.count(F.lit(1)).alias("rows"))
    )
    edges = bucket_edges(counted, ["value"], rows_per_bucket)["value"]
    placed = running_totals(counted, [key, "slot"], "value", ["rows"], edges)
    middle = F.array(F.floor((F.col("all_rows") + 1) / 2), F.floor((F.col("all_rows") + 2) / 2))
    hits = F.filter(middle, lambda r: (r > F.col("cum_rows") - F.col("rows")) & (r <= F.col("cum_rows")))
    picked = placed.select(key, "slot", "value", F.explode(hits))
    return picked.groupBy(key).agg(*[
        F.avg(F.when(F.col("slot") == columns.index(c), F.col("value"))).alias(out) for out, c in outputs.items()
    ])


def grouped_median(df: DataFrame, key: str, column: str, output: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact median of one column per key."""
    return grouped_medians(df.where(F.col(key).isNotNull()), key, {output: column}, rows_per_bucket)


def merge_left(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left equi-join; Spark picks the strategy from run-time sizes."""
    return left.join(right, on, "left")


def merge_features(base: DataFrame, tables: Sequence[DataFrame], on: str) -> DataFrame:
    """Left-join feature tables that are unique per key.

    Tables that come out of a ``groupBy`` on the same key keep their partitioning; written ones are shuffled once.
    """
    names = [on, *[c for c in base.columns if c != on], *[c for t in tables for c in t.columns if c != on]]
    if len({n.lower() for n in names}) < len(names):
        merged = base
        for table in tables:
            merged = merge_left(merged, table, on)
        return merged
    # A wide table goes through the joins and their sorts as one value, which is copied whole and not field by field.
    merged, places = base, {c: quoted(c) for c in base.columns}
    for i, table in enumerate(tables):
        own = [c for c in table.columns if c != on]
        places |= {c: quoted(c) for c in own}
        if len(own) > PACKED_FROM:
            packed = f"_packed{i}_{uuid.uuid4().hex[:8]}"
            table = table.select(on, F.struct(*[quoted(c) for c in own]).alias(packed))
            places |= {c: F.col(packed).getField(c).alias(c) for c in own}
        merged = merge_left(merged, table, on)
    return merged.select(*[places[c] for c in names])


def prepare_dataset(
    base: DataFrame, tables: Sequence[DataFrame], target: str = "TARGET", key: str = APPLICANT
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(features, target with key, merged table)."""
    merged = merge_features(base, tables, key)
    labels = merged.select(key, target) if target in merged.columns else None
    return merged.drop(target, key), labels, merged


# ---- Derived columns of the five histories ----

def bureau_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "DEBT_CREDIT_DIFF": F.col("AMT_CREDIT_SUM") - F.col("AMT_CREDIT_SUM_DEBT"),
        "DEBT_RATIO": safe_ratio(F.col("AMT_CREDIT_SUM_DEBT"), F.col("AMT_CREDIT_SUM")),
        "CREDIT_DURATION": F.col("DAYS_CREDIT_ENDDATE") - F.col("DAYS_CREDIT"),
    })


def previous_application_columns(df: DataFrame) -> DataFrame:
    credit, annuity = F.col("AMT_CREDIT"), F.col("AMT_ANNUITY")
    return df.withColumns({
        "ASK_GRANT_RATIO": safe_ratio(F.col("AMT_APPLICATION"), credit),
        "APPLICATION_DIFF": F.col("AMT_APPLICATION") - credit,
        "PAYMENT_TERM": safe_ratio(credit, annuity),
        "recent_decision": F.col("DAYS_DECISION"),
        "INTEREST_ESTIMATE": safe_ratio(F.col("CNT_PAYMENT") * annuity - credit, credit),
    })


def pos_cash_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "LATE_PAYMENT": positive_flag(F.col("SK_DPD")),
        "TOTAL_INSTALMENT_PROG": safe_ratio(F.col("CNT_INSTALMENT_FUTURE"), F.col("CNT_INSTALMENT")),
    })


def installment_columns(df: DataFrame) -> DataFrame:
    due, paid = F.col("AMT_INSTALMENT"), F.col("AMT_PAYMENT")
    delay = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return df.withColumns({
        "PAYMENT_DIFF": due - paid,
        "PAYMENT_RATIO": safe_ratio(paid, due),
        "DAYS_DIFF": delay,
        "IS_LATE": positive_flag(delay),
        "IS_UNDERPAID": positive_flag(due - paid),
    })


def credit_card_columns(df: DataFrame) -> DataFrame:
    limit = F.col("AMT_CREDIT_LIMIT_ACTUAL")
    return df.withColumns({
        "LIMIT_USE": safe_ratio(F.col("AMT_BALANCE"), limit),
        "PAYMENT_DIV_MIN": safe_ratio(F.col("AMT_PAYMENT_CURRENT"), F.col("AMT_INST_MIN_REGULARITY")),
        "DRAWING_RATIO": safe_ratio(F.col("AMT_DRAWINGS_CURRENT"), limit),
    })


# ---- Feature tables ----

def bureau_credits(bureau: DataFrame, balance: DataFrame | None, plan: AggregationPlan | None = None, **options) -> DataFrame:
    """Bureau credits with their derived columns and their aggregated monthly balances."""
    if balance is not None:
        bureau = merge_left(bureau, mass_aggregate(balance, BUREAU_KEY, "BB", plan=plan, **options), BUREAU_KEY)
    return bureau_columns(bureau)


def bureau_features(
    bureau: DataFrame,
    balance: DataFrame | None = None,
    balance_plan: AggregationPlan | None = None,
    plan: AggregationPlan | None = None,
    **options,
) -> DataFrame:
    """Two levels: monthly balances per bureau credit, then credits per applicant, each read once."""
    credits = bureau_credits(bureau, balance, balance_plan, **options)
    return mass_aggregate(credits, APPLICANT, "BURO", plan=plan, **options)


def previous_application_features(previous: DataFrame, **options) -> DataFrame:
    table = mass_aggregate(previous_application_columns(previous), APPLICANT, "PREV", **options)
    if "PREV_recent_decision_MAX" in table.columns:
        table = table.withColumn("recent_decision", F.col("PREV_recent_decision_MAX"))
    return table


def pos_cash_features(pos: DataFrame, **options) -> DataFrame:
    return mass_aggregate(pos_cash_columns(pos), APPLICANT, "POS", **options)


def installment_features(installments: DataFrame, **options) -> DataFrame:
    return mass_aggregate(installment_columns(installments), APPLICANT, "INSTAL", **options)


def credit_card_features(cards: DataFrame, **options) -> DataFrame:
    return mass_aggregate(credit_card_columns(cards), APPLICANT, "CC", **options)


# Table name to (prefix, derived columns, feature table) of the one-level histories.
ONE_LEVEL = {
    "previous_application": ("PREV", previous_application_columns, previous_application_features),
    "POS_CASH_balance": ("POS", pos_cash_columns, pos_cash_features),
    "installments_payments": ("INSTAL", installment_columns, installment_features),
    "credit_card_balance": ("CC", credit_card_columns, credit_card_features),
}


def profile_histories(tables: Tables, categorical: str = "ignore") -> dict[str, AggregationPlan]:
    """Plans by prefix. Kept and handed back later, they fix the output columns and save the profile passes."""
    plans = {}
    if "bureau" in tables:
        balance = tables.get("bureau_balance")
        if balance is not None:
            plans["BB"] = profile_for_aggregation(nan_to_null(balance), BUREAU_KEY, categorical)
        credits = bureau_credits(tables["bureau"], balance, plans.get("BB"))
        plans["BURO"] = profile_for_aggregation(nan_to_null(credits), APPLICANT, categorical)
    for name, (prefix, derive, _) in ONE_LEVEL.items():
        if name in tables:
            plans[prefix] = profile_for_aggregation(nan_to_null(derive(tables[name])), APPLICANT, categorical)
    return plans


def all_history_features(
    tables: Tables, plans: Mapping[str, AggregationPlan] | None = None, **options
) -> list[DataFrame]:
    """Feature table of every history that is present.

    Histories do not depend on each other: a few are built beside each other, so that the last tasks of one leave no core idle.
    """
    plans, work = plans or {}, []
    if "bureau" in tables:
        work.append(lambda: bureau_features(
            tables["bureau"], tables.get("bureau_balance"), plans.get("BB"), plans.get("BURO"), **options
        ))
    for name, (prefix, _, build) in ONE_LEVEL.items():
        if name in tables:
            work.append(partial(build, tables[name], plan=plans.get(prefix), **options))
    if not work:
        return []
    run = inheritable_thread_target(next(iter(tables.values())).sparkSession)(lambda step: step())
    with ThreadPoolExecutor(HISTORIES_AT_ONCE) as pool:
        return list(pool.map(run, work))


def latest_per_key(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The whole row with the greatest (order, tie) per key; a hot key is reduced before the shuffle."""
    others = [c for c in df.columns if c not in (key, order, tie)]
    best = F.max(F.struct(order, tie, *others)).alias("best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "best.*").select(df.columns)


def rate_and_volume(df: DataFrame, by: str, target: str) -> DataFrame:
    """Mean and count of a target per group value."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.avg(target).alias("mean"), F.count(target).alias("count")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(column, "count", share(F.col("count"), total).alias("share"))
