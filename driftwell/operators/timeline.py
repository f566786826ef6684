"""Relative time: recency proxy, windows, leakage checks and time-ordered splits.

Time is a number: days before the reference date, negative, 0 = newest.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.numbers import finite, latest, months_to_days, quoted
from driftwell.operators.history import APPLICANT, ONE_LEVEL
from driftwell.operators.ordering import at_or_before, bucket_edges, running_totals, values_at

# Proxy column, source tables with their day expressions, split column candidates.
TIME_PROXY = "application_time_proxy"
DAY_COLUMNS = {
    "previous_application": ("DAYS_DECISION",),
    "bureau": ("DAYS_CREDIT",),
    "installments_payments": ("DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT"),
}
MONTH_COLUMNS = {"POS_CASH_balance": "MONTHS_BALANCE", "credit_card_balance": "MONTHS_BALANCE"}
TIME_CANDIDATES = ("recent_decision", "PREV_recent_decision_MAX", "DAYS_DECISION")
ID_COLUMNS = ("SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV")
EXCLUDED_FEATURES = (
    "TARGET", "recent_decision", "PREV_recent_decision_MAX", "DAYS_DECISION", "application_time_proxy",
)
MISSING_TIME_OFFSET = 30.0


# ---- Recency ----

def latest_event(df: DataFrame | None, key: str, source: str, output: str) -> DataFrame | None:
    """Newest ``source`` per key, missing sources left out; None when a column is absent."""
    if df is None or key not in df.columns or source not in df.columns:
        return None
    value = finite(F.col(source))
    return (
        df.where(F.col(key).isNotNull() & value.isNotNull()).groupBy(key).agg(F.max(value).alias(output))
    )


def event_days(tables: Mapping[str, DataFrame], key: str = APPLICANT) -> list[DataFrame]:
    """(key, day) per history that is present and has a usable time column."""
    parts: list[DataFrame] = []
    for name in ("previous_application", "bureau", "installments_payments"):
        table = tables.get(name)
        if table is not None and key in table.columns:
            days = [F.col(c) for c in DAY_COLUMNS[name] if c in table.columns]
            if days:
                parts.append(table.select(key, latest(*days).alias("day")))
    for name, column in MONTH_COLUMNS.items():
        table = tables.get(name)
        if table is not None and key in table.columns and column in table.columns:
            parts.append(table.select(key, finite(months_to_days(F.col(column))).alias("day")))
    return parts


def newest_only(tables: Mapping[str, DataFrame], features: Sequence[DataFrame], key: str = APPLICANT) -> dict[str, DataFrame]:
    """Histories cut to what ``time_proxy`` reads: one row per key with the newest value of each time column.

    The newest of several columns over all rows is the newest of their maxima, which the feature tables have. A history
    whose maxima are not all there stays as it is.
    """
    prefixes = {"bureau": "BURO"} | {name: prefix for name, (prefix, _, _) in ONE_LEVEL.items()}
    cut = dict(tables)
    for name, columns in (DAY_COLUMNS | {n: (c,) for n, c in MONTH_COLUMNS.items()}).items():
        if name not in tables or key not in tables[name].columns:
            continue
        maxima = {c: f"{prefixes[name]}_{c}_MAX" for c in columns if c in tables[name].columns}
        for made in features:
            if maxima and key in made.columns and set(maxima.values()) <= set(made.columns):
                cut[name] = made.select(key, *[quoted(m).alias(c) for c, m in maxima.items()])
    return cut


def time_proxy(tables: Mapping[str, DataFrame], key: str = APPLICANT) -> DataFrame | None:
    """Newest event per key over all histories.

    The maximum over a chain of full outer joins is the maximum over a union: one shuffle, not five, and
    a hot key is reduced before it.
    """
    parts = event_days(tables, key)
    if not parts:
        return None
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return (
        stacked.where(F.col(key).isNotNull() & F.col("day").isNotNull())
        .groupBy(key)
        .agg(F.max("day").alias(TIME_PROXY))
    )


def resolve_time_column(columns: Sequence[str], preferred: str, extra: Sequence[str] = ()) -> str:
    """First candidate present as written, in upper case or in lower case."""
    tried = [form for name in (preferred, *extra) for form in (name, name.upper(), name.lower())]
    for name in tried:
        if name in columns:
            return name
    raise ValueError(f"no time column; tried {tried}")


def fill_missing_time(df: DataFrame, time: str) -> DataFrame:
    """Missing time becomes 30 days before the earliest seen one."""
    if time not in df.columns:
        raise ValueError(f"{time} is not a column")
    earliest = df.agg(F.min(time)).first()[0]
    if earliest is None:
        raise ValueError(f"{time} has no observed values")
    return df.withColumn(time, F.coalesce(F.col(time).cast("double"), F.lit(float(earliest) - MISSING_TIME_OFFSET)))


# ---- DEV / OOT windows ----

@dataclass(frozen=True)
class Windows:
    """DEV is [dev_start, oot_start), OOT is [oot_start, oot_end]."""

    dev_start: float = -600
    oot_start: float = -240
    oot_end: float = 0


def split_label(time: Column, windows: Windows) -> Column:
    return F.when((time >= windows.dev_start) & (time < windows.oot_start), "dev").when(
        (time >= windows.oot_start) & (time <= windows.oot_end), "oot"
    )


def cut_windows(df: DataFrame, time: str, windows: Windows = Windows()) -> DataFrame:
    """Rows inside the windows, with their ``split``. The range reaches the scan as a pushed filter."""
    inside = F.col(time).between(windows.dev_start, windows.oot_end)
    return df.where(inside).withColumn("split", split_label(F.col(time), windows))


def window_audit(df: DataFrame, time: str, windows: Windows = Windows()) -> DataFrame:
    """One row: source rows, rows dropped for missing time or for being too old, rows per split."""
    label = split_label(F.col(time), windows)
    return df.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(F.col(time).isNull()).alias("dropped_missing_time"),
        F.count_if(F.col(time) < windows.dev_start).alias("dropped_older"),
        F.count_if(label == "dev").alias("dev_rows"),
        F.count_if(label == "oot").alias("oot_rows"),
    )


def check_windows(df: DataFrame, time: str, windows: Windows = Windows()) -> dict[str, int]:
    """The audit as numbers; refuses an empty DEV or OOT."""
    found = window_audit(df, time, windows).first().asDict()
    if not found["dev_rows"] or not found["oot_rows"]:
        raise ValueError(f"temporal split failed: {found} with {windows}")
    return found


def split_manifest(df: DataFrame, time: str, target: str) -> DataFrame:
    """Rows, time range and target rate per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(time).alias("time_min"),
        F.max(time).alias("time_max"),
        F.avg(target).alias("target_rate"),
    )


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Tolerant drop."""
    return df.drop(*names)


def model_columns(df: DataFrame, time: str, target: str, excluded: Iterable[str] = EXCLUDED_FEATURES,
                  others: Iterable[str] = (*ID_COLUMNS, "split")) -> list[str]:
    """Columns a model may see."""
    banned = {time, target, *excluded, *others}
    return [c for c in df.columns if c not in banned]


def leakage_report(
    df: DataFrame, features: Sequence[str], time: str, target: str, excluded: Iterable[str] = EXCLUDED_FEATURES
) -> DataFrame:
    """One row with the checks passed; raises when a forbidden column or an overlapping window is found."""
    forbidden = sorted({time, target, *excluded} & set(features))
    if forbidden:
        raise ValueError(f"leakage: forbidden columns among the features: {forbidden}")
    report = df.agg(
        F.max(F.when(F.col("split") == "dev", F.col(time))).cast("double").alias("train_time_max"),
        F.min(F.when(F.col("split") == "oot", F.col(time))).cast("double").alias("oot_time_min"),
    ).select(
        "*",
        (F.col("train_time_max") < F.col("oot_time_min")).alias("temporal_split_disjoint"),
        F.lit(True).alias("target_column_excluded"),
        F.lit(False).alias("oot_used_in_feature_selection"),
    )
    row = report.first()
    if not row["temporal_split_disjoint"]:
        raise ValueError(f"leakage: OOT is not strictly after DEV: {row}")
    return df.sparkSession.createDataFrame([row], report.schema)


# ---- Grouped expanding splits ----

@dataclass(frozen=True)
class TimeFold:
    """Train on ``time <= train_end``, validate on ``val_start <= time <= val_end``."""

    fold: int
    train_end: float
    val_start: float
    val_end: float

    def train(self, time: Column) -> Column:
        return time <= F.lit(self.train_end)

    def validation(self, time: Column) -> Column:
        return time.between(F.lit(self.val_start), F.lit(self.val_end))


def time_groups(df: DataFrame, time: str) -> DataFrame:
    """Rows per time value with running row count and 0-based position among the distinct times."""
    counted = df.groupBy(time).agg(F.count(F.lit(1)).alias("rows")).withColumn("groups", F.lit(1).cast("long"))
    edges = bucket_edges(df, [time])[time]
    return running_totals(counted, [], time, ["rows", "groups"], edges).select(
        time,
        "rows",
        F.col("cum_rows").alias("upto"),
        (F.col("cum_groups") - 1).alias("place"),
        F.col("all_rows").alias("total_rows"),
        F.col("all_groups").alias("total_groups"),
    )


def grouped_time_bounds(df: DataFrame, time: str, n_splits: int = 5, gap: int = 0) -> DataFrame:
    """Bounds of the expanding folds: (fold, train_end, val_start, val_end), at most ``n_splits`` rows.

    Equal times are never split. Folds without training rows are left out.
    """
    groups = time_groups(df, time)
    size = F.floor(F.col("total_rows") / (n_splits + 1))
    before, upto = F.col("upto") - F.col("rows"), F.col("upto")

    def first_row(fold: Column) -> Column:
        return F.col("total_rows") - (n_splits - fold + 1) * size + 1

    def covers(position: Column) -> Column:
        return (position > before) & (position <= upto)

    # Each time group names the folds that start or end in it.
    folds = F.sequence(F.lit(1), F.lit(n_splits))
    touched = groups.withColumn(
        "fold",
        F.explode(F.filter(folds, lambda i: covers(first_row(i)) | covers(first_row(i) + size - 1))),
    ).withColumns({
        "starts": covers(first_row(F.col("fold"))),
        "ends": covers(first_row(F.col("fold")) + size - 1),
    })
    marks = (
        touched.groupBy("fold")
        .agg(
            F.max(F.when(F.col("starts"), F.col(time))).alias("val_start"),
            F.max(F.when(F.col("starts"), F.col("place"))).alias("start_place"),
            F.max(F.when(F.col("ends"), F.col(time))).alias("val_end"),
        )
        .withColumn("train_place", F.col("start_place") - gap - 1)
        .where("train_place >= 0")
    )
    ends = groups.select(F.col(time).alias("train_end"), F.col("place").alias("train_place"))
    return ends.join(F.broadcast(marks), "train_place").select("fold", "train_end", "val_start", "val_end")


def grouped_time_folds(df: DataFrame, time: str, n_splits: int = 5, gap: int = 0) -> list[TimeFold]:
    """The bounds as driver values; refuses missing times and too few distinct times."""
    checked = df.agg(
        F.count_if(F.col(time).isNull()).alias("missing"), F.count_distinct(time).alias("groups")
    ).first()
    if checked["missing"]:
        raise ValueError(f"{time} contains missing values")
    if checked["groups"] <= n_splits:
        raise ValueError(f"need more than {n_splits} distinct times, got {checked['groups']}")
    rows = grouped_time_bounds(df, time, n_splits, gap).orderBy("fold").collect()
    return [TimeFold(r["fold"], r["train_end"], r["val_start"], r["val_end"]) for r in rows]


def fold_info(df: DataFrame, time: str, folds: Sequence[TimeFold]) -> DataFrame:
    """Sizes and first/last time of the train and validation part of each fold.

    Rows are counted per time first, so the folds, which overlap, never multiply the rows.
    """
    per_time = df.where(F.col(time).isNotNull()).groupBy(time).agg(F.count(F.lit(1)).alias("rows"))
    pieces = []
    for fold in folds:
        for role, member in (("train", fold.train(F.col(time))), ("val", fold.validation(F.col(time)))):
            pieces += [F.when(member, F.struct(F.lit(fold.fold).alias("fold"), F.lit(role).alias("role")))]
    parts = per_time.select(time, "rows", F.explode(F.array_compact(F.array(*pieces))).alias("part"))
    return (
        parts.groupBy(F.col("part.fold").alias("fold"))
        .agg(*_role_aggregates(time))
    )


def _role_aggregates(time: str) -> list[Column]:
    aggregates = []
    for role in ("train", "val"):
        mine = F.col("part.role") == role
        aggregates += [
            F.sum(F.when(mine, F.col("rows"))).alias(f"{role}_size"),
            F.min(F.when(mine, F.col(time))).alias(f"{role}_time_start"),
            F.max(F.when(mine, F.col(time))).alias(f"{role}_time_end"),
        ]
    return aggregates


def fold_membership(df: DataFrame, time: str, folds: Sequence[TimeFold]) -> DataFrame:
    """Every row once per (fold, role) it belongs to. Bounds are literals, so no join is needed.

    Folds overlap: prefer filtering by ``TimeFold.train`` and ``TimeFold.validation`` over keeping this.
    """
    parts = [
        F.when(member, F.struct(F.lit(f.fold).alias("fold"), F.lit(role).alias("role")))
        for f in folds
        for role, member in (("train", f.train(F.col(time))), ("val", f.validation(F.col(time))))
    ]
    return _exploded(df, parts)


def _exploded(df: DataFrame, parts: list[Column]) -> DataFrame:
    return (
        df.withColumn("part", F.explode(F.array_compact(F.array(*parts))))
        .withColumns({"fold": F.col("part.fold"), "role": F.col("part.role")})
        .drop("part")
    )


# ---- Positional splits ----

@dataclass(frozen=True)
class PositionFold:
    """0-based half-open row positions in (time, key) order."""

    fold: int
    train_start: int
    train_end: int
    test_start: int
    test_end: int


def sliding_positions(
    rows: int, n_splits: int = 5, window: int | None = None, test: int | None = None, gap: int = 0
) -> list[PositionFold]:
    """Fixed-size windows that slide by the test size."""
    window = rows // (n_splits + 1) if window is None else window
    test = window if test is None else test
    possible = min(n_splits, (rows - window) // test) if test > 0 else 0
    if possible < 1:
        raise ValueError(f"{rows} rows are too few for a window of {window} and a test of {test}")
    made = []
    for i in range(possible):
        train_end = i * test + window
        test_end = train_end + gap + test
        if test_end > rows:
            break
        made.append(PositionFold(i + 1, i * test, train_end, train_end + gap, test_end))
    return made


def ratio_positions(
    rows: int, n_splits: int = 5, train_ratio: float = 0.7, test_ratio: float = 0.3, gap: int = 0
) -> list[PositionFold]:
    """Sliding windows whose sizes are shares of the rows."""
    return sliding_positions(
        rows, n_splits, int(rows * train_ratio / n_splits), int(rows * test_ratio / n_splits), gap
    )


def sliding_split(df: DataFrame, time: str, key: str, folds: Sequence[PositionFold]) -> DataFrame:
    """Rows of every fold with (fold, role). Positions become (time, key) bounds, so no row is numbered."""
    ends = {p for f in folds for p in (f.train_start, f.train_end, f.test_start, f.test_end) if p > 0}
    cuts = values_at(df, time, key, sorted(ends))

    def within(start: int, end: int) -> Column:
        upto = at_or_before(time, key, cuts[end])
        return upto & ~at_or_before(time, key, cuts[start]) if start > 0 else upto

    parts = [
        F.when(within(start, end), F.struct(F.lit(f.fold).alias("fold"), F.lit(role).alias("role")))
        for f in folds
        for role, start, end in (("train", f.train_start, f.train_end), ("test", f.test_start, f.test_end))
    ]
    return _exploded(df, parts)


def out_of_time_split(
    df: DataFrame, time: str, key: str, test_size: float = 0.2, min_train: int | None = None
) -> DataFrame:
    """``role`` train for the first ``int(n * (1 - test_size))`` rows in (time, key) order, else test."""
    if time not in df.columns:
        raise ValueError(f"{time} is not a column")
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    timed = df.where(F.col(time).isNotNull())
    cut = int(timed.count() * (1 - test_size))
    if min_train and cut < min_train:
        raise ValueError(f"{cut} training rows, fewer than {min_train}")
    if cut == 0:
        return timed.withColumn("role", F.lit("test"))
    bound = values_at(timed, time, key, [cut])[cut]
    return timed.withColumn("role", F.when(at_or_before(time, key, bound), "train").otherwise("test"))


def last_fold_scores(scored: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """Out-of-fold row per key: boundary times are validated twice, the last fold counts.

    Of rows with one key and fold, the one that is largest in the other columns, taken in their order, counts.
    """
    others = [c for c in scored.columns if c not in (key, fold)]
    return scored.groupBy(key).agg(F.max(F.struct(fold, *others)).alias("newest")).select(key, "newest.*")
