"""Column profiles: metadata, statistics, missing rates, correlations, descriptions, feature cards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.labels import engineered_description, engineered_table, semantic_group
from driftwell.functions.numbers import NUMBERS, double_sql, finite_sql, numeric_columns, quoted, share, sql_name
from driftwell.operators.binning import column_moments
from driftwell.operators.gram import all_pairs, gram_cells
from driftwell.operators.ordering import ROWS_PER_BUCKET, bucket_edges, running_totals
from driftwell.operators.quantiles import exact_quantiles
from driftwell.session import small_side, written_table

PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


SPREAD = ("mean", "min", "max", "std", "var")


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, missing_rate), highest first."""
    found = column_moments(df, df.columns if columns is None else columns, ["rows", "missing_count"])
    rate = share(F.col("missing_count"), F.col("rows")).alias("missing_rate")
    return found.select("feature", rate).orderBy(F.col("missing_rate").desc(), "feature")


@dataclass
class MissingRateFilter:
    """Keeps columns whose missing rate on the training rows is at most the limit."""

    max_missing_rate: float = 0.95
    selected: list[str] = field(default_factory=list)
    summary: DataFrame | None = None

    def __post_init__(self) -> None:
        if not 0.0 <= self.max_missing_rate <= 1.0:
            raise ValueError("max_missing_rate must lie between 0 and 1")

    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> MissingRateFilter:
        columns = list(df.columns if columns is None else columns)
        rows = missing_rates(df, columns).collect()
        schema = "feature string, missing_rate double, kept boolean"
        kept = {r["feature"] for r in rows if r["missing_rate"] is None or r["missing_rate"] <= self.max_missing_rate}
        self.selected = [c for c in columns if c in kept]
        self.summary = df.sparkSession.createDataFrame(
            [(r["feature"], r["missing_rate"], r["feature"] in kept) for r in rows], schema
        )
        return self

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *[sql_name(c) for c in self.selected])


def feature_metadata(
    df: DataFrame, columns: Sequence[str], descriptions: DataFrame | None = None
) -> DataFrame:
    """One row per feature: where it comes from, its group, missingness, moments and percentiles.

    ``descriptions`` has (feature, description, table); blanks fall back to what the name tells.
    Numbers are rounded to four places, half to even.
    """
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NUMBERS)]
    known = set(numbers)
    quantiles = exact_quantiles(df, numbers, list(PERCENTILES.values()))
    facts = [
        (i, c, df.schema[c].dataType.simpleString(), *(quantiles.get(c) or [None] * len(PERCENTILES)))
        for i, c in enumerate(columns)
    ]
    schema = "position int, feature string, dtype string, " + ", ".join(f"{p} double" for p in PERCENTILES)
    # Every side below holds one row per feature.
    base = df.sparkSession.createDataFrame(facts, schema)
    profile = (
        base.join(column_moments(df, columns, ["rows", "missing_count", *SPREAD]), "feature")
        .join(distinct_values(df, [c for c in columns if c not in known]), "feature", "left")
    )
    rounded = {c: F.bround(c, 4) for c in (*SPREAD, *PERCENTILES)}
    counted = profile.withColumns(rounded | {
        "missing_rate": F.bround(share(F.col("missing_count"), F.col("rows")), 4),
        "non_null_count": F.col("rows") - F.col("missing_count"),
        "unique_count": F.when(~F.col("feature").isin(numbers), F.coalesce("n_unique", F.lit(0))),
    })
    return describe(counted, descriptions).select(
        "position", "feature", "description", "table", "semantic_group", "missing_rate", "non_null_count",
        "dtype", *SPREAD, "unique_count", *PERCENTILES,
    )


def describe(features: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Add ``description``, ``table`` and ``semantic_group`` to a table with ``feature``."""
    if descriptions is not None:
        joined = features.join(
            descriptions.select("feature", F.col("description").alias("_d"), F.col("table").alias("_t")), "feature", "left"
        )
    else:
        joined = features.withColumns({"_d": F.lit(None).cast("string"), "_t": F.lit(None).cast("string")})

    def filled(given: str, inferred: Column) -> Column:
        return F.coalesce(F.nullif(F.col(given), F.lit("")), inferred)

    named = joined.withColumns({
        "description": filled("_d", engineered_description(F.col("feature"))),
        "table": filled("_t", engineered_table(F.col("feature"))),
    }).drop("_d", "_t")
    return named.withColumn(
        "semantic_group", semantic_group(F.col("feature"), F.col("description"), F.col("table"))
    )


def feature_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Description table: count, mean, std, min, quartiles, max, missing count and percent, distinct values."""
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NUMBERS)]
    quartiles = exact_quantiles(df, numbers, [0.25, 0.5, 0.75])
    facts = [(c, *(quartiles.get(c) or [None] * 3)) for c in columns]
    base = df.sparkSession.createDataFrame(facts, "feature string, p25 double, p50 double, p75 double")
    joined = (
        base.join(column_moments(df, columns, ["rows", "missing_count", *SPREAD]), "feature")
        .join(distinct_values(df, columns), "feature", "left")
    )
    return joined.select(
        "feature",
        (F.col("rows") - F.col("missing_count")).alias("count"),
        "mean", "std", "min", "p25", "p50", "p75", "max",
        "missing_count",
        (share(F.col("missing_count"), F.col("rows")) * 100).alias("missing_pct"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_unique): distinct pairs are counted in the long form, so no column is held in one task."""
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, n_unique long")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), quoted(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.explode(cells).alias("cell")).select("cell.feature", "cell.value")
    return long.where(F.col("value").isNotNull()).distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"))


# ---- Correlation ----

def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature_a, feature_b, correlation) over pairwise complete rows; a constant column gives NULL.

    With m the 0/1 presence, x the centred value (0 where missing) and its square, all sums that pairwise
    complete correlations need are sums of products of [m, x, x*x], which are added up in blocks.
    """
    columns = list(columns or numeric_columns(df))
    spark, p = df.sparkSession, len(columns)
    if p < 2:
        return spark.createDataFrame([], "feature_a string, feature_b string, correlation double")
    moments = {r["feature"]: r for r in column_moments(df, columns, ["mean", "min", "max"]).collect()}
    parts: list[list[str]] = [[], [], []]
    for c in columns:
        row = moments[c]
        # A constant column is centred on its value, so that it leaves no rounding noise.
        centre = row["min"] if row["min"] == row["max"] else row["mean"]
        value = f"({finite_sql(c)} - {double_sql(centre or 0.0)})"
        parts[0].append(f"CASE WHEN {value} IS NULL THEN 0D ELSE 1D END")
        parts[1].append(f"coalesce({value}, 0D)")
        parts[2].append(f"coalesce({value} * {value}, 0D)")
    cells = gram_cells(df, 3 * p, F.expr(f"array({', '.join(v for part in parts for v in part)})"))
    placed = cells.select(
        F.explode(F.array(
            F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.when(F.col("i") != F.col("j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
        )).alias("at"), "value",
    ).where("at IS NOT NULL")
    kinds = {"n": (0, 0), "sa": (1, 0), "sb": (0, 1), "qa": (2, 0), "qb": (0, 2), "ab": (1, 1)}
    sums = placed.groupBy(F.expr(f"at.i % {p}").alias("i"), F.expr(f"at.j % {p}").alias("j")).agg(*[
        F.sum(F.expr(f"CASE WHEN at.i div {p} = {a} AND at.j div {p} = {b} THEN value END")).alias(name) for name, (a, b) in kinds.items()
    ])
    spread = "(q{0} - s{0} * try_divide(s{0}, n))"
    varies = " AND ".join(f"{spread.format(x)} > 1e-12D * q{x}" for x in "ab")
    value = f"CASE WHEN {varies} THEN (ab - sa * try_divide(sb, n)) / sqrt({spread.format('a')} * {spread.format('b')}) END"
    named = F.array(*[F.lit(c) for c in columns])
    return all_pairs(df, p).join(sums, ["i", "j"], "left").select(
        named[F.col("i")].alias("feature_a"), named[F.col("j")].alias("feature_b"), F.expr(value).alias("correlation")
    )


def complete_correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson"):
    """Correlation matrix of columns without missing values as a driver array (features x features)."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_features").transform(df).select("_features")
    return vector_correlation(vectors, "_features", method)


def vector_correlation(df: DataFrame, column: str, method: str = "pearson"):
    """Correlation matrix of a vector column as a driver array."""
    return Correlation.corr(df, column, method).first()[0].toArray()


def presence_classes(numbers: DataFrame, row: str, columns: Sequence[str]) -> list[int]:
    """The class of each column: columns of one class are present in the same rows. Class 0 is present in all.

    Columns with the same count and sum of row hashes are taken together if no row parts them.
    """
    present = lambda c: F.col(c).isNotNull()
    marks = [F.struct(F.count(c).alias("n"), F.sum(F.when(present(c), F.xxhash64(row).cast("decimal(38,0)"))).alias("h")) for c in columns]
    found = numbers.agg(F.count(F.lit(1)), *marks).first()
    total, seen = found[0], [(m["n"], m["h"]) for m in found[1:]]
    first: dict[tuple, int] = {}
    leader = [first.setdefault(m, i) for i, m in enumerate(seen)]
    parted = numbers.agg(F.lit(0), *[F.count_if(present(c) != present(columns[i])) for c, i in zip(columns, leader)]).first()[1:]
    leader = [i if n == 0 else k for k, (i, n) in enumerate(zip(leader, parted))]
    numbered: dict[int, int] = {}
    return [0 if seen[i][0] == total else 1 + numbered.setdefault(i, len(numbered)) for i in leader]


def rank_correlation(df: DataFrame, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Spearman correlations, each over the rows where both columns of the pair are present.

    Ranks depend on the rows that take part, and these on the classes of columns that are present together. A column is
    ranked once for its own class and once for each other class with gaps, all of them in one long form: values are
    counted, ranked by running totals in buckets of value, and brought back to their rows; products of centred ranks are
    added up in blocks. The number of jobs does not depend on the number of columns. NULL where a column is constant or fewer
    than two rows are left.
    """
    spark, columns = df.sparkSession, list(columns)
    if not columns:
        return spark.createDataFrame([], "feature_a string, feature_b string, correlation double")
    p = len(columns)
    values = [f"v{i}" for i in range(p)]
    cells = [F.expr(f"{finite_sql(c)} AS v{i}") for i, c in enumerate(columns)]
    numbers = written_table(df.select(F.monotonically_increasing_id().alias("row"), *cells))
    classes = presence_classes(numbers, "row", values)
    gaps = sorted(set(classes) - {0})
    member = {c: values[classes.index(c)] for c in gaps}
    # (column, class, pair of classes whose common rows count), numbered.
    slots = []
    for i, own in enumerate(classes):
        subsets = [(own, own), *(((b, b) if own == 0 else (min(own, b), max(own, b))) for b in gaps if b != own)]
        slots += [(i, own, low, high) for low, high in subsets]
    taken = []
    for k, (i, _, low, high) in enumerate(slots):
        there = " AND ".join(f"{member[c]} IS NOT NULL" for c in {low, high} - {0}) or "true"
        taken.append(f"named_struct('slot', {k}, 'value', CASE WHEN {there} THEN v{i} END)")
    long = numbers.select("row", F.expr(f"inline(array({', '.join(taken)}))")).where("value IS NOT NULL")
    counted = written_table(long.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("rows")))
    totals = running_totals(counted, ["slot"], "value", ["rows"], bucket_edges(counted, ["value"], rows_per_bucket)["value"])
    # Centred mean ranks: the mean rank of n rows is (n + 1) / 2.
    ranks = totals.select("slot", "value", (F.col("cum_rows") - F.col("rows") / 2 - F.col("all_rows") / 2).alias("rank"))
    ranked = long.join(small_side(ranks), ["slot", "value"]).groupBy("row").agg(F.collect_list(F.struct("slot", "rank")).alias("cells"))
    sums = written_table(gram_cells(ranked, len(slots), F.col("cells.rank"), F.col("cells.slot")))
    table = F.broadcast(spark.createDataFrame([(k, *s) for k, s in enumerate(slots)], "slot int, column int, class int, low int, high int"))
    side = lambda n: table.select(*[F.col(c).alias(f"{n}_{c}") for c in table.columns])
    placed = sums.join(side("a"), F.col("i") == F.col("a_slot")).join(side("b"), F.col("j") == F.col("b_slot"))
    fitting = """a_low = b_low AND a_high = b_high AND CASE
        WHEN a_class = b_class THEN a_low = a_class AND a_high = a_class WHEN a_class = 0 THEN a_low = b_class AND a_high = b_class
        WHEN b_class = 0 THEN a_low = a_class AND a_high = a_class ELSE a_low = least(a_class, b_class) AND a_high = greatest(a_class, b_class) END"""
    spreads = sums.where("i = j").select("i", F.col("value").alias("spread"))
    spread = lambda n: spreads.select(F.col("i").alias(n), F.col("spread").alias(f"{n}_spread"))
    pairs = placed.where(fitting).join(spread("i"), "i").join(spread("j"), "j")
    value = F.when((F.col("i_spread") > 0) & (F.col("j_spread") > 0), F.col("value") / F.sqrt(F.col("i_spread")) / F.sqrt(F.col("j_spread")))
    exact = F.when((F.col("a_column") == F.col("b_column")) & value.isNotNull(), 1.0).otherwise(value).alias("correlation")
    one = pairs.select(F.col("a_column").alias("i"), F.col("b_column").alias("j"), exact)
    both = one.unionByName(one.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "correlation"))
    named = F.array(*[F.lit(c) for c in columns])
    return all_pairs(df, p).join(both, ["i", "j"], "left").select(
        named[F.col("i")].alias("feature_a"), named[F.col("j")].alias("feature_b"), "correlation"
    )


def feature_cards(metadata: DataFrame) -> DataFrame:
    """(position, feature, card): one line of text per feature for a reviewer who never sees rows."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    numbers = ["mean", "min", "max", "std", "var", *PERCENTILES]
    head = F.concat_ws(
        " | ",
        F.concat(F.lit("- "), F.col("feature")),
        F.concat(F.lit("semantic_group="), F.col("semantic_group")),
        F.concat(F.lit("table="), F.coalesce(F.nullif(F.col("table"), F.lit("")), F.lit("application_train"))),
        F.concat(F.lit("dtype="), F.col("dtype")),
        F.concat(F.lit("missing_rate="), F.format_string("%.1f%%", F.col("missing_rate") * 100)),
        F.concat(F.lit("non_null_count="), text("non_null_count")),
        F.concat(F.lit("desc="), F.col("description")),
    )
    moments = F.concat_ws(" | ", *[F.concat(F.lit(f"{n}="), text(n)) for n in numbers])
    tail = F.when(F.col("mean").isNotNull(), F.concat(F.lit(" | "), moments)).when(
        F.col("unique_count").isNotNull(), F.concat(F.lit(" | unique_count="), text("unique_count"))
    )
    return metadata.select("position", "feature", F.concat(head, F.coalesce(tail, F.lit(""))).alias("card"))


def cards_signature(cards: DataFrame, target_mean: float, filters: str = "") -> DataFrame:
    """SHA-256 of all cards in feature order, the target mean and the filter settings: a ranking's key."""
    # As many rows as features.
    ordered = F.array_sort(F.collect_list(F.struct("position", "card")))
    body = F.array_join(F.transform(ordered, lambda x: x["card"]), "\n")
    return cards.agg(
        F.sha2(F.concat_ws("\n", body, F.lit(f"{target_mean:.6f}"), F.lit(filters)), 256).alias("metadata_signature"),
        F.count(F.lit(1)).alias("n_features"),
    )
