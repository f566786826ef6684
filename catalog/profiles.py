"""Profiles, labels, preprocessing and correlations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import ORDERS, SINGLE, query, rounded, scored_orders, table
from driftwell.functions import labels
from driftwell.functions.numbers import finite, to_number
from driftwell.operators import models, preprocess, profile
from driftwell.operators.binning import column_moments
from driftwell.session import checkpoint_dir

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Every 13th price is missing.
LINES = "(SELECT * REPLACE (CASE WHEN l_orderkey % 13 = 5 THEN NULL ELSE l_extendedprice END AS l_extendedprice) FROM lineitem)"


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("l_orderkey") % 13 != 5, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").withColumn("l_extendedprice", price)


def unioned(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("missing_rates", unioned(f"SELECT '{{c}}' AS feature, count(*) FILTER ({{c}} IS NULL) / CAST(count(*) AS DOUBLE) AS missing_rate FROM {LINES}",
                                ["l_orderkey", *LINE_NUMBERS, "l_returnflag"]))
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_rates(gappy_lines(spark, sf_dir), ["l_orderkey", *LINE_NUMBERS, "l_returnflag"])


@query("missing_filter", unioned(f"SELECT * FROM (SELECT '{{c}}' AS feature, count(*) FILTER ({{c}} IS NULL) / CAST(count(*) AS DOUBLE) AS missing_rate FROM {LINES}) WHERE missing_rate <= 0.05",
                                 LINE_NUMBERS))
def missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns kept at a strict limit."""
    fitted = profile.MissingRateFilter(0.05).fit(gappy_lines(spark, sf_dir), LINE_NUMBERS)
    return fitted.summary.where("kept").select("feature", "missing_rate")


PERCENT = "round_even(quantile_cont(CAST({{c}} AS DOUBLE), {p}), 4) AS {n}"
PROFILE = ", ".join(PERCENT.format(p=p, n=n) for n, p in profile.PERCENTILES.items())


@query("profile_numeric", unioned(f"""SELECT '{{c}}' AS feature, round_even(count(*) FILTER ({{c}} IS NULL) / CAST(count(*) AS DOUBLE), 4) AS missing_rate,
       CAST(count({{c}}) AS BIGINT) AS non_null_count, round_even(avg({{c}}), 4) AS mean, round_even(min({{c}}), 4) AS min,
       round_even(max({{c}}), 4) AS max, round_even(stddev_samp({{c}}), 4) AS std, CAST(CAST(var_samp({{c}}) AS FLOAT) AS DOUBLE) AS var, {PROFILE} FROM {LINES}""", LINE_NUMBERS))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.feature_metadata(gappy_lines(spark, sf_dir), LINE_NUMBERS)
    columns = ["feature", "missing_rate", "non_null_count", "mean", "min", "max", "std", "var", *profile.PERCENTILES]
    # Four places of a variance of prices is more than a double sum can promise.
    exact = column_moments(gappy_lines(spark, sf_dir), LINE_NUMBERS, ["var"]).select("feature", F.col("var").alias("v"))
    return rounded(found.join(exact, "feature").withColumn("var", F.col("v")), {"var": SINGLE}).select(columns)


@query("profile_text", unioned("""SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS non_null_count, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM documents""",
                               ["lang", "source", "text"]))
def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.feature_metadata(table(spark, sf_dir, "documents"), ["lang", "source", "text"])
    return found.select("feature", "non_null_count", "unique_count")


@query("feature_statistics", unioned(f"""SELECT '{{c}}' AS feature, CAST(count({{c}}) AS BIGINT) AS count, CAST(CAST(avg({{c}}) AS FLOAT) AS DOUBLE) AS mean,
       CAST(CAST(stddev_samp({{c}}) AS FLOAT) AS DOUBLE) AS std, min({{c}}) AS min, round(quantile_cont({{c}}, 0.25), 6) AS p25, round(quantile_cont({{c}}, 0.5), 6) AS p50,
       round(quantile_cont({{c}}, 0.75), 6) AS p75, max({{c}}) AS max, CAST(count(*) - count({{c}}) AS BIGINT) AS missing_count,
       round(100.0 * (count(*) - count({{c}})) / count(*), 9) AS missing_pct, CAST(count(DISTINCT {{c}}) AS BIGINT) AS n_unique FROM {LINES}""", LINE_NUMBERS))
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.feature_statistics(gappy_lines(spark, sf_dir), LINE_NUMBERS)
    return rounded(found, {"mean": SINGLE, "std": SINGLE, "p25": 6, "p50": 6, "p75": 6, "missing_pct": 9})


PAIRS = [(a, b) for a in LINE_NUMBERS for b in LINE_NUMBERS]


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 9) AS correlation FROM {LINES}" for a, b in PAIRS))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.correlation_matrix(gappy_lines(spark, sf_dir), LINE_NUMBERS), {"correlation": 9})


RANKS = "(SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r, event_id FROM events)"


@query("spearman", f"""
WITH v AS {RANKS.format(c='value')}, u AS {RANKS.format(c='user_id')},
c AS (SELECT round(corr(v.r, u.r), 9) AS x FROM v JOIN u USING (event_id))
SELECT a AS feature_a, b AS feature_b, CASE WHEN a = b THEN 1.0 ELSE x END AS correlation
FROM c, (VALUES ('value'), ('user_id')) s(a), (VALUES ('value'), ('user_id')) t(b)""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.rank_correlation(table(spark, sf_dir, "events"), ["value", "user_id"]), {"correlation": 9})


GAPPY_EVENTS = """(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, user_id, CASE WHEN event_id % 5 > 1 THEN CAST(event_id % 97 AS DOUBLE) END AS part,
    CASE WHEN event_id % 5 > 1 THEN CAST(user_id % 12 AS DOUBLE) END AS few, 7.0 AS same, CAST(NULL AS DOUBLE) AS none FROM events)"""
GAPPY = ["value", "user_id", "part", "few", "same", "none"]


def pair_sql(a: str, b: str) -> str:
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 9) END AS correlation
FROM (SELECT {rank.format('a')} AS x, {rank.format('b')} AS y FROM (SELECT {a} AS a, {b} AS b FROM {GAPPY_EVENTS}) WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query("spearman_gaps", " UNION ALL ".join(pair_sql(a, b) for a in GAPPY for b in GAPPY))
def spearman_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of columns with gaps in different rows, of a constant column and of one without values."""
    here = lambda test, value: F.when(test, value.cast("double"))
    number, user = F.col("event_id"), F.col("user_id")
    events = table(spark, sf_dir, "events").select(
        here(number % 7 != 0, F.col("value")).alias("value"), "user_id", here(number % 5 > 1, number % 97).alias("part"),
        here(number % 5 > 1, user % 12).alias("few"), F.lit(7.0).alias("same"), F.lit(None).cast("double").alias("none"),
    )
    return rounded(profile.rank_correlation(events, GAPPY), {"correlation": 9})


# ---- Labels ----

def tokens_sql(text: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in tokens) + ")"


def group_sql(name: str, text: str, source: str) -> str:
    bureau = f"(starts_with({name}, 'BURO_') OR contains({source}, 'BUREAU'))"
    return f"""CASE WHEN contains({name}, 'EXT_SOURCE') OR contains({text}, 'EXTERNAL SCORE') THEN 'external_score'
        WHEN {tokens_sql(text, labels.MISSING_TOKENS)} THEN 'missingness_or_unknown'
        WHEN {bureau} AND {tokens_sql(text, labels.BUREAU_DEBT_TOKENS)} THEN 'bureau_debt'
        WHEN {bureau} THEN 'bureau_credit_history'
        WHEN starts_with({name}, 'INSTAL_') OR contains({source}, 'INSTALLMENTS_PAYMENTS') THEN 'installment_repayment_behavior'
        WHEN starts_with({name}, 'CC_') OR contains({source}, 'CREDIT_CARD_BALANCE') THEN 'credit_card_utilization'
        WHEN starts_with({name}, 'PREV_') OR contains({source}, 'PREVIOUS_APPLICATION') THEN 'previous_application_behavior'
        WHEN {tokens_sql(text, labels.INCOME_TOKENS)} THEN 'income_capacity'
        WHEN {tokens_sql(text, labels.AMOUNT_TOKENS)} THEN 'application_amounts'
        WHEN {tokens_sql(text, labels.DELINQUENCY_TOKENS)} THEN 'delinquency_behavior'
        WHEN {tokens_sql(text, labels.DEMOGRAPHIC_TOKENS)} THEN 'demographic_time_variables' ELSE 'other' END"""


# Parts read as engineered features: prefix by size, base by name, statistic by size.
PREFIXES = ["BURO", "PREV", "POS", "INSTAL", "CC", "EXT_SOURCE", "DAYS"]
STATS = ["MIN", "MAX", "MEAN", "SUM", "VAR", "RAW"]
PART_NAMES = f"""(SELECT DISTINCT concat_ws('_', [{', '.join(repr(p) for p in PREFIXES)}][p_size % 7 + 1], upper(replace(p_name, ' ', '_')),
        [{', '.join(repr(s) for s in STATS)}][p_size % 6 + 1]) AS feature, p_type AS kind FROM part)"""


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), F.col("p_size") % n + 1)
    name = F.concat_ws("_", pick(PREFIXES, 7), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), pick(STATS, 6))
    return table(spark, sf_dir, "part").select(name.alias("feature"), F.col("p_type").alias("kind")).distinct()


TABLE_SQL = "CASE split_part(feature, '_', 1) " + " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in labels.PREFIX_TABLES.items()) + " ELSE '' END"
WORD_SQL = "CASE split_part(feature, '_', -1) " + " ".join(f"WHEN '{s}' THEN '{w}'" for s, w in labels.STATISTIC_WORDS.items()) + " END"
ENGINEERED = f"""(SELECT feature, kind, tab, CASE WHEN tab <> '' AND len(string_split(feature, '_')) >= 3 AND word IS NOT NULL
        THEN word || ' of ' || lower(array_to_string(string_split(feature, '_')[2:-2], ' ')) || ' from ' || tab
        ELSE lower(replace(feature, '_', ' ')) END AS description
    FROM (SELECT *, {TABLE_SQL} AS tab, {WORD_SQL} AS word FROM {PART_NAMES}))"""


@query("engineered_desc", f"SELECT feature, kind, description, tab AS \"table\" FROM {ENGINEERED}")
def engineered_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_features(spark, sf_dir).withColumns({
        "description": labels.engineered_description(F.col("feature")), "table": labels.engineered_table(F.col("feature")),
    })


@query("described_features", f"""
WITH d AS (SELECT feature, kind, description, tab AS "table", upper(feature) AS un, upper(concat_ws(' ', feature, description, tab)) AS text, upper(tab) AS ut
           FROM (SELECT feature, kind, coalesce(nullif(CASE WHEN kind = 'SMALL' THEN 'Overdue debt ' || kind ELSE '' END, ''), description) AS description, tab FROM {ENGINEERED}))
SELECT feature, kind, description, "table", {group_sql('un', 'text', 'ut')} AS semantic_group FROM d""")
def described_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions given for one kind, blank for the others, which fall back to the name."""
    named = part_features(spark, sf_dir)
    text = F.when(F.col("kind") == "SMALL", F.concat(F.lit("Overdue debt "), F.col("kind"))).otherwise("")
    marked = named.withColumn("key", F.concat_ws("|", "feature", "kind"))
    given = marked.select(F.col("key").alias("feature"), text.alias("description"), F.lit("").alias("table"))
    joined = marked.join(given.select(F.col("feature").alias("key"), F.col("description").alias("_d")), "key", "left")
    described = joined.withColumns({
        "description": F.coalesce(F.nullif("_d", F.lit("")), labels.engineered_description(F.col("feature"))),
        "table": labels.engineered_table(F.col("feature")),
    })
    group = labels.semantic_group(F.col("feature"), F.col("description"), F.col("table"))
    return described.select("feature", "kind", "description", "table", group.alias("semantic_group"))


@query("semantic_groups", f"""
WITH d AS (SELECT doc_id, lang, upper(source) AS un, upper(concat_ws(' ', source, text, lang)) AS text, upper(lang) AS ut FROM documents)
SELECT lang, {group_sql('un', 'text', 'ut')} AS semantic_group, CAST(count(*) AS BIGINT) AS documents FROM d GROUP BY ALL""")
def semantic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule list over whole texts as descriptions."""
    group = labels.semantic_group(F.col("source"), F.col("text"), F.col("lang"))
    return table(spark, sf_dir, "documents").groupBy("lang", group.alias("semantic_group")).agg(F.count(F.lit(1)).alias("documents"))


@query("month_labels", f"""
SELECT 'M-' || CAST(round_even(abs(day) / 30.0, 0) AS BIGINT) AS month, 'M-' || CAST(round_even(abs(day) / 30.0, 0) AS BIGINT) || ' to ' ||
       'M-' || CAST(round_even(abs(day + 45) / 30.0, 0) AS BIGINT) AS months, CAST(count(*) AS BIGINT) AS rows FROM {ORDERS} GROUP BY ALL""")
def month_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    return scored_orders(spark, sf_dir).groupBy(
        labels.month_bucket(day).alias("month"), labels.window_label(day, day + 45).alias("months")
    ).agg(F.count(F.lit(1)).alias("rows"))


@query("number_coercion", """
SELECT event_type, CAST(count(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE)) AS BIGINT) AS numbers,
       CAST(count(CASE WHEN user_id % 10 <> 0 THEN value / (user_id % 10) END) AS BIGINT) AS finite_ratios
FROM events GROUP BY event_type""")
def number_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that may not be a number, and ratios that may be infinite."""
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    ratio = F.when(F.col("user_id") % 10 == 0, F.lit(float("inf"))).otherwise(F.try_divide("value", F.col("user_id") % 10))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(to_number(text)).alias("numbers"), F.count(finite(ratio)).alias("finite_ratios")
    )


@query("feature_cards", unioned(f"""SELECT '- {{c}} | semantic_group=other | table=application_train | dtype=double | missing_rate=' ||
       printf('%.1f', round_even(count(*) FILTER ({{c}} IS NULL) / CAST(count(*) AS DOUBLE), 4) * 100) || '% | non_null_count=' || count({{c}}) AS head FROM {LINES}""",
                                ["l_quantity", "l_discount"]))
def feature_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each card before the description, which has no float formatting of its own."""
    cards = profile.feature_cards(profile.feature_metadata(gappy_lines(spark, sf_dir), ["l_quantity", "l_discount"]))
    return cards.select(F.element_at(F.split("card", r" \| desc="), 1).alias("head"))


@query("cards_signature")
def cards_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of all cards: compared with hashlib in the tests."""
    cards = profile.feature_cards(profile.feature_metadata(gappy_lines(spark, sf_dir), LINE_NUMBERS))
    return profile.cards_signature(cards, 0.25, "max_missing_rate=0.95")


# ---- Preprocessing ----

SCALED = ["l_quantity", "l_extendedprice", "l_discount"]

def scaled_sql(fill: str, shift: str, scale: str) -> str:
    """Fill, then (x - shift) / scale, per column."""
    cells = [f"coalesce({c}, (SELECT {fill.format(c=c)} FROM {LINES})) AS {c}" for c in SCALED]
    scaled = [
        f"round(avg((l.{c} - s.{c}_shift) / s.{c}_scale), 9) AS {c}_mean, round(max((l.{c} - s.{c}_shift) / s.{c}_scale), 9) AS {c}_max, "
        f"round(min((l.{c} - s.{c}_shift) / s.{c}_scale), 9) AS {c}_min" for c in SCALED
    ]
    stats = [f"{shift.format(c=c)} AS {c}_shift, {scale.format(c=c)} AS {c}_scale" for c in SCALED]
    return f"""
WITH filled AS (SELECT l_returnflag, {', '.join(cells)} FROM {LINES}), stats AS (SELECT {', '.join(stats)} FROM filled)
SELECT l_returnflag, {', '.join(scaled)} FROM filled l, stats s GROUP BY l_returnflag"""


def scaled(spark: SparkSession, sf_dir: str, strategy: str, scaler: str) -> DataFrame:
    lines = gappy_lines(spark, sf_dir).select("l_returnflag", *SCALED)
    made = preprocess.NumberScaler(strategy, scaler).fit(lines, SCALED)
    out = lines.select("l_returnflag", *made.expressions())
    aggregates = [f(c).alias(f"{c}_{n}") for c in SCALED for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return rounded(out.groupBy("l_returnflag").agg(*aggregates), {f"{c}_{n}": 9 for c in SCALED for n in ("mean", "max", "min")})


@query("standardize", scaled_sql("avg({c})", "avg({c})", "stddev_pop({c})"))
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, "mean", "standard")


@query("minmax", scaled_sql("max(0.0)", "min({c})", "(max({c}) - min({c}))"))
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, "zero", "minmax")


@query("median_fill", scaled_sql("quantile_cont({c}, 0.5)", "avg({c})", "stddev_pop({c})"))
def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, "median", "standard")


@query("onehot_pooled", """
WITH c AS (SELECT coalesce(nullif(o_orderpriority, '2-HIGH'), 'Missing') AS p, day % 9 AS g FROM """ + ORDERS + """),
n AS (SELECT p, count(*) AS rows, (SELECT count(*) FROM c) AS total FROM c GROUP BY p),
f AS (SELECT CASE WHEN rows < 0.2 * total THEN 'infrequent_sklearn' ELSE p END AS level, g FROM c JOIN n USING (p))
SELECT 'priority_' || level AS "column", CAST(count(*) AS DOUBLE) AS hits, count(DISTINCT g) AS groups FROM f GROUP BY level""")
def onehot_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels under a fifth of the rows share one column."""
    orders = scored_orders(spark, sf_dir).select(
        F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("priority"), (F.col("day") % 9).alias("g")
    )
    made = preprocess.LevelEncoder(min_frequency=0.2).fit(orders, ["priority"])
    wide = made.attach(orders).select("g", *made.expressions())
    names = [c for c in wide.columns if c != "g"]
    long = wide.unpivot("g", names, "column", "hit").where("hit = 1")
    return long.groupBy("column").agg(F.sum("hit").alias("hits"), F.count_distinct("g").alias("groups"))


@query("level_reload", """
WITH lines AS (SELECT l_quantity AS q, CASE WHEN l_partkey % 3 = 0 THEN 'hot' ELSE 'o' || l_orderkey END AS level FROM lineitem),
counted AS (SELECT level, count(*) AS rows FROM lines GROUP BY level),
frequent AS (SELECT level, row_number() OVER (ORDER BY level) AS code FROM counted WHERE rows >= 5),
cells AS (SELECT 0 AS place, q AS value FROM lines WHERE q <> 0 UNION ALL
          SELECT coalesce(f.code, (SELECT count(*) FROM frequent) + 1), 1.0 FROM lines l LEFT JOIN frequent f ON l.level = f.level)
SELECT CAST(place AS INT) AS place, CAST(count(*) AS BIGINT) AS lines, CAST(sum(value) AS DOUBLE) AS total FROM cells GROUP BY place""")
def level_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far more than 10 000 levels, a third of the lines with one of them: fitted, saved, loaded and applied."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_partkey") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("l_orderkey"))).alias("level"),
    )
    path = f"{checkpoint_dir(spark)}/level-reload-{uuid.uuid4().hex}"
    preprocess.Preprocessor(scaler=None, min_frequency=5).fit(lines).save(spark, path)
    made = preprocess.Preprocessor.load(spark, path).transform_sparse(lines)
    cells = made.select(F.explode(F.arrays_zip("indices", "values")).alias("cell"))
    return cells.groupBy(F.col("cell.indices").alias("place")).agg(F.count(F.lit(1)).alias("lines"), F.sum("cell.values").alias("total"))


# ---- Linear attribution ----

WEIGHTS = {"l_quantity": 0.5, "l_extendedprice": -0.001, "l_discount": 8.0, "l_tax": -3.0}


@query("linear_shap", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs(CAST({w} AS DOUBLE) * (coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) FROM {LINES})))), 8) AS mean_abs_shap FROM {LINES}"
    for c, w in WEIGHTS.items()))
def linear_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.linear_attribution(gappy_lines(spark, sf_dir), WEIGHTS), {"mean_abs_shap": 8})
