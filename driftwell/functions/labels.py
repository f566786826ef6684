"""Column expressions that name things: semantic groups, drift levels, month buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: group names, token lists, prefixes and statistic words, in rule order. ----
MISSING_TOKENS = ["MISSING", "UNKNOWN", "UNAVAILABLE", "NOT KNOWN"]
BUREAU_DEBT_TOKENS = [
    "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_MAX_OVERDUE", "AMT_ANNUITY", "CREDIT_LIMIT",
    "OVERDUE", "DEBT", "UTILIZATION", "EXPOSURE", "LEVERAGE",
]
INCOME_TOKENS = [
    "AMT_INCOME_TOTAL", "INCOME", "SALARY", "ANNUITY", "PAYMENT_RATE", "EMPLOY", "OCCUPATION", "CAPACITY",
    "FAMILY_MEMBERS",
]
AMOUNT_TOKENS = [
    "AMT_CREDIT", "AMT_GOODS_PRICE", "AMT_ANNUITY", "AMT_APPLICATION", "DOWN_PAYMENT", "CREDIT_TO_ANNUITY",
    "APPLICATION",
]
DELINQUENCY_TOKENS = ["OVERDUE", "DPD", "DBD", "DELINQ", "PAST DUE", "LATE", "DEFAULT", "BAD DEBT"]
DEMOGRAPHIC_TOKENS = [
    "DAYS_BIRTH", "AGE", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH", "DAYS_LAST_PHONE_CHANGE", "REGION", "CITY",
    "ORGANIZATION_TYPE", "OWN_CAR_AGE", "HOUR_APPR_PROCESS_START", "WEEKDAY_APPR_PROCESS_START", "TIME",
]
PREFIX_TABLES = {
    "BURO": "bureau",
    "PREV": "previous_application",
    "POS": "POS_CASH_balance",
    "INSTAL": "installments_payments",
    "CC": "credit_card_balance",
}
STATISTIC_WORDS = {"MIN": "minimum", "MAX": "maximum", "MEAN": "mean", "SUM": "sum", "VAR": "variance"}
GROUP_PRIORITY = {
    "external_score": 100,
    "bureau_debt": 95,
    "bureau_credit_history": 90,
    "installment_repayment_behavior": 85,
    "delinquency_behavior": 80,
    "credit_card_utilization": 78,
    "income_capacity": 74,
    "previous_application_behavior": 70,
    "application_amounts": 64,
    "demographic_time_variables": 58,
    "missingness_or_unknown": 10,
    "other": 40,
}
# ---- End of fixed values. ----


def _any_token(text: Column, tokens: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in tokens))


def _lookup(mapping: dict[str, str | int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def semantic_group(name: Column, description: Column | None = None, table: Column | None = None) -> Column:
    """First matching business group of a feature; tokens match anywhere in the upper-cased text.

    The text is bound once per row, so that long descriptions are not put together again for every token.
    """
    upper = F.upper(name)
    source = F.upper(F.coalesce(table, F.lit(""))) if table is not None else F.lit("")
    words = F.upper(F.coalesce(description, F.lit(""))) if description is not None else F.lit("")
    parts = F.struct(upper.alias("name"), source.alias("table"), F.concat_ws(" ", upper, words, source).alias("text"))
    return F.transform(F.array(parts), _group_of)[0]


def _group_of(parts: Column) -> Column:
    upper, source, text = parts["name"], parts["table"], parts["text"]
    from_bureau = upper.startswith("BURO_") | source.contains("BUREAU")
    rules = [
        (upper.contains("EXT_SOURCE") | text.contains("EXTERNAL SCORE"), "external_score"),
        (_any_token(text, MISSING_TOKENS), "missingness_or_unknown"),
        (from_bureau & _any_token(text, BUREAU_DEBT_TOKENS), "bureau_debt"),
        (from_bureau, "bureau_credit_history"),
        (upper.startswith("INSTAL_") | source.contains("INSTALLMENTS_PAYMENTS"), "installment_repayment_behavior"),
        (upper.startswith("CC_") | source.contains("CREDIT_CARD_BALANCE"), "credit_card_utilization"),
        (upper.startswith("PREV_") | source.contains("PREVIOUS_APPLICATION"), "previous_application_behavior"),
        (_any_token(text, INCOME_TOKENS), "income_capacity"),
        (_any_token(text, AMOUNT_TOKENS), "application_amounts"),
        (_any_token(text, DELINQUENCY_TOKENS), "delinquency_behavior"),
        (_any_token(text, DEMOGRAPHIC_TOKENS), "demographic_time_variables"),
    ]
    expression = F.when(rules[0][0], rules[0][1])
    for test, group in rules[1:]:
        expression = expression.when(test, group)
    return expression.otherwise("other")


def group_priority(group: Column) -> Column:
    return F.coalesce(F.element_at(_lookup(GROUP_PRIORITY), group), F.lit(0))


def engineered_table(name: Column) -> Column:
    """Source table told by the name's prefix; empty text when the prefix is not known."""
    return F.coalesce(F.element_at(_lookup(PREFIX_TABLES), F.element_at(F.split(name, "_"), 1)), F.lit(""))


def engineered_description(name: Column) -> Column:
    """``PREFIX_base_STAT`` reads "stat of base from table"; any other name is spelled out in lower case."""
    parts = F.split(name, "_")
    word = F.element_at(_lookup(STATISTIC_WORDS), F.element_at(parts, -1))
    base = F.lower(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), " "))
    table = engineered_table(name)
    derived = (table != "") & (F.size(parts) >= 3) & word.isNotNull()
    return F.when(derived, F.concat(word, F.lit(" of "), base, F.lit(" from "), table)).otherwise(
        F.lower(F.translate(name, "_", " "))
    )


def drift_level(psi: Column) -> Column:
    """Left-closed cuts at 0.1 and 0.25."""
    return (
        F.when(psi.isNull(), "unknown").when(psi < 0.1, "low").when(psi < 0.25, "moderate").otherwise("high")
    )


def psi_flag(psi: Column) -> Column:
    """Right-closed cuts at 0.1 and 0.25; NULL stays NULL."""
    return F.when(psi <= 0.1, "stable").when(psi <= 0.25, "moderate").when(psi.isNotNull(), "unstable")


def help_label(delta_cv: Column, delta_oot: Column, tolerance: float) -> Column:
    """Did a change help both in validation and out of time?"""
    return (
        F.when((delta_cv > tolerance) & (delta_oot > tolerance), "yes")
        .when((delta_cv < -tolerance) & (delta_oot < -tolerance), "no")
        .otherwise("mixed")
    )


def month_bucket(day: Column) -> Column:
    """``M-n`` with n months back, rounded half to even."""
    return F.concat(F.lit("M-"), F.bround(F.abs(day.cast("double")) / 30.0).cast("long").cast("string"))


def window_label(start_day: Column, end_day: Column) -> Column:
    return F.concat(month_bucket(start_day), F.lit(" to "), month_bucket(end_day))


def month_floor(day: Column) -> Column:
    return F.floor(day.cast("double") / 30.0)


def month_ceil(day: Column) -> Column:
    return F.ceil(day.cast("double") / 30.0)


def segment_label(month: Column, dev_start_day: int = -600, oot_start_day: int = -210) -> Column:
    """Cohort of a month index: older than DEV, DEV, or OOT."""
    return (
        F.when(month < dev_start_day // 30, "Trash")
        .when(month < oot_start_day // 30, "Dev")
        .when(month.isNotNull(), "OOT")
    )
