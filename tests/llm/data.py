"""Small tables for the operators' tests."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# Names that operators use inside; a table may have them as columns of its own.
CLASHING = ["size", "shard", "slot", "row_number", "node", "label", "raw", "k0", "key", "media", "taken", "times", "score", "uid", "hash"]


def docs(spark, rows, extra=True):
    """Documents from (doc_id, text, lang, source), with clashing extra columns."""
    df = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"x{c}") for c in CLASHING})
    return df


ODD_TEXTS = [
    None, "", " ", "\n", "\t", "a", "Z", "é", "x " * 40_000, "word", "two words", "  lead and trail  ", "a\n\n\nb", "a  b", " nbsp wide",
    "under the MIT License", "zero\x00byte", "\U0001f600 emoji \U0001f469‍\U0001f4bb", "ﬁ ligature İ", "1234 5678", "!!!", "日本語 テキスト",
]


def odd_docs(spark):
    """NULLs in every column, empty and very long texts, repeated rows and keys."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], rows[10], (None, "no key", "en", "s1"), (None, None, None, None), (5, "same key, other text", "en", "s2")]
    return docs(spark, rows)


def words(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n)]
