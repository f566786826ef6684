import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from driftwell.llm import sharding
from tests.llm.data import docs, odd_docs


def check(rows, shards):
    per = defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    counts = [len(per[s]) for s in range(shards)]
    assert set(per) <= set(range(shards)) and max(counts) - min(counts) <= 1


def test_shard_documents(spark):
    df = odd_docs(spark)
    rows = sharding.shard_documents(df, 4).collect()
    check(rows, 4)
    key = lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(key(r.doc_id, r.text) for r in df.collect())
    again = sharding.shard_documents(df.repartition(3), 4).collect()
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r) for r in again)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sharding.shard_documents(docs(spark, []), 4).count() == 0


def test_permutation_is_one_to_one_and_spreads(spark):
    for n in (1, 2, 17, 5_003):
        f = sharding.feistel(n)
        placed = sharding.shuffled_place(spark.range(n), "id", "p", f).collect()
        assert sorted(r.p for r in placed) == list(range(n))
        if n > 1_000:
            moved = sum(r.id != r.p for r in placed)
            near = sum(abs(a.p - b.p) <= 40 for a, b in zip(sorted(placed), sorted(placed)[1:]))
            assert moved > 0.99 * n and near < 0.03 * n


def test_row_numbers_follow_the_order(spark):
    df = spark.range(3_000).select(F.pmod(F.col("id") * 7, F.lit(1_000)).alias("v")).repartition(5)
    got = sharding.number_rows(df, ["v"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(3_000))
    assert [r.v for r in got] == sorted(r.v for r in got)
