import hashlib
import re

import pytest

from driftwell.llm import mixing, statements
from tests.llm.data import docs, odd_docs, words


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def hashes_of(rows):
    """(row, hash), a number telling equal rows apart."""
    seen, number = {}, lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    for row in rows:
        i, t, _ = row
        n = seen[row] = seen.get(row, -1) + 1
        first = number(f"mix-2:{'null' if i is None else i}:{'null' if t is None else hashlib.md5(t.encode()).hexdigest()}")
        yield row, number(f"{first}:{n}") if n else first


def brute(rows):
    """Targets by repeated resharing, and rows taken one by one in hash order."""
    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    capped = set()
    while True:
        free = [s for s in sources if s not in capped]
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        price = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * price > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * total[s] if s in capped else weight[s] * price for s in sources}
    out = []
    for s in sources:
        full = int(target[s] // total[s] if total[s] else 0)
        if total[s] and target[s] / total[s] + 1e-9 >= full + 1:
            full += 1
        budget, reached, cut = target[s] - full * total[s], 0, 0
        own = [(size(t), h, i) for (i, t, x), h in hashes_of(rows) if x == s]
        hashes = {}
        for n, h, _ in own:
            hashes[h] = hashes.get(h, 0) + n
        for h in sorted(hashes):
            if budget <= 0:
                break
            if reached + hashes[h] >= budget:
                cut = h + 1 if reached + hashes[h] - budget <= budget - reached else h
                break
            reached += hashes[h]
        out += [(i, n, total[s], round(target[s], 6), n * (full + (h < cut))) for n, h, i in own]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_documents(df).collect()), key=str)


def test_odd_documents(spark):
    df = odd_docs(spark)
    assert got(df) == brute([(r.doc_id, r.text, r.source) for r in df.collect()])
    assert mixing.mix_documents(docs(spark, [])).count() == 0
    nothing = docs(spark, [(1, None, None, None), (2, "", None, "a")])
    assert got(nothing) == brute([(1, None, None), (2, "", "a")])


@pytest.mark.parametrize("seed", [1])
def test_hot_source(spark, seed):
    pool = words(500, seed)
    rows = [(i, " ".join(pool[i % 400 : i % 400 + 1 + i * seed % 37]), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(1_500)]
    assert got(docs(spark, rows)) == brute([(i, t, s) for i, t, _, s in rows])
    # By source: sources of one weight share one target.
    source, per = {i: s for i, _, _, s in rows}, {}
    for r in mixing.mix_documents(docs(spark, rows)).collect():
        assert r.taken <= 3 * r["size"]
        per.setdefault((source[r.doc_id], r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 40 for (_, t), v in per.items())


def test_hot_keys_are_divided(spark):
    """A third of a source under one key, and a third that is one row over and over: the target is still met."""
    pool = words(300, 4)
    rows = [(7, " ".join(pool[i % 200 : i % 200 + 9]) + f" {i}", "en", "a") for i in range(3_000)]
    rows += [(8, " ".join(pool[:10]), "en", "a")] * 9_000 + [(None, None, None, "a")] * 50
    rows += [(100 + i, " ".join(pool[i % 250 : i % 250 + 10]), "en", "bc"[i % 2]) for i in range(9_000)]
    df = docs(spark, rows)
    found = got(df)
    assert found == brute([(i, t, s) for i, t, _, s in rows]) == got(df.repartition(5))
    kept = [r for r in mixing.mix_documents(df).collect() if r.doc_id in (7, 8)]
    assert abs(sum(r.taken for r in kept) - kept[0].target) <= 20
    assert len({r.taken for r in kept if r.doc_id == 8}) == 2


def test_columns_of_the_plan_may_be_there_already(spark):
    df = spark.createDataFrame([(1, "a", 5, 9, 8, 7), (1, "a", 5, 9, 8, 7), (1, "a", 5, 9, 8, 7), (2, "b", 5, 9, 8, 7)], "id int, s string, _size long, full int, _hash int, target int")
    rows = mixing.mix(df, "s", "_size", ["id"]).collect()
    assert len(rows) == 4 and all((r["full"], r["_hash"], r["_size"]) == (9, 8, 5) and r.target > 0 for r in rows)
    assert sorted(mixing.mix(df, "s", "_size", "id").collect()) == sorted(rows)


def test_agrees_with_sql(spark, tmp_path):
    import duckdb

    df = odd_docs(spark)
    df = df.unionByName(df.where("doc_id in (8, 9, 10)")).unionByName(df)
    df.write.parquet(str(tmp_path / "d"))
    want = duckdb.sql(f"WITH documents AS (SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')), {statements.SOURCE_MIXING.strip()[5:]}").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in mixing.mix_documents(df).collect())
