import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from driftwell.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")
KIND = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def brute(rows):
    """Cheapest edits by uniform-cost search over (place, role initials so far); least letters among the cheapest.

    rows: (initial, must go, cut off). Gives cost, letters, the roles of the new rows and of the rows that stay.
    """
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, initials, made = heapq.heappop(heap)
        if at == len(rows) and LEGAL.fullmatch(initials):
            return cost, letters, made
        # What may follow depends on the last initials alone.
        state = at, initials[-1:]
        if (state, letters) in seen or len(letters) > 2 * len(rows) + 4:
            continue
        seen.add((state, letters))
        legal = lambda i: any(LEGAL.fullmatch(initials + i + rest) for rest in ("", "a", "ua"))
        for i, role in (("u", "user"), ("a", "assistant")):
            if legal(i):
                heapq.heappush(heap, (cost + 3, letters + "I", at, initials + i, (*made, (role, None))))
        if at == len(rows):
            continue
        initial, go, cut = rows[at]
        heapq.heappush(heap, (cost + 4, letters + "D", at + 1, initials, made))
        if go:
            continue
        if len(initial) == 1 and initial in "sua" and legal(initial):
            heapq.heappush(heap, (cost + 3 * cut, letters + "K", at + 1, initials + initial, (*made, (None, at))))
        for i, role in (("u", "user"), ("a", "assistant")):
            if legal(i):
                heapq.heappush(heap, (cost + 3 + 3 * cut, letters + "R", at + 1, initials + i, (*made, (role, at))))
    raise AssertionError


def whole(codes):
    cost, end, closing = repair.best_end(repair.block_item(codes))
    return cost, "".join(e for e, _ in repair.row_edits(codes, repair.START, end)) + closing


@pytest.mark.parametrize("seed", range(6))
def test_letters_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        codes = rng.choices(range(9), k=rng.randint(0, 6))
        rows = [("sua?"[c % 4], c == repair.MUST_GO, 4 <= c < 8) for c in codes]
        assert whole(codes) == brute(rows)[:2], codes


def test_blocks_of_blocks_agree_with_rows():
    rng = random.Random(9)
    for n in (1, 2, 7, 64, 500):
        codes = rng.choices(range(9), weights=[1, 5, 5, 1, 1, 2, 2, 1, 2], k=n)
        for size in (1, 3, 16):
            items = [repair.block_item(codes[i : i + size]) for i in range(0, n, size)]
            assert repair.block_item(items) == repair.block_item(codes)
            cost, end, closing = repair.best_end(repair.block_item(items))
            states = repair.crossings(items, repair.START, end)
            letters = "".join(e for k, (p, q) in enumerate(zip(states, states[1:])) for e, _ in repair.row_edits(codes[k * size : (k + 1) * size], p, q))
            assert (cost, letters + closing) == whole(codes)
            assert repair._unpack(repair._pack(items[0])) == items[0]


def plain(rows):
    """The contract in plain Python."""
    given, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        given[conv]
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        given[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for conv, found in given.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in found if r[0] is not None]
        counts, seen, codes = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in found:
            kept = text.rstrip(WS)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, made = brute(codes)
        lines = [f"{found[at][1] if role is None else role}:{'' if at is None else found[at][2]}" for role, at in made]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def odd_rows(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "User"]
    texts = ["Yes.", "No!", "cut off", None, "", " \t", "\u00a0", "two\nlines?", "Hello. ", "x" * 3_000 + "."]
    return [(rng.choice([0, 1, 2, 3, 4, None]) if rng.random() < 0.3 else rng.randint(5, 40), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("block", [2, 4_096])
def test_conversations_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = odd_rows(120, block)
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS pos", "2 AS fault", "'x' AS edit", "3 AS conv", "4 AS chunk")
    assert table(repair.repair_conversations(df)) == plain(rows)


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert table(repair.repair_conversations(df)) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """Three levels of blocks; letters and cost agree with the rows taken at once."""
    monkeypatch.setattr(repair, "BLOCK", 16)
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"text {t}" + rng.choice([".", ""])) for t in range(2_000)]
    rows += [(c, t, "user", "hi.") for c in range(20) for t in range(2) if c != 7]
    made, ends = repair.repair(spark.createDataFrame(rows, KIND).repartition(5), "conv_id", "turn", "role", "text")
    cost = {r.conv: r.cost for r in ends.collect()}
    letters = "".join(r.edit for r in sorted(made.where("conv = 7").collect(), key=lambda r: r.pos))
    codes = [{"s": 0, "u": 1, "a": 2}[r[2][0]] + 4 * (r[3][-1] != ".") for r in rows[:2_000]]
    assert (cost[7], letters + ends.where("conv = 7").first().closing) == whole(codes)


def test_empty_and_dropped(spark):
    assert repair.repair_conversations(spark.createDataFrame([], KIND)).count() == 0
    # Every turn of these is dropped by the damage.
    gone = [(c, t, "user", "x.") for c in range(100) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = table(repair.repair_conversations(spark.createDataFrame(gone, KIND)))
    assert got and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    far = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    assert table(repair.repair_conversations(spark.createDataFrame(far, KIND)))[1][0] is None
