"""Conversation structure repair by Hirschberg's divide and conquer over four states.

A conversation is legal if its role initials are nothing or ``s?(ua)+``. Four states read it: nothing yet, after the
system row, after a user row, after an assistant row. A row may be kept, given another role or deleted, and empty rows may
be inserted; the cheapest edits are a shortest way through rows and states. Two cost vectors, one forward from the
beginning and one backward from the end, meet in the middle; the state in which the best way crosses the middle splits the
task into two independent halves, so only borders are ever stored. Among equally cheap crossings the one with the least
edit letters before it is taken: a forward vector also holds the order of its states' letters, and as they end with the
letter of one and the same row, none is the beginning of another, so this order decides.

Long conversations are not brought into one task. Rows are numbered in the order of all conversations and cut into blocks
of at most ``BLOCK``. A block is summed up by the cost and letter order of the best way between any two states (a 4 x 4
table that stands where a row stood), blocks by blocks of blocks, until one is left of each conversation. Then the crossing
states are found from the top down, the same way on every level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from driftwell.llm.rows import arrow_map, drop_kept, give_back, grouped_map, number_rows, stored

# Rows, or blocks of the level below, in a block.
BLOCK = 4_096
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
START, SYSTEM, USER, ASSISTANT = range(4)
# By state: the state after an inserted or newly named row, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
READS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
# By state: letters that end a conversation legally.
ENDINGS = ("", "II", "I", "")
# Code of a row that must go; other codes are the role's initial, 3 for any other, and 4 more if the text is cut off.
MUST_GO = 8
# The characters that count as blank: a fixed value of the contract.
BLANK = " \t\n\x0b\x0c\r"

Item = tuple  # 4 x 4: (cost, order of the letters among those from the same state) or None
Vector = tuple  # 4: (cost, order of the letters) or None


def _ways(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> (cost, letters) of the best way over one row, with inserted rows before it."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in range(4):
        state = begin
        # More than two inserted rows in a row lead to states that fewer lead to.
        for inserted in range(3):
            cut = TRUNCATED if code >= 4 else 0
            options = [(state, DELETE, "D")]
            if code != MUST_GO:
                options.append((NEXT[state], REROLE + cut, "R"))
                if (state, code % 4) in READS:
                    options.append((READS[state, code % 4], KEEP + cut, "K"))
            for end, cost, letter in options:
                way = INSERT * inserted + cost, "I" * inserted + letter
                if (begin, end) not in found or way < found[begin, end]:
                    found[begin, end] = way
            state = NEXT[state]
    return found


WAYS = [_ways(code) for code in range(MUST_GO + 1)]


def _row_item(code: int) -> Item:
    ways = WAYS[code]
    table = []
    for p in range(4):
        order = sorted(ways[p, q][1] for q in range(4) if (p, q) in ways)
        table.append(tuple((ways[p, q][0], order.index(ways[p, q][1])) if (p, q) in ways else None for q in range(4)))
    return tuple(table)


ROWS = [_row_item(code) for code in range(MUST_GO + 1)]


def _one(state: int) -> Vector:
    return tuple((0, 0) if q == state else None for q in range(4))


def _advance(vector: Vector, item: Item) -> Vector:
    """The forward vector after one more item."""
    best = []
    for q in range(4):
        ways = [(v[0] + way[0], v[1], way[1]) for v, row in zip(vector, item) if v is not None and (way := row[q]) is not None]
        best.append(min(ways) if ways else None)
    order = sorted(b[1:] for b in best if b is not None)
    return tuple(None if b is None else (b[0], order.index(b[1:])) for b in best)


def _retreat(vector: tuple, item: Item) -> tuple:
    """The backward vector (costs only) before one more item."""
    out = []
    for p in range(4):
        ways = [way[0] + c for way, c in zip(item[p], vector) if way is not None and c is not None]
        out.append(min(ways) if ways else None)
    return tuple(out)


# Vectors less their least cost take few values, so steps over rows are looked up.
@lru_cache(maxsize=1 << 14)
def _advance_row(vector: Vector, code: int) -> tuple[Vector, int]:
    made = _advance(vector, ROWS[code])
    least = min(v[0] for v in made if v is not None)
    return tuple(None if v is None else (v[0] - least, v[1]) for v in made), least


@lru_cache(maxsize=1 << 14)
def _retreat_row(vector: tuple, code: int) -> tuple[tuple, int]:
    made = _retreat(vector, ROWS[code])
    least = min((c for c in made if c is not None), default=0)
    return tuple(None if c is None else c - least for c in made), least


def forward(items: Sequence, vector: Vector) -> Vector:
    """``vector`` after all items; an item is a row's code or a block's table."""
    base = 0
    for item in items:
        if isinstance(item, int):
            vector, more = _advance_row(vector, item)
            base += more
        else:
            vector = _advance(vector, item)
    return tuple(None if v is None else (v[0] + base, v[1]) for v in vector)


def backward(items: Sequence, vector: tuple) -> tuple:
    base = 0
    for item in reversed(items):
        if isinstance(item, int):
            vector, more = _retreat_row(vector, item)
            base += more
        else:
            vector = _retreat(vector, item)
    return tuple(None if c is None else c + base for c in vector)


def crossings(items: Sequence, begin: int, end: int) -> list[int]:
    """The states before, between and after the items on the cheapest way with the least letters."""
    found = [begin] * (len(items) + 1)
    found[-1] = end
    open_ = [(0, len(items))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        before = forward(items[low:middle], _one(found[low]))
        after = backward(items[middle:high], tuple(0 if q == found[high] else None for q in range(4)))
        ways = [(v[0] + c, v[1], q) for q, (v, c) in enumerate(zip(before, after)) if v is not None and c is not None]
        found[middle] = min(ways)[2]
        open_ += [(low, middle), (middle, high)]
    return found


def block_item(items: Sequence) -> Item:
    """The table of a block: forward vectors from each state."""
    return tuple(forward(items, _one(p)) for p in range(4))


def best_end(table: Item) -> tuple[int, int, str]:
    """Cost, last state and closing letters of the best legal conversation."""
    ways = [(v[0] + INSERT * len(ENDINGS[q]), v[1], q) for q, v in enumerate(table[START]) if v is not None]
    cost, _, state = min(ways)
    return cost, state, ENDINGS[state]


def row_edits(codes: Sequence[int], begin: int, end: int) -> list[tuple[str, int]]:
    """Letters of each row (inserted rows before it first) and the state that they begin in."""
    states = crossings(codes, begin, end)
    return [(WAYS[c][p, q][1], p) for c, p, q in zip(codes, states, states[1:])]


# ---- as Spark jobs ----


def _pack(item: Item) -> list[int]:
    return [x for row in item for way in row for x in ((-1, -1) if way is None else way)]


def _unpack(flat: Sequence[int]) -> Item:
    ways = [None if flat[i] < 0 else (flat[i], flat[i + 1]) for i in range(0, 32, 2)]
    return tuple(tuple(ways[4 * p : 4 * p + 4]) for p in range(4))


_KEY = ["none", "conv", "chunk"]
_LEVEL = "none boolean, conv long, chunk long, ways array<long>, first string, last string, illegal long"


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _summed(key: dict, items: list, pairs: list[tuple[str, str, int]]) -> dict:
    illegal = sum(p[2] for p in pairs) + sum(not _legal(a[1] + b[0]) for a, b in zip(pairs, pairs[1:]))
    return key | {"ways": [_pack(block_item(items))], "first": [pairs[0][0]], "last": [pairs[-1][1]], "illegal": [illegal]}


def _key_of(rows: pa.Table, keys: Sequence[str] = _KEY) -> dict:
    return {k: [rows[k][0].as_py()] for k in keys}


def _sum_rows(rows: pa.Table) -> dict:
    rows = rows.sort_by("pos")
    initials = rows["initial"].to_pylist()
    return _summed(_key_of(rows), rows["code"].to_pylist(), [(i, i, 0) for i in initials])


def _sum_blocks(rows: pa.Table) -> dict:
    rows = rows.sort_by("below")
    pairs = list(zip(rows["first"].to_pylist(), rows["last"].to_pylist(), rows["illegal"].to_pylist()))
    return _summed(_key_of(rows), [_unpack(w) for w in rows["ways"].to_pylist()], pairs)


def _borders(rows: pa.Table) -> dict:
    """The states around each block of a block."""
    rows = rows.sort_by("below")
    states = crossings([_unpack(w) for w in rows["ways"].to_pylist()], rows["begin"][0].as_py(), rows["end"][0].as_py())
    n = rows.num_rows
    return {"none": rows["none"].to_pylist(), "conv": rows["conv"].to_pylist(), "chunk": rows["below"].to_pylist(), "begin": states[:n], "end": states[1:]}


def _row_edits(rows: pa.Table) -> dict:
    rows = rows.sort_by("pos")
    made = row_edits(rows["code"].to_pylist(), rows["begin"][0].as_py(), rows["end"][0].as_py())
    return {"pos": rows["pos"].to_pylist(), "edit": [m[0] for m in made], "state": [m[1] for m in made]}


def _ends(rows: pa.Table) -> dict:
    out: dict = {k: rows[k] for k in ("none", "conv", "chunk", "illegal")} | {"begin": [], "end": [], "cost": [], "closing": []}
    for ways in rows["ways"].to_pylist():
        cost, state, closing = best_end(_unpack(ways))
        for name, value in (("begin", START), ("end", state), ("cost", cost), ("closing", closing)):
            out[name].append(value)
    return out


def with_faults(df: DataFrame) -> DataFrame:
    """Add ``fault`` to rows with conv, pos, role and text: the first of blank, duplicate and truncated that holds, else ''.

    A row is a duplicate if its conversation holds role and text at an earlier place. The first place of each is found by
    aggregation and joined back by place, so that a text which fills a conversation stays spread over all tasks.
    """
    trimmed = F.expr(f"trim(TRAILING '{BLANK}' FROM text)")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = df.groupBy("conv", digest.alias("_digest")).agg(F.min("pos").alias("_first"))
    marked = df.join(firsts.select("_first"), F.col("pos") == F.col("_first"), "left")
    fault = (
        F.when(trimmed == "", "blank")
        .when(F.col("_first").isNull(), "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    return marked.withColumn("fault", fault).drop("_first")


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str, tie: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """Cheapest legal edits of every conversation: a table of rows and one of conversations.

    Rows: conv, pos (place among all rows, by conversation and turn, NULLs first, then role, text and ``tie``), turn, role,
    text, fault, edit (letters; I for each row inserted before it, then K, R or D), state (in which these begin).
    Conversations: conv, cost, illegal (neighbours that may not follow each other), closing (letters behind the last row).
    NULL roles and texts count as one space; NULL conversations are one. Ids are integers. Columns of other names are not
    read. An empty table gives empty ones.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    slim = df.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"),
        *[c.alias(f"tie{i}") for i, c in enumerate(tie)],
    )
    placed = number_rows(slim, ["conv", "turn", "role", "text", *[f"tie{i}" for i in range(len(tie))]], "pos")
    rows = stored(with_faults(placed.drop(*[f"tie{i}" for i in range(len(tie))])), "conversation-rows")
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", number + 4).otherwise(number)
    # NULL conversations as a flag, since groups are told apart by plain numbers.
    keyed = rows.select(
        F.col("conv").isNull().alias("none"), F.coalesce("conv", F.lit(0)).alias("conv"), F.expr(f"pos div {BLOCK}").alias("chunk"),
        "pos", code.cast("int").alias("code"), initial.alias("initial"),
    )
    levels = [stored(grouped_map(keyed, _KEY, _sum_rows, _LEVEL), "conversation-blocks")]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        above = levels[-1].withColumnRenamed("chunk", "below").withColumn("chunk", F.expr(f"below div {BLOCK}"))
        levels.append(stored(grouped_map(above, _KEY, _sum_blocks, _LEVEL), "conversation-blocks"))
    top = stored(
        arrow_map(levels.pop(), _ends, "none boolean, conv long, chunk long, illegal long, begin int, end int, cost long, closing string"), "conversation-ends"
    )
    borders = top.select(*_KEY, "begin", "end")
    for level in reversed(levels):
        below = level.withColumnRenamed("chunk", "below").withColumn("chunk", F.expr(f"below div {BLOCK}"))
        made = grouped_map(below.join(borders, _KEY), _KEY, _borders, "none boolean, conv long, chunk long, begin int, end int")
        borders = stored(made, "conversation-borders")
    edits = grouped_map(keyed.join(borders, _KEY), _KEY, _row_edits, "pos long, edit string, state int")
    ends = top.select(F.when(~F.col("none"), F.col("conv")).alias("conv"), "cost", "illegal", "closing")
    return rows.join(stored(edits, "conversation-edits"), "pos"), ends


def repaired_lines(edit: str, state: int, role: str, text: str) -> list[str]:
    """``role:text`` of the rows that stand where a row stood."""
    out = []
    for letter in edit:
        if letter == "D":
            break
        if letter == "K":
            out.append(f"{role}:{text}")
            break
        state = NEXT[state]
        out.append(f"{ROLE[state]}:" + (text if letter == "R" else ""))
    return out


def digests(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """conv, audit and repaired_sha256: all edit letters, and the hash of the repaired rows' ``role:text`` in order.

    Rows of a conversation pass in order through one task, which holds the hash and the letters alone: a hash of a text
    cannot be put together from parts.
    """
    nothing = {"pos": F.lit(None).cast("long"), "state": F.lit(None).cast("int"), "role": F.lit(""), "text": F.lit("")}
    closing = ends.select("conv", F.col("closing").alias("edit"), *[c.alias(n) for n, c in nothing.items()])
    both = rows.select("conv", "pos", "edit", "state", "role", "text").unionByName(closing)
    kind = _parse_datatype_string("conv long, audit string, repaired_sha256 string")
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()

        def packed(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), target)], schema=target)

        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("conv", "edit", "state", "role", "text")])

        out: list[tuple] = []
        for conv, rows_ in groupby(flat(), key=lambda r: r[0]):
            sha, letters, began, state = hashlib.sha256(), [], False, START
            for _, edit, begins, role, text in rows_:
                state = state if begins is None else begins
                for line in repaired_lines(edit, state, role, text):
                    sha.update((("\n" if began else "") + line).encode())
                    began = True
                for letter in edit:
                    if letter in "IR":
                        state = NEXT[state]
                    elif letter == "K":
                        state = READS[state, INITIALS.index(role[0])]
                letters.append(edit)
            out.append((conv, "".join(letters), sha.hexdigest()))
            if len(out) >= BLOCK:
                yield packed(out)
                out = []
        if out:
            yield packed(out)
        give_back()

    dealt = both.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("pos").asc_nulls_last())
    return dealt.mapInArrow(run, kind)


def damaged(df: DataFrame) -> DataFrame:
    """The rows of the contract's damage: dropped, emptied, without sentence ends, repeated, or of the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    slim = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return slim.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def repair_conversations(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows with one turn stand in the order of role and text. Turns so far apart that their distance is no long give NULL gaps.
    """
    rows, ends = repair(damaged(df), "conv_id", "turn", "role", "text", [F.col("copy")])
    distance = F.expr("try_cast(CAST(max(turn) AS decimal(20)) - min(turn) + 1 - count(DISTINCT turn) AS bigint)")
    counts = rows.groupBy("conv").agg(
        F.when(F.count("turn") == 0, F.lit(0).cast("long")).otherwise(distance).alias("gaps"),
        *[F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    found = _same(_same(counts, ends), digests(rows, ends))
    every = df.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = _same(every, found.withColumn("_found", F.lit(True)), "left")
    return whole.select(
        F.col("conv").alias("conv_id"),
        *[F.when(F.col("_found").isNull(), F.lit(0).cast("long")).otherwise(F.col(n)).alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``conv``, where NULL equals NULL."""
    right = right.withColumnRenamed("conv", "_conv")
    return left.join(right, F.col("conv").eqNullSafe(F.col("_conv")), how).drop("_conv")
