"""Mixing sources to target weights with hash-threshold histograms, by DataFrame functions alone.

Every row has a fixed hash in [0, 2**60), one of its own even where rows are equal. A source's budget is met by taking
the rows whose hash lies under a threshold. The threshold is found from sums per (source, hash bucket): the bucket in
which the running sum crosses the budget is refined by the next 12 bits, and only that bucket's rows are read again.
Nothing is sorted by hash, a larger budget keeps every row of a smaller one, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.rows import number_rows, stored
from driftwell.session import small_side

HASH_BITS = 60
LEVEL_BITS = 12
SEED = "mix-2"
# Equal rows are written out in pieces of this many, so that many equal rows are not one row's array.
PIECE = 4096


def hash_of(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts, joined by colons: the same number in any engine."""
    named = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *named)), 1, HASH_BITS // 4), 16, 10).cast("long")


def copy_hash(first: Column, number: Column) -> Column:
    """The hash of one of several equal rows, numbered from 0."""
    return F.when(number == 0, first).otherwise(hash_of(first, number))


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and return; NULL has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sources`` (one row each: source, source_size) with ``weight`` and ``target``.

    Weights repeat over the sources in code point order, NULL last. All sizes are shared by weight; a target stops
    at ``most`` times its source's size and the excess goes to the others by weight, until none is above. That is
    one common price per unit of weight, raised until the capped sources stay the same; each round is one sum over
    the sources.
    """
    ranked = stored(number_rows(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_rank"), "sources")
    given = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod("_rank", F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("weight", given.cast("long")).drop("_last", "_rank")
    cap = F.col("source_size") * most
    price, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(price) > cap
        total, held, free, n = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
            F.count(F.when(over, 1)),
        ).first()
        if n == capped or not free:
            break
        capped, price = n, (total - held) / free
    share = F.col("weight") * F.lit(price)
    return ranked.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share))


def hash_cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets`` (source, budget > 0) with ``cut``: rows of the source with a hash under it make up the budget.

    ``rows`` has source (never NULL), size and hash. Each level sums sizes per bucket of the open range and walks on into the bucket
    where the budget is crossed; at the last bit the rows of one hash are taken if that comes nearer to the budget.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        # One row per source: broadcast only if few.
        open_rows = rows.join(small_side(state), "source")
        if level > 1:
            open_rows = open_rows.where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        # At most 4096 buckets per source, summed before the shuffle.
        sums = open_rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("below").alias("below")
        )
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = sums.withColumn("reached", F.col("below") + F.sum("words").over(upto))
        crossing = running.where((F.col("reached") >= F.col("budget")) & (F.col("reached") - F.col("words") < F.col("budget")))
        state = stored(
            crossing.groupBy("source").agg(
                F.min_by(F.struct("budget", "bucket", "words", (F.col("reached") - F.col("words")).alias("below")), "bucket").alias("s")
            ).select("source", "s.budget", F.col("s.bucket").alias("prefix"), "s.below", "s.words"),
            "cuts",
        )
    nearer = F.col("below") + F.col("words") - F.col("budget") <= F.col("budget") - F.col("below")
    return state.select("source", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("cut"))


def equal_rows(slim: DataFrame) -> DataFrame:
    """(source, hash, size, copies) of rows that occur more than once; counted before they are shuffled."""
    return slim.groupBy("source", "hash", "size").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def numbered_copies(repeated: DataFrame) -> DataFrame:
    """One row per copy of ``repeated``, with the copy's own hash; a group of any size is dealt over the tasks."""
    pieces = repeated.withColumn("piece", F.explode(F.expr(f"sequence(0L, (copies - 1) div {PIECE})")))
    dealt = pieces.repartition("source", "hash", "size", "piece")
    last = F.least(F.col("copies"), (F.col("piece") + 1) * PIECE) - 1
    each = dealt.withColumn("number", F.explode(F.sequence(F.col("piece") * PIECE, last)))
    return each.select("source", F.col("hash").alias("first"), "size", "copies", copy_hash(F.col("hash"), F.col("number")).alias("hash"))


def mix(
    df: DataFrame, source: str, size: str, keys: str | Sequence[str], weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = SEED
) -> DataFrame:
    """``df`` with source_size, target, ``times`` (how often the mix takes the row) and taken (words).

    Every row is taken floor(target / source size) times, and once more if its hash lies under the source's cut,
    so a row is taken at most ``most`` times. The hash is that of ``keys``, one name or several. Rows equal in source, size and keys are
    numbered and each has a hash of its own: how many of them are taken follows from their count, so reruns agree, and
    a key of many rows is divided. NULL sources are one source of their own; rows of size 0 are taken zero words; an
    empty table gives no rows. Columns of ``df`` with the new names are replaced.
    """
    df = df.drop("source_size", "target", "times", "taken")
    # A NULL source joins as a tagged name; other names keep their order behind the tag.
    tag = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    first = hash_of(F.lit(seed), *[F.col(k) for k in ([keys] if isinstance(keys, str) else keys)])
    # Stored, since every level of the search reads it: sizes are counted once.
    slim = stored(df.select(F.col(size).alias("size"), tag.alias("source"), first.alias("hash")), "hashes")
    totals = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    named = totals.select(F.expr("CASE WHEN source = 'n' THEN NULL ELSE substring(source, 2) END").alias("source"), "source_size")
    shares = source_targets(named, weights, most)
    # The small term keeps a quotient that is whole but for rounding from losing one.
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    shares = shares.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source"), "source_size", "target", full.alias("full")
    ).withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    shares = stored(shares, "shares")
    repeated = stored(equal_rows(slim), "equal-rows")
    same = ["source", "hash", "size"]
    twice = not repeated.isEmpty()
    if twice:
        copies = stored(numbered_copies(repeated), "copies")
        units = slim.join(small_side(repeated.drop("copies")), same, "left_anti").select("size", "source", "hash")
        units = stored(units.unionByName(copies.select("size", "source", "hash")), "units")
    else:
        units = slim
    cuts = hash_cuts(units, shares.where(F.col("budget") > 0).select("source", "budget"))
    plan = stored(shares.join(cuts, "source", "left").select(
        F.col("source").alias("_mix_tag"), "source_size", "target", F.col("full").alias("_mix_full"), F.col("cut").alias("_mix_cut")
    ), "plan")
    joined = df.withColumns({"_mix_tag": tag, "_mix_hash": first}).join(small_side(plan), "_mix_tag")
    once = F.when(F.col("_mix_hash") < F.col("_mix_cut"), 1).otherwise(0)
    if twice:
        joined, once = with_copies(joined, copies, plan, size), F.coalesce("_mix_once", once)
    joined = joined.withColumn("times", F.col("_mix_full") + once).withColumn("taken", F.col(size) * F.col("times"))
    return joined.drop("_mix_tag", "_mix_hash", "_mix_once", "_mix_full", "_mix_cut")


def with_copies(joined: DataFrame, copies: DataFrame, plan: DataFrame, size: str) -> DataFrame:
    """``joined`` with ``_once``: 1 for as many of equal rows as have a copy under the cut, 0 for the others, NULL for single rows.

    Only rows of groups that are taken in part need a number; they are numbered over all tasks.
    """
    under = F.count(F.when(F.col("hash") < F.col("_mix_cut"), 1))
    groups = copies.join(small_side(plan.select(F.col("_mix_tag").alias("source"), "_mix_cut")), "source").groupBy("source", "first", "size").agg(
        F.first("copies").alias("_mix_copies"), under.alias("_mix_under")
    )
    same = ["_mix_tag", "_mix_hash", "_mix_size"]
    groups = stored(groups.toDF(*same, "_mix_copies", "_mix_under"), "taken-copies")
    sized = joined.withColumn("_mix_size", F.col(size)).join(small_side(groups), same, "left")
    partly = F.coalesce((F.col("_mix_under") > 0) & (F.col("_mix_under") < F.col("_mix_copies")), F.lit(False))
    whole = sized.where(~partly).withColumn("_mix_once", F.when(F.col("_mix_under") > 0, 1).when(F.col("_mix_under") == 0, 0))
    placed = number_rows(sized.where(partly), same, "_mix_at")
    begins = placed.groupBy(*same).agg(F.min("_mix_at").alias("_mix_begin"))
    some = placed.join(small_side(begins), same).withColumn(
        "_mix_once", F.when(F.col("_mix_at") - F.col("_mix_begin") < F.col("_mix_under"), 1).otherwise(0)
    )
    spare = ["_mix_size", "_mix_copies", "_mix_under"]
    return whole.drop(*spare).unionByName(some.drop(*spare, "_mix_at", "_mix_begin"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document; texts are read once, to count and hash them."""
    slim = docs.select("doc_id", "source", F.md5("text").alias("text"), word_count(F.col("text")).alias("size"))
    mixed = mix(stored(slim, "words"), "source", "size", ["doc_id", "text"], weights, most)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
