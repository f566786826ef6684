"""Near-duplicate vectors by NN-descent, with saturated neighbour lists enlarged and recall audited.

Every vector keeps a list of its LIST nearest known neighbours. Lists start from random projection trees: vectors
in one leaf are compared with each other. NN-descent then compares the neighbours of each vector (in both directions)
with one another and keeps what is nearer, until lists hardly change. Pairs at the threshold are edges.

A list whose entries all reach the threshold is saturated: there may be more. Since such a vector's partners are its
partners' partners, its list is enlarged to its whole connected component: components are cut into blocks and blocks
compared two by two, so inside components the links are complete and only counts leave the tasks.

A link between two saturated vectors of different components is in neither list if both have LIST nearer ones. So
saturated vectors are searched once more for their nearest ones outside their own component, and components that turn
out to be linked are joined, until none is. Any one link joins two components, and their links are then counted in full.

The trees follow from the planes per tree, so that a pair at the threshold meets in one of them with probability MEET.

Recall is audited, and while it lies below the target, further trees and rounds are added. A fixed sample of vectors is
compared with all vectors, which says little where links are rare. So each of them also gets a planted partner at the
threshold, in a random direction: a pair that only the trees can find, as hard as any. Planted vectors have no weight and
join nothing.

Equal vectors are one node with a weight. Cosines are taken in double precision.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from driftwell.llm.graphs import components
from driftwell.llm.rows import arrow_map, grouped_map, stored

THRESHOLD = 0.9
LIST = 10
# At least so many trees in a pass; more are made in turns of at most BATCH.
TREES = 8
BATCH = 16
MEET = 0.995
LEAF = 64
CODE_BITS = 40
ROUNDS = 3
# Lists are settled when fewer than this share of their entries changes.
SETTLED = 0.02
BLOCK = 256
AUDIT = 1_024
RECALL = 0.99
# A planted partner lies this little above the threshold, so that rounding does not matter.
ABOVE = 1e-6
MOST_PASSES = 6
BROADCAST_ROWS = 100_000


def _matrix(vectors: list[bytes], dims: np.ndarray) -> np.ndarray:
    """Unit rows in double precision, padded with zeros to the longest; rows of other lengths are told apart by ``dims``."""
    wide = int(dims.max())
    if (dims == wide).all():
        x = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, wide)
    else:
        x = np.zeros((len(vectors), wide))
        for i, v in enumerate(vectors):
            x[i, : dims[i]] = np.frombuffer(v, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    wide = min(x.shape[1], y.shape[1])
    found = x[:, :wide] @ y[:, :wide].T
    if dx.min() != dx.max() or dy.min() != dy.max() or dx[0] != dy[0]:
        found[dx[:, None] != dy[None, :]] = -2.0
    return found


def sketched(df: DataFrame, vector: str, key: str) -> DataFrame:
    """``id`` and, for usable vectors, digest, dim and the components as doubles.

    NULL and zero vectors and those with NULL or non-finite components are not usable: their digest is NULL.
    """
    slim = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(ArrayType(DoubleType())).alias("v"))

    def run(rows: pa.Table) -> dict:
        out: dict = {"id": rows["id"], "digest": [], "dim": [], "vec": []}
        for v in rows["v"].to_pylist():
            x = None if not v or None in v else np.array(v, np.float64) + 0.0
            if x is None or not np.isfinite(x).all() or not x.any():
                x = None
            else:
                # Tiny and huge vectors keep their direction when squared.
                x = x / np.abs(x).max() if not 1e-100 < np.abs(x).max() < 1e100 else x
            out["digest"].append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            out["dim"].append(0 if x is None else len(x))
            out["vec"].append(None if x is None else x.tobytes())
        return out

    return arrow_map(slim, run, "id long, digest binary, dim int, vec binary")


def _dims(rows: pa.Table) -> np.ndarray:
    return rows["dim"].to_numpy().astype(np.int64)


def leaves(nodes: DataFrame, trees: int, seed: int, wide: int, bits: int) -> DataFrame:
    """(g1 tree, g2 leaf, g3 part, node): the leaf of every node in each random projection tree.

    A leaf is the side of ``bits`` random planes that a vector lies on. A leaf with many more nodes than usual, such as
    a group of copies, is parted at random: its nodes are near each other whichever part they share.
    """

    def run(rows: pa.Table) -> dict:
        planes = np.random.default_rng(seed).normal(size=(wide, trees * bits))
        dims = _dims(rows)
        x = _matrix(rows["vec"].to_pylist(), dims)
        side = (x @ planes[: x.shape[1]] > 0).reshape(len(x), trees, bits)
        codes = side @ (np.int64(1) << np.arange(bits, dtype=np.int64))
        return {"node": rows["node"], "codes": list(codes)}

    coded = arrow_map(nodes.select("node", "dim", "vec"), run, "node long, codes array<long>")
    placed = stored(coded.select("node", F.posexplode("codes").alias("g1", "g2")), "leaves")
    large = placed.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 2 * LEAF)
    parts = F.ceil(F.coalesce("rows", F.lit(1)) / F.lit(2 * LEAF)).cast("long")
    return placed.join(large, ["g1", "g2"], "left").select(
        F.col("g1").cast("long"), "g2", F.pmod(F.xxhash64("node", "g1"), parts).alias("g3"), "node"
    )


def _nearest(rows: pa.Table) -> dict | None:
    """For each vector of a group, its nearest ones in the group that beat the worst entry of its list.

    With a column ``root``, only vectors of another root count.
    """
    node, worst, dims = rows["node"].to_numpy(), rows["worst"].to_numpy(), _dims(rows)
    if len(node) < 2:
        return None
    x = _matrix(rows["vec"].to_pylist(), dims)
    sims = _cosines(x, x, dims, dims)
    np.fill_diagonal(sims, -2.0)
    if "root" in rows.column_names:
        root = rows["root"].to_numpy()
        sims[root[:, None] == root[None, :]] = -2.0
    k = min(LIST, len(node) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    found = np.take_along_axis(sims, top, 1)
    i, j = np.nonzero(found > np.maximum(worst, -1.5)[:, None])
    if not len(i):
        return None
    return {"node": node[i], "near": node[top[i, j]], "sim": found[i, j]}


_NEAR = "node long, near long, sim double"


def best_lists(found: DataFrame) -> DataFrame:
    """The LIST nearest distinct entries of each node. A node has a few times LIST rows here."""
    once = found.groupBy("node", "near").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "near")
    return once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= LIST).drop("_r")


def tree_bits(n: int) -> int:
    """Planes per tree that leave about LEAF of ``n`` nodes in a leaf."""
    return min(CODE_BITS, max(0, math.ceil(math.log2(n / LEAF)))) if n > LEAF else 0


def tree_count(bits: int) -> int:
    """Trees in which a pair at the threshold shares a leaf at least once with probability MEET."""
    apart = 1.0 - (1.0 - math.acos(THRESHOLD) / math.pi) ** bits
    return max(TREES, math.ceil(math.log(1.0 - MEET) / math.log(apart))) if apart > 0 else TREES


def from_trees(nodes: DataFrame, seed: int, wide: int, bits: int, lists: DataFrame | None) -> DataFrame:
    trees = tree_count(bits)
    for start in range(0, trees, BATCH):
        grouped = leaves(nodes, min(BATCH, trees - start), 1_000 * seed + start, wide, bits)
        grouped = grouped.join(nodes.drop("digest", "id", "weight"), "node").withColumn("worst", F.lit(-2.0))
        found = grouped_map(grouped, ["g1", "g2", "g3"], _nearest, _NEAR)
        lists = stored(best_lists(found if lists is None else found.union(lists)), "lists")
    return lists


def descend(nodes: DataFrame, lists: DataFrame, beside: DataFrame | None = None) -> tuple[DataFrame, int]:
    """One round: neighbours of each node, in both directions, compared with one another. New lists and how many entries changed.

    Entries of ``beside`` count as neighbours too, but stay out of the lists. A node that very many others list is
    handled in parts of its neighbours.
    """
    worst = lists.groupBy("node").agg(F.when(F.count(F.lit(1)) >= LIST, F.min("sim")).otherwise(-2.0).alias("worst"))
    entries = lists if beside is None else lists.union(beside)
    forward = entries.select(F.col("node").alias("g1"), F.col("near").alias("node"))
    backward = entries.select(F.col("near").alias("g1"), "node")
    around = stored(forward.union(backward).distinct(), "around")
    large = around.groupBy("g1").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > LEAF)
    parts = F.ceil(F.coalesce("rows", F.lit(1)) / F.lit(LEAF)).cast("long")
    placed = around.join(large, "g1", "left").select("g1", F.pmod(F.xxhash64("node", "g1"), parts).alias("g2"), "node")
    known = nodes.drop("digest", "id", "weight").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    found = grouped_map(placed.join(known, "node"), ["g1", "g2"], _nearest, _NEAR)
    fresh = stored(best_lists(found.union(lists)), "lists")
    return fresh, fresh.join(lists, ["node", "near"], "left_anti").count()


def bridges(nodes: DataFrame, lists: DataFrame, labels: DataFrame, seed: int, wide: int) -> DataFrame | None:
    """Links between saturated nodes of different components of ``labels``; None if there are none.

    Only two saturated nodes can miss each other in complete lists. Their nearest ones outside the own component are
    searched like the lists: by trees, and by comparing the neighbours of each node inside and outside its component.
    """
    full = lists.where(F.col("sim") >= THRESHOLD).groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= LIST)
    slim = nodes.select("node", "dim", "vec").join(labels, "node").select("node", "dim", "vec", "root")
    dense = stored(slim.join(full, "node", "left_semi"), "saturated")
    n, roots = dense.agg(F.count(F.lit(1)), F.count_distinct("root")).first()
    if roots < 2:
        return None
    across = from_trees(dense, seed, wide, tree_bits(n), None)
    for _ in range(ROUNDS):
        across, changed = descend(dense, across, lists)
        if changed <= SETTLED * n * LIST:
            break
    found = across.where(F.col("sim") >= THRESHOLD)
    return None if found.isEmpty() else found


def joined_components(nodes: DataFrame, lists: DataFrame, edges: DataFrame, seed: int, wide: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the bridges between their components, and the components: repeated until no two are linked any more."""
    while True:
        labels = stored(components(edges, "node", "near"), "vector-labels")
        more = bridges(nodes, lists, labels, seed, wide)
        if more is None:
            return edges, labels
        edges, seed = edges.union(more.select("node", "near")), seed + 1


def _block_links(rows: pa.Table) -> dict | None:
    """How much weight each vector of a pair of blocks links with on the other side."""
    side, node, weight, dims = rows["side"].to_numpy(), rows["node"].to_numpy(), rows["weight"].to_numpy(), _dims(rows)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return None
    x = _matrix(rows["vec"].to_pylist(), dims)
    linked = _cosines(x[left], x[right], dims[left], dims[right]) >= THRESHOLD
    linked &= node[left][:, None] != node[right][None, :]
    return {
        "node": np.concatenate([node[left], node[right]]),
        "links": np.concatenate([linked @ weight[right], weight[left] @ linked]).astype(np.int64),
    }


def _blocks(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(BLOCK))).cast("long")


def component_links(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, links): all links of each node inside its component, from pairs of blocks of the component.

    Block pairs i < j give both sides' counts; a block against itself stands on both sides and one side's counts are taken.
    """
    sizes = labels.groupBy("root").agg(_blocks(F.count(F.lit(1))).alias("b"))
    placed = labels.join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("b")))
    zero = F.lit(0).cast("long")
    pairs = F.concat(
        F.transform(F.sequence(F.col("mine"), F.col("b") - 1), lambda j: F.struct(F.col("mine").alias("g2"), j.alias("g3"), F.lit(0).alias("side"))),
        F.transform(F.sequence(zero, F.col("mine")), lambda i: F.struct(i.alias("g2"), F.col("mine").alias("g3"), F.lit(1).alias("side"))),
    )
    grouped = placed.select(F.col("root").alias("g1"), "node", F.explode(pairs).alias("p")).select("g1", "p.*", "node")
    grouped = grouped.join(nodes.select("node", "dim", "vec", "weight"), "node")

    def count(rows: pa.Table) -> dict | None:
        made = _block_links(rows)
        if made is not None and rows["g2"][0].as_py() == rows["g3"][0].as_py():
            # The same vectors stand on both sides: one side has all counts.
            half = len(made["node"]) // 2
            made = {c: v[:half] for c, v in made.items()}
        return made

    return grouped_map(grouped, ["g1", "g2", "g3"], count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def audit_sample(nodes: DataFrame) -> DataFrame:
    """At most AUDIT nodes, always the same."""
    return nodes.select("node", "dim", "vec", F.xxhash64("node").alias("h")).orderBy("h", "node").limit(AUDIT)


def planted_partners(sample: DataFrame) -> DataFrame:
    """node (-1 - the partner's), dim, vec: a vector at the threshold from each of ``sample`` that has two or more components."""

    def run(rows: pa.Table) -> dict:
        out: dict = {"node": [], "dim": [], "vec": []}
        for node, dim, vec in zip(rows["node"].to_pylist(), rows["dim"].to_pylist(), rows["vec"].to_pylist()):
            x = np.frombuffer(vec, np.float64)
            x = x / np.linalg.norm(x)
            r = np.random.default_rng(node).normal(size=dim)
            r -= (r @ x) * x
            cosine = THRESHOLD + ABOVE
            out["node"].append(-1 - node)
            out["dim"].append(dim)
            out["vec"].append((cosine * x + math.sqrt(1 - cosine**2) * r / np.linalg.norm(r)).tobytes())
        return out

    return arrow_map(sample.where(F.col("dim") > 1).select("node", "dim", "vec"), run, "node long, dim int, vec binary")


def planted_recall(planted: DataFrame, lists: DataFrame) -> float:
    """Share of planted nodes whose link with their partner is in a list, or whose list is full of other links.

    Partners whose own lists are full are left out: around them links are many, and the sample compared with all tells.
    """
    linked = lists.where(F.col("sim") >= THRESHOLD)
    pair = linked.where(F.col("node") + F.col("near") == -1).select(F.least("node", "near").alias("node")).distinct()
    full = linked.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= LIST).select("node")
    judged = planted.select("node").join(full.select((-1 - F.col("node")).alias("node")), "node", "left_anti")
    hit = pair.union(full).distinct().withColumn("hit", F.lit(1))
    found, total = judged.join(hit, "node", "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return found / total if total else 1.0


def true_links(nodes: DataFrame) -> dict[int, int]:
    """Links of the sampled nodes, by comparing them with all nodes."""
    sample = audit_sample(nodes).collect()
    ids = np.array([r["node"] for r in sample], np.int64)
    dims = np.array([r["dim"] for r in sample], np.int64)
    x = _matrix([bytes(r["vec"]) for r in sample], dims)
    shared = nodes.sparkSession.sparkContext.broadcast((ids, dims, x))

    def run(rows: pa.Table) -> dict:
        ids, dims, x = shared.value
        own, node, weight = _dims(rows), rows["node"].to_numpy(), rows["weight"].to_numpy()
        linked = _cosines(x, _matrix(rows["vec"].to_pylist(), own), dims, own) >= THRESHOLD
        linked &= ids[:, None] != node[None, :]
        links = linked @ weight
        hit = np.flatnonzero(links)
        return {"node": ids[hit], "links": links[hit]}

    counted = arrow_map(nodes.select("node", "dim", "vec", "weight"), run, "node long, links long")
    return {r["node"]: r["l"] for r in counted.groupBy("node").agg(F.sum("links").alias("l")).collect()}


def near_vectors(df: DataFrame, vector: str, key: str) -> DataFrame:
    """``key``, n_links, component_id (smallest key reachable), kept (the key is its component's), for every row.

    Vectors that are NULL, zero or hold NULL or non-finite components link with nothing, nor do vectors of different
    lengths. Equal vectors link with each other. A NULL key has no order: its row joins its component and shows the
    component's smallest key. Repeated rows count as vectors of their own. Other columns are left out.
    """
    sketch = stored(sketched(df, vector, key), "vectors")
    nodes = stored(
        sketch.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vector-nodes",
    )
    n, wide = nodes.agg(F.count(F.lit(1)), F.max("dim")).first()
    counts = labels = None
    if n > 1:
        wanted = true_links(nodes)
        planted = stored(planted_partners(audit_sample(nodes)), "planted")
        searched = stored(nodes.select("node", "dim", "vec").union(planted), "searched")
        bits = tree_bits(searched.count())
        lists = bridged = None
        for attempt in range(MOST_PASSES):
            lists = from_trees(searched, 1_000 + attempt, wide, bits, lists)
            for _ in range(ROUNDS):
                lists, changed = descend(searched, lists)
                if changed <= SETTLED * n * LIST:
                    break
            edges = lists.where((F.col("sim") >= THRESHOLD) & (F.col("node") >= 0) & (F.col("near") >= 0)).select("node", "near")
            bridged, labels = joined_components(
                nodes, lists, edges if bridged is None else edges.union(bridged), 1_000_000 * (attempt + 1), wide
            )
            counts = stored(component_links(nodes, labels), "vector-links")
            if planted_recall(planted, lists) < RECALL:
                continue
            ids = F.array(*[F.lit(i) for i in wanted])
            found = {r["node"]: r["links"] for r in counts.where(F.array_contains(ids, F.col("node"))).collect()} if wanted else {}
            if sum(min(found.get(i, 0), w) / w for i, w in wanted.items()) >= RECALL * len(wanted):
                break
        else:
            raise RuntimeError(f"recall stays below {RECALL} after {MOST_PASSES} passes")
    known = nodes.select("digest", "node", "id", "weight")
    if labels is not None:
        known = known.join(labels, "node", "left").join(counts, "node", "left")
        known = known.select("digest", "id", "weight", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    else:
        known = known.select("digest", "id", "weight", F.col("node").alias("root"), F.lit(0).cast("long").alias("links"))
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(
        known.join(least, "root").select("digest", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links")), "vector-named"
    )
    own = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return sketch.select("id", "digest").join(named, "digest", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.col("id").eqNullSafe(own).alias("kept"),
    )


def embedding_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every embedding, whatever its label."""
    return near_vectors(embeddings, "embedding", "vec_id")
