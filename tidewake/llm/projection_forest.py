"""Operator 7: embedding near-duplicates by a forest of random-projection trees.

A tree halves the unit vectors again and again at the median of their projection on a
random direction. Vectors within ``MARGIN`` of the median go to both sides (spill), so a
pair of near vectors is cut apart only where it straddles the whole margin, and several
trees make up for that. A node whose halves hardly shrink (a dense cluster that the margin
keeps together) stays a leaf. Trees are fitted on a bounded sample; every vector is routed.

All pairs inside a leaf (and label) are compared in double precision. A pair that meets in
several leaves counts in the first of them only, which both vectors' lists of leaves tell,
so link counts add up without gathering pairs. Large leaves are cut in tiles and compared
tile against tile; each task returns counts and a spanning forest, never the pairs.
Copies of one vector are one node with a weight.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import join_unskewed, materialise, prepare, table
from tidewake.llm.components import components, local_components

COSINE = 0.93
TREES = 5
#: Half-width of the spill zone, as a difference of projections of unit vectors.
MARGIN = 0.03
#: Vectors of the most common label that a leaf should hold.
LEAF = 256
#: Most vectors that the forest is fitted on.
SAMPLE = 20_000
#: Most bytes of vectors that it is fitted on.
SAMPLE_BYTES = 256 << 20
#: Rows of a leaf that one task compares with as many others.
TILE = 2048


@dataclass
class Tree:
    """Nodes in arrays; a child below 0 is leaf -child - 1."""

    direction: list[np.ndarray] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    child: list[list[int]] = field(default_factory=list)
    leaves: int = 0


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over the unit vectors of a sample, with about ``leaf`` of them in each leaf."""
    tree = Tree()

    def build(own: np.ndarray) -> int:
        if len(own) > leaf:
            for _ in range(4):
                d = rng.standard_normal(x.shape[1])
                d /= np.linalg.norm(d)
                p = x[own] @ d
                t = float(np.median(p))
                left, right = own[p <= t + MARGIN], own[p > t - MARGIN]
                if max(len(left), len(right)) <= 0.8 * len(own):
                    at = len(tree.child)
                    tree.direction.append(d)
                    tree.threshold.append(t)
                    tree.child.append([0, 0])
                    tree.child[at] = [build(left), build(right)]
                    return at
        tree.leaves += 1
        return -tree.leaves

    tree.root = build(np.arange(len(x)))
    return tree


def route(tree: Tree, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) for every leaf that a row of x goes to."""
    out, stack = [], [(tree.root, np.arange(len(x)))]
    while stack:
        node, own = stack.pop()
        if not len(own):
            continue
        if node < 0:
            out.append((-node - 1, own))
            continue
        p, t = x[own] @ tree.direction[node], tree.threshold[node]
        stack += [(tree.child[node][0], own[p <= t + MARGIN]), (tree.child[node][1], own[p > t - MARGIN])]
    return out


def _padded(column: pa.Array | pa.ChunkedArray, width: int, fill, kind) -> np.ndarray:
    """A list column as a matrix of ``width`` columns, shorter rows filled up."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if len(size) and (size == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.full((len(size), width), fill, kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision (scaled first, so nothing overflows)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_forest(sample: np.ndarray, leaf: int, trees: int = TREES, seed: int = 7) -> list[Tree]:
    return [grow(sample, leaf, np.random.default_rng([seed, i])) for i in range(trees)]


def _router(forest: list[Tree], dims: int):
    base = np.concatenate([[0], np.cumsum([t.leaves for t in forest])])

    def run(batches):
        for batch in batches:
            x = unit(_padded(batch.column(2), dims, 0.0, np.float64)) if batch.num_rows else np.empty((0, dims))
            met = [(np.full(len(own), base[i] + leaf), own) for i, tree in enumerate(forest) for leaf, own in route(tree, x)]
            leaf, row = (np.concatenate(c) for c in zip(*met)) if met else (np.empty(0, np.int64),) * 2
            order = np.lexsort((leaf, row))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "label", "vector", "weight", "leaves"])

    return run


def _earlier(leaves: pa.Array, leaf: int) -> np.ndarray:
    """Each row's leaves before ``leaf``, filled up with -1; lists ascend."""
    out = _padded(leaves, int(np.max(leaves.value_lengths().to_numpy())), -1, np.int32)
    out[out >= leaf] = -1
    return out[:, : max(1, int((out >= 0).sum(1).max()))]


def _met_before(early: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share an earlier leaf; ``early`` holds each row's, -1 where there is none."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 15):
        x, y = early[i[s : s + (1 << 15)]], early[j[s : s + (1 << 15)]]
        for k in range(early.shape[1]):
            out[s : s + (1 << 15)] |= ((x[:, k : k + 1] == y) & (y >= 0)).any(1)
    return out


_TILE_OUT = "node long, root long, n_links long"


def _compare(least: float):
    def run(t: pa.Table) -> pa.Table:
        """One tile pair of one leaf: link counts and a spanning forest."""
        node = t["node"].to_numpy()
        weight = t["weight"].to_numpy()
        tile = t["tile"].to_numpy()
        leaf = t["leaf"][0].as_py()
        x = unit(_padded(t["vector"], t["dims"][0].as_py(), 0.0, np.float64))
        early = _earlier(t["leaves"].combine_chunks(), leaf)
        across = tile.min() != tile.max()
        count = np.zeros(len(node), np.int64)
        a, b = [], []
        for lo in range(0, len(x), 512):
            ok = x[lo : lo + 512] @ x.T >= least
            ok &= np.arange(lo, lo + len(ok))[:, None] < np.arange(len(x))[None, :]
            if across:
                ok &= tile[lo : lo + 512, None] != tile[None, :]
            i, j = np.nonzero(ok)
            i += lo
            a.append(i)
            b.append(j)
            new = ~_met_before(early, i, j)
            np.add.at(count, i[new], weight[j[new]])
            np.add.at(count, j[new], weight[i[new]])
        by_id = np.argsort(node, kind="stable")
        place = np.empty(len(node), np.int64)
        place[by_id] = np.arange(len(node))
        label = local_components(len(node), place[np.concatenate(a)], place[np.concatenate(b)])
        root = node[by_id][label[place]]
        said = (count > 0) | (root != node)
        return pa.table({"node": pa.array(node[said]), "root": pa.array(root[said]), "n_links": pa.array(count[said])})

    return run


def _usable(vector: F.Column) -> F.Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and they are equally
    long. A vector that is null, empty, zero or holds a null or non-finite component links
    with nothing, and so does a row without an identifier (its component is null, it is
    kept). Copies link with each other; repeated rows count as copies. An empty table gives
    an empty table.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    nodes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    nodes = materialise(nodes.select("node", "label", "vector", "weight"), "nodes")

    sizes = nodes.groupBy("label").agg(F.count("*").alias("count"), F.max(F.size("vector")).alias("dims")).agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max("dims").alias("dims")).first()
    n, most, dims = sizes["n"] or 0, sizes["most"] or 0, sizes["dims"] or 1
    most_rows = max(1, min(sample, SAMPLE_BYTES // (8 * dims)))
    taken = nodes.orderBy(F.xxhash64("node")).limit(most_rows).select("vector").toArrow()["vector"]
    share = len(taken) / n if n else 1
    forest = fit_forest(unit(_padded(taken, dims, 0.0, np.float64)), max(8, round(leaf * share * n / most)), trees) if len(taken) else []
    routed = nodes.mapInArrow(_router(forest, dims), f"node long, label {nodes.schema['label'].dataType.simpleString()}, vector array<double>, weight long, leaves array<int>")
    routed = materialise(routed.withColumn("dims", F.size("vector")), "routed")

    key = ["label", "dims", "leaf"]
    spread = routed.withColumn("leaf", F.explode("leaves"))
    counts = spread.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("members")).filter("members > 1").drop("members")
    tiled = spread.join(counts, key).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    work = tiled.select(*key, "i", "j", "tile", "node", "weight", "vector", "leaves")
    found = materialise(work.groupBy(*key, "i", "j").applyInArrow(_compare(cosine), _TILE_OUT), "found")

    links = found.groupBy("node").agg(F.sum("n_links").alias("others"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = nodes.join(links, "node", "left").join(comp, "node", "left")
    told = told.select("label", "vector", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    key = F.xxhash64("label", "vector").alias("key")
    out = join_unskewed(rows.select("*", key), told.select("*", key), "key", "left", also=("label", "vector"))
    linked = F.col("component").isNotNull() & F.col("vec_id").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op7_projection_forest(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
