"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With R the largest norm, x' = (x, sqrt(R^2 - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + R^2 - 2 q.x, so a window of
inner products is an annulus around the query and the highest product its nearest point. A vantage-point tree of medians
is made from a bounded sample; all rows are then dealt to its leaves, and each leaf gets, for each vantage point on its
path, the least and largest distance of its own rows, which bound by the triangle inequality how near or far they lie to
any query. A leaf of many rows (equal vectors cannot be parted by distance) is stored as several blocks of bounded size.

A search is a query row: its vector, a window of scores, and whether it wants rows of its own label or of others. Each
query takes the leaves that can meet its annulus nearest first, in rounds of 1, SPREAD, SPREAD^2, ... leaves; after a round
what it has found narrows the annulus, and it is done when no leaf in it is left. A round is one co-grouping of the
visits with the blocks. Results are exact at every size of tree: products are of whole numbers (exact below 2^53), and
bounds are drawn with a margin for rounding.

How many leaves a query visits depends on the data: with vectors that are spread evenly over many dimensions distances
hardly differ and most leaves stay in reach; then the work is that of comparing each query with all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Rows from which the tree is made, rows of a leaf and of a block about, and the most leaves (each has 16 rows of the sample or more).
SAMPLE, LEAF, MOST_LEAVES = 16_384, 4_096, 1_024
#: Anchors whose visits to a block meet in one group, and the growth of rounds.
ANCHORS, SPREAD = 4_096, 16
_SCAN = 1_024


@dataclass
class Tree:
    """Inner nodes in order, the root first: vantage point, radius, and its two children (leaf k is ~k)."""

    dim: int
    norm2: float  # the largest squared norm
    points: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    paths: list[list[int]]  # inner nodes above each leaf

    @property
    def slack(self) -> float:
        return 1e-6 * (1.0 + self.norm2)


def _augmented(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """From each row of x to the point p, or to its own row of p."""
    d = x - p
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def grown(sample: np.ndarray, norm2: float, leaves: int, seed: int = 5) -> Tree:
    """A tree of at most `leaves` leaves (a power of two) over a sample; parts of equal distance stay whole."""
    dim = sample.shape[1]
    x = _augmented(sample, norm2)
    rng = np.random.default_rng(seed)
    points, radius, children, paths = [], [], [], []

    def part(rows: np.ndarray, depth: int, path: list[int]) -> int:
        if depth > 0 and len(rows) >= 2:
            some = rows[rng.integers(0, len(rows), 8)]
            far = [_distances(x[rows], x[i]) for i in some]
            best = int(np.argmax([d.std() for d in far]))
            d = far[best]
            r = float(np.median(d))
            r = r if (d > r).any() else float(np.max(d[d < d.max()], initial=-1.0))
            if r >= 0:
                k = len(points)
                points.append(x[some[best]])
                radius.append(r)
                children.append([0, 0])
                for side, mask in enumerate((d <= r, d > r)):
                    children[k][side] = part(rows[mask], depth - 1, [*path, k])
                return k
        paths.append(path)
        return ~(len(paths) - 1)

    part(np.arange(len(x)), int(math.log2(max(leaves, 1))), [])
    return Tree(dim, norm2, np.array(points).reshape(-1, dim + 1), np.array(radius), np.array(children, np.int64).reshape(-1, 2), paths)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    y, at = _augmented(x, tree.norm2), np.zeros(len(x), np.int64)
    if not len(tree.points):
        return at
    while (rows := np.flatnonzero(at >= 0)).size:
        node = at[rows]
        outside = _distances(y[rows], tree.points[node]) > tree.radius[node]
        at[rows] = tree.children[node, outside.astype(np.int64)]
    return ~at


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of vectors kept as bytes."""
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


@dataclass
class Bounds:
    tree: Tree
    low: np.ndarray  # leaf x node: least distance of its rows, 0 where the node is not above the leaf
    high: np.ndarray
    first: np.ndarray  # number of a leaf's first block; one more at the end


@dataclass
class Index:
    bounds: Bounds
    rows: DataFrame  # id, label, v (bytes of doubles), leaf, block


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, x): rows that take part, their components floor(scale * x) as doubles. One row of each id, the one of the least
    label and vector; vectors of the most usual length, of equally usual ones the longest."""
    v, far = F.col(vec_col), F.lit(float("inf"))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < far), F.lit(False)))
    own = df.where(good).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda c: F.floor(scale * c.cast("double")).cast("double")).alias("x"))
    usual = own.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return own
    own = own.where(F.size("x") == usual["n"])
    again = written(own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if again.isEmpty():
        return own
    one = own.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "x")).alias("m")).select("id", "m.label", "m.x")
    return own.join(again, "id", "left_anti").unionByName(one)


def indexed(vectors: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> Index | None:
    """The tree and all rows of vectors(id, label, x), dealt to its leaves; None without any."""
    spark = vectors.sparkSession
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    n, norm2, dim = vectors.agg(F.count("*"), F.max(norm), F.max(F.size("x"))).first()
    if not n:
        return None
    some = vectors.orderBy(F.xxhash64(F.lit("vantage"), "id"), "id").select("x").limit(sample)
    drawn = np.array([r["x"] for r in some.collect()], np.float64).reshape(-1, dim)  # `sample` rows at most
    leaves = min(MOST_LEAVES, 1 << max(0, math.ceil(math.log2(n / leaf))), 1 << max(0, int(math.log2(max(1, len(drawn) // 16)))))
    tree = grown(drawn, norm2, leaves)
    shared = spark.sparkContext.broadcast(tree)
    kinds = dict(vectors.dtypes)

    def deal(batches):
        for b in batches:
            for part in (b.slice(k, _SCAN) for k in range(0, b.num_rows, _SCAN)):
                if part.num_rows:
                    x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(leaf_of(shared.value, x), pa.int64())], ["id", "label", "v", "leaf"])

    rows = written(vectors.select("id", "label", "x").mapInArrow(deal, f"id {kinds['id']}, label {kinds['label']}, v binary, leaf long"), "leaves")
    count = np.zeros(len(tree.paths), np.int64)
    for r in rows.groupBy("leaf").count().collect():  # MOST_LEAVES rows at most
        count[r["leaf"]] = r["count"]
    blocks = np.maximum(1, -(-count // leaf))
    first = np.concatenate([[0], np.cumsum(blocks)])
    nodes = max(1, len(tree.points))

    def ranges(batches):
        low, high = np.full((len(tree.paths), nodes), np.inf), np.full((len(tree.paths), nodes), -np.inf)
        t = shared.value
        for b in batches:
            x, own = _matrix(b.column(1).to_pylist(), t.dim), b.column(0).to_numpy(zero_copy_only=False)
            y = _augmented(x, t.norm2)
            for k in np.unique(own):
                mine = y[own == k]
                for node in t.paths[k]:
                    d = _distances(mine, t.points[node])
                    low[k, node], high[k, node] = min(low[k, node], d.min()), max(high[k, node], d.max())
        k, node = np.nonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(node), pa.array(low[k, node]), pa.array(high[k, node])], ["leaf", "node", "low", "high"])

    bounds = rows.select("leaf", "v").mapInArrow(ranges, "leaf long, node long, low double, high double").groupBy("leaf", "node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.zeros((len(tree.paths), nodes)), np.full((len(tree.paths), nodes), np.inf)
    for r in bounds.collect():  # leaves x depth
        low[r["leaf"], r["node"]], high[r["leaf"], r["node"]] = r["low"], r["high"]
    sizes = F.element_at(F.array(*[F.lit(int(x)) for x in blocks]), (F.col("leaf") + 1).cast("int")) if len(blocks) <= 64 else None
    if sizes is None:
        table = spark.createDataFrame([(k, int(x), int(first[k])) for k, x in enumerate(blocks)], "leaf long, _n long, _first long")
        rows = rows.join(F.broadcast(table), "leaf")
    else:
        rows = rows.withColumn("_n", sizes).withColumn("_first", F.element_at(F.array(*[F.lit(int(x)) for x in first[:-1]]), (F.col("leaf") + 1).cast("int")))
    rows = rows.withColumn("block", F.col("_first") + F.pmod(F.xxhash64(F.lit("block"), "id"), "_n")).drop("_n", "_first")
    return Index(Bounds(tree, low, high, first), rows)


def reach(b: Bounds, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that any row of each leaf can have with each query (query x leaf)."""
    t = b.tree
    q2 = (q * q).sum(axis=1)
    near, far = np.zeros((len(q), len(t.paths))), np.full((len(q), len(t.paths)), np.inf)
    if len(t.points):
        d = np.stack([_distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), p) for p in t.points], axis=1)
        for k, path in enumerate(t.paths):
            own = d[:, path]
            near[:, k] = np.maximum(0.0, np.maximum(own - b.high[k, path], b.low[k, path] - own)).max(axis=1, initial=0.0)
            far[:, k] = (own + b.high[k, path]).min(axis=1, initial=np.inf)
    whole = (q2 + t.norm2)[:, None]
    return (whole - far * far) / 2 - t.slack, (whole - near * near) / 2 + t.slack


def _visits(shared: Broadcast, after: int, until: int, parts: int):
    """The blocks of the leaves that a query takes as its places `after` to `until` of those in reach, nearest first."""

    def run(batches):
        index = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            worst, best = reach(index, _matrix(pdf["v"], index.tree.dim))
            lo, hi = pdf["lo"].to_numpy(float), pdf["hi"].to_numpy(float)
            need = np.maximum(lo, pdf["bound"].to_numpy(float))
            meets = (best >= lo[:, None]) & (worst <= hi[:, None])
            order = np.argsort(np.where(meets, -np.minimum(best, hi[:, None]), np.inf), axis=1, kind="stable")[:, after:until]
            ok = np.take_along_axis(meets & (best >= need[:, None]), order, axis=1)
            row, at = np.nonzero(ok)
            leaf = order[row, at]
            n = index.first[leaf + 1] - index.first[leaf]
            out = pdf.iloc[np.repeat(row, n)].drop(columns=["bound"])
            start = np.repeat(np.cumsum(n) - n, n)
            yield out.assign(block=np.repeat(index.first[leaf], n) + np.arange(n.sum()) - start, part=pd.util.hash_array(out["anchor"].to_numpy()).astype(np.int64) % parts)

    return run


def _scan(dim: int):
    """The k best rows of a block for each query that visits it."""

    def run(visits: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor": visits["anchor"][:0], "slot": visits["slot"][:0], "id": rows["id"][:0], "score": np.zeros(0, np.int64)})
        if visits.empty or rows.empty:
            return none
        ids, order = rows["id"].to_numpy(), np.argsort(rows["id"].to_numpy(), kind="stable")
        ids, labels, x = ids[order], rows["label"].to_numpy()[order], _matrix(rows["v"], dim)[order]
        visits = visits.sort_values("anchor", kind="stable")
        out = []
        for k in range(0, len(visits), 256):
            own = visits.iloc[k : k + 256]
            scores = _matrix(own["v"], dim) @ x.T
            same = own["label"].to_numpy()[:, None] == labels[None, :]
            fits = (same == own["same"].to_numpy(bool)[:, None]) & (ids[None, :] != own["anchor"].to_numpy()[:, None])
            fits &= (scores >= own["lo"].to_numpy(float)[:, None]) & (scores <= own["hi"].to_numpy(float)[:, None])
            value = np.where(fits, scores, -np.inf)
            most = int(own["k"].max())
            for i, (anchor, slot, n) in enumerate(zip(own["anchor"], own["slot"], own["k"], strict=True)):
                line = value[i]
                if len(line) > most:  # all ties of the last place stay for the sort
                    at = np.flatnonzero(line >= max(np.partition(line, len(line) - n)[len(line) - n], -1e300))
                else:
                    at = np.flatnonzero(line > -np.inf)
                at = at[np.lexsort((ids[at], -line[at]))][:n]
                out.append((np.full(len(at), anchor), np.full(len(at), slot), ids[at], line[at].astype(np.int64)))
        if not out:
            return none
        return pd.DataFrame(dict(zip(("anchor", "slot", "id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def search(index: Index, queries: DataFrame, anchors: int) -> DataFrame:
    """The best rows of each of queries(anchor, slot, label, v, same, lo, hi, k): (anchor, slot, id, score, place), by falling
    score and, of equal scores, rising id; fewer than k where no more lie in the window."""
    parts = max(1, -(-anchors // ANCHORS))
    leaves = len(index.bounds.tree.paths)
    shared = queries.sparkSession.sparkContext.broadcast(index.bounds)
    kinds = dict(queries.dtypes)
    key = kinds["anchor"]
    shape = ", ".join(f"{c} {kinds[c]}" for c in ("anchor", "slot", "label", "v", "same", "lo", "hi", "k"))
    best, after, width = None, 0, 1
    while after < leaves:
        asked = queries.select("anchor", "slot", "label", "v", "same", "lo", "hi", "k")
        if best is None:
            asked = asked.withColumn("bound", F.lit(float("-inf")))
        else:
            full = best.groupBy("anchor", "slot").agg(F.count("*").alias("_n"), F.min("score").cast("double").alias("_least"))
            asked = asked.join(full, ["anchor", "slot"], "left").withColumn("bound", F.coalesce(F.when(F.col("_n") >= F.col("k"), F.col("_least")), F.lit(float("-inf")))).drop("_n", "_least")
        visits = asked.mapInPandas(_visits(shared, after, after + width, parts), f"{shape}, block long, part long")
        dealt = index.rows.select("block", "id", "label", "v").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))) if parts > 1 else index.rows.select("block", "id", "label", "v", F.lit(0).cast("long").alias("part"))
        hits = visits.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInPandas(_scan(index.bounds.tree.dim), f"anchor {key}, slot int, id {key}, score long")
        hits = hits.join(queries.select("anchor", "slot", "k"), ["anchor", "slot"])
        hits = hits if best is None else hits.unionByName(best.select(*hits.columns))
        w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
        best = written(hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("k")), "best")
        after, width = after + width, width * SPREAD
    return best.select("anchor", "slot", "id", "score", "place")


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, k: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """For each anchor (rows with is_anchor, a condition on `id`) and each of its `positives` best rows of the same label, the k
    best rows of another label whose score is between low and high hundredths of the positive's:
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of whole numbers, floor(scale * x); higher ones come first, of equal ones the smaller id. Rows
    with a null id or label, or a null, empty or not wholly finite vector, take no part, nor do vectors of another length than
    most; of repeated ids the row of the least label and vector counts once. Other columns are ignored; an empty table, and
    anchors without positives or without negatives in the window, give no rows. A negative or zero positive score has no or
    only zero scores in its window.
    """
    spark = vectors.sparkSession
    own = clean_vectors(vectors, id_col, vec_col, label_col, scale)
    index = indexed(own, sample, leaf)
    key = dict(own.dtypes)["id"]
    if index is None:
        return spark.createDataFrame([], f"anchor_id {key}, positive_id {key}, rank int, negative_id {key}, positive_score long, negative_score long")
    anchors = index.rows.where(is_anchor).select(F.col("id").alias("anchor"), "label", "v")
    anchors = written(anchors, "anchors")
    n = anchors.count()
    every = anchors.select("anchor", F.lit(0).alias("slot"), "label", "v", F.lit(True).alias("same"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(positives).alias("k"))
    near = search(index, every, n).select("anchor", F.col("place").cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    windows = near.where(p >= 0).withColumn("lo", F.ceil(low * p / 100).cast("double")).withColumn("hi", F.floor(high * p / 100).cast("double")).where("lo <= hi")
    asked = windows.join(anchors, "anchor").select("anchor", "slot", "label", "v", F.lit(False).alias("same"), "lo", "hi", F.lit(k).alias("k"))
    found = search(index, written(asked, "windows"), n)
    return found.join(near, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
