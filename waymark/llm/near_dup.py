"""MinHash near-deduplication with an LSH forest.

1. Every text becomes its set of distinct k-word shingles, a 128-bit fingerprint of that set and a MinHash signature.
   Texts of equal sets form one class, so exact copies cost one grouped minimum however many there are.
2. Forest: each tree holds the classes in the order of one permutation of the signature. Classes whose longest common
   prefix reaches the tree's depth form a region; within a region signatures are compared in sorted order, nearest
   neighbours first, and a pair already connected is not compared again. A region beyond `region_rows` is not cut:
   its classes go to the next level, of deeper prefixes and more trees (adaptive depth). On the deepest level neighbours
   of such a region are compared in sorted order, and then the region is dealt out as pairs of blocks, each pair a task of
   its own, so that all pairs meet that candidates do not connect already; step 3 verifies the others anyway.
3. Candidate pairs are verified exactly, by a join with both full sets; components of links are the result. A pair that
   fails between two components leaves a doubt, as the forest skips pairs that candidates connect: the classes of such a
   cluster meet in pairs of blocks of bounded size, where pairs of different components and alike signatures are verified.

Every tree has slots of its own, and those of the deeper levels are drawn for the classes that get there, so level l misses
a pair of similarity s with probability (1 - s**depth)**trees: 6e-9, 6e-9 and 3e-10 at s = 0.85, 6e-7, 5e-6 and 1e-5 at 0.8.
Comparing signatures misses 1e-9 at most. The sum of all bounds the whole, as a crowded pair goes through several levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, dealt_join
from ..scratch import written
from .textvec import BYTE_VALUE_LOWER, NONSPACE, _splitmix_stream, chunks, hash_ranges, mix, reduce_rows, row_bounds, runs, shingles, sort_rows

SIGNATURE = 64
_FACTORS = (_splitmix_stream(0x515, SIGNATURE) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: (depth, trees) of each level of the forest.
LEVELS = ((3, 20), (6, 40), (10, 100))
#: The share of pairs of the threshold's similarity that comparing signatures may miss.
MISSED = 1e-9


def _factors(level: int) -> np.ndarray:
    """The hash factors of a level's slots: the signature's for the first, depth x trees new ones for each deeper level."""
    if level == 0:
        return _FACTORS
    depth, trees = LEVELS[level]
    return (_splitmix_stream(0x9D2C0000515 * level, depth * trees) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    offs = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(rows)])


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, width), dtype)
    _, _, data = column.buffers()
    size = width * np.dtype(dtype).itemsize
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[start : start + len(column) * size].view(dtype).reshape(-1, width)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and their bounds."""
    s, e = runs(NONSPACE[data], offs)
    return sort_rows(*shingles(hash_ranges(data, s, e, BYTE_VALUE_LOWER), row_bounds(s, offs), k))


def _fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, 2), dtype=np.uint64)
    out[:, 0] = reduce_rows(np.add, values, bounds, 0)
    out[:, 1] = reduce_rows(np.add, mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), bounds, 0)
    return out


def _signatures(values: np.ndarray, bounds: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    full = bounds[:-1] < bounds[1:]
    out = np.zeros((len(bounds) - 1, len(factors)), dtype=np.uint16)
    if full.any():
        x, at, buf = (values >> np.uint64(32)).astype(np.uint32), bounds[:-1][full], np.empty(len(values), np.uint32)
        cols = np.empty((int(full.sum()), len(factors)), np.uint16)
        for j, a in enumerate(factors):
            np.multiply(x, a, out=buf)
            cols[:, j] = (mix(np.minimum.reduceat(buf, at).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        out[full] = cols
    return out


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(2)):
                v, vb = shingle_sets(data, offs, k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], pa.array(np.diff(vb)), _binary(_fingerprints(v, vb)), _binary(_signatures(v, vb))],
                    ["id", "tie", "n", "fp", "sig"],
                )

    return run


def _widen(level: int, k: int):
    """The classes whose text has the wanted set, with the slots of a deeper level."""
    factors = _factors(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(0), 1 << 18):
                v, vb = shingle_sets(data, offs, k)
                same = pa.array((_fingerprints(v, vb) == _matrix(b.column(1)[i:j], np.uint64, 2)).all(axis=1))
                own = pa.RecordBatch.from_arrays([*[b.column(c)[i:j] for c in (1, 2, 3)], _binary(_signatures(v, vb, factors))], ["fp", "n", "sig", "slots"])
                yield own.filter(same)

    return run


def _plant(level: int, regions_only: bool = False):
    """Each class once for each tree: the region, of the tree's own slots, and its signature in the tree's order."""
    depth, trees = LEVELS[level]
    width = len(_factors(level))
    rng = np.random.default_rng(level)
    orders = [np.roll(np.arange(SIGNATURE), -depth * t) for t in range(trees)] if level == 0 else [rng.permutation(SIGNATURE) for _ in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                sig = _matrix(b.column(2), np.uint16, SIGNATURE)
                slots = _matrix(b.column(3), np.uint16, width) if level else sig
                for t, order in enumerate(orders):
                    key = np.full(len(sig), t + 1, dtype=np.uint64)
                    for d in range(depth):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, (depth * t + d) % width].astype(np.uint64))
                    region = pa.array(key.view(np.int64))
                    if regions_only:
                        yield pa.RecordBatch.from_arrays([region], ["region"])
                    else:
                        yield pa.RecordBatch.from_arrays([region, b.column(0), b.column(1), _binary(sig[:, order])], ["region", "fp", "n", "sig"])

    return run


def _settle(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merges the labels of u and v in place; a label is the smallest index of its component."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _alike(threshold: float) -> int:
    """The most equal slots that a pair of the threshold's similarity falls short of with probability MISSED at most."""
    least, below = 0, 0.0
    while least < SIGNATURE:
        below += math.comb(SIGNATURE, least) * threshold**least * (1 - threshold) ** (SIGNATURE - least)
        if below > MISSED:
            break
        least += 1
    return least


_EDGES = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _stars(threshold: float):
    """Star edges between rows of equal keys and alike signatures, nearest rows first; a pair already connected is not compared."""
    alike = _alike(threshold)

    def edges(t: pa.Table, key: np.ndarray) -> pa.RecordBatch | None:
        lone = np.ones(len(key), bool)
        lone[1:] &= key[1:] != key[:-1]
        lone[:-1] &= key[1:] != key[:-1]
        if lone.all():
            return None
        t, key = t.filter(pa.array(~lone)), key[~lone]
        sig, size = _matrix(t["sig"], np.uint16, SIGNATURE), t["n"].to_numpy().astype(np.float64)
        label, lag = np.arange(len(key)), 1
        live = np.flatnonzero(key[:-1] == key[1:])
        while len(live):
            pair = live[label[live] != label[live + lag]]
            a, b = size[pair], size[pair + lag]
            pair = pair[np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9]
            for p in np.array_split(pair, max(1, len(pair) // 50_000)):
                hit = p[(sig[p] == sig[p + lag]).sum(axis=1) >= alike]
                if len(hit):
                    _settle(label, hit, hit + lag)
            lag += 1
            live = live[live + lag < len(key)]
            live = live[key[live] == key[live + lag]]
        own = np.flatnonzero(label != np.arange(len(key)))
        fp = t["fp"].combine_chunks()
        return pa.RecordBatch.from_arrays([fp.take(pa.array(own)), fp.take(pa.array(label[own]))], schema=_EDGES) if len(own) else None

    return edges


def _grow(threshold: float):
    """Star edges within regions, all of bounded size; the input is sorted by region and signature."""
    edges = _stars(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            reg = t["region"].to_numpy()
            tail = int(np.searchsorted(reg, reg[-1]))
            if (r := edges(t.slice(0, tail), reg[:tail])) is not None:
                yield r
            held = t.slice(tail)
        if held is not None and (r := edges(held, held["region"].to_numpy())) is not None:
            yield r

    return run


def _neighbours(threshold: float, window: int):
    """Star edges between neighbours in sorted order, in windows that overlap; they leave fewer pairs to `_cross`."""
    edges = _stars(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, reg = pa.Table.from_batches([b]), b.column(0).to_numpy()
            for shift in (0, window // 2):
                block = mix(((np.arange(len(reg)) + shift) // window).astype(np.uint64)).view(np.int64)
                if (r := edges(t, reg ^ block)) is not None:
                    yield r

    return run


def _cross(threshold: float, num: int | None = None, den: int = 100):
    """Star edges between the two blocks of each key, or within its only one; the input is sorted by key, side and root.

    Rows of one root are connected already. With `num`, pairs of alike signatures are linked only where their full sets
    (the last column) have den * |intersection| >= num * |union|.
    """
    alike = _alike(threshold)

    def edges(t: pa.Table) -> pa.RecordBatch | None:
        n, sig = t["n"].to_numpy().astype(np.int64), _matrix(t["sig"], np.uint16, SIGNATURE)
        code = t["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        _, first, at = np.unique(code, return_index=True, return_inverse=True)
        if len(first) < 2:
            return None
        if num is not None:
            lists = t["shingles"].combine_chunks()
            flat, cuts = lists.flatten().to_numpy(), np.r_[0, np.cumsum(n)]
            sets = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        was = first[at]
        label, side = was.copy(), t["side"].to_numpy()
        one, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for k, i in enumerate(one):
            rest = other if len(other) else one[k + 1 :]
            rest = rest[(label[rest] != label[i]) & (np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i]) - 1e-9)]
            hit = rest[(sig[rest] == sig[i]).sum(axis=1) >= alike]
            if len(hit) and num is not None:
                both = np.concatenate([_common(sets[i], [sets[j] for j in part]) for part in np.array_split(hit, max(1, int(n[hit].sum()) // 1_000_000))])
                hit = hit[den * both >= num * (n[i] + n[hit] - both)]
            if len(hit):
                _settle(label, np.full(len(hit), i), hit)
        own = np.flatnonzero(label != was)
        fp = t["fp"].combine_chunks()
        return pa.RecordBatch.from_arrays([fp.take(pa.array(own)), fp.take(pa.array(label[own]))], ["u", "v"]) if len(own) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            key = b.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else np.zeros(0, np.int64)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and held[-1].column(0)[0] != b.column(0)[i]:
                    if (r := edges(pa.Table.from_batches(held))) is not None:
                        yield r
                    held = []
                held.append(b.slice(i, j - i))
        if held and (r := edges(pa.Table.from_batches(held))) is not None:
            yield r

    return run


def _common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a set with each of others, none of which is empty."""
    flat = np.concatenate(others)
    own = np.sort(own)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    size = np.array([len(x) for x in others])
    return np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size) - size)


def _dealt(rooted: DataFrame, group: str, block_rows: int, block_values: int) -> DataFrame:
    """(key, side, root, fp, n, ...) of the rows of each group, dealt out in blocks so that rows of different roots meet.

    The largest root of a group has blocks of its own, which meet those of all others but not each other.
    """
    blocks = lambda rows, values: F.greatest(F.ceil(rows * 2 / block_rows), F.ceil(values * 2 / block_values)).cast("int")
    per = rooted.groupBy(group, "root").agg(F.count("*").alias("rows"), F.sum("n").alias("values"))
    top = per.groupBy(group).agg(F.max(F.struct("rows", "values", "root")).alias("big"), F.sum("rows").alias("rows"), F.sum("values").alias("values"), F.count("*").alias("roots"))
    rest = blocks(F.col("rows") - F.col("big.rows"), F.col("values") - F.col("big.values"))
    plan = written(top.where("roots > 1").select(group, F.col("big.root").alias("largest"), rest.alias("rest"), blocks(F.col("big.rows"), F.col("big.values")).alias("most")), "blocks")
    dealt = rooted.join(F.broadcast(plan), group) if _small(plan) else dealt_join(rooted, group, "fp", plan)
    big = F.col("root") == F.col("largest")
    dealt = dealt.withColumn("own", F.when(big, F.col("rest") + F.pmod(F.hash("fp"), "most")).otherwise(F.pmod(F.hash("fp"), "rest")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") + F.when(big, 0).otherwise(F.col("most")) - 1)))
    key = F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    extra = [c for c in rooted.columns if c not in (group, "root", "fp", "n")]
    keyed = dealt.select(key.alias("key"), (F.col("own") > F.col("other")).cast("int").alias("side"), "root", "fp", "n", *extra)
    return keyed.repartition("key").sortWithinPartitions("key", "side", "root", "fp")


def _crowded(marks: DataFrame, found: DataFrame, classes: DataFrame, threshold: float, region_rows: int) -> DataFrame:
    """(u, v) of the regions in marks(region, fp) whose classes the edges `found` do not connect."""
    roots = connected_components(found, "crowd")
    rooted = marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("region", "fp", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted.join(classes.select("fp", "n", "sig"), "fp"), "crowded")
    return written(_dealt(rooted, "region", max(2, region_rows // 4), 1 << 60).mapInArrow(_cross(threshold), "u binary, v binary"), "crossed")


def candidate_edges(classes: DataFrame, threshold: float, region_rows: int, widened=None) -> DataFrame:
    """(u, v) fingerprints of classes that the forest holds for possibly similar.

    widened(fps, level) gives the classes of fps(fp) as (fp, n, sig, slots); only a forest of one level needs none. Regions
    are counted first, so that no task gets the rows of a crowded one.
    """
    found, level = None, 0
    todo = classes.select("fp", "n", "sig")
    while True:
        planted = todo.mapInArrow(_plant(level), "region long, fp binary, n long, sig binary")
        sizes = todo.mapInArrow(_plant(level, True), "region long").groupBy("region").count()
        over = written(sizes.where(F.col("count") > region_rows).select("region"), "over")
        crowded, free = None, planted
        if not over.isEmpty():
            label = over.withColumn("over", F.lit(True))
            both = planted.join(F.broadcast(label), "region", "left") if _small(over) else dealt_join(planted, "region", "fp", label, "left")
            crowded, free = written(both.where("over").drop("over"), "crowded"), both.where("over IS NULL").drop("over")
        grown = free.repartition("region").sortWithinPartitions("region", "sig", "fp").mapInArrow(_grow(threshold), "u binary, v binary")
        edges = written(grown, "forest")
        found = edges if found is None else found.unionByName(edges)
        if crowded is None:
            return found
        if level == len(LEVELS) - 1:
            ordered = crowded.repartitionByRange("region", "sig", "fp").sortWithinPartitions("region", "sig", "fp")
            found = found.unionByName(written(ordered.mapInArrow(_neighbours(threshold, min(region_rows, 512)), "u binary, v binary"), "neighbours"))
            return found.unionByName(_crowded(crowded.select("region", "fp"), found, classes, threshold, region_rows))
        level += 1
        todo = widened(crowded.select("fp").distinct(), level)


def _sets(k: int):
    """(fp, shingles) of (text, fp) whose set is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(0)):
                v, vb = shingle_sets(data, offs, k)
                values = pa.ListArray.from_arrays(pa.array(vb.astype(np.int32)), pa.array(v.view(np.int64)))
                same = (_fingerprints(v, vb) == _matrix(b.column(1)[i:j], np.uint64, 2)).all(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(1)[i:j], values], ["fp", "shingles"]).filter(pa.array(same))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v, linked) of pairs(u, v), by a join with both full sets; a v of very many pairs is dealt out over several keys."""
    hubs = pairs.groupBy("v").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("salts")).where("salts > 1")
    hubs = F.broadcast(hubs) if _small(hubs) else hubs
    salts = F.coalesce("salts", F.lit(1))
    one = pairs.join(hubs, "v", "left").select("u", "v", F.pmod(F.hash("u"), salts).alias("salt")).join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("x")), "u")
    two = sets.select(F.col("fp").alias("v"), F.col("shingles").alias("y")).join(pairs.select("v").distinct(), "v", "left_semi").join(hubs, "v", "left")
    two = two.select("v", "y", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    both = F.size(F.array_intersect("x", "y"))
    return written(one.join(two, ["v", "salt"]).select("u", "v", (den * both >= num * (F.size("x") + F.size("y") - both)).alias("linked")), "verified")


def exact_links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int, region_rows: int, cluster_values: int) -> DataFrame:
    """(u, v) links whose components are those of all links between classes that the candidate pairs(u, v) connect.

    Pairs are verified on full sets. One that fails between classes which no other links join leaves its cluster in doubt:
    a pair that the forest skipped as connected may be linked. The classes of such clusters meet in blocks, where pairs of
    different components and alike signatures are verified too.
    """
    seen = _verified(pairs, sets, num, den)
    links = seen.where("linked").select("u", "v")
    roots = connected_components(links, "exact")
    name = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    failed = dealt_join(seen.where("NOT linked").join(name("u"), "u", "left"), "v", "u", name("v"), "left")
    failed = failed.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).where("u <> v").distinct()
    failed = written(failed, "failed")
    if failed.isEmpty():
        return links
    doubt = connected_components(failed, "doubt").select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    ends = pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct()
    members = ends.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    members = dealt_join(members, "root", "fp", doubt).join(classes.select("fp", "n", "sig"), "fp").join(sets, "fp")
    members = written(members.select("cluster", "root", "fp", "n", "sig", "shingles"), "doubtful")
    more = written(_dealt(members, "cluster", max(2, region_rows // 4), cluster_values).mapInArrow(_cross(num / den, num, den), "u binary, v binary"), "links")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 80, den: int = 100,
                    region_rows: int = 2048, cluster_values: int = 4_000_000) -> DataFrame:
    """One row for each row of docs: (id_col, n_shingles, component_id, kept).

    Documents are linked where den * |intersection| >= num * |union| of their shingle sets (0.8 by default, with five words);
    component_id is the smallest id that a document reaches, kept says whether it is that document. Words are runs of
    non-white-space, A-Z lower-cased; a text of fewer words is one shingle; a null text or one without words has an empty
    set, links to nothing and is kept. Rows of equal id and text get equal rows; null ids join components but never name
    one, and a component of null ids only has a null name and is kept. Other columns are ignored. An empty table gives none.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    signed = written(own.mapInArrow(_sign(shingle_words), f"id {id_type}, tie long, n long, fp binary, sig binary"), "signatures")
    classes = signed.where("n > 0").groupBy("fp").agg(
        F.min("id").alias("low"), F.min(F.struct("id", "tie")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    classes = written(classes, "classes")

    def texts_of(fps: DataFrame) -> DataFrame:
        """(text, fp): one text of each class of fps(fp), null ids included; repeated rows are folded before the shuffle."""
        wanted = written(classes.join(fps, "fp", "left_semi").select(F.col("at.id").alias("_id"), F.col("at.tie").alias("_tie"), "fp"), "wanted")
        on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
        return own.join(F.broadcast(wanted) if _small(wanted) else wanted, on).groupBy("fp").agg(F.first("text").alias("text")).select("text", "fp")

    def widened(fps: DataFrame, level: int) -> DataFrame:
        texts = texts_of(fps).join(classes.select("fp", F.col("n").alias("size"), "sig"), "fp").select("text", "fp", "size", "sig")
        return written(texts.mapInArrow(_widen(level, shingle_words), "fp binary, n long, sig binary, slots binary"), "widened")

    pairs = written(candidate_edges(classes, num / den, region_rows, widened).distinct(), "candidates")
    ends = pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct()
    sets = written(texts_of(ends).mapInArrow(_sets(shingle_words), "fp binary, shingles array<long>"), "sets")
    joined = connected_components(exact_links(pairs, classes, sets, num, den, region_rows, cluster_values), "linked")
    named = joined.join(classes.select(F.col("fp").alias("node"), "low"), "node")
    named = dealt_join(named, "root", "node", named.groupBy("root").agg(F.min("low").alias("name"))).select(F.col("node").alias("fp"), "name")
    labels = classes.select("fp", "low").join(written(named, "named"), "fp", "left")
    rows = signed.select("id", "n", "fp", F.xxhash64("id", "tie").alias("row"))
    out = dealt_join(rows, "fp", "row", labels, "left")
    name = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("name", "low"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), name.alias("component_id"), F.col("id").eqNullSafe(name).alias("kept"))


#: Pairs of one class beyond which its set is sent to several tasks.
HUB_PAIRS = 1000
#: Rows of about 60 bytes that may be sent to every executor.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without all but one document of each group of near duplicates, its columns as they were.

    The document of the smallest id stays (null first), of equal ids with different texts the one of the smaller hash, of
    equal rows one. Texts without words are in no group and all stay.
    """
    hashed = F.xxhash64(text_col)
    own = docs.select(F.struct(F.col(id_col).alias("id"), hashed.alias("of")).alias("k"), F.col(text_col).alias("t"))
    found = near_duplicates(own, "k", "t", **how).where("kept")
    stay = found.groupBy(F.col("k.id").alias("__wm_id"), F.col("k.of").alias("__wm_of")).agg(F.count_if(F.col("n_shingles") > 0).alias("__wm_rows"))
    stay = written(stay, "stay")
    keyed = docs.withColumn("__wm_key", hashed)
    on = F.col(f"`{id_col}`").eqNullSafe(F.col("__wm_id")) & (F.col("__wm_key") == F.col("__wm_of"))
    lone = keyed.join(stay.where("__wm_rows <= 1"), on, "left_semi")
    again = stay.where("__wm_rows > 1")
    if not again.isEmpty():
        lone = lone.unionByName(keyed.join(again, on, "left_semi").dropDuplicates([id_col, "__wm_key"]))
    return lone.select(*[F.col(f"`{c}`") for c in docs.columns])
