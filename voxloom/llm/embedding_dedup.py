"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Trees are fitted on a bounded sample: each node projects on a random direction and splits at
the median; vectors near the split go to both sides. All vectors fall into leaves, are
compared there in double precision, and the links of all trees are united: a pair that meets
in several leaves counts in the one with the smallest number. Equal vectors are one class.
A leaf that stays large is cut into tiles, and each pair of tiles is its own task.

Dense groups of the sample get a ball each, before the trees: its core is the group, and all
vectors within the threshold's angle of the core are compared whole in it. Angles are a metric,
so a core vector meets all its links in its ball and stays out of the trees.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_roots
from .util import Scratch, hashed_sample

THRESHOLD = 0.95
TREES = 8
LEAF = 256
TILE = 1024
SAMPLE = 20_000
#: Share of a node's margin at which a vector goes both ways, in standard deviations of a threshold pair's projected distance.
SPILL = 0.3
#: Sample rows that make a group dense, and the most rows of a ball for each one of its core.
DENSE, BALL = 16, 4
_SEED = 7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balls(sample: np.ndarray, total: int, leaf: int = LEAF, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(centres, angles of the cores) of the sample's dense groups, from the largest on; the groups stand for more than leaf rows."""
    ratio, theta = max(1.0, total / max(1, len(sample))), math.acos(threshold)
    least = max(DENSE, leaf / ratio)
    x = sample.astype(np.float32)
    degree = np.concatenate([(x[a : a + 512] @ x.T >= threshold).sum(1) for a in range(0, len(x), 512)] or [np.zeros(0, int)])
    free, centres, cores = degree >= least, [], []
    while free.any():
        k = int(np.argmax(np.where(free, degree, -1)))
        free[k] = False
        centre = sample[sample @ sample[k] >= threshold].mean(0)
        for _ in range(3):
            centre = centre / np.linalg.norm(centre)
            angle = np.arccos(np.clip(sample @ centre, -1, 1))
            centre = sample[angle <= theta].mean(0) if (angle <= theta).any() else centre
        centre = centre / np.linalg.norm(centre)
        angle = np.arccos(np.clip(sample @ centre, -1, 1))
        group = angle[angle <= theta]
        if not len(group):
            continue
        core = float(np.quantile(group, 0.99)) + 0.05
        inside = (angle <= core).sum()
        if inside >= least and (angle <= core + theta).sum() <= BALL * inside:
            centres.append(centre)
            cores.append(core)
            free &= angle > core
        else:
            free &= angle > theta / 2
    return np.array(centres).reshape(-1, sample.shape[1]), np.array(cores)


def in_balls(found: tuple[np.ndarray, np.ndarray], x: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, ball) of each vector in each ball, and which vectors are in no core."""
    centres, cores = found
    if not len(cores) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(len(x), bool)
    angle = np.arccos(np.clip(x @ centres[:, : x.shape[1]].T, -1, 1))
    row, ball = np.nonzero(angle <= cores + (math.acos(threshold) + 1e-6))
    return row, ball, ~(angle <= cores).any(1)


def grow(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, threshold: float = THRESHOLD, spill: float = SPILL) -> list[list]:
    """Per tree a list of nodes: (direction, split, margin, left, right), or a leaf's number."""
    rng = np.random.Generator(np.random.PCG64(_SEED))
    dim = sample.shape[1]
    margin = spill * math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
    ratio = max(1.0, total / max(1, len(sample)))
    forest, number = [], 0
    for _ in range(trees):
        nodes: list = [None]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            at, own = todo.pop()
            u = rng.standard_normal(dim)
            u /= np.linalg.norm(u)
            p = sample[own] @ u
            split = float(np.median(p)) if len(own) else 0.0
            left, right = own[p <= split + margin], own[p > split - margin]
            if len(own) * ratio <= leaf or len(own) < 16 or max(len(left), len(right)) > 0.85 * len(own):
                nodes[at] = number
                number += 1
                continue
            nodes[at] = (u, split, margin, len(nodes), len(nodes) + 1)
            nodes += [None, None]
            todo += [(len(nodes) - 2, left), (len(nodes) - 1, right)]
        forest.append(nodes)
    return forest


def leaves(forest: list[list], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each vector in each leaf that it falls into."""
    rows, nums = [], []
    for nodes in forest:
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            if isinstance(nodes[at], int):
                rows.append(own)
                nums.append(np.full(len(own), nodes[at]))
                continue
            u, split, margin, a, b = nodes[at]
            p = x[own] @ u[: x.shape[1]]
            todo += [(a, own[p <= split + margin]), (b, own[p > split - margin])]
    return np.concatenate(rows), np.concatenate(nums)


def fit(sample: np.ndarray, total: int, trees: int = TREES, threshold: float = THRESHOLD) -> tuple:
    """(balls, forest, threshold); the forest is grown on what is in no core."""
    found = balls(sample, total, threshold=threshold)
    rest = sample[in_balls(found, sample, threshold)[2]]
    return found, grow(rest, round(total * len(rest) / max(1, len(sample))), trees, threshold=threshold), threshold


def places(model: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each vector in each ball and leaf that it takes part in; the balls come first."""
    found, forest, threshold = model
    row, ball, free = in_balls(found, x, threshold)
    own = np.flatnonzero(free)
    if not len(own):
        return row, ball
    at, leaf = leaves(forest, x[own])
    return np.concatenate([row, own[at]]), np.concatenate([ball, leaf + len(found[1])])


def _vectors(col) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length: (row numbers, vectors as doubles)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = np.diff(col.offsets.to_numpy())
    flat, at = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lens)])
    return [(own := np.flatnonzero(lens == n), flat[at[own][:, None] + np.arange(n)]) for n in np.unique(lens)]


def _count(model_b):
    def run(it):
        for b in it:
            for _, x in _vectors(b.column(0)):
                _, leaf = places(model_b.value, _unit(x))
                num, n = np.unique(leaf, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(num), pa.array(n)], ["leaf", "n"])

    return run


def _deal(model_b, tiles_b):
    """A row for each (leaf, pair of tiles) that a vector takes part in."""

    def run(it):
        for whole in it:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                ids, n = b.column("rep").to_numpy(), b.column("n").to_numpy()
                for own, x in _vectors(b.column("embedding")):
                    row, leaf = places(model_b.value, _unit(x))
                    order = np.argsort(row, kind="stable")
                    edge = np.searchsorted(row[order], np.arange(len(x) + 1))
                    sets = [np.sort(leaf[order[a:z]]).astype("<i8").tobytes() for a, z in zip(edge, edge[1:])]
                    vecs = [v.tobytes() for v in x]
                    many = np.array([tiles_b.value.get(int(k), 1) for k in leaf])
                    tile = ((ids[own[row]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % many
                    rep = np.repeat(np.arange(len(row)), many)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
                    own_tile = tile[rep]
                    r = row[rep]
                    cols = [leaf[rep], np.minimum(own_tile, other), np.maximum(own_tile, other), own_tile, ids[own[r]], n[own[r]]]
                    for z in range(0, len(r), 8192):
                        yield pa.RecordBatch.from_arrays([pa.array(c[z : z + 8192], pa.int64()) for c in cols] + [pa.array([vecs[k] for k in r[z : z + 8192]], pa.binary()), pa.array([sets[k] for k in r[z : z + 8192]], pa.binary())], ["leaf", "t1", "t2", "tile", "rep", "n", "vec", "leaves"])

    return run


def _compare(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        leaf, t1, t2 = (t[c][0].as_py() for c in ("leaf", "t1", "t2"))
        tile, rep, n = (t[c].to_numpy() for c in ("tile", "rep", "n"))
        raw, sets = t["vec"].to_pylist(), t["leaves"].to_pylist()
        dim = np.array([len(v) for v in raw])
        out = []
        for size in np.unique(dim):
            own = np.flatnonzero(dim == size)
            x = _unit(np.stack([np.frombuffer(raw[k], np.float64) for k in own]))
            lists = [np.frombuffer(sets[k], "<i8") for k in own]
            early = [s[s < leaf] for s in lists]
            names, col = np.unique(np.concatenate(early), return_inverse=True)
            member = np.zeros((len(own), len(names)), np.float32)
            member[np.repeat(np.arange(len(own)), [len(e) for e in early]), col] = 1
            left = np.flatnonzero(tile[own] == t1)
            right = left if t1 == t2 else np.flatnonzero(tile[own] == t2)
            count, ii, jj = np.zeros(len(own), np.int64), [], []
            for a in range(0, len(left), 512):
                block = left[a : a + 512]
                hit = (x[block] @ x[right].T >= threshold) & (member[block] @ member[right].T == 0)
                if t1 == t2:
                    hit &= block[:, None] != right[None, :]
                count[block] += hit @ n[own[right]]
                if t1 != t2:
                    count[right] += n[own[block]] @ hit
                i, j = np.nonzero(hit)
                if len(i):
                    root = local_roots(len(own), block[i], right[j])
                    far = np.flatnonzero(root != np.arange(len(own)))
                    ii.append(far)
                    jj.append(root[far])
            if ii:
                root = local_roots(len(own), np.concatenate(ii), np.concatenate(jj))
                some = np.flatnonzero(count)
                out.append(pa.table([pa.array(rep[own[some]]), pa.array(count[some]), pa.array(rep[own[root[some]]])], ["a", "n", "b"]))
        return pa.concat_tables(out) if out else pa.table({"a": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return run


def valid(e="embedding"):
    """No nulls, all finite, not all zero."""
    d = F.col(e).cast("array<double>")
    fine = F.forall(d, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(d, lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False))


def links(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, trees: int = TREES, sample_rows: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """vectors (vec_id, embedding), valid ones -> classes (embedding, low, n, rep) and links (a, n, b) of their numbers rep."""
    sc = vectors.sparkSession.sparkContext
    classes = vectors.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = scratch.table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # no two classes share a number, whatever ids their rows have
    total = classes.count()
    sample = hashed_sample(classes.select("embedding"), sample_rows, total, "embedding").collect()
    dim = max((len(r[0]) for r in sample), default=1)
    x = np.zeros((len(sample), dim))
    for k, r in enumerate(sample):
        x[k, : len(r[0])] = r[0]
    model = sc.broadcast(fit(_unit(x) if len(x) else x, total, trees, threshold))
    each = classes.select(F.col("embedding").cast("array<double>").alias("embedding"), "rep", "n").repartition("rep")
    sizes = each.select("embedding").mapInArrow(_count(model), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    large = {r.leaf: -(-r.n // TILE) for r in sizes.filter(F.col("n") > TILE).collect()}  # at most as many as the model has balls and leaves
    dealt = each.mapInArrow(_deal(model, sc.broadcast(large)), "leaf long, t1 long, t2 long, tile long, rep long, n long, vec binary, leaves binary")
    return classes, dealt.groupBy("leaf", "t1", "t2").applyInArrow(_compare(threshold), "a long, n long, b long")


def op2(spark, vectors: DataFrame) -> DataFrame:
    """One row per vector. Invalid vectors (null, zero, null or non-finite parts, no vec_id) link
    with nothing and are their own component; vectors of different lengths don't link; repeated
    rows are vectors of their own, and so are unlike ones that share a vec_id; an empty table gives no rows."""
    scratch = Scratch(spark, "op2")
    rows = vectors.select("vec_id", "embedding")
    fine = rows.filter(valid())
    classes, found = links(fine, scratch)
    found = scratch.table(found, "links")
    comp = components(found.select("a", "b"), scratch)
    per = found.groupBy("a").agg(F.sum("n").alias("links"))
    of = classes.join(per, classes["rep"] == per["a"], "left").join(comp, classes["rep"] == comp["id"], "left")
    of = scratch.table(of.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "low", F.coalesce("component", "rep").alias("component")), "of")
    lowest = scratch.table(of.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    of = of.join(lowest, "component").drop("low", "component")
    good = fine.join(of, "embedding").select("vec_id", "n_links", "component_id")
    bad = rows.filter(~valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))
