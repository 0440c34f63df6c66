"""Neighbourhood measures over blocks with a halo, and resampling between grids.

The grid is cut into cubes; each voxel goes to its own cube and to those it borders, so a cube
has every neighbour of its voxels and is one bounded task: rows are copied 1.2 to 1.4 times,
not once per neighbour.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import finite
from .series import detrend as detrended
from .series import ideal_filter, ranks

BLOCK = 16


def offsets(cluster: int) -> np.ndarray:
    """Centre and neighbours: 7 share a face, 19 a face or an edge, 27 all."""
    reach = {7: 1, 19: 2, 27: 3}
    if cluster not in reach:
        raise ValueError("cluster must be 7, 19 or 27")
    return np.array([o for o in product((-1, 0, 1), repeat=3) if sum(v * v for v in o) <= reach[cluster]])


def by_block(bold: DataFrame, kernel, output: str, subject: list[str], block: int = BLOCK) -> DataFrame:
    """kernel(coordinates, series) -> (kept rows, values); a row for each kept voxel of each block's inside."""
    axis = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / block) for d in (-1, 0, 1)]))
    dealt = bold
    for c in "xyz":
        dealt = dealt.withColumn(f"b{c}", F.explode(axis(c)))
    keys = [*subject, "bx", "by", "bz"]
    kinds = {f.name: f.dataType.simpleString() for f in bold.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in subject], "x int", "y int", "z int", f"{output} double"])

    def run(t: pa.Table) -> pa.Table:
        xyz = np.stack([t[c].to_numpy() for c in "xyz"], 1).astype(np.int64)
        ts = t["ts"].combine_chunks()
        series = ts.flatten().to_numpy(zero_copy_only=False).reshape(len(xyz), -1)
        home = np.array([t[f"b{c}"][0].as_py() for c in "xyz"])
        inside = (xyz // block == home).all(1)
        rows, values = kernel(xyz, series, inside)
        at = t.take(pa.array(rows))
        cols = [at[k] for k in subject] + [pa.array(xyz[rows, k], pa.int32()) for k in range(3)]
        return pa.table(cols + [pa.array(values, pa.float64(), mask=np.isnan(values))], [*subject, "x", "y", "z", output])

    picked = dealt.select(*subject, "x", "y", "z", "bx", "by", "bz", F.col("ts").cast("array<double>").alias("ts"))
    return picked.groupBy(*keys).applyInArrow(run, schema)


def _neighbours(xyz: np.ndarray, centre: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row number of each centre's neighbours, -1 where there is none."""
    low = xyz.min(0) - 1
    size = xyz.max(0) - low + 2
    table = np.full(size.prod(), -1)
    flat = lambda p: ((p[..., 0] - low[0]) * size[1] + p[..., 1] - low[1]) * size[2] + p[..., 2] - low[2]
    table[flat(xyz)] = np.arange(len(xyz))
    return table[flat(xyz[centre][:, None, :] + off[None, :, :])]


def reho(bold: DataFrame, shape: tuple[int, int, int], cluster: int = config.CLUSTER, subject: list[str] | None = None, block: int = BLOCK, detrend: bool = False, band: tuple[float, float, float] | None = None) -> DataFrame:
    """Kendall's W of each masked voxel and its masked neighbours; 0 on the outermost shell of the grid.

    With detrend the series lose their lines first, with a band (tr, low, high) they go through the ideal filter.
    """
    off, top = offsets(cluster), np.array(shape) - 1
    keep = ideal_filter(*band) if band else None

    def kernel(xyz, series, inside):
        if detrend:
            series = detrended(series)
        if keep:
            series = keep(series)["ts"]
        r = np.vstack([ranks(series), np.zeros(series.shape[1])])
        rows = np.flatnonzero(inside)
        near = _neighbours(xyz, rows, off)
        total = np.zeros((len(rows), series.shape[1]))
        for k in range(near.shape[1]):
            total += r[near[:, k]]
        n, t = (near >= 0).sum(1), series.shape[1]
        s = ((total - total.mean(1, keepdims=True)) ** 2).sum(1)
        w = 12 * s / (n**2 * (t**3 - t) + 1e-8)
        border = ((xyz[rows] == 0) | (xyz[rows] == top)).any(1)
        return rows, np.where(border, 0.0, w)

    return by_block(bold, kernel, "reho", subject or [], block)


def segments(t: int, tr: float, low: float) -> tuple[int, int]:
    """Length and step of the windows that the lowest frequency asks for."""
    k = max(math.floor(2 * t / (1 / low / tr)) - 1, 1)
    n = max(math.floor(2 * t / (k + 1)), 2)
    return n, n - math.ceil(n / 2)


def coherence_reho(bold: DataFrame, tr: float = config.TR, low: float = config.LOW, high: float = config.HIGH, subject: list[str] | None = None) -> DataFrame:
    """Mean coherence of all pairs of valid voxels among the 27; null without a pair."""
    off = offsets(27)

    def kernel(xyz, series, inside):
        n, step = segments(series.shape[1], tr, low)
        starts = range(0, series.shape[1] - n + 1, step)
        window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(1, n + 1) / (n + 1)))
        f = np.fft.rfftfreq(n, tr)
        band = (f >= low) & (f <= high)
        cut = np.stack([series[:, s : s + n] for s in starts], 1)
        x = np.fft.rfft((cut - cut.mean(2, keepdims=True)) * window, axis=2)[:, :, band].reshape(len(series), -1)
        valid = np.isfinite(series).all(1) & (series.std(1) > 1e-12)
        rows = np.flatnonzero(inside)
        near = _neighbours(xyz, rows, off)
        near = np.where((near >= 0) & valid[near], near, len(series))
        x = np.vstack([x, np.zeros(x.shape[1])])
        there = np.append(valid, False)
        out = np.full(len(rows), np.nan)
        i, j = np.triu_indices(27, 1)
        for a in range(0, len(rows), 512):
            c = x[near[a : a + 512]]
            cross = np.abs(c @ c.conj().transpose(0, 2, 1)) ** 2
            p = (np.abs(c) ** 2).sum(2)
            coh = (cross / np.maximum(p[:, :, None] * p[:, None, :], 1e-12))[:, i, j]
            ok = (there[near[a : a + 512]][:, i]) & (there[near[a : a + 512]][:, j])
            m = ok.sum(1)
            out[a : a + 512] = np.where(m > 0, (coh * ok).sum(1) / np.maximum(m, 1), np.nan)
        return rows, out

    return by_block(bold, kernel, "coherence_reho", subject or [])


def sample(at: DataFrame, values: DataFrame, keys: list[str], by: list[str], method: str = "trilinear") -> DataFrame:
    """(keys, value) at the positions sx, sy, sz of at, from values (by, x, y, z, value).

    Nearest takes the rounded voxel. Trilinear weighs the eight around it: voxels that are missing
    count as 0, one without a value makes the sample null.
    """
    given = values.select(*by, *[F.col(c).alias(f"g{c}") for c in "xyz"], "value", F.lit(True).alias("there"))
    if method == "nearest":
        near = at.select(*dict.fromkeys([*keys, *by]), *[F.floor(F.col(f"s{c}") + 0.5).cast("int").alias(f"g{c}") for c in "xyz"])
        return near.join(given, [*by, "gx", "gy", "gz"], "left").select(*keys, F.when(F.col("there"), F.col("value")).otherwise(0.0).alias("value"))
    if method != "trilinear":
        raise ValueError(f"unknown method {method!r}")
    corner = F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in product((0, 1), repeat=3)]))
    base = {c: F.floor(f"s{c}") for c in "xyz"}
    part = {c: F.col(f"s{c}") - base[c] for c in "xyz"}
    weight = F.lit(1.0)
    for k, c in enumerate("xyz"):
        weight = weight * F.when(F.get("o", F.lit(k)) == 1, part[c]).otherwise(1 - part[c])
    eight = at.withColumn("o", corner).select(*dict.fromkeys([*keys, *by]), *[(base[c] + F.get("o", F.lit(k))).cast("int").alias(f"g{c}") for k, c in enumerate("xyz")], weight.alias("w")).filter("w > 0")
    hole = F.bool_or(F.coalesce(F.col("there"), F.lit(False)) & F.col("value").isNull())
    total = F.sum(F.col("w") * F.coalesce("value", F.lit(0.0)))
    return eight.join(given, [*by, "gx", "gy", "gz"], "left").groupBy(*keys).agg(F.when(~hole, total).alias("value"))


def _spline_coefficients(grid: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients that interpolate the grid, mirrored at its ends."""
    for axis in range(3):
        n = grid.shape[axis]
        if n == 1:
            continue
        a = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
        a[0, 1] = a[-1, -2] = 2.0
        moved = np.moveaxis(grid, axis, 0)
        grid = np.moveaxis(np.linalg.solve(a / 6, moved.reshape(n, -1)).reshape(moved.shape), 0, axis)
    return grid


def spline(grid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through a grid's values at positions (n x 3); 0 outside the grid."""
    c, size = _spline_coefficients(np.nan_to_num(grid, nan=0.0, posinf=0.0, neginf=0.0)), np.array(grid.shape)
    inside = ((at >= 0) & (at <= size - 1)).all(1)
    base = np.floor(at).astype(int)
    f = at - base
    w = np.stack([(1 - f) ** 3, 3 * f**3 - 6 * f**2 + 4, -3 * f**3 + 3 * f**2 + 3 * f + 1, f**3]) / 6  # 4 x n x 3
    out = np.zeros(len(at))
    for o in product(range(4), repeat=3):
        idx = base + np.array(o) - 1
        period = np.maximum(2 * size - 2, 1)
        idx = np.abs(idx) % period
        idx = np.where(idx >= size, period - idx, idx)
        out += w[o[0], :, 0] * w[o[1], :, 1] * w[o[2], :, 2] * c[idx[:, 0], idx[:, 1], idx[:, 2]]
    return np.where(inside, out, 0.0)


def resample_spline(maps: DataFrame, inverse: list[list[float]], source: tuple[int, int, int], target: tuple[int, int, int], by: list[str]) -> DataFrame:
    """maps (by, x, y, z, value) on the source grid -> the target grid (by, x, y, z, value, in_mask) by a cubic spline.

    Missing voxels are 0. in_mask holds where the nearest source voxel has a usable value and the
    new one is not 0. One map's grid is one bounded task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in maps.schema}
    m = np.array(inverse, float)

    def run(t: pa.Table) -> pa.Table:
        grid = np.zeros(source)
        grid[tuple(t[c].to_numpy() for c in "xyz")] = np.nan_to_num(t["value"].to_numpy(zero_copy_only=False).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
        to = np.stack(np.unravel_index(np.arange(int(np.prod(target))), target), 1)
        at = to @ m[:3, :3].T + m[:3, 3]
        near = np.rint(at).astype(int)
        inside = ((near >= 0) & (near < np.array(source))).all(1)
        held = np.zeros(len(to), bool)
        held[inside] = grid[tuple(near[inside].T)] != 0
        value = spline(grid, at)
        own = [pa.array([t[k][0].as_py()] * len(to), t[k].type) for k in by]
        return pa.table([*own, *[pa.array(to[:, k].astype(np.int32)) for k in range(3)], pa.array(value), pa.array(held & (value != 0))], [*by, "x", "y", "z", "value", "in_mask"])

    return maps.select(*by, "x", "y", "z", "value").groupBy(*by).applyInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "x int, y int, z int, value double, in_mask boolean"]))


def resample(values: DataFrame, inverse: list[list[float]], target: DataFrame, method: str = "trilinear") -> DataFrame:
    """Values (x, y, z, value) on the target grid (x, y, z); inverse maps its indices to source indices.

    Nearest takes the rounded source voxel. Trilinear weighs the eight around it (voxels that are
    missing count as 0): a stand-in for a cubic spline.
    """
    src = [sum((F.lit(float(a)) * F.col(c) for a, c in zip(row[:3], "xyz")), F.lit(float(row[3]))) for row in inverse[:3]]
    at = target.select("x", "y", "z", *[s.alias(f"s{c}") for s, c in zip(src, "xyz")])
    given = values.select("x", "y", "z", F.coalesce(finite(F.col("value")), F.lit(0.0)).alias("value"))
    if method == "nearest":  # halves go to the even voxel
        near = at.select("x", "y", "z", *[F.rint(f"s{c}").cast("int").alias(f"g{c}") for c in "xyz"])
        source = given.select(*[F.col(c).alias(f"g{c}") for c in "xyz"], "value")
        return near.join(source, ["gx", "gy", "gz"], "left").select("x", "y", "z", F.coalesce("value", F.lit(0.0)).alias("value"))
    return sample(at, given, ["x", "y", "z"], [], method)
