"""Structural connectivity from streamlines in millimetres.

Points are taken to the atlas's voxels by the inverse of its affine; the two ends of a streamline
get labels from the nearest voxel, every point an FA sample from the nearest one or, trilinearly,
from the eight around it. Both are equi-joins on voxels, so any number of subjects goes through
one plan; subject keys stand in front of the voxel keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import connect as N
from . import spatial as P


def in_voxels(points: DataFrame, affine: list[list[float]]) -> DataFrame:
    """Adds sx, sy, sz: voxel coordinates of px, py, pz under a voxel-to-world affine."""
    inverse = np.linalg.inv(np.array(affine, float))
    mm = [F.col(c) for c in ("px", "py", "pz")]
    return points.withColumns({f"s{c}": sum((F.lit(float(a)) * m for a, m in zip(row[:3], mm)), F.lit(float(row[3]))) for c, row in zip("xyz", inverse)})


def end_labels(points: DataFrame, atlas: DataFrame, by: list[str], atlas_by: list[str] | None = None) -> DataFrame:
    """(by, sl, a, b): labels of the nearest voxels of the first and last point; 0 outside the atlas. Labels are rounded."""
    place = F.struct("ord", *[F.floor(F.col(f"s{c}") + 0.5).cast("int").alias(c) for c in "xyz"])
    ends = points.groupBy(*by, "sl").agg(F.min(place).alias("p"), F.max(place).alias("q"))
    ends = ends.select(*by, "sl", F.explode(F.array(F.struct(F.lit("a").alias("end"), "p.x", "p.y", "p.z"), F.struct(F.lit("b").alias("end"), "q.x", "q.y", "q.z"))).alias("e")).select(*by, "sl", "e.*")
    keys = [*(atlas_by or []), "x", "y", "z"]
    found = ends.join(atlas.select(*keys, F.rint("label").cast("int").alias("label")), keys, "left")
    label = lambda e: F.max(F.when(F.col("end") == e, F.coalesce("label", F.lit(0))))
    return found.groupBy(*by, "sl").agg(label("a").alias("a"), label("b").alias("b"))


def fa_samples(points: DataFrame, fa: DataFrame, by: list[str], limit: float = 0.0, method: str = "trilinear", fa_by: list[str] | None = None) -> DataFrame:
    """(by, sl, ord, fa): FA at each point; with a limit, a sample that a voxel under it has part in is null."""
    value = F.when(F.col("fa") >= limit, F.col("fa")) if limit > 0 else F.col("fa")
    given = fa.select(*(fa_by or []), "x", "y", "z", value.alias("value"))
    return P.sample(points, given, [*by, "sl", "ord"], fa_by or [], method).withColumnRenamed("value", "fa")


def fa_weighted_connectivity(points: DataFrame, affine, atlas: DataFrame, fa: DataFrame, by: list[str] | None = None, limit: float = 0.0, method: str = "trilinear", atlas_by: list[str] | None = None, fa_by: list[str] | None = None) -> DataFrame:
    """points (by, sl, ord, px, py, pz) -> (by, i, j, w): mean FA along each streamline, then over those of a pair of regions."""
    by = by or []
    at = in_voxels(points, affine)
    line = fa_samples(at, fa, by, limit, method, fa_by).groupBy(*by, "sl").agg(F.avg("fa").alias("fa"))
    return N.edge_weights(end_labels(at, atlas, by, atlas_by).join(line, [*by, "sl"]), by)


def structural_connectivity(points: DataFrame | None, affine, atlas: DataFrame, config: Config = Config(), fa: DataFrame | None = None, dwi: DataFrame | None = None, gradients: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """A subject's matrix: from the FA map if there is one, else from a tensor fit of dwi (x, y, z, ts)."""
    if config.fa_measure == "roi_fa":
        raise ValueError("roi_fa gives a value per region, not a matrix")
    if config.fa_measure != "fa_weighted_sc":
        raise ValueError(f"unknown fa_measure {config.fa_measure!r}")
    if fa is None and dwi is None:
        raise ValueError("neither an FA map nor diffusion images")
    if points is None:
        raise ValueError("fa_weighted_sc needs a tractogram")
    if fa is None:
        rows = gradients.orderBy("g").collect()  # a few hundred directions
        inside = dwi if mask is None else dwi.join(mask.filter("value <> 0").select("x", "y", "z"), ["x", "y", "z"], "left_semi")
        fa = N.tensor_fa(inside.withColumnRenamed("ts", "signal"), [r.bval for r in rows], [[r.bx, r.by, r.bz] for r in rows])
    return fa_weighted_connectivity(points, affine, atlas, fa, limit=config.fa_threshold)
