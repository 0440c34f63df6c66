"""Grids: their sizes, and checks that two tables share one.

A table of voxels carries no shape of its own; its grid is one past the greatest index on each
axis, unless a shape is declared (as an image's header does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def grid(voxels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, nx, ny, nz): a partial maximum, one row a map."""
    return voxels.groupBy(*(by or [])).agg(*[(F.max(c) + 1).cast("int").alias(f"n{c}") for c in AXES])


def grid_mismatch(maps: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """(by, nx, ny, nz, mismatch): whether a map's grid is another one than the reference's."""
    ref = grid(reference).select(*[F.col(f"n{c}").alias(f"r{c}") for c in AXES])
    differs = ~(F.col("nx").eqNullSafe(F.col("rx")) & F.col("ny").eqNullSafe(F.col("ry")) & F.col("nz").eqNullSafe(F.col("rz")))
    return grid(maps, by).crossJoin(F.broadcast(ref)).select(*by, "nx", "ny", "nz", differs.alias("mismatch"))


def require_same_grid(a: tuple[int, ...], b: tuple[int, ...], what: str) -> None:
    if tuple(a) != tuple(b):
        raise ValueError(f"{what}: grids {tuple(a)} and {tuple(b)} differ")
