"""The measure registry: key -> (bold, parameters) -> values over the mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from . import series as S
from . import spatial as P
from .cohort import simple_reference
from .grids import require_same_grid


@dataclass(frozen=True)
class Parameters:
    tr: float = config.TR
    low: float = config.LOW
    high: float = config.HIGH
    cluster: int = config.CLUSTER
    max_lag: int = config.MAX_LAG
    mse_scales: tuple[int, ...] = config.MSE_SCALES
    mse_m: int = config.MSE_M
    mse_r: float = config.MSE_R
    shape: tuple[int, int, int] | None = None
    detrend: bool = False
    filter_band: bool = False


def _per_voxel(kernel_of, output: str):
    def measure(bold: DataFrame, p: Parameters, by: list[str]) -> DataFrame:
        return S.apply(bold, kernel_of(p), {output: "double"}).withColumnRenamed(output, "value")

    return measure


def _reho(bold: DataFrame, p: Parameters, by: list[str]) -> DataFrame:
    """The grid's size is a parameter; without it, one row with the greatest coordinates is asked for."""
    shape = p.shape or tuple(int(v or 0) + 1 for v in bold.agg(F.max("x"), F.max("y"), F.max("z")).first())
    return P.reho(bold, shape, p.cluster, by, detrend=p.detrend, band=(p.tr, p.low, p.high) if p.filter_band else None).withColumnRenamed("reho", "value")


def _coherence(bold: DataFrame, p: Parameters, by: list[str]) -> DataFrame:
    return P.coherence_reho(bold, p.tr, p.low, p.high, by).withColumnRenamed("coherence_reho", "value")


MEASURES = {
    "alff": _per_voxel(lambda p: S.alff(p.tr, p.low, p.high), "alff"),
    "falff": _per_voxel(lambda p: S.alff(p.tr, p.low, p.high), "falff"),
    "alff_slow4": _per_voxel(lambda p: S.alff(p.tr, *config.SLOW4, S.slow_bins), "alff"),
    "alff_slow5": _per_voxel(lambda p: S.alff(p.tr, *config.SLOW5, S.slow_bins), "alff"),
    "falff_slow4": _per_voxel(lambda p: S.alff(p.tr, *config.SLOW4, S.slow_bins), "falff_slow"),
    "falff_slow5": _per_voxel(lambda p: S.alff(p.tr, *config.SLOW5, S.slow_bins), "falff_slow"),
    "rsfa": _per_voxel(lambda p: S.rsfa(p.tr, p.low, p.high), "rsfa"),
    "reho": _reho,
    "int": _per_voxel(lambda p: S.timescale(p.tr, p.max_lag), "int_timescale"),
    "coherence_reho": _coherence,
    "mse": _per_voxel(lambda p: S.multiscale_entropy(p.mse_scales, p.mse_m, p.mse_r), "mse"),
}


def compute(measure: str, bold: DataFrame, parameters: Parameters = Parameters(), mask: DataFrame | None = None, by: list[str] | None = None, mask_shape: tuple[int, int, int] | None = None) -> DataFrame:
    """bold (by, x, y, z, ts) -> (by, x, y, z, value) over the given mask or the default one; voxels without a value leave it.

    by names the subject: a whole cohort goes through one plan. A mask's shape other than that of the
    series is an error.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known: {', '.join(MEASURES)}")
    if mask_shape and parameters.shape:
        require_same_grid(mask_shape, parameters.shape, "mask and series")
    k = by or []
    inside = S.explicit_mask(bold, mask) if mask is not None else bold.filter(S.brain_mask())
    out = MEASURES[measure](inside.select(*k, "x", "y", "z", "ts"), parameters, k)
    return out.select(*k, "x", "y", "z", "value").filter("value is not null")


def measure_reference(measure: str, bold: DataFrame, parameters: Parameters = Parameters(), mask: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """bold (subject, x, y, z, ts) of a cohort -> its simple reference, and (subject, reason) of those left out.

    limit keeps the first subjects in order of their names (a feature, for trials). Subjects whose
    images hold one volume are left out; an unknown measure is an error.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known: {', '.join(MEASURES)}")
    if limit is not None:
        bold = bold.join(F.broadcast(bold.select("subject").distinct().orderBy("subject").limit(limit)), "subject", "left_semi")
    flat = bold.groupBy("subject").agg(F.max(F.size("ts")).alias("times")).filter("times < 2")
    errors = flat.select("subject", F.lit("not 4-D").alias("reason"))
    maps = compute(measure, bold.filter(F.size("ts") >= 2), parameters, mask, ["subject"])
    return simple_reference(maps), errors
