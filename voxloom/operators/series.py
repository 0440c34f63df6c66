"""Per-voxel time-series kernels: one row in, one row out, no shuffle.

A voxel's series is an array column. Kernels take a batch of equally long series as a matrix
and run in NumPy through Arrow, so a transform costs O(T log T) a voxel at any grid size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config


def brain_mask(ts="ts"):
    """Kept if all values are finite and any is not zero."""
    ok = F.forall(ts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(ts, lambda v: v != 0), F.lit(False))


def explicit_mask(bold: DataFrame, mask: DataFrame, keys=("x", "y", "z")) -> DataFrame:
    """Voxels where the mask volume is not zero; a missing row is outside."""
    return bold.join(mask.filter("value <> 0").select(*keys), list(keys), "left_semi")


def inflate(values: DataFrame, grid: DataFrame, keys=("x", "y", "z")) -> DataFrame:
    """Values over the whole grid, 0 outside the mask."""
    return grid.join(values, list(keys), "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def apply(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], outputs: dict[str, str], ts: str = "ts") -> DataFrame:
    """All columns but ts, and the kernel's outputs ("double" or "array<double>"); NaN becomes null."""
    keep = [c for c in df.columns if c != ts]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ts] + [f"{k} {v}" for k, v in outputs.items()])

    def run(it):
        for whole in it:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                col = b.column(b.num_columns - 1)
                lens = np.diff(col.offsets.to_numpy())
                flat, edge = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lens)])
                for n in np.unique(lens):
                    own = np.flatnonzero(lens == n)
                    got = kernel(flat[edge[own][:, None] + np.arange(n)])
                    part = b.take(pa.array(own))
                    arrays = [part.column(k) for k in range(b.num_columns - 1)]
                    for name, kind in outputs.items():
                        v = np.asarray(got[name], float)
                        if kind == "double":
                            arrays.append(pa.array(v, pa.float64(), mask=np.isnan(v)))
                        else:
                            arrays.append(pa.array(list(v), pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays(arrays, keep + list(outputs))

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(ts).cast("array<double>").alias(ts)).mapInArrow(run, schema)


# Spectra


def padded(n: int) -> int:
    return 1 << (n - 1).bit_length()


def detrend(x: np.ndarray) -> np.ndarray:
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    centred = x - x.mean(1, keepdims=True)
    return centred - (centred @ t / (t @ t if len(t) > 1 else 1.0))[:, None] * t


def amplitude(x: np.ndarray) -> np.ndarray:
    """Padded amplitude spectrum, scaled by the unpadded length."""
    return np.abs(np.fft.rfft(x, padded(x.shape[1]), axis=1)) * 2 / x.shape[1]


def band_bins(n: int, tr: float, low: float, high: float) -> tuple[int, int]:
    """First and last bin of a band on the padded spectrum, counted from 1 and taken back to 0."""
    p, top = padded(n), 0.5 / tr
    lo = p // 2 if low >= top else math.ceil(low * p * tr + 1) - 1
    hi = p // 2 if high >= top or high == 0 else int(high * p * tr + 1) - 1
    return max(0, min(lo, p // 2)), max(0, min(hi, p // 2))


def slow_bins(n: int, tr: float, low: float, high: float) -> tuple[int, int]:
    p, top = padded(n), 0.5 / tr
    return p // 2 if low >= top else math.ceil(low * p * tr), p // 2 if high >= top or high == 0 else math.floor(high * p * tr)


def alff(tr=config.TR, low=config.LOW, high=config.HIGH, bins=band_bins):
    def kernel(x):
        a, (lo, hi) = amplitude(detrend(x)), bins(x.shape[1], tr, low, high)
        band, total = a[:, lo : hi + 1], a[:, 1:].sum(1)
        return {"alff": band.mean(1), "falff": np.where(total > 0, band.sum(1) / np.where(total > 0, total, 1), 0.0), "falff_slow": band.sum(1) / np.maximum(total, 1e-12)}

    return kernel


def rsfa(tr=config.TR, low=config.LOW, high=config.HIGH, bandpass=True):
    """Spread of the band-passed series, bins kept by frequency without padding."""

    def kernel(x):
        d = detrend(x)
        if bandpass:
            f = np.fft.rfftfreq(x.shape[1], tr)
            d = np.fft.irfft(np.fft.rfft(d, axis=1) * ((f >= low) & (f <= high)), x.shape[1], axis=1)
        return {"rsfa": d.std(1, ddof=1)}

    return kernel


def ideal_filter(tr=config.TR, low=config.LOW, high=config.HIGH):
    """Mean-removed, padded, band and mirror kept, cut to the old length."""

    def kernel(x):
        n, p = x.shape[1], padded(x.shape[1])
        lo, hi = band_bins(n, tr, low, high)
        s = np.fft.rfft(x - x.mean(1, keepdims=True), p, axis=1)
        k = np.arange(s.shape[1])
        return {"ts": np.fft.irfft(s * ((k >= lo) & (k <= hi)), p, axis=1)[:, :n]}

    return kernel


# Ranks, autocorrelation, entropy


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks along time from 1, tied values share their mean."""
    order = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, order, 1)
    n, t = x.shape
    new = np.ones((n, t), bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    group = np.cumsum(new, 1) - 1 + np.arange(n)[:, None] * t
    place = np.broadcast_to(np.arange(1.0, t + 1), (n, t))
    mean = np.bincount(group.ravel(), place.ravel(), n * t) / np.maximum(np.bincount(group.ravel(), minlength=n * t), 1)
    out = np.empty((n, t))
    np.put_along_axis(out, order, mean[group], 1)
    return out


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    d = x - x.mean(1, keepdims=True)
    p = padded(2 * x.shape[1])
    s = np.fft.rfft(d, p, axis=1)
    a = np.fft.irfft(s * s.conj(), p, axis=1)[:, : lags + 1]
    return a / np.where(a[:, :1] > 0, a[:, :1], 1)


def timescale(tr=config.TR, max_lag=config.MAX_LAG):
    """Sum of the autocorrelation before it first falls to zero, the last lag never counted, in seconds."""

    def kernel(x):
        last = min(max_lag, x.shape[1] - 1)
        a = autocorrelation(x, last)[:, 1:last]
        return {"int_timescale": tr * np.where(np.cumprod(a > 0, 1), a, 0).sum(1)}

    return kernel


def coarse(x: np.ndarray, scale: int) -> np.ndarray:
    n = x.shape[1] // scale
    if n < 1:
        raise ValueError("series is shorter than the scale")
    return x[:, : n * scale].reshape(len(x), n, scale).mean(2)


def sample_entropy(x: np.ndarray, m: int, r: np.ndarray) -> np.ndarray:
    """-ln of the share of m-point matches (strictly nearer than r) that go on for one more; all series at once."""
    n = x.shape[1]
    some, more = np.zeros(len(x)), np.zeros(len(x))
    for lag in range(1, n - m):
        near = np.abs(x[:, :-lag] - x[:, lag:]) < r[:, None]
        w = n - lag - m
        run = np.ones((len(x), w), bool)
        for k in range(m):
            run &= near[:, k : k + w]
        some += run.sum(1)
        more += (run & near[:, m : m + w]).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(some == 0, 0.0, -np.log(more / some)) + 0.0


def multiscale_entropy(scales=config.MSE_SCALES, m=config.MSE_M, r=config.MSE_R, method="mean"):
    def kernel(x):
        d = detrend(x)
        tol = r * d.std(1)
        out = []
        for s in scales:
            if d.shape[1] // s < m + 2:
                out.append(np.full(len(d), np.nan))
                continue
            c = coarse(d, s)
            v = sample_entropy(c, m, tol)
            out.append(np.where((c.std(1) < 1e-12) | (tol <= 0) | ~np.isfinite(v), np.nan, v))
        per = np.stack(out, 1)
        n = (~np.isnan(per)).sum(1)
        total = np.nansum(per, 1)
        return {"mse": np.where(n > 0, total / np.maximum(n, 1), np.nan) if method == "mean" else total, **{f"scale_{s}": per[:, k] for k, s in enumerate(scales)}}

    return kernel
