"""Column helpers: rounding for output, guarded arithmetic, affine maps, distribution tails."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def safe_divide(a: Column, b: Column) -> Column:
    """a over b, which counts as 1e-12 at least."""
    return a / F.greatest(b, F.lit(1e-12))


def to_mm(affine: list[list[float]], x="x", y="y", z="z") -> list[Column]:
    """Voxel indices to millimetres by a 4x4 affine."""
    v = [F.col(x), F.col(y), F.col(z)]
    return [sum((F.lit(float(a)) * c for a, c in zip(row[:3], v)), F.lit(float(row[3]))) for row in affine[:3]]


def normal_cdf(z: Column, terms: int = 120) -> Column:
    """Normal distribution function: density times an all-positive series; 0 or 1 beyond six deviations."""
    step = lambda a, k: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * z * z / (2 * k + 3)).alias("t"))
    series = F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), F.struct(F.lit(0.0).alias("s"), z.cast("double").alias("t")), step, lambda a: a["s"])
    inner = F.lit(0.5) + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z > 6, 1.0).when(z < -6, 0.0).otherwise(inner)


def _t_coefficients(df: int) -> list[float]:
    """Coefficients of the finite trigonometric series for whole degrees of freedom."""
    odd = df % 2 == 1
    if odd and df == 1:
        return []
    coef = [1.0]
    for k in range(1, ((df - 3) // 2 if odd else df // 2 - 1) + 1):
        coef.append(coef[-1] * (2 * k / (2 * k + 1) if odd else (2 * k - 1) / (2 * k)))
    return coef


def t_two_sided(t: Column, df: int) -> Column:
    """Two-sided tail of Student's t with whole degrees of freedom, as an expression; for few degrees."""
    theta, coef = F.atan(F.abs(t) / math.sqrt(df)), _t_coefficients(df)
    c2 = F.pow(F.cos(theta), 2)
    total = F.aggregate(F.reverse(F.array(*[F.lit(x) for x in coef])), F.lit(0.0), lambda a, x: a * c2 + x) if coef else F.lit(0.0)
    inside = F.lit(2 / math.pi) * (theta + F.sin(theta) * F.cos(theta) * total) if df % 2 else F.sin(theta) * total
    return F.greatest(F.lit(0.0), 1.0 - inside)


def t_tails(t: np.ndarray, df: int) -> np.ndarray:
    """The same for a batch of values: one multiplication and one addition a term and value."""
    theta = np.arctan(np.abs(t) / math.sqrt(df))
    c2, total = np.cos(theta) ** 2, np.zeros(len(t))
    for x in reversed(_t_coefficients(df)):
        total = total * c2 + x
    inside = 2 / math.pi * (theta + np.sin(theta) * np.cos(theta) * total) if df % 2 else np.sin(theta) * total
    return np.maximum(0.0, 1.0 - inside)


def with_t_tail(df: DataFrame, t: str, p: str, degrees: str) -> DataFrame:
    """Adds the two-sided tail p of column t under a column of degrees (null without either, or under one degree), in Arrow
    batches: the series has half as many terms as degrees."""
    names = [*df.columns, p]
    at, of = df.columns.index(t), df.columns.index(degrees)

    def run(it):
        for b in it:
            v, n = (b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (at, of))
            got = np.full(len(v), np.nan)
            for k in np.unique(n[n >= 1]):
                own = n == k
                got[own] = t_tails(v[own], int(k))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64(), mask=np.isnan(got))], names)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"`{p}` double"])
    return df.mapInArrow(run, schema)
