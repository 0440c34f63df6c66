"""Region series, functional and structural connectivity, FA, and structure-function coupling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config


def region_timeseries(bold: DataFrame, subject: list[str] | None = None) -> DataFrame:
    """(subject, label, t, v): mean over a label's voxels; label 0 is background, labels are rounded. Combined map-side."""
    keys = subject or []
    long = bold.select(*keys, F.rint("label").cast("int").alias("label"), F.posexplode(F.col("ts").cast("array<double>")).alias("t", "v")).filter("label <> 0")
    return long.groupBy(*keys, "label", "t").agg(F.avg("v").alias("v"))


def functional_connectivity(region: DataFrame, measure: str = "correlation", subject: list[str] | None = None) -> DataFrame:
    """(subject, i, j, w) for i < j; null for a constant region. One matrix (regions x times) a subject is a task, so no
    pair of samples is shuffled; times that a region lacks are left out."""
    keys = subject or []
    if measure not in ("correlation", "partial_correlation"):
        raise ValueError(f"unknown connectivity measure {measure!r}")
    kinds = {f.name: f.dataType.simpleString() for f in region.schema}

    def run(t: pa.Table) -> pa.Table:
        label, at, v = (t[c].to_numpy() for c in ("label", "t", "v"))
        names = np.unique(label)
        times = np.unique(at)
        x = np.full((len(names), len(times)), np.nan)
        x[np.searchsorted(names, label), np.searchsorted(times, at)] = v
        x = x[:, ~np.isnan(x).any(0)]  # times that all regions have
        with np.errstate(divide="ignore", invalid="ignore"):
            if measure == "correlation":
                p, sign = np.atleast_2d(np.cov(x)), 1
            else:
                p, sign = np.linalg.pinv(np.atleast_2d(np.cov(x))), -1
            d = np.sqrt(np.diag(p))
            i, j = np.triu_indices(len(names), 1)
            w = (sign * p / np.outer(d, d))[i, j]
        own = [pa.array([t[k][0].as_py()] * len(i), t[k].type) for k in keys]
        return pa.table(own + [pa.array(names[i], pa.int32()), pa.array(names[j], pa.int32()), pa.array(w, pa.float64(), mask=np.isnan(w))], [*keys, "i", "j", "w"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "i int", "j int", "w double"])
    grouped = region if keys else region.withColumn("__all", F.lit(0))
    return grouped.groupBy(*(keys or ["__all"])).applyInArrow(run, schema)  # one bounded matrix a subject: regions x times


def fisher_z(w="w"):
    return F.atanh(F.greatest(F.least(F.col(w), F.lit(0.999999)), F.lit(-0.999999)))


def apply_threshold(fa, limit: float):
    """Values under the limit become 0; a limit of 0 or less changes nothing."""
    return F.when(F.col(fa) < limit, 0.0).otherwise(F.col(fa)) if limit > 0 else F.col(fa)


def roi_fa(fa: DataFrame, limit: float = 0.0) -> DataFrame:
    """(label, fa): mean per label; with a limit, of values that reach it; null if none does."""
    kept = F.when(F.col("fa") >= limit, F.col("fa")) if limit > 0 else F.col("fa")
    return fa.filter("label <> 0").groupBy("label").agg(F.avg(kept).alias("fa"))


def fa_stats(fa: DataFrame, limit: float) -> DataFrame:
    before, after = F.count(F.when(F.col("fa") > 0, 1)), F.count(F.when(apply_threshold("fa", limit) > 0, 1))
    kept = F.avg(F.when(apply_threshold("fa", limit) > 0, F.col("fa")))
    return fa.agg(before.alias("before"), after.alias("after"), kept.alias("mean_kept"), (100.0 * after / before).alias("pct_kept"))


def edge_weights(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """lines (keys, sl, a, b, fa) -> (keys, i, j, w): the mean over the streamlines of an unordered pair of
    regions. Ends in label 0 or in one region are left out."""
    k = keys or []
    ends = lines.filter("a <> 0 and b <> 0 and a <> b").select(*k, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "fa")
    return ends.groupBy(*k, "i", "j").agg(F.avg("fa").alias("w"))


def fa_connectivity(points: DataFrame, limit: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """points (keys, sl, ord, label, fa) -> (keys, i, j, w): per streamline the mean of its samples, then edge_weights."""
    sample = F.when(F.col("fa") >= limit, F.col("fa")) if limit > 0 else F.col("fa")
    line = points.groupBy(*(keys or []), "sl").agg(F.min(F.struct("ord", "label"))["label"].alias("a"), F.max(F.struct("ord", "label"))["label"].alias("b"), F.avg(sample).alias("fa"))
    return edge_weights(line, keys)


def symmetric(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    k = keys or []
    return edges.select(*k, "i", "j", "w").unionByName(edges.select(*k, F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def align(structural: DataFrame, functional: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(i, j, s, f): pairs of the functional matrix; no streamlines is 0 and counts, a null weight drops out later."""
    k = [*(keys or []), "i", "j"]
    s = structural.select(*k, F.col("w").alias("s"), F.lit(True).alias("there"))
    return functional.select(*k, F.col("w").alias("f")).join(s, k, "left").withColumn("s", F.when(F.col("there"), F.col("s")).otherwise(0.0)).drop("there")


def guarded_correlation(pairs: DataFrame, by: list[str], a: str, b: str, method: str = "spearman") -> DataFrame:
    """(by, value): correlation over pairs where both are finite; null with fewer than three."""
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown correlation {method!r}")
    whole = by or ["__all"]
    rows = pairs if by else pairs.withColumn("__all", F.lit(0))
    fine = rows.filter(f"{a} is not null and {b} is not null and not isnan({a}) and not isnan({b}) and abs({a}) < double('infinity') and abs({b}) < double('infinity')")
    if method == "spearman":
        for c in (a, b):
            tied = F.count("*").over(W.partitionBy(*whole, c))
            fine = fine.withColumn(f"r_{c}", F.rank().over(W.partitionBy(*whole).orderBy(c)) + (tied - 1) / 2)
        x, y = f"r_{a}", f"r_{b}"
    else:
        x, y = a, b
    got = fine.groupBy(*whole).agg(F.when(F.count("*") >= 3, F.corr(x, y)).alias("value"))
    return rows.select(*whole).distinct().join(got, whole, "left").drop("__all")


def global_coupling(aligned: DataFrame, method: str = "spearman", keys: list[str] | None = None) -> DataFrame:
    return guarded_correlation(aligned, keys or [], "s", "f", method)


def regional_coupling(aligned: DataFrame, method: str = "spearman", keys: list[str] | None = None) -> DataFrame:
    k = keys or []
    both = aligned.select(*k, F.col("i").alias("region"), "s", "f").unionByName(aligned.select(*k, F.col("j").alias("region"), "s", "f"))
    return guarded_correlation(both, [*k, "region"], "s", "f", method)


def coupling(structural: DataFrame, functional: DataFrame, config: Config = Config(), keys: list[str] | None = None, regions: tuple[int, int] | None = None) -> DataFrame:
    """The configured coupling; regions are the sizes of the two matrices, which must be the same."""
    config.check()
    if regions and regions[0] != regions[1]:
        raise ValueError(f"matrices of {regions[0]} and {regions[1]} regions don't share a parcellation")
    measure = global_coupling if config.coupling_metric == "global_corr" else regional_coupling
    return measure(align(structural, functional, keys), config.coupling_corr, keys)


def functional(bold: DataFrame, config: Config = Config(), keys: list[str] | None = None) -> DataFrame:
    fc = functional_connectivity(region_timeseries(bold, keys), config.fc_measure, keys)
    return fc.withColumn("w", fisher_z()) if config.fc_fisher_z else fc


def extract_subject(bold: DataFrame, points: DataFrame, config: Config = Config(), keys: list[str] | None = None) -> DataFrame:
    """Functional matrix, structural matrix, coupling, in one plan; with keys, of every subject at once."""
    config.check()
    if config.fa_measure == "roi_fa":
        raise ValueError("roi_fa gives a value per region, not a matrix")
    return coupling(fa_connectivity(points, config.fa_threshold, keys), functional(bold, config, keys), config, keys)


def extract_cohort(subjects: DataFrame, bold: DataFrame, points: DataFrame, config: Config = Config(), regions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """subjects as discovery.resolve gives them; bold and points with a subject column -> couplings, and
    (subject, reason) of those left out: files that lack, or another number of regions than the atlas has."""
    from .discovery import conformance

    checked = conformance(subjects, config.fa_measure)
    errors = checked.filter(F.size("problems") > 0).select("subject", F.array_join("problems", "; ").alias("reason"))
    fine = checked.filter(F.size("problems") == 0).select("subject")
    if regions is not None:
        found = bold.filter("label <> 0").groupBy("subject").agg(F.count_distinct(F.rint("label")).alias("k"))
        counted = fine.join(found, "subject", "left").withColumn("k", F.coalesce("k", F.lit(0)))
        errors = errors.unionByName(counted.filter(F.col("k") != regions).select("subject", F.concat("k", F.lit(f" of {regions} regions")).alias("reason")))
        fine = counted.filter(F.col("k") == regions).select("subject")
    own = lambda df: df.join(F.broadcast(fine), "subject", "left_semi")  # noqa: E731  ids alone go out: a join by subject would put each subject's points in one task
    return extract_subject(own(bold), own(points), config, ["subject"]), errors


def matrix_range(edges: DataFrame, symmetric_range: bool = False) -> DataFrame:
    """(low, high) of the finite weights for a colour scale; -1..1 or 0..1 where there is none, 1 for a top of 0."""
    from ..functions.columns import finite

    v = finite(F.col("w"))
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    if symmetric_range:
        top = F.coalesce(one(F.max(F.abs(v))), F.lit(1.0))
        return edges.agg((-top).alias("low"), top.alias("high"))
    return edges.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("low"), F.coalesce(one(F.max(v)), F.lit(1.0)).alias("high"))


def tensor_fa(dwi: DataFrame, bvals: list[float], bvecs: list[list[float]]) -> DataFrame:
    """(x, y, z, fa) by a weighted least-squares tensor fit of the log signals; clipped to 0..1, non-finite is 0."""
    b, g = np.array(bvals, float), np.array(bvecs, float)
    if g.shape[0] == 3 and len(b) != 3:
        g = g.T
    design = np.stack([-b * g[:, 0] ** 2, -b * g[:, 1] ** 2, -b * g[:, 2] ** 2, -2 * b * g[:, 0] * g[:, 1], -2 * b * g[:, 0] * g[:, 2], -2 * b * g[:, 1] * g[:, 2], np.ones(len(b))], 1)

    def kernel(x):
        y = np.log(np.maximum(x, 1e-6))
        first = y @ np.linalg.pinv(design).T
        w = np.exp(2 * (first @ design.T))
        a = np.einsum("gi,vg,gj->vij", design, w, design)
        d = np.linalg.solve(a + 1e-12 * np.eye(7), np.einsum("gi,vg,vg->vi", design, w, y)[:, :, None])[:, :, 0]
        m = np.stack([d[:, [0, 3, 4]], d[:, [3, 1, 5]], d[:, [4, 5, 2]]], 1)
        e = np.linalg.eigvalsh(m)
        mean = e.mean(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            fa = np.sqrt(1.5 * ((e - mean) ** 2).sum(1) / (e**2).sum(1))
        return {"fa": np.clip(np.nan_to_num(fa, nan=0.0, posinf=0.0, neginf=0.0), 0, 1)}

    from .series import apply

    return apply(dwi, kernel, {"fa": "double"}, "signal")
