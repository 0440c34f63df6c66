"""Cohort references and single-case comparison.

Maps are rows (subject, run, x, y, z, value); missing voxels have no row. Cohort statistics are
one partial aggregation over voxels; tests join a subject's map with the reference on voxels.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite, normal_cdf, with_t_tail

VOXEL = ["x", "y", "z"]


def usable(value="value") -> Column:
    """Finite and not zero, else null."""
    v = finite(F.col(value))
    return F.when(v != 0, v)


def global_normalize(maps: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Each map over the mean of its usable voxels, others 0; unchanged where that mean is 0 or there is none.

    The means are one small row a map, joined back: no map is gathered."""
    means = maps.groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg(F.avg(usable(value)).alias("__mean"))
    v = F.when(F.coalesce(F.col("__mean"), F.lit(0.0)) != 0, F.coalesce(usable(value) / F.col("__mean"), F.lit(0.0))).otherwise(F.col(value))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])  # a null key is a map of its own
    return maps.join(means, same).withColumn(value, v).drop("__mean", *[f"__{k}" for k in by])


def simple_reference(maps: DataFrame) -> DataFrame:
    """Mean and SD of all values, zeros included; the SD of one map is 0. in_mask holds where every map has the voxel."""
    n = maps.select("subject").distinct().agg(F.count("*").alias("n"))
    seen = maps.groupBy(*VOXEL).agg(F.count("*").alias("k"), F.avg("value").alias("a"), F.var_pop("value").alias("v"))
    k, n_, a = F.col("k"), F.col("n"), F.col("a")
    spread = k * F.col("v") + k * (n_ - k) / n_ * a * a
    sd = F.when(n_ > 1, F.sqrt(spread / (n_ - 1))).otherwise(0.0)
    return seen.crossJoin(F.broadcast(n)).select(*VOXEL, (k * a / n_).alias("mean"), sd.alias("sd"), (k == n_).alias("in_mask"))


def summaries(maps: DataFrame) -> DataFrame:
    return maps.groupBy("subject").agg(F.avg(finite(F.col("value"))).alias("summary"))


def voxel_reference(maps: DataFrame, runs: str = "separate") -> DataFrame:
    """(x, y, z, mean, sd, n_obs, in_mask) over usable observations; SD from two on.

    runs="average" takes each subject's mean over its runs first, a missing run counting as 0."""
    if runs == "average":
        per = maps.select("subject", "run").distinct().groupBy("subject").agg(F.count("*").alias("runs"))
        sums = maps.groupBy("subject", *VOXEL).agg(F.sum(F.coalesce(usable(), F.lit(0.0))).alias("s"))
        maps = sums.join(per, "subject").select("subject", *VOXEL, (F.col("s") / F.col("runs")).alias("value"))
    elif runs != "separate":
        raise ValueError("runs must be separate or average")
    v = usable()
    out = maps.groupBy(*VOXEL).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n_obs")).filter("n_obs > 0")
    return out.withColumn("in_mask", F.coalesce((F.col("n_obs") >= 2) & (F.col("sd") > 0), F.lit(False)))


def cohort_size(maps: DataFrame, reference: DataFrame, runs: str = "separate") -> DataFrame:
    if runs == "separate":
        return maps.filter(usable().isNotNull()).agg(F.count_distinct("subject").alias("n"))
    return reference.filter("in_mask").agg(F.percentile("n_obs", 0.5).alias("n"))


def slice_statistics(maps: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """(z, mean, sd, n) over observations of slices with enough usable voxels."""
    per = maps.groupBy(*by, "z").agg(F.count(usable()).alias("k"), F.avg(usable()).alias("m")).filter(F.col("k") >= least)
    return per.groupBy("z").agg(F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))


def median_cv(reference: DataFrame) -> DataFrame:
    return reference.filter("in_mask").agg(F.percentile(F.col("sd") / F.col("mean"), 0.5).alias("median_cv"))


def wrap_group_map(mean: DataFrame, sd: DataFrame, count: DataFrame | None = None, n: int | None = None, mask: DataFrame | None = None) -> DataFrame:
    """A reference from a group's mean, SD, count and mask maps (x, y, z, value): voxels of the mask, or else of a mean that is
    finite and not zero, where mean and SD are finite."""
    inside = usable() if mask is None else finite(F.col("value"))
    out = mean.select(*VOXEL, inside.alias("mean")).filter("mean is not null").join(sd.select(*VOXEL, finite(F.col("value")).alias("sd")), VOXEL).filter("sd is not null")
    if mask is not None:
        out = out.join(mask.filter("value <> 0").select(*VOXEL), VOXEL, "left_semi")
    if n is not None:
        return out.withColumn("n", F.lit(n))
    return out.crossJoin(F.broadcast(count.agg(F.max("value").cast("long").alias("n")))) if count is not None else out.withColumn("n", F.lit(None).cast("long"))


def group_average(maps: DataFrame) -> DataFrame:
    """Voxel means over the subjects that cover it; nothing with fewer than two subjects."""
    n = maps.select("subject").distinct().agg(F.count("*").alias("__n"))
    return maps.groupBy(*VOXEL).agg(F.avg(finite(F.col("value"))).alias("value"), F.count("*").alias("covered")).crossJoin(F.broadcast(n)).filter("__n >= 2").drop("__n")


def map_stats(values: DataFrame, by: list[str]) -> DataFrame:
    return values.groupBy(*by).agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.count("*").alias("voxels"))


# Coupling references


def coupling_reference(values: DataFrame) -> DataFrame:
    v = finite(F.col("value"))
    return values.groupBy("region").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))


def compare_subject(subject: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """z and its normal percentile; a zero SD gives an infinite or missing z as division does."""
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("sd"))
    return subject.join(reference, on).withColumn("z", z).withColumn("percentile", 100 * normal_cdf(F.col("z")))


def summary_percentile(subject: DataFrame, cohort: DataFrame) -> DataFrame:
    """subject (value), cohort (value) -> percentile among the finite summaries; null where there is none."""
    fine = cohort.select(finite(F.col("value")).alias("v")).filter("v is not null")
    below = fine.crossJoin(F.broadcast(subject.select("value").limit(1))).agg(100 * F.avg(F.when(F.col("v") < F.col("value"), 1.0).otherwise(0.0)))
    return below.toDF("percentile")


def empirical_percentile(subject: DataFrame, cohort: DataFrame, on: list[str]) -> DataFrame:
    """100 times the share of cohort values strictly below; a missing value is not below but counts."""
    pairs = cohort.select(*on, F.col("value").alias("v")).join(subject, on)
    below = F.avg(F.when((F.col("v") < F.col("value")) & ~F.isnan("v"), 1.0).otherwise(0.0))
    return pairs.groupBy(*on).agg((100 * below).alias("percentile"))


# Single-case tests


def z_map(subject: DataFrame, reference: DataFrame) -> DataFrame:
    return subject.join(reference.filter("in_mask and sd > 0"), VOXEL).withColumn("score", (F.col("value") - F.col("mean")) / F.col("sd"))


def t_test(subject: DataFrame, reference: DataFrame, n: int | DataFrame, by: list[str], normalized: bool = False) -> DataFrame:
    """Single case against a cohort of n: t with n - 1 degrees of freedom and its two-sided p.

    n is a number, or a table of one row (n) that is worked out with the rest; a cohort under two is
    an error, or no p in the second case.
    """
    if isinstance(n, int) and n <= 1:
        raise ValueError("a test needs a cohort of two or more")
    own = subject.join(reference.filter("in_mask and sd > 0").select(*VOXEL, "mean", "sd"), VOXEL)
    if normalized:
        own = global_normalize(own, by)
    own = own.withColumn("__n", F.lit(n).cast("long")) if isinstance(n, int) else own.crossJoin(F.broadcast(n.select(F.col("n").cast("long").alias("__n"))))
    t = (F.col("value") - F.col("mean")) / (F.col("sd") * F.sqrt((F.col("__n") + 1) / F.col("__n")))
    return with_t_tail(own.withColumn("t", t).withColumn("__n", F.col("__n") - 1), "t", "p", "__n").drop("__n")


def fdr(tests: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds q, and threshold: the greatest p within rank / m times alpha, else 0. One group is one map."""
    group, order = W.partitionBy(*by), W.partitionBy(*by).orderBy("p")
    m = F.count("*").over(group)
    ranked = tests.withColumn("__rank", F.count("*").over(order.rangeBetween(W.unboundedPreceding, 0)))
    ranked = ranked.withColumn("__m", m)
    q = F.min(F.col("p") * F.col("__m") / F.col("__rank")).over(W.partitionBy(*by).orderBy(F.desc("p")).rangeBetween(W.unboundedPreceding, 0))
    hit = F.max(F.when(F.col("p") <= F.col("__rank") / F.col("__m") * alpha, F.col("p"))).over(group)
    return ranked.withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))).withColumn("threshold", F.coalesce(hit, F.lit(0.0))).drop("__rank", "__m")


def t_summary(tests: DataFrame, by: list[str]) -> DataFrame:
    n = F.count("*")
    low, sure = F.count(F.when(F.col("p") < 0.05, 1)), F.count(F.when(F.col("q") < 0.05, 1))
    out = tests.groupBy(*by).agg(
        F.avg("t").alias("mean_t"), F.max(F.abs("t")).alias("max_abs_t"), n.alias("tested"), low.alias("p_hits"), (100.0 * low / n).alias("p_pct"),
        sure.alias("q_hits"), (100.0 * sure / n).alias("q_pct"), F.max("threshold").alias("p_threshold"), F.stddev_pop("t").alias("sd_t"), (low / (0.05 * n)).alias("obs_chance"),
    )
    return out.withColumn("warning", (F.col("obs_chance") < 0.5) | (F.col("sd_t") < 0.7))


def peaks(tests: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """Survivors (q < 0.05) by |t|, where there are 1 to most of them; a report of few peaks."""
    hit = tests.filter("q < 0.05").withColumn("__n", F.count("*").over(W.partitionBy(*by))).filter(F.col("__n") <= most)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.abs("t")), *VOXEL))
    return hit.withColumn("rank", rank).withColumn("side", F.when(F.col("t") > 0, "above").otherwise("below")).drop("__n")


def difference(subject: DataFrame, reference: DataFrame) -> DataFrame:
    return subject.join(reference.filter("in_mask"), VOXEL).withColumn("diff", F.col("value") - F.col("mean"))


def difference_summary(subject: DataFrame, reference: DataFrame, same_grid: bool = True) -> DataFrame:
    """(subject_mean, group_mean) over the shared mask, null where that is empty; the subject's alone on another grid."""
    if not same_grid:
        return subject.agg(F.avg("value").alias("subject_mean"), F.lit(None).cast("double").alias("group_mean"))
    return difference(subject, reference).agg(F.avg("value").alias("subject_mean"), F.avg("mean").alias("group_mean"))


def calibration(tests: DataFrame, by: list[str]) -> DataFrame:
    """Medians over held-out maps of mean t, SD(t) and observed / chance, and the verdict."""
    per = tests.groupBy(*by).agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("s"), (F.count(F.when(F.col("p") < 0.05, 1)) / (0.05 * F.count("*"))).alias("r"))
    out = per.agg(F.count("*").alias("maps"), *[F.percentile(c, 0.5).alias(n) for c, n in (("m", "mean_t"), ("s", "sd_t"), ("r", "obs_chance"))])
    s, r = F.col("sd_t"), F.col("obs_chance")
    verdict = F.when(s < 0.7, "sd too small").when(s > 1.4, "sd too large").when(r > 1.5, "too many").when(r < 0.5, "too few").otherwise("calibrated")
    return out.withColumn("verdict", verdict)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select(*VOXEL, F.col("value").alias("a")).join(b.select(*VOXEL, F.col("value").alias("b")), VOXEL)
    out = both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_diff"), F.corr("a", "b").alias("r"))
    return out.withColumn("verdict", F.when((F.col("max_diff") < 1e-4) | (F.col("r") > 0.9999), "MATCH").otherwise("DIFFERENT"))


def reference_facts(maps: DataFrame, by: list[str]) -> DataFrame:
    """(by, has_sd, n, can_ttest) of the references that maps (by, subject, x, y, z, value) make: n counts subjects."""
    spread = maps.groupBy(*by, *VOXEL).agg(F.stddev_samp(usable()).alias("sd")).groupBy(*by).agg(F.coalesce(F.bool_or(F.col("sd") > 0), F.lit(False)).alias("has_sd"))
    size = maps.groupBy(*by).agg(F.count_distinct("subject").alias("n"))
    return spread.join(size, by).withColumn("can_ttest", F.col("has_sd") & (F.col("n") > 1))


def mode(meta: DataFrame) -> DataFrame:
    """meta (measure, n, has_sd) -> mode: t, else z, else diff."""
    return meta.withColumn("mode", F.when(F.col("has_sd") & (F.col("n") > 1), "t").when(F.col("has_sd"), "z").otherwise("diff"))


# Charts' data


def histogram(values: DataFrame, bins: int, value: str = "value", zeros: bool = False) -> DataFrame:
    """(bin, lo, n, excluded): equal bins from least to greatest, the last one closed; one row gives the range.

    Null, NaN and infinite values are no values; zeros are left out and counted as excluded, unless zeros is set.
    """
    fine = finite(F.col(value))
    values = values.select(fine.alias(value)).filter(F.col(value).isNotNull())
    kept = F.col(value) if zeros else usable(value)
    ends = values.agg(F.min(kept).alias("lo_"), F.max(kept).alias("hi_"), F.count(F.when(kept.isNull(), 1)).alias("excluded"))
    values = values.filter(kept.isNotNull())
    width = (F.col("hi_") - F.col("lo_")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo_")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return values.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "lo_", width.alias("w_"), "excluded").agg(F.count("*").alias("n")).select("bin", (F.col("lo_") + F.col("bin") * F.col("w_")).alias("lo"), "n", "excluded")


def cohort_histogram(subject: DataFrame, cohort: DataFrame, region: int | None = None, bins: int = 25) -> DataFrame:
    """subject (region, value), cohort (subject, region, value) -> the cohort's histogram (bin, lo, n), the
    subject's value and its percentile: of one region, or of the mean across regions."""
    v = finite(F.col("value"))
    if region is not None:
        own, rest = subject.filter(F.col("region") == region).select("value"), cohort.filter(F.col("region") == region).select("subject", "value")
    else:
        own, rest = subject.agg(F.avg(v).alias("value")), cohort.groupBy("subject").agg(F.avg(v).alias("value"))
    below = rest.crossJoin(F.broadcast(own.select(F.col("value").alias("own")))).agg(F.max("own").alias("own"), (100 * F.avg(F.when((F.col("value") < F.col("own")) & ~F.isnan("value"), 1.0).otherwise(0.0))).alias("percentile"))
    return histogram(rest, bins, zeros=True).drop("excluded").crossJoin(F.broadcast(below))


def slice_profile(subject: DataFrame, slices: DataFrame, least: int = 20) -> DataFrame:
    per = subject.groupBy("z").agg(F.count(usable()).alias("k"), F.avg(usable()).alias("value")).filter(F.col("k") >= least)
    kept = slices.filter("sd > 0 and n >= 2").select("z", "mean", "sd")
    return per.join(kept, "z").select("z", "value", "mean", (F.col("mean") - F.col("sd")).alias("low"), (F.col("mean") + F.col("sd")).alias("high"))


def montage(mask: DataFrame, rows: int = 3, cols: int = 8) -> DataFrame:
    """(tile, z): slices spread evenly over the mask's range."""
    n = rows * cols
    ends = mask.agg(F.min("z").alias("a"), F.max("z").alias("b"))
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile"), "a", "b").select("tile", F.floor(F.col("a") + F.col("tile") * (F.col("b") - F.col("a")) / (n - 1)).cast("int").alias("z"))


def pooled_percentiles(values: DataFrame, value: Column, fractions: dict[str, float]) -> DataFrame:
    """One row of exact percentiles (name: fraction) over all values, linear between neighbours; null where there is none.

    Values are counted in buckets of a hundredth of their logarithm, then in equal parts of the buckets that hold the wanted ranks;
    only the values of those parts are put in order. Bucket and part never fall as the value rises, so each is a range of values
    and no rank is lost. Four ranges at most go out to the rows; the rows are read once for each step and never gathered."""
    v, n, log = F.col("v"), F.count("*").alias("n"), F.floor((F.ln(F.abs("v")) + 800) * 100)
    rows = values.select(value.cast("double").alias("v")).filter("v is not null")
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(f)).alias("f")) for k, f in fractions.items()])
    ranks = F.flatten(F.transform(each, lambda w: F.transform(F.array_distinct(F.array(F.floor(w["f"] * (F.col("total") - 1)), F.ceil(w["f"] * (F.col("total") - 1)))), lambda r: F.struct(w["name"].alias("name"), (w["f"] * (F.col("total") - 1)).alias("pos"), r.alias("rank")))))

    def holding(counted: DataFrame, of: list[str], order: str) -> DataFrame:
        """Rows that hold wanted ranks, with those: base comes to be the number of values below."""
        below = F.col("base") + F.sum("n").over(W.partitionBy(*of).orderBy(order)) - F.col("n")
        own = F.filter("wanted", lambda w: (w["rank"] >= F.col("base")) & (w["rank"] < F.col("base") + F.col("n")))
        return counted.withColumn("base", below).withColumn("wanted", own).filter(F.size("wanted") > 0)

    def within(ranges: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(ranges.select("lo", "hi", "base", "wanted")), (v >= F.col("lo")) & (v <= F.col("hi")))

    ends = [F.min("v").alias("lo"), F.max("v").alias("hi")]
    seen = rows.groupBy(F.when(v > 0, log).when(v < 0, -log).otherwise(F.lit(0).cast("long")).alias("b")).agg(n, *ends)  # 231 rows a power of ten at most
    seen = seen.withColumn("total", F.sum("n").over(W.partitionBy())).withColumn("base", F.lit(0).cast("long")).withColumn("wanted", ranks)
    part = F.when(F.col("hi") > F.col("lo"), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * 4096)).otherwise(F.lit(0).cast("long"))
    parts = within(holding(seen, [], "b")).groupBy(F.col("lo").alias("bucket"), "base", "wanted", part.alias("c")).agg(n, *ends)
    last = within(holding(parts, ["bucket"], "c")).groupBy(F.col("lo").alias("part"), "base", "wanted", "v").agg(n)
    found = holding(last, ["part"], "v").select("v", F.explode("wanted").alias("w")).select("v", "w.*")
    out = []
    for k in fractions:
        own = F.col("name") == k
        pos, low, high = F.max(F.when(own, F.col("pos"))), F.min(F.when(own, v)), F.max(F.when(own, v))
        out.append(F.when(low == high, low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high).alias(k))
    return found.agg(*out)


def display_range(values: DataFrame, symmetric: bool = False, by: list[str] | None = None) -> DataFrame:
    """(by, low, high) of each map's usable values: exact percentiles of one grid's values; without by, of all values, however many."""
    v = usable()
    if not by:
        if symmetric:
            return pooled_percentiles(values, F.abs(v), {"high": 0.99}).select((-F.col("high")).alias("low"), "high")
        return pooled_percentiles(values, v, {"low": 0.02, "high": 0.98})
    maps = values.groupBy(*by)
    if symmetric:
        top = F.percentile(F.abs(v), 0.99)
        return maps.agg((-top).alias("low"), top.alias("high"))
    return maps.agg(F.percentile(v, 0.02).alias("low"), F.percentile(v, 0.98).alias("high"))


def fullest_slice(mask: DataFrame) -> DataFrame:
    return mask.groupBy("z").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "z").limit(1)


# Sharing and cohort lists

SENSITIVE = ("subject_ids", "summaries", "subjects_file")


def strip_ids(reference: DataFrame) -> DataFrame:
    return reference.drop(*SENSITIVE)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether neither has a row that the other lacks, and that none of the sensitive columns is left in b."""
    cols = [c for c in a.columns if c in b.columns]
    extra = a.select(*cols).exceptAll(b.select(*cols)).unionByName(b.select(*cols).exceptAll(a.select(*cols)))
    return extra.agg((F.count("*") == 0).alias("same")).withColumn("clean", F.lit(not set(SENSITIVE) & set(b.columns)))


def cohort_filter(maps: DataFrame, ids: DataFrame) -> DataFrame:
    return maps.join(ids.select("subject").distinct(), "subject", "left_semi")


def missing_ids(maps: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("subject").distinct().join(maps.select("subject"), "subject", "left_anti")


def held_out(maps: DataFrame, ids: DataFrame) -> DataFrame:
    return maps.join(ids.select("subject"), "subject", "left_anti")


def common_mask(maps: DataFrame) -> DataFrame:
    """Voxels that every subject's map has."""
    n = maps.select("subject").distinct().agg(F.count("*").alias("__n"))
    return maps.groupBy(*VOXEL).agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).filter("k = __n").select(*VOXEL)


def mask_mismatch(maps: DataFrame, reference: DataFrame, neighbourhood: bool = False) -> DataFrame:
    """(subject, voxels, expected, warning): a map whose mask is not the reference's; worse for neighbourhood measures."""
    n = reference.filter("in_mask").agg(F.count("*").alias("expected"))
    note = "mask differs; neighbourhoods at its edge differ too" if neighbourhood else "mask differs"
    per = maps.groupBy("subject").agg(F.count("*").alias("voxels")).crossJoin(F.broadcast(n))
    return per.withColumn("warning", F.when(F.col("voxels") != F.col("expected"), note))


def batch_reference(maps: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The simple reference of the subjects with enough voxels, and a table of those left out with the reason."""
    size = maps.groupBy("subject").agg(F.count("*").alias("voxels"))
    errors = size.filter(F.col("voxels") < least).select("subject", F.concat(F.lit("only "), F.col("voxels"), F.lit(" voxels")).alias("reason"))
    return simple_reference(maps.join(size.filter(F.col("voxels") >= least), "subject", "left_semi")), errors


def synthetic_coupling(spark, subjects: int = 100, regions: int = 200, seed: int = 0) -> DataFrame:
    """(subject, region, value): made-up couplings around 0.3."""
    i = F.col("id")
    return spark.range(subjects * regions).select(F.floor(i / regions).alias("subject"), (i % regions).alias("region"), (0.3 + 0.1 * F.randn(seed)).alias("value"))


def checksums(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, sha256)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, ok): a missing or changed file is not ok."""
    return expected.join(checksums(files).withColumnRenamed("sha256", "found"), "path", "left").select("path", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))
