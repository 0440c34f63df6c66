"""One query for each operator over the stand-in tables; outputs are rounded to six places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import r6, to_mm
from ..operators import cohort as C
from ..operators import connect as N
from ..operators import discovery as D
from ..operators import grids as G
from ..operators import measures as M
from ..operators import series as S
from ..operators import spatial as P
from ..operators import tracts as T
from ..sources import images as I
from ..streaming import reference as R
from . import fixtures as X

SLOW_BAND = (0.05, 0.2)
MNI = [[2.0, 0.0, 0.0, -90.0], [0.0, 2.0, 0.0, -126.0], [0.0, 0.0, 2.0, -72.0], [0.0, 0.0, 0.0, 1.0]]
INVERSE = [[0.8, 0.0, 0.0, 0.3], [0.0, 0.9, 0.0, 0.45], [0.0, 0.0, 0.7, 0.2]]


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def _kernel(spark, sf, kernel, kinds: dict[str, str], keep: tuple[str, ...], name: str | None = None) -> DataFrame:
    df = S.apply(X.bold(spark, sf).filter(S.brain_mask()).select("vec_id", "ts"), kernel, kinds)
    df = _round(df, *[k for k, v in kinds.items() if v == "double"]).select("vec_id", *keep)
    return df.withColumnRenamed(keep[0], name) if name else df


def brain_mask(spark, sf):
    ts = F.when(F.col("vec_id") % 11 == 0, F.transform("ts", lambda v: v * 0)).when(F.col("vec_id") % 13 == 0, F.transform("ts", lambda v, k: F.when(k == 5, F.lit(float("nan"))).otherwise(v))).otherwise(F.col("ts"))
    return X.bold(spark, sf).withColumn("ts", ts).select("vec_id", "x", "y", "z", S.brain_mask().alias("in_mask"))


def masked_inflate(spark, sf):
    b = X.bold(spark, sf)
    mask = b.select("x", "y", "z", F.col("label").alias("value"))
    inside = S.explicit_mask(b, mask).select("x", "y", "z", F.get("ts", F.lit(0)).alias("value"))
    return _round(S.inflate(inside, b.select("x", "y", "z")), "value")


def _long(df, col):
    return df.select("vec_id", F.posexplode(col).alias("t", "v"))


def detrend(spark, sf):
    df = S.apply(X.bold(spark, sf).select("vec_id", "ts"), lambda x: {"d": S.detrend(x)}, {"d": "array<double>"})
    return _round(_long(df, "d"), "v")


def amp_spectrum(spark, sf):
    df = S.apply(X.bold(spark, sf).select("vec_id", "ts"), lambda x: {"a": S.amplitude(S.detrend(x))}, {"a": "array<double>"})
    return _round(_long(df, "a"), "v").withColumnRenamed("t", "k").withColumnRenamed("v", "amp")


def amp_spectrum_padded(spark, sf):
    df = X.bold(spark, sf).select("vec_id", F.slice("ts", 1, 60).alias("ts"))
    df = S.apply(df, lambda x: {"a": S.amplitude(S.detrend(x))}, {"a": "array<double>"})
    return _round(_long(df, "a"), "v").withColumnRenamed("t", "k").withColumnRenamed("v", "amp")


def alff(spark, sf):
    return _kernel(spark, sf, S.alff(), {"alff": "double"}, ("alff",))


def falff(spark, sf):
    return _kernel(spark, sf, S.alff(), {"falff": "double"}, ("falff",))


def alff_slow4(spark, sf):
    return _kernel(spark, sf, S.alff(config.TR, *config.SLOW4, S.slow_bins), {"alff": "double"}, ("alff",))


def alff_slow5(spark, sf):
    return _kernel(spark, sf, S.alff(config.TR, *config.SLOW5, S.slow_bins), {"alff": "double"}, ("alff",))


def falff_slow4(spark, sf):
    return _kernel(spark, sf, S.alff(config.TR, *config.SLOW4, S.slow_bins), {"falff_slow": "double"}, ("falff_slow",), "falff")


def falff_slow5(spark, sf):
    return _kernel(spark, sf, S.alff(config.TR, *config.SLOW5, S.slow_bins), {"falff_slow": "double"}, ("falff_slow",), "falff")


def rsfa(spark, sf):
    return _kernel(spark, sf, S.rsfa(), {"rsfa": "double"}, ("rsfa",))


def rsfa_nofilter(spark, sf):
    return _kernel(spark, sf, S.rsfa(bandpass=False), {"rsfa": "double"}, ("rsfa",))


def ideal_filter(spark, sf):
    df = S.apply(X.bold(spark, sf).select("vec_id", "ts"), lambda x: {"f": S.ideal_filter()(x)["ts"]}, {"f": "array<double>"})
    return _round(_long(df, "f"), "v")


def ranks(spark, sf):
    tied = X.bold(spark, sf).select("vec_id", F.transform("ts", lambda v: F.floor(v * 20).cast("double")).alias("ts"))
    return _long(S.apply(tied, lambda x: {"r": S.ranks(x)}, {"r": "array<double>"}), "r").withColumnRenamed("v", "r")


def _reho(cluster):
    def query(spark, sf):
        b = X.masked_bold(spark, sf)
        return _round(P.reho(b, X.shape(X.bold(spark, sf)), cluster), "reho")

    return query


reho_7, reho_19, reho_27 = _reho(7), _reho(19), _reho(27)


def acf(spark, sf):
    df = S.apply(X.bold(spark, sf).select("vec_id", "ts"), lambda x: {"a": S.autocorrelation(x, 20)}, {"a": "array<double>"})
    return _round(_long(df, "a"), "v").withColumnRenamed("t", "lag").withColumnRenamed("v", "acf")


def int_timescale(spark, sf):
    return _kernel(spark, sf, S.timescale(), {"int_timescale": "double"}, ("int_timescale",))


def coarse_grain(spark, sf):
    df = S.apply(X.bold(spark, sf).select("vec_id", "ts"), lambda x: {"c": S.coarse(x, 3)}, {"c": "array<double>"})
    return _round(_long(df, "c"), "v")


def _mse_scale(s):
    def query(spark, sf):
        return _kernel(spark, sf, S.multiscale_entropy((s,), r=0.5), {f"scale_{s}": "double"}, (f"scale_{s}",), "sampen")

    return query


mse_scale1, mse_scale2, mse_scale3, mse_scale4, mse_scale5 = map(_mse_scale, (1, 2, 3, 4, 5))


def mse(spark, sf):
    return _kernel(spark, sf, S.multiscale_entropy(r=0.5), {"mse": "double"}, ("mse",))


def mse_default_r(spark, sf):
    return _kernel(spark, sf, S.multiscale_entropy(), {"mse": "double"}, ("mse",))


def coherence_reho(spark, sf):
    return _round(P.coherence_reho(X.masked_bold(spark, sf), X.TR, *SLOW_BAND), "coherence_reho")


# Connectivity and coupling


def region_ts(spark, sf):
    return _round(N.region_timeseries(X.bold(spark, sf)), "v")


def _fc(spark, sf):
    return N.functional_connectivity(N.region_timeseries(X.bold(spark, sf)))


def fc_pearson(spark, sf):
    return _round(_fc(spark, sf), "w")


def fc_fisher(spark, sf):
    return _round(_fc(spark, sf).withColumn("w", N.fisher_z()), "w")


def fc_partial(spark, sf):
    return _round(N.functional_connectivity(N.region_timeseries(X.bold(spark, sf)), "partial_correlation"), "w")


def apply_threshold(spark, sf):
    return _round(X.fa(spark, sf).select("voxel", N.apply_threshold("fa", 0.2).alias("fa")), "fa")


def roi_fa(spark, sf):
    return _round(N.roi_fa(X.fa(spark, sf)), "fa")


def roi_fa_thr(spark, sf):
    return _round(N.roi_fa(X.fa(spark, sf), 0.2), "fa")


def roi_fa_bars(spark, sf):
    return _round(N.roi_fa(X.fa(spark, sf), 0.99).withColumn("fa", F.coalesce("fa", F.lit(0.0))), "fa")


def fa_stats(spark, sf):
    return _round(N.fa_stats(X.fa(spark, sf), 0.2), "mean_kept", "pct_kept")


def fa_sc(spark, sf):
    return _round(N.fa_connectivity(X.points(spark, sf)), "w")


def fa_sc_thr(spark, sf):
    return _round(N.symmetric(N.fa_connectivity(X.points(spark, sf), 0.2)), "w")


def _aligned(spark, sf):
    return N.align(N.fa_connectivity(X.points(spark, sf)), _fc(spark, sf))


def coupling_global_spearman(spark, sf):
    return _round(N.global_coupling(_aligned(spark, sf)), "value")


def coupling_global_pearson(spark, sf):
    return _round(N.global_coupling(_aligned(spark, sf), "pearson"), "value")


def coupling_regional(spark, sf):
    return _round(N.regional_coupling(_aligned(spark, sf)), "value")


def extract_subject(spark, sf):
    return _round(N.extract_subject(X.bold(spark, sf), X.points(spark, sf), config.Config(coupling_corr="pearson")), "value")


def matrix_range(spark, sf):
    fc = _fc(spark, sf)
    ranges = [N.matrix_range(df, s).withColumn("kind", F.lit(k)) for k, df, s in (("plain", fc, False), ("symmetric", fc, True), ("none", fc.filter("i = 0"), False), ("none symmetric", fc.filter("i = 0"), True))]
    return _round(ranges[0].unionByName(ranges[1]).unionByName(ranges[2]).unionByName(ranges[3]), "low", "high")


def sc_from_streamlines(spark, sf):
    """Streamlines in millimetres -> voxels -> end labels and FA samples -> matrices of five subjects."""
    volume = X.fa_volume(spark, sf)
    return _round(T.fa_weighted_connectivity(X.tracts(spark, sf), X.AFFINE, volume, volume, ["subject"], 0.1), "w")


def sc_nearest(spark, sf):
    volume = X.fa_volume(spark, sf)
    return _round(T.fa_weighted_connectivity(X.tracts(spark, sf), X.AFFINE, volume, volume, ["subject"], method="nearest"), "w")


def _coupled_cohort(spark, sf):
    volume = X.fa_volume(spark, sf)
    at = T.in_voxels(X.tracts(spark, sf), X.AFFINE)
    near = at.select("subject", "sl", "ord", *[F.floor(F.col(f"s{c}") + 0.5).cast("int").alias(c) for c in "xyz"])
    points = near.join(volume.withColumn("label", F.col("label") % 10), ["x", "y", "z"])
    subjects = D.resolve(X.files(spark, sf).filter("subject < 5").select("subject", "path"))
    return N.extract_cohort(subjects, X.cohort_bold(spark, sf), points, config.Config(coupling_corr="pearson", fa_threshold=0.0, fc_fisher_z=False), 9)


def coupling_cohort(spark, sf):
    return _round(_coupled_cohort(spark, sf)[0], "value")


def coupling_cohort_errors(spark, sf):
    return _coupled_cohort(spark, sf)[1]


def _measured(spark, sf):
    one = X.cohort_bold(spark, sf).withColumn("ts", F.when(F.col("subject") == 4, F.slice("ts", 1, 1)).otherwise(F.col("ts")))
    return M.measure_reference("alff", one)


def measure_cohort(spark, sf):
    """One measure over every subject, and the cohort's reference, in one plan."""
    return _round(_measured(spark, sf)[0], "mean", "sd")


def measure_cohort_errors(spark, sf):
    return _measured(spark, sf)[1]


def grid_mismatch(spark, sf):
    m = X.maps(spark, sf).filter("subject % 3 <> 0 or z < 7")
    return G.grid_mismatch(m, _reference(spark, sf), ["subject"])


def coupling_ref(spark, sf):
    return _round(C.coupling_reference(X.regional_values(spark, sf).filter("subject <> 0")), "mean", "sd")


def compare_subject(spark, sf):
    v = X.regional_values(spark, sf)
    ref = C.coupling_reference(v.filter("subject <> 0"))
    return _round(C.compare_subject(v.filter("subject = 0").select("region", "value"), ref, ["region"]).select("region", "value", "z", "percentile"), "value", "z", "percentile")


def empirical_pct(spark, sf):
    v = X.regional_values(spark, sf)
    return _round(C.empirical_percentile(v.filter("subject = 0").select("region", "value"), v.filter("subject <> 0"), ["region"]), "percentile")


# Cohort references


def ref_simple(spark, sf):
    return _round(C.simple_reference(X.cohort(X.maps(spark, sf))), "mean", "sd")


def summary(spark, sf):
    return _round(C.summaries(X.maps(spark, sf)), "summary")


def global_norm(spark, sf):
    return _round(C.global_normalize(X.maps(spark, sf), ["subject"]), "value")


def _normal_runs(spark, sf):
    return C.global_normalize(X.cohort(X.run_maps(spark, sf)), ["subject", "run"])


def ref_runs_separate(spark, sf):
    return _round(C.voxel_reference(_normal_runs(spark, sf)), "mean", "sd")


def ref_runs_average(spark, sf):
    return _round(C.voxel_reference(_normal_runs(spark, sf), "average"), "mean", "sd")


def cohort_size(spark, sf):
    m = _normal_runs(spark, sf)
    return C.cohort_size(m, m)


def cohort_size_average(spark, sf):
    m = _normal_runs(spark, sf)
    return C.cohort_size(m, C.voxel_reference(m, "average"), "average")


def slice_stats(spark, sf):
    return _round(C.slice_statistics(_normal_runs(spark, sf), ["subject", "run"], 20), "mean", "sd")


def _reference(spark, sf):
    return C.voxel_reference(C.global_normalize(X.cohort(X.maps(spark, sf)), ["subject"]))


def median_cv(spark, sf):
    return _round(C.median_cv(_reference(spark, sf)), "median_cv")


def wrap_group_map(spark, sf):
    ref = _reference(spark, sf)
    at = lambda c: ref.select("x", "y", "z", F.col(c).cast("double").alias("value"))
    return _round(C.wrap_group_map(at("mean"), at("sd"), at("n_obs")), "mean", "sd")


def _one(spark, sf):
    return X.maps(spark, sf).filter("subject = 0")


def zmap(spark, sf):
    return _round(_zmap(spark, sf), "score")


def _zmap(spark, sf):
    return C.z_map(C.global_normalize(_one(spark, sf), ["subject"]), _reference(spark, sf)).select(*C.VOXEL, "score")


def summary_pct(spark, sf):
    s = C.summaries(X.maps(spark, sf)).select("subject", F.col("summary").alias("value"))
    odd = F.when(F.col("subject") % 10 == 3, F.lit(None)).when(F.col("subject") % 10 == 4, F.lit(float("nan"))).otherwise(F.col("value"))
    return _round(C.summary_percentile(s.filter("subject = 0"), s.filter("subject % 10 <> 0").withColumn("value", odd)), "percentile")


def _n(spark, sf) -> DataFrame:
    return X.cohort(X.maps(spark, sf)).agg(F.count_distinct("subject").alias("n"))


def _tests(spark, sf):
    return C.t_test(X.held_out(X.maps(spark, sf)), _reference(spark, sf), _n(spark, sf), ["subject"], normalized=True)


def _fdr(spark, sf):
    return C.fdr(_tests(spark, sf), ["subject"])


def ttest(spark, sf):
    return _round(_tests(spark, sf).select("subject", "x", "y", "z", "t", "p"), "t", "p")


def fdr(spark, sf):
    return _round(_fdr(spark, sf).select("subject", "x", "y", "z", "q", "threshold"), "q", "threshold")


def diff_map(spark, sf):
    return _round(C.difference(_one(spark, sf), C.voxel_reference(X.cohort(X.maps(spark, sf)))).select("x", "y", "z", "diff"), "diff")


def diff_summary(spark, sf):
    ref, one = C.voxel_reference(X.cohort(X.maps(spark, sf))), _one(spark, sf)
    rows = [C.difference_summary(one, ref), C.difference_summary(one.filter("x < 0"), ref), C.difference_summary(one, ref, False)]
    named = [r.withColumn("kind", F.lit(k)) for k, r in zip(("shared", "empty", "other grid"), rows)]
    return _round(named[0].unionByName(named[1]).unionByName(named[2]), "subject_mean", "group_mean")


def t_summary(spark, sf):
    return _round(C.t_summary(_fdr(spark, sf), ["subject"]), "mean_t", "max_abs_t", "p_pct", "q_pct", "p_threshold", "sd_t", "obs_chance")


def peaks(spark, sf):
    top = C.peaks(_fdr(spark, sf), ["subject"])
    mm = [c.alias(f"m{a}") for c, a in zip(to_mm(MNI), "xyz")]
    return _round(top.select("subject", "rank", "side", "t", *mm), "t")


def calibration(spark, sf):
    return _round(C.calibration(_tests(spark, sf), ["subject"]), "mean_t", "sd_t", "obs_chance")


def map_agreement(spark, sf):
    m = X.maps(spark, sf)
    return _round(C.agreement(m.filter("subject = 1"), m.filter("subject = 2")), "max_diff", "mean_diff", "r")


def group_average(spark, sf):
    return _round(C.group_average(C.global_normalize(X.held_out(X.maps(spark, sf)), ["subject"])), "value")


def map_stats(spark, sf):
    return _round(C.map_stats(X.maps(spark, sf), ["subject"]), "mean", "median")


def mode_choice(spark, sf):
    """References of a cohort, of one subject with a repeated run, and of one map."""
    m = X.run_maps(spark, sf)
    parts = [(0, "subject % 10 <> 0"), (1, "subject = 1"), (2, "subject = 2 and run = 0")]
    named = [m.filter(w).withColumn("measure", F.lit(k)) for k, w in parts]
    return C.mode(C.reference_facts(named[0].unionByName(named[1]).unionByName(named[2]), ["measure"]))


# Charts' data


def hist40(spark, sf):
    """With zeros and values that are none among the others."""
    odd = F.when(F.col("x") == 1, 0.0).when(F.col("y") == 2, F.lit(float("nan"))).when(F.col("z") == 3, F.lit(None)).otherwise(F.col("value"))
    return _round(C.histogram(X.maps(spark, sf).withColumn("value", odd), 40), "lo")


def cohort_hist(spark, sf):
    v = X.regional_values(spark, sf)
    own, rest = v.filter("subject = 0").select("region", "value"), v.filter("subject <> 0")
    both = [C.cohort_histogram(own, rest).withColumn("region", F.lit(-1)), C.cohort_histogram(own, rest, 3).withColumn("region", F.lit(3))]
    return _round(both[0].unionByName(both[1]), "lo", "own", "percentile")


def slice_profile(spark, sf):
    slices = C.slice_statistics(X.cohort(X.maps(spark, sf)), ["subject"], 10)
    return _round(C.slice_profile(_one(spark, sf), slices, 10), "value", "mean", "low", "high")


def montage(spark, sf):
    return C.montage(X.maps(spark, sf))


def range_2_98(spark, sf):
    return _round(C.display_range(X.maps(spark, sf)), "low", "high")


def range_symmetric(spark, sf):
    return _round(C.display_range(C.difference(_one(spark, sf), C.voxel_reference(X.cohort(X.maps(spark, sf)))).select(F.col("diff").alias("value")), True), "low", "high")


def fullest_slice(spark, sf):
    return C.fullest_slice(X.held_out(X.maps(spark, sf)))


def affine_mm(spark, sf):
    b = X.bold(spark, sf)
    return b.select("vec_id", *[c.alias(f"m{a}") for c, a in zip(to_mm(MNI), "xyz")])


# Sharing, cohort lists, discovery, resampling


def _ref_with_ids(spark, sf):
    return C.voxel_reference(X.cohort(X.maps(spark, sf))).withColumn("subject_ids", F.lit("a b")).withColumn("summaries", F.lit(1.0))


def strip_ids(spark, sf):
    return _round(C.strip_ids(_ref_with_ids(spark, sf)), "mean", "sd")


def strip_verify(spark, sf):
    ref = _ref_with_ids(spark, sf)
    changed = C.strip_ids(ref).withColumn("sd", F.when(F.col("x") == 2, F.col("sd") + 1).otherwise(F.col("sd")))
    cases = {"stripped": C.strip_ids(ref), "not stripped": ref, "changed": changed, "short": C.strip_ids(ref).filter("x <> 3")}
    out = [C.same_rows(ref, df).withColumn("case", F.lit(k)) for k, df in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _ids(spark, sf):
    return X.table(spark, sf, "supplier").filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 5).alias("subject"))


def cohort_filter(spark, sf):
    return C.cohort_filter(X.maps(spark, sf), _ids(spark, sf)).groupBy("subject").agg(F.count("*").alias("voxels"))


def cohort_missing(spark, sf):
    return C.missing_ids(X.maps(spark, sf), _ids(spark, sf))


def held_out(spark, sf):
    return C.held_out(X.maps(spark, sf), _ids(spark, sf)).groupBy("subject").agg(F.count("*").alias("voxels"))


def subject_id_norm(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("_finproc.nii.gz", "_bold.nii", "_rest.nii.gz", "_clean.nii", ".nii.gz")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s = X.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("data/sub"), "s_suppkey", suffix).alias("path"))
    return s.select("s_suppkey", D.subject_id().alias("subject"))


def discovery(spark, sf):
    return D.bold_files(X.files(spark, sf).select("path"))


def resolve_files(spark, sf):
    return D.resolve(X.files(spark, sf))


def conformance(spark, sf):
    return D.conformance(D.resolve(X.files(spark, sf))).select("subject", F.array_join("problems", "; ").alias("problems"))


def region_count(spark, sf):
    return D.region_problem(X.fa(spark, sf), 24)


def _volume(spark, sf):
    return C.global_normalize(_one(spark, sf), ["subject"]).select("x", "y", "z", "value")


def _target(spark):
    n = spark.range(300)
    return n.select(F.floor(F.col("id") / 50).cast("int").alias("x"), (F.floor(F.col("id") / 10) % 5).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("z"))


def resample_nearest(spark, sf):
    return _round(P.resample(_volume(spark, sf), INVERSE, _target(spark), "nearest"), "value")


def resample_trilinear(spark, sf):
    return _round(P.resample(_volume(spark, sf), INVERSE, _target(spark)), "value")


def tensor_fa(spark, sf):
    """FA of signals made from the FA table's own tensors: the fit gives them back."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    g = rng.standard_normal((12, 3))
    g = np.vstack([[0, 0, 0], g / np.linalg.norm(g, axis=1, keepdims=True)])
    b = [0.0] + [1000.0] * 12
    d1, d2 = F.lit(0.0005) + F.col("fa") * 0.001, F.lit(0.0005)
    signal = F.array(*[F.lit(1000.0) * F.exp(-b[k] * (d1 * float(g[k, 0] ** 2) + d2 * float(g[k, 1] ** 2 + g[k, 2] ** 2))) for k in range(13)])
    return _round(N.tensor_fa(X.fa(spark, sf).select("voxel", signal.alias("signal")), b, g.tolist()), "fa")


def common_mask(spark, sf):
    return C.common_mask(X.held_out(X.maps(spark, sf)))


def mask_mismatch(spark, sf):
    return C.mask_mismatch(X.held_out(X.maps(spark, sf)), _reference(spark, sf), True)


def batch_reference(spark, sf):
    return _round(C.batch_reference(X.cohort(X.maps(spark, sf)), 190)[0], "mean", "sd")


def batch_reference_errors(spark, sf):
    return C.batch_reference(X.cohort(X.maps(spark, sf)), 190)[1]


def synthetic_coupling_ref(spark, sf):
    """Made-up couplings have the mean and spread they are made with, and no other."""
    ref = C.coupling_reference(C.synthetic_coupling(spark)).select("region", "n", "mean", "sd")
    return ref.select("region", "n", (F.abs(F.col("mean") - 0.3) < 0.05).alias("mean_ok"), (F.abs(F.col("sd") - 0.1) < 0.03).alias("sd_ok"), (F.abs(F.col("mean") - 0.4) < 0.05).alias("other_mean"), (F.col("sd") > 0.2).alias("other_sd"))


def _contents(spark, sf):
    return X.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_name").cast("binary").alias("content"))


def checksums(spark, sf):
    return C.checksums(_contents(spark, sf))


def checksum_verify(spark, sf):
    files = _contents(spark, sf)
    expected = C.checksums(files).withColumn("sha256", F.when(F.col("path") == "p9", "changed").otherwise(F.col("sha256")))
    return C.verify_checksums(files.filter(F.col("path") != "p7"), expected)


def compute_measure(spark, sf):
    """Three measures through the registry, over an explicit mask."""
    b = X.bold(spark, sf)
    mask = b.select("x", "y", "z", F.col("label").alias("value"))
    parts = [M.compute(k, b, M.Parameters(cluster=7), mask).select(F.lit(k).alias("measure"), "x", "y", "z", "value") for k in ("alff", "rsfa", "int")]
    return _round(parts[0].unionByName(parts[1]).unionByName(parts[2]), "value")


# Sources and sinks, through bytes


def nifti_scan(spark, sf):
    """Maps written as images and read again; values are float32 there."""
    m = X.maps(spark, sf).withColumn("value", F.col("value").cast("float").cast("double"))
    back = I.voxels(I.images(m, "subject", (5, 5, 8)))
    out = back.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("subject"), "x", "y", "z", F.get("ts", F.lit(0)).alias("value"))
    return _round(out.withColumn("value", F.col("value").cast("float").cast("double")).filter("value <> 0").withColumn("value", F.round("value", 3)), "value")


def tractogram_scan(spark, sf):
    """Orders as streamlines, their lines as points: 64 .tck files written and read again."""
    import numpy as np
    import pyarrow as pa

    lines = X.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 64).alias("file"), "l_orderkey", "l_linenumber", "l_partkey")

    def pack(t):
        key, number, part = (t[c].to_numpy() for c in ("l_orderkey", "l_linenumber", "l_partkey"))
        order = np.lexsort((part, number, key))
        start = np.flatnonzero(np.diff(key[order], prepend=-1))
        points = np.stack([number[order], part[order] % 100, np.zeros(len(order))], 1)
        return pa.table({"path": [str(t["file"][0].as_py())], "content": [I.tck_of(points, np.diff(start, append=len(order)))]})

    back = I.streamlines(lines.groupBy("file").applyInArrow(pack, "path string, content binary"))
    return back.select(F.col("path").cast("long").alias("file"), "sl", "ord", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"))


def _folder(spark, name: str) -> str:
    """A folder of this run's own that all executors see; a local one only in a local session without spark.checkpoint.dir."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="voxloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def gradient_scan(spark, sf):
    """The regions' keys as b-values and directions: two text files written, and read again."""
    r = X.table(spark, sf, "region").orderBy("r_regionkey").select(F.col("r_regionkey").alias("k"))
    line = lambda c: F.concat_ws("  ", F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("v")))), lambda x: x["v"].cast("string")))
    rows = [line(F.col("k") * 1000.0), line(F.col("k") / 10), line(F.col("k") * 0.5), line(1.0 - F.col("k"))]
    text = r.agg(*[x.alias(f"l{k}") for k, x in enumerate(rows)])
    root = _folder(spark, "gradients")
    text.select("l0").coalesce(1).write.text(f"{root}/bval")
    text.select(F.explode(F.array("l1", "l2", "l3"))).coalesce(1).write.text(f"{root}/bvec")
    return I.gradients(spark, f"{root}/bval", f"{root}/bvec")


def reference_table(spark, sf):
    """Two measures saved, one of them twice: each is read back once."""
    root, ref = _folder(spark, "reference"), _reference(spark, sf)
    for measure in ("alff", "rsfa", "alff"):
        I.save_reference(ref, root, measure)
    return _round(I.load_reference(spark, root, "alff"), "mean", "sd")


def stats_bundle(spark, sf):
    """The t, p, q and mask images of the held-out maps, written as files and scanned again."""
    root = _folder(spark, "bundle")
    I.save_files(I.bundle(_fdr(spark, sf), "subject", (5, 5, 8)), root)
    back = I.voxels(I.binary(spark, root, "*.nii.gz")).select(F.regexp_extract("path", r"/(\d+)/", 1).cast("long").alias("subject"), F.regexp_extract("path", r"([a-z]+)\.nii", 1).alias("image"), F.get("ts", F.lit(0)).alias("v"))
    return back.groupBy("subject", "image").agg(F.count(F.when(F.abs("v") > 1e-6, 1)).alias("set"), F.round(F.sum("v"), 1).alias("total"))


def npz_roundtrip(spark, sf):
    ref = C.voxel_reference(C.global_normalize(X.cohort(X.maps(spark, sf)), ["subject"])).filter("in_mask")
    return _round(I.npz_reference(spark, I.reference_npz(ref, (5, 5, 8), 90, "alff")), "mean", "sd")


def synthetic_bold(spark, sf):
    return _round(I.synthetic_bold(spark, (6, 6, 6), 16).select("x", "y", "z", F.posexplode("ts").alias("t", "v")), "v")


def stream_reference(spark, sf):
    """The batch reference, from a stream of map files."""
    root = _folder(spark, "stream")
    X.cohort(X.maps(spark, sf)).repartition(8, "subject").write.parquet(f"{root}/maps")
    return _round(R.run_to_end(spark, f"{root}/maps", f"{root}/reference", f"{root}/state"), "mean", "sd")


def flagship(spark, sf):
    """Mask, measure and map statistics in one plan: a subject's broadband amplitude."""
    a = S.apply(X.bold(spark, sf).filter(S.brain_mask()).select("x", "y", "z", "ts"), S.alff(), {"alff": "double"})
    return _round(C.map_stats(a.select(F.lit("alff").alias("measure"), F.col("alff").alias("value")), ["measure"]), "mean", "median")


def queries() -> dict:
    skip = {"Column", "DataFrame", "queries", "r6", "to_mm"}
    return {k: v for k, v in globals().items() if callable(v) and not k.startswith("_") and k not in skip}
