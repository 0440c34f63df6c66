"""Checks of shapes and files, splines against dense sums, and cohorts against one subject at a time."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom import config
from voxloom.functions.columns import safe_divide
from voxloom.operators import cohort as C
from voxloom.operators import connect as N
from voxloom.operators import discovery as D
from voxloom.operators import grids as G
from voxloom.operators import measures as M
from voxloom.operators import spatial as P
from voxloom.operators import tracts as T
from voxloom.sources import images as I

RNG = np.random.Generator(np.random.PCG64(9))


def _grid(spark, values, by=None):
    rows = [(by, *map(int, at), float(v)) for at, v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "subject long, x int, y int, z int, value double")


def test_settings():
    assert config.truthy("On") and config.truthy(" yes ") and config.truthy(1) and not config.truthy("off") and not config.truthy(None)
    assert config.scales("1, 2 4") == (1, 2, 4) and config.scales("1 x") == config.MSE_SCALES and config.scales(None) == config.MSE_SCALES
    p = config.parameters_of({"alff_tr": "2.0", "reho_cluster": "", "mse_scales": "1,3"})
    assert (p["tr"], p["cluster"], p["mse_scales"], p["max_lag"]) == (2.0, 27, (1, 3), 20)
    with pytest.raises(ValueError):
        config.parameters_of({"alff_tr": "fast"})
    assert set(config.COLOURS) == set(M.MEASURES) and config.colours("unheard of") == "viridis"
    with pytest.raises(ValueError):
        config.Config(coupling_metric="other").check()


def test_safe_divide(spark):
    got = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, -5.0)], "a double, b double").select(safe_divide(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0.5, 1e12, 0.0]


def test_grids_must_agree(spark):
    a, b = _grid(spark, np.ones((3, 2, 2)), 1), _grid(spark, np.ones((3, 2, 3)), 2)
    assert {(r.subject, r.mismatch) for r in G.grid_mismatch(a.unionByName(b), a, ["subject"]).collect()} == {(1, False), (2, True)}
    with pytest.raises(ValueError):
        G.require_same_grid((3, 2, 2), (3, 2, 3), "mask")
    with pytest.raises(ValueError):
        M.compute("alff", a, M.Parameters(shape=(3, 2, 2)), mask=b, mask_shape=(3, 2, 3))
    edges = spark.createDataFrame([(1, 2, 0.5)], "i int, j int, w double")
    with pytest.raises(ValueError):
        N.coupling(edges, edges, regions=(10, 8))


def test_spline_passes_through_values_and_polynomials():
    g = RNG.standard_normal((5, 6, 4))
    at = np.stack(np.unravel_index(np.arange(g.size), g.shape), 1).astype(float)
    assert np.allclose(P.spline(g, at), g.ravel())
    assert (P.spline(g, np.array([[-0.1, 0, 0], [0, 5.1, 0], [0, 0, 3.5]])) == 0).all()


def test_spline_against_a_dense_sum():
    """Coefficients solved in one dense system over all three axes at once."""
    shape = (4, 5, 3)
    g = RNG.standard_normal(shape)

    def kernel(t):
        t = np.abs(t)
        return np.where(t < 1, 2 / 3 - t**2 + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0))

    def basis(n, x):
        """Weights of the n coefficients at x, those beyond the ends folded back."""
        out = np.zeros(n)
        for k in range(-n, 2 * n):
            j = abs(k) % (2 * n - 2)
            out[j if j < n else 2 * n - 2 - j] += kernel(x - k)
        return out

    dense = np.array([np.einsum("i,j,k->ijk", *(basis(n, float(v)) for n, v in zip(shape, at))).ravel() for at in np.ndindex(shape)])
    coef = np.linalg.solve(dense, g.ravel())
    at = RNG.random((40, 3)) * (np.array(shape) - 1)
    want = [np.einsum("i,j,k->ijk", *(basis(n, v) for n, v in zip(shape, p))).ravel() @ coef for p in at]
    assert np.allclose(P.spline(g, at), want)


def test_resampled_maps_have_masks(spark):
    g = np.round(RNG.random((4, 4, 4)) + 0.5, 3)
    g[0] = 0
    maps = _grid(spark, g, 1).unionByName(_grid(spark, 2 * g, 2))
    same = {(r.subject, r.x, r.y, r.z): (r.value, r.in_mask) for r in P.resample_spline(maps, np.eye(4).tolist(), (4, 4, 4), (5, 4, 4), ["subject"]).collect()}
    assert len(same) == 2 * 80
    assert all(abs(v - k[0] * (g[k[1:]] if k[1] < 4 else 0)) < 1e-9 for k, (v, _) in same.items())
    assert all(m == (0 < k[1] < 4) for k, (_, m) in same.items())


def test_reho_options_change_the_series_first(spark):
    rows = [(x, y, z, (RNG.standard_normal(64) + np.arange(64) * x).tolist()) for x in range(3) for y in range(3) for z in range(3)]
    b = spark.createDataFrame(rows, "x int, y int, z int, ts array<double>")
    one = lambda **k: P.reho(b, (3, 3, 3), **k).filter("x = 1 and y = 1 and z = 1").first().reho
    flat = spark.createDataFrame([(x, y, z, (np.array(t) - np.polyval(np.polyfit(np.arange(64), t, 1), np.arange(64))).tolist()) for x, y, z, t in rows], b.schema)
    assert abs(one(detrend=True) - P.reho(flat, (3, 3, 3)).filter("x = 1 and y = 1 and z = 1").first().reho) < 1e-9
    assert abs(one(detrend=True) - one()) > 1e-3 and abs(one(band=(0.72, 0.01, 0.08)) - one()) > 1e-3
    p = M.Parameters(shape=(3, 3, 3), detrend=True, filter_band=True)
    assert abs(M.compute("reho", b, p).filter("x = 1 and y = 1 and z = 1").first().value - one(detrend=True, band=(0.72, 0.01, 0.08))) < 1e-12


def test_measures_of_a_cohort_are_those_of_each_subject(spark):
    rows = [(s, x, y, z, RNG.standard_normal(40).tolist()) for s in (1, 2) for x in range(3) for y in range(4) for z in range(3)]
    both = spark.createDataFrame(rows, "subject long, x int, y int, z int, ts array<double>")
    for measure in ("falff", "reho", "coherence_reho", "int"):
        p = M.Parameters(shape=(3, 4, 3))
        got = {tuple(r)[:4]: r.value for r in M.compute(measure, both, p, by=["subject"]).collect()}
        for s in (1, 2):
            for r in M.compute(measure, both.filter(F.col("subject") == s), p).collect():
                assert abs(got[s, r.x, r.y, r.z] - r.value) < 1e-12
    assert len({r.in_mask for r in M.measure_reference("falff", both, limit=1)[0].collect()}) == 1
    with pytest.raises(ValueError):
        M.measure_reference("nothing", both)


def test_streamlines_to_matrix(spark):
    """Two regions, three streamlines, an affine that is no unit matrix."""
    affine = [[2.0, 0, 0, 10], [0, 3.0, 0, -5], [0, 0, 1.0, 0], [0, 0, 0, 1]]
    atlas = spark.createDataFrame([(x, y, z, (1.0 if x < 2 else 2.0) if y else 0.0, 0.1 * x + 0.2) for x in range(4) for y in range(2) for z in range(2)], "x int, y int, z int, label double, fa double")
    lines = [[(0, 1, 0), (1, 1, 0), (3, 1, 0)], [(3, 1, 1), (0.4, 1, 1)], [(0, 0, 0), (3, 1, 0)], [(0, 1, 0), (1, 1, 0)]]
    pts = [(k, j, 2.0 * p[0] + 10, 3.0 * p[1] - 5, 1.0 * p[2]) for k, line in enumerate(lines) for j, p in enumerate(line)]
    points = spark.createDataFrame(pts, "sl long, ord int, px double, py double, pz double")
    got = T.structural_connectivity(points, affine, atlas, config.Config(fa_threshold=0.0), fa=atlas).collect()
    want = np.mean([np.mean([0.2, 0.3, 0.5]), np.mean([0.5, 0.24])])
    assert [(r.i, r.j) for r in got] == [(1, 2)] and abs(got[0].w - want) < 1e-9
    high = T.structural_connectivity(points, affine, atlas, config.Config(fa_threshold=0.25), fa=atlas).collect()
    assert abs(high[0].w - np.mean([np.mean([0.3, 0.5]), 0.5])) < 1e-9  # samples with a voxel under the limit are none
    for bad in ({"fa": None}, {"points": None}, {"config": config.Config(fa_measure="roi_fa")}, {"config": config.Config(fa_measure="x")}):
        with pytest.raises(ValueError):
            T.structural_connectivity(**{"points": points, "affine": affine, "atlas": atlas, "fa": atlas} | bad)


def test_matrix_from_diffusion_images(spark):
    g = RNG.standard_normal((12, 3))
    g = np.vstack([[0, 0, 0], g / np.linalg.norm(g, axis=1, keepdims=True)])
    b = [0.0] + [1000.0] * 12
    turn = np.linalg.qr(RNG.standard_normal((3, 3)))[0]
    tensor = turn @ np.diag([1.7e-3, 4e-4, 3e-4]) @ turn.T  # not along an axis
    signal = [float(1000 * np.exp(-b[k] * g[k] @ tensor @ g[k])) for k in range(13)]
    e = np.array([1.7e-3, 4e-4, 3e-4])
    fa = np.sqrt(1.5 * ((e - e.mean()) ** 2).sum() / (e**2).sum())
    dwi = spark.createDataFrame([(x, 0, 0, signal) for x in range(4)], "x int, y int, z int, ts array<double>")
    atlas = spark.createDataFrame([(x, 0, 0, 1 + x // 2) for x in range(4)], "x int, y int, z int, label int")
    points = spark.createDataFrame([(0, k, float(x), 0.0, 0.0) for k, x in enumerate((0, 3))], "sl long, ord int, px double, py double, pz double")
    tables = spark.createDataFrame(I.gradient_rows(b, g), "g int, bval double, bx double, by double, bz double")
    got = T.structural_connectivity(points, np.eye(4).tolist(), atlas, config.Config(fa_threshold=0.0), dwi=dwi, gradients=tables).collect()
    assert abs(got[0].w - fa) < 1e-6


def test_saving_a_reference_twice_keeps_it_once(spark, tmp_path):
    ref = _grid(spark, np.ones((2, 2, 2)), 1)
    for measure in ("alff", "reho", "alff"):
        I.save_reference(ref, str(tmp_path / "ref"), measure)
    assert I.load_reference(spark, str(tmp_path / "ref"), "alff").count() == 8 and spark.read.parquet(str(tmp_path / "ref")).count() == 16


def test_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        D.listing(spark, str(tmp_path / "nowhere"))
    (tmp_path / "s1").mkdir()
    for name in ("s1_mask.nii", "s1_T1w.nii.gz", "s1_bold.nii"):
        (tmp_path / "s1" / name).write_bytes(b"0")
    got = D.resolve(D.listing(spark, str(tmp_path)).withColumn("subject", F.lit("s1"))).first()
    assert got.dwi_mask_path.endswith("s1_mask.nii") and got.t1_path.endswith("s1_T1w.nii.gz") and got.fa_path is None


def test_null_keys_are_maps_of_their_own(spark):
    m = spark.createDataFrame([(None, 1, 2.0), (None, 1, 4.0), (5, None, 3.0)], "subject long, run int, value double")
    assert sorted(r.value for r in C.global_normalize(m, ["subject", "run"]).collect()) == [2 / 3, 1.0, 4 / 3]


def test_wrapped_maps_take_a_mask(spark):
    mean, sd = np.array([[[1.0, np.nan, 0.0, 2.0]]]), np.array([[[0.5, 0.5, 0.5, np.nan]]])
    mask = _grid(spark, np.array([[[1.0, 1.0, 1.0, 1.0]]]))
    args = _grid(spark, mean), _grid(spark, sd)
    assert C.wrap_group_map(*args, n=3).count() == 1 and C.wrap_group_map(*args, n=3, mask=mask).count() == 2
    assert C.wrap_group_map(*args, n=3, mask=mask.filter("z = 2")).first().z == 2


def test_histogram_of_values_that_are_none(spark):
    v = [1.0, 2.0, 3.0, 0.0, 0.0, None, float("nan"), float("inf")]
    got = C.histogram(spark.createDataFrame([(x,) for x in v], "value double"), 2).collect()
    assert sorted((r.bin, r.lo, r.n, r.excluded) for r in got) == [(0, 1.0, 1, 2), (1, 2.0, 2, 2)]


def test_streamlines_leave_in_bounded_batches():
    """Thousands of short streamlines fill few batches, a long one goes over several; numbers and places stay."""
    size = np.array([2, 1, 3] * 4000 + [2 * I.POINTS])
    points = RNG.standard_normal((size.sum(), 3)).astype("f4")
    trk = bytearray(1000)
    trk[:5] = b"TRACK"
    struct.pack_into("<3f", trk, 12, 2, 2, 2)
    struct.pack_into("<2h", trk, 36, 1, 0)
    struct.pack_into("<h", trk, 238, 2)
    struct.pack_into("<16f", trk, 440, *np.eye(4).ravel())
    struct.pack_into("<i", trk, 996, 1000)
    extended = np.hstack([points, np.ones((len(points), 1), "f4")])
    trk = bytes(trk) + b"".join(struct.pack("<i", len(p)) + p.tobytes() + struct.pack("<2f", 7, 8) for p in np.split(extended, np.cumsum(size)[:-1]))
    for raw, want in ((I.tck_of(points, size), points), (trk, points / 2 - 0.5)):
        got = list(I._streamlines([pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([raw])], ["path", "content"])]))
        assert len(got) == -(-len(points) // I.POINTS) and max(b.num_rows for b in got) <= I.POINTS
        t = pa.Table.from_batches(got)
        assert np.array_equal(t["sl"], np.repeat(np.arange(len(size)), size)) and np.array_equal(t["ord"], np.concatenate([np.arange(n) for n in size]))
        assert np.allclose(np.stack([t[c] for c in ("px", "py", "pz")], 1), want)
    with pytest.raises(ValueError):
        I.parse_trk(trk[:-16])


def test_no_join_deals_rows_by_subject_alone(spark):
    """A few subjects with many points each: choosing them must not put a subject's points in one task."""
    from conftest import SF

    from voxloom.plans import queries

    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.coupling_cohort(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    chosen = [line for line in plan.splitlines() if "Join" in line and "LeftSemi" in line]
    assert chosen and all("BroadcastHashJoin" in line for line in chosen)


def test_pooled_percentiles_are_exact_and_spread_out(spark):
    """Any spread of values against NumPy; no task holds all values of a cohort, as the percentile aggregate does."""
    wide = np.concatenate([RNG.standard_normal(3000) * 10.0 ** RNG.integers(-300, 300, 3000), [1e308, -1e308, 5e-324]])
    cases = [RNG.standard_normal(5001), wide, np.repeat([1.0, 2.0, 2.5], [10, 400, 30]), 1 + RNG.random(2000) * 1e-12, np.array([3.0]), np.array([-2.0, 7.0])]
    want = {"a": 0.02, "b": 0.5, "c": 0.98, "d": 0.0, "e": 1.0}
    for x in cases:
        got = C.pooled_percentiles(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "value double"), F.col("value"), want).first()
        for k, f in want.items():
            s, at = np.sort(x), f * (len(x) - 1)
            low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert got[k] == (low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high), (k, len(x))
    none = spark.createDataFrame([(0.0,), (None,), (float("nan"),)], "value double")
    assert [tuple(C.display_range(none, s).first()) for s in (False, True)] == [(None, None)] * 2
    plan = C.display_range(spark.createDataFrame([(1.0,)], "value double"))._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
