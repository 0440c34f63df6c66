"""Formulas against plain NumPy, properties that must hold, and the file formats' round trips."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom import config
from voxloom.functions.columns import normal_cdf, t_tails, t_two_sided
from voxloom.operators import cohort as C
from voxloom.operators import connect as N
from voxloom.operators import discovery as D
from voxloom.operators import measures as M
from voxloom.operators import series as S
from voxloom.operators import spatial as P
from voxloom.sources import images as I

RNG = np.random.Generator(np.random.PCG64(5))


def test_normal_cdf(spark):
    z = [-7.0, -3.0, -0.5, 0.0, 1.0, 2.5, 8.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert np.allclose(got, [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z], atol=1e-9)


@pytest.mark.parametrize("df", [1, 2, 3, 8, 89])
def test_t_tail(spark, df):
    x = np.linspace(0, 400, 4_000_001)
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    f = const * (1 + x**2 / df) ** (-(df + 1) / 2)
    for t in (0.0, 0.7, 2.3):
        k = int(round(t / (x[1] - x[0])))
        want = 1 - 2 * float(np.trapezoid(f[: k + 1], x[: k + 1]))
        got = spark.range(1).select(t_two_sided(F.lit(-t), df)).first()[0]
        assert abs(got - want) < 1e-6 and abs(t_tails(np.array([t]), df)[0] - got) < 1e-12


def test_spectral_properties():
    x = RNG.standard_normal((20, 100))
    a = S.alff()(x)
    assert np.allclose(S.alff()(x * 3)["falff"], a["falff"])
    assert np.allclose(S.alff()(x * 3)["alff"], 3 * a["alff"])
    assert (a["falff"] <= 1).all()
    whole = S.rsfa(low=0.0, high=10.0)(x)["rsfa"]
    assert np.allclose(whole, S.rsfa(bandpass=False)(x)["rsfa"])


def test_ranks_share_ties():
    assert S.ranks(np.array([[3.0, 1.0, 3.0, 2.0]])).tolist() == [[3.5, 1.0, 3.5, 2.0]]


def test_timescale_stops_before_first_fall():
    x = RNG.standard_normal((5, 80)).cumsum(1)
    for row, got in zip(x, S.timescale(1.0, 20)(x)["int_timescale"]):
        d = row - row.mean()
        total = 0.0
        for lag in range(1, 20):
            r = (d[:-lag] * d[lag:]).sum() / (d * d).sum()
            if r <= 0:
                break
            total += r
        assert abs(total - got) < 1e-9


def test_sample_entropy_against_loops():
    x = RNG.standard_normal(40)
    r, m = 0.5, 2
    some = more = 0
    for i in range(40 - m):
        for j in range(i + 1, 40 - m):
            if max(abs(x[i + k] - x[j + k]) for k in range(m)) < r:
                some += 1
                more += abs(x[i + m] - x[j + m]) < r
    assert abs(S.sample_entropy(x[None], m, np.array([r]))[0] + math.log(more / some)) < 1e-12


def _bold(spark, grid, n=40):
    rows = [(x, y, z, RNG.standard_normal(n).tolist()) for x in range(grid[0]) for y in range(grid[1]) for z in range(grid[2])]
    return spark.createDataFrame(rows, "x int, y int, z int, ts array<double>")


def test_reho_does_not_depend_on_blocks(spark):
    b = _bold(spark, (5, 4, 6))
    one = {(x, y, z): v for x, y, z, v in P.reho(b, (5, 4, 6)).collect()}
    many = {(x, y, z): v for x, y, z, v in P.reho(b, (5, 4, 6), block=3).collect()}
    assert one.keys() == many.keys() and len(one) == 120
    assert all(abs(v - many[k]) < 1e-12 for k, v in one.items())
    assert all(v == 0 for (x, y, z), v in one.items() if x in (0, 4) or y in (0, 3) or z in (0, 5))
    assert all(0 <= v <= 1 for v in one.values())


def test_reho_of_equal_series_is_one(spark):
    ts = RNG.standard_normal(30).tolist()
    b = spark.createDataFrame([(x, y, z, ts) for x in range(3) for y in range(3) for z in range(3)], "x int, y int, z int, ts array<double>")
    assert abs(P.reho(b, (3, 3, 3)).filter("x = 1 and y = 1 and z = 1").first().reho - 1) < 1e-9


def test_partial_correlation(spark):
    x = RNG.standard_normal((3, 200))
    x[2] = x[0] + x[1] + 0.5 * x[2]
    rows = [(i + 1, t, float(x[i, t])) for i in range(3) for t in range(200)]
    got = {(r.i, r.j): r.w for r in N.functional_connectivity(spark.createDataFrame(rows, "label int, t int, v double"), "partial_correlation").collect()}
    c = np.corrcoef(x)
    want = (c[0, 1] - c[0, 2] * c[1, 2]) / math.sqrt((1 - c[0, 2] ** 2) * (1 - c[1, 2] ** 2))
    assert abs(got[1, 2] - want) < 1e-9


def test_identical_matrices_couple(spark):
    m = RNG.random((15, 15))
    edges = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(15) for j in range(i + 1, 15)], "i int, j int, w double")
    both = N.align(edges, edges)
    assert N.global_coupling(both).first().value > 0.99
    assert N.regional_coupling(both).count() == 15
    few = both.filter("i < 2 and j < 3")
    assert [r.value for r in N.regional_coupling(few).collect()] == [None] * 3


def test_unknown_choices_raise(spark):
    with pytest.raises(ValueError):
        config.Config(fc_measure="no").check()
    with pytest.raises(ValueError):
        P.offsets(9)
    with pytest.raises(ValueError):
        N.guarded_correlation(spark.range(1), [], "a", "b", "kendall")
    assert config.scales("1, 2 3") == (1, 2, 3) and config.scales("x") == config.MSE_SCALES
    assert config.chosen_measures(["b", "a", "b", "q"], {"a", "b"}) == ["b", "a"]


def test_measure_registry(spark):
    b = _bold(spark, (4, 4, 4), 64)
    for key in M.MEASURES:
        got = M.compute(key, b, M.Parameters(low=0.05, high=0.2, mse_r=0.5))
        assert got.columns == ["x", "y", "z", "value"] and 0 < got.count() <= 64
    with pytest.raises(ValueError):
        M.compute("no", b)
    corner = spark.createDataFrame([(0, 0, 0, 1.0), (1, 1, 1, 0.0)], "x int, y int, z int, value double")
    assert [tuple(r)[:3] for r in M.compute("alff", b, mask=corner).collect()] == [(0, 0, 0)]


def test_build_and_compare(spark):
    v = 0.5 + 0.1 * RNG.standard_normal(100)
    cohort = spark.createDataFrame([(1, float(x)) for x in v], "region int, value double")
    ref = C.coupling_reference(cohort)
    at = lambda x: C.compare_subject(spark.createDataFrame([(1, x)], "region int, value double"), ref, ["region"]).first()
    assert abs(at(float(v.mean())).z) < 1e-9 and abs(at(float(v.mean())).percentile - 50) < 1e-6
    assert at(0.8).percentile > 95
    grid = spark.createDataFrame([(1, k / 100) for k in range(101)], "region int, value double")
    p = C.empirical_percentile(spark.createDataFrame([(1, 0.5)], "region int, value double"), grid, ["region"]).first().percentile
    assert abs(p - 50) < 2


def test_normalised_test_ignores_scale(spark):
    rows = [(s, x, y, 0, float(100 + 10 * RNG.standard_normal())) for s in range(12) for x in range(6) for y in range(6)]
    m = spark.createDataFrame(rows, "subject int, x int, y int, z int, value double")
    ref = C.voxel_reference(C.global_normalize(m.filter("subject > 0"), ["subject"]))
    one = m.filter("subject = 0")
    a = C.t_test(one, ref, 11, ["subject"], True).orderBy("x", "y").collect()
    b = C.t_test(one.withColumn("value", F.col("value") * 1.3), ref, 11, ["subject"], True).orderBy("x", "y").collect()
    assert np.allclose([r.t for r in a], [r.t for r in b])


def test_fdr_against_loops(spark):
    p = np.round(RNG.random(50) ** 3, 3)
    df = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(p)], "m int, k int, p double")
    got = {r.k: r.q for r in C.fdr(df, ["m"]).collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * 50 / np.arange(1, 51))[::-1])[::-1]
    assert np.allclose([got[k] for k in order], np.minimum(q, 1))


def test_nifti_and_tractograms():
    data = RNG.standard_normal((3, 4, 2, 5)).astype("f4").astype(float)
    a = np.array([[2.0, 0, 0, -90], [0, 2, 0, -126], [0, 0, 2, -72], [0, 0, 0, 1]])
    for compress in (True, False):
        got, affine = I.parse_nifti(I.nifti_bytes(data, a, compress))
        assert np.array_equal(got, data) and np.array_equal(affine, a)
    lines = [RNG.standard_normal((n, 3)).astype("f4") for n in (1, 4, 2)]
    back = I.parse_tck(I.tck_bytes(lines))
    assert len(back) == 3 and all(np.array_equal(x, y) for x, y in zip(lines, back))
    assert I.parse_tck(I.tck_bytes([])) == []
    head = bytearray(1000)
    head[:5] = b"TRACK"
    struct.pack_into("<3f", head, 12, 2, 2, 2)
    struct.pack_into("<16f", head, 440, *np.eye(4).ravel())
    struct.pack_into("<i", head, 996, 1000)
    raw = bytes(head) + struct.pack("<i6f", 2, 1, 1, 1, 3, 3, 3)
    assert np.allclose(I.parse_trk(raw)[0], [[0, 0, 0], [1, 1, 1]])


def test_files_from_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    data = RNG.standard_normal((2, 2, 2, 3)).astype("f4").astype(float)
    (tmp_path / "a" / "a_bold.nii.gz").write_bytes(I.nifti_bytes(data))
    (tmp_path / "g.bval").write_text("0 1000\n")
    (tmp_path / "g.bvec").write_text("0 1\n0 0\n0 0\n")
    rows = I.voxels(I.binary(spark, str(tmp_path), "*.nii.gz")).collect()
    assert len(rows) == 8 and all(np.allclose(r.ts, data[r.x, r.y, r.z]) for r in rows)
    assert I.gradients(spark, str(tmp_path / "g.bval"), str(tmp_path / "g.bvec")).orderBy("g").collect()[1].bx == 1.0
    assert D.listing(spark, str(tmp_path), "*.bv*").count() == 2
    ref = spark.createDataFrame([(0, 0, 0, 1.0)], "x int, y int, z int, mean double")
    I.save_reference(ref, str(tmp_path / "ref"), "alff")
    I.save_reference(ref, str(tmp_path / "ref"), "reho")
    assert I.load_reference(spark, str(tmp_path / "ref"), "alff").count() == 1


def test_flat_files_only_without_folders(spark):
    flat = [("s1_bold.nii.gz",), ("s2_rest.nii",)]
    got = D.bold_files(spark.createDataFrame(flat, "path string")).collect()
    assert {r.subject for r in got} == {"s1", "s2"}
    got = D.bold_files(spark.createDataFrame([*flat, ("s3/x.nii",), ("s3/a_bold.nii",)], "path string")).collect()
    assert [tuple(r) for r in got] == [("s3", "s3/a_bold.nii")]


def test_without_training_operators():
    """The library and its queries stand without the subpackage of training-data operators."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "voxloom"
    for f in root.rglob("*.py"):
        if root / "llm" not in f.parents:
            assert "llm" not in f.read_text()
