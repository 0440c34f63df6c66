"""DuckDB SQL with the same results as the queries, written from the definitions, not from the plans."""

from __future__ import annotations

from itertools import product

from .. import config
from ..operators import spatial
from . import queries as Q

# Stand-in tables

BOLD = "bold AS (SELECT vec_id, CAST(vec_id // 100 AS INTEGER) AS x, CAST((vec_id // 10) % 10 AS INTEGER) AS y, CAST(vec_id % 10 AS INTEGER) AS z, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS ts FROM embeddings)"
LONG = BOLD + ", long AS (SELECT vec_id, x, y, z, label, CAST(u - 1 AS INTEGER) AS t, ts[u] AS v FROM bold, range(1, 65) r(u))"
FLAT = "flat AS (SELECT *, v - (regr_intercept(v, t) OVER w + regr_slope(v, t) OVER w * t) AS d FROM long WINDOW w AS (PARTITION BY vec_id))"
PLACE = "CAST(v // 40 AS INTEGER) AS x, CAST((v // 8) % 5 AS INTEGER) AS y, CAST(v % 8 AS INTEGER) AS z, value / 977::DOUBLE * CASE WHEN subject % 10 = 0 AND v BETWEEN 100 AND 104 THEN 3::DOUBLE ELSE 1::DOUBLE END AS value"
MAPS = f"maps AS (SELECT subject, {PLACE} FROM (SELECT l_suppkey AS subject, l_partkey % 200 AS v, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL))"
RUNS = f"runs AS (SELECT subject, run, {PLACE} FROM (SELECT l_suppkey AS subject, CAST(l_linenumber % 2 AS INTEGER) AS run, l_partkey % 200 AS v, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL) WHERE subject % 10 <> 0), nruns AS (SELECT subject, run, x, y, z, value / avg(value) OVER (PARTITION BY subject, run) AS value FROM runs)"
REF = MAPS + ", nmaps AS (SELECT subject, x, y, z, value / avg(value) OVER (PARTITION BY subject) AS value FROM maps), ref AS (SELECT x, y, z, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n_obs FROM nmaps WHERE subject % 10 <> 0 GROUP BY ALL), good AS (SELECT * FROM ref WHERE n_obs >= 2 AND sd > 0)"
FA = "fa AS (SELECT p_partkey AS voxel, CASE WHEN n = 25 THEN 0 ELSE n END AS label, p_size / 50::DOUBLE AS fa FROM (SELECT *, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS n FROM part))"
POINTS = FA + ", points AS (SELECT l_orderkey AS sl, l_linenumber::BIGINT * 100000000 + l_partkey AS ord, label, fa FROM lineitem JOIN fa ON voxel = l_partkey)"
REGION = "region AS (SELECT label, t, avg(v) AS v FROM long WHERE label <> 0 GROUP BY ALL), fc AS (SELECT a.label AS i, b.label AS j, corr(a.v, b.v) AS w FROM region a JOIN region b ON a.t = b.t AND a.label < b.label GROUP BY ALL)"
VALUES = "vals AS (SELECT c_custkey % 50 AS subject, c_nationkey AS region, avg(c_acctbal) AS value FROM customer GROUP BY ALL)"


def r(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE AS {name or x}"


def sc(limit: float = 0.0) -> str:
    sample = f"CASE WHEN fa >= {limit}::DOUBLE THEN fa END" if limit else "fa"
    return f"{POINTS}, line AS (SELECT sl, arg_min(label, ord) AS a, arg_max(label, ord) AS b, avg({sample}) AS fa FROM points GROUP BY sl), sc AS (SELECT least(a, b) AS i, greatest(a, b) AS j, avg(fa) AS w FROM line WHERE a <> 0 AND b <> 0 AND a <> b GROUP BY ALL)"


def spectrum(n: int = 64) -> str:
    """Amplitudes of the detrended series: a plain discrete Fourier sum, padded to 64."""
    flat = FLAT if n == 64 else FLAT.replace("FROM long", f"FROM (SELECT * FROM long WHERE t < {n})")
    return f"{LONG}, {flat}, amp AS (SELECT vec_id, CAST(k AS INTEGER) AS k, sqrt(pow(sum(d * cos(2 * pi() * k * t / 64)), 2) + pow(sum(d * sin(2 * pi() * k * t / 64)), 2)) * 2 / {n} AS amp FROM flat, range(0, 33) q(k) GROUP BY ALL)"


def band(lo: int, hi: int, name: str, fraction: bool) -> str:
    inside = f"FILTER (WHERE k BETWEEN {lo} AND {hi})"
    x = f"sum(amp) {inside} / greatest(sum(amp) FILTER (WHERE k >= 1), 1e-12)" if fraction else f"avg(amp) {inside}"
    return f"WITH {spectrum()} SELECT vec_id, {r(x, name)} FROM amp GROUP BY vec_id"


def reho(cluster: int) -> str:
    near = " UNION ALL ".join(f"SELECT {a} AS dx, {b} AS dy, {c} AS dz" for a, b, c in spatial.offsets(cluster).tolist())
    return f"""WITH {LONG}, m AS (SELECT * FROM long WHERE label <> 0),
rk AS (SELECT vec_id, x, y, z, t, rank() OVER (PARTITION BY vec_id ORDER BY v) + (count(*) OVER (PARTITION BY vec_id, v) - 1) / 2.0::DOUBLE AS r FROM m),
off AS ({near}), s AS (SELECT a.x, a.y, a.z, b.t, sum(b.r) AS r, count(*) AS k FROM (SELECT DISTINCT x, y, z FROM m) a, off JOIN rk b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL),
w AS (SELECT x, y, z, 12 * var_pop(r) * count(*) / (max(k) * max(k) * (pow(count(*), 3) - count(*)) + 1e-8) AS w FROM s GROUP BY ALL),
g AS (SELECT max(x) AS gx, max(y) AS gy, max(z) AS gz FROM bold)
SELECT x, y, z, {r("CASE WHEN x IN (0, gx) OR y IN (0, gy) OR z IN (0, gz) THEN 0 ELSE w END", "reho")} FROM w, g"""


def sampen(scale: int, rr: float = 0.5) -> str:
    """Common table expressions ending in e{scale} (vec_id, value)."""
    n = 64 // scale
    return f"""c{scale} AS (SELECT vec_id, CAST(t // {scale} AS INTEGER) AS t, avg(d) AS v FROM flat WHERE t < {n * scale} GROUP BY ALL),
a{scale} AS (SELECT vec_id, t, v, lead(v) OVER (PARTITION BY vec_id ORDER BY t) AS v1, lead(v, 2) OVER (PARTITION BY vec_id ORDER BY t) AS v2 FROM c{scale}),
p{scale} AS (SELECT a.vec_id, count(*) FILTER (WHERE abs(a.v - b.v) < tol AND abs(a.v1 - b.v1) < tol) AS n_some, count(*) FILTER (WHERE abs(a.v - b.v) < tol AND abs(a.v1 - b.v1) < tol AND abs(a.v2 - b.v2) < tol) AS more
  FROM a{scale} a JOIN a{scale} b ON a.vec_id = b.vec_id AND a.t < b.t JOIN (SELECT vec_id, {rr}::DOUBLE * stddev_pop(d) AS tol FROM flat GROUP BY vec_id) q ON q.vec_id = a.vec_id WHERE a.v2 IS NOT NULL AND b.v2 IS NOT NULL GROUP BY a.vec_id),
e{scale} AS (SELECT vec_id, CASE WHEN n_some = 0 THEN 0 WHEN more = 0 THEN NULL ELSE -ln(more / n_some::DOUBLE) END AS value FROM p{scale})"""


def mse(rr: float) -> str:
    each = ",\n".join(sampen(s, rr) for s in config.MSE_SCALES)
    union = " UNION ALL ".join(f"SELECT * FROM e{s}" for s in config.MSE_SCALES)
    return f"WITH {LONG}, {FLAT}, {each} SELECT vec_id, {r('avg(value)', 'mse')} FROM ({union}) GROUP BY vec_id"


def coherence() -> str:
    near = " UNION ALL ".join(f"SELECT {k} AS slot, {a} AS dx, {b} AS dy, {c} AS dz" for k, (a, b, c) in enumerate(spatial.offsets(27).tolist()))
    return f"""WITH {LONG}, m AS (SELECT * FROM long WHERE label <> 0),
seg AS (SELECT vec_id, x, y, z, s, t - s * 16 AS u, v - avg(v) OVER (PARTITION BY vec_id, s) AS v FROM m, range(0, 3) q(s) WHERE t BETWEEN s * 16 AND s * 16 + 31),
win AS (SELECT *, v * 0.5::DOUBLE * (1 - cos(2 * pi() * (u + 1) / 33)) AS w FROM seg),
f AS (SELECT vec_id, x, y, z, s, k, sum(w * cos(2 * pi() * k * u / 32)) AS re, -sum(w * sin(2 * pi() * k * u / 32)) AS im FROM win, range(2, 5) q(k) GROUP BY ALL),
p AS (SELECT vec_id, sum(re * re + im * im) AS p FROM f GROUP BY vec_id),
off AS ({near}), vox AS (SELECT DISTINCT vec_id, x, y, z FROM m),
mem AS (SELECT a.vec_id AS centre, slot, b.vec_id AS v FROM vox a, off JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
pairs AS (SELECT a.centre, a.v AS va, b.v AS vb FROM mem a JOIN mem b ON a.centre = b.centre AND a.slot < b.slot),
uniq AS (SELECT DISTINCT va, vb FROM pairs),
coh AS (SELECT va, vb, (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.im * b.re - a.re * b.im), 2)) / greatest(max(pa.p) * max(pb.p), 1e-12) AS c
  FROM uniq JOIN f a ON a.vec_id = va JOIN f b ON b.vec_id = vb AND b.s = a.s AND b.k = a.k JOIN p pa ON pa.vec_id = va JOIN p pb ON pb.vec_id = vb GROUP BY va, vb)
SELECT x, y, z, {r("avg(c)", "coherence_reho")} FROM vox LEFT JOIN pairs ON centre = vox.vec_id LEFT JOIN coh USING (va, vb) GROUP BY vox.vec_id, x, y, z"""


def spearman(by: str, table: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT {by}, {rank('s')} AS rs, {rank('f')} AS rf FROM {table} WHERE s IS NOT NULL AND f IS NOT NULL"


ALIGNED = f"{LONG}, {REGION}, {sc()}, al AS (SELECT fc.i, fc.j, fc.w AS f, CASE WHEN sc.i IS NULL THEN 0 ELSE sc.w END AS s, 1 AS one FROM fc LEFT JOIN sc USING (i, j))"


TESTS = (
    REF
    + """, n AS (SELECT count(DISTINCT subject) AS n FROM maps WHERE subject % 10 <> 0),
steps AS (SELECT i, CASE WHEN i = 0 THEN 0::DOUBLE WHEN (n - 1) % 2 = 1 THEN ln(2 * i / (2 * i + 1)::DOUBLE) ELSE ln((2 * i - 1) / (2 * i)::DOUBLE) END AS l FROM n, range(0, 2000) q(i) WHERE i <= CASE WHEN (n - 1) % 2 = 1 THEN (n - 1 - 3) // 2 ELSE (n - 1) // 2 - 1 END),
coefs AS (SELECT i, exp(sum(l) OVER (ORDER BY i)) AS c FROM steps),
own AS (SELECT subject, x, y, z, value / avg(value) OVER (PARTITION BY subject) AS value, mean, sd FROM maps JOIN good USING (x, y, z) WHERE subject % 10 = 0),
tv AS (SELECT row_number() OVER (ORDER BY subject, x, y, z) AS id, subject, x, y, z, n, (value - mean) / (sd * sqrt((n + 1)::DOUBLE / n)) AS t FROM own, n),
th AS (SELECT *, atan(abs(t) / sqrt(n - 1)) AS th FROM tv),
ser AS (SELECT id, sum(c * pow(cos(th), 2 * i)) AS s FROM th, coefs GROUP BY id),
tests AS (SELECT subject, x, y, z, t, greatest(0::DOUBLE, 1 - CASE WHEN (n - 1) % 2 = 1 THEN 2 / pi() * (th + sin(th) * cos(th) * s) ELSE sin(th) * s END) AS p FROM th JOIN ser USING (id)),
rk AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY p) + count(*) OVER (PARTITION BY subject, p) - 1 AS k, count(*) OVER (PARTITION BY subject) AS m FROM tests),
fdr AS (SELECT subject, x, y, z, t, p, least(1::DOUBLE, min(p * m / k) OVER (PARTITION BY subject ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q,
  coalesce(max(CASE WHEN p <= k / m::DOUBLE * 0.05::DOUBLE THEN p END) OVER (PARTITION BY subject), 0) AS threshold FROM rk)"""
)


def phi(z: str) -> str:
    """Normal distribution function by the series of odd products, its terms made by logarithms."""
    return f"CASE WHEN {z} > 6 THEN 1::DOUBLE WHEN {z} < -6 THEN 0::DOUBLE ELSE 0.5::DOUBLE + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * sign({z}) * (SELECT sum(CASE WHEN {z} = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs({z})) - o) END) FROM odd) END"


ODD = "odd AS (SELECT k, sum(ln(2 * k + 1)) OVER (ORDER BY k) AS o FROM range(0, 120) q(k))"


def hist(table: str, bins: int) -> str:
    return f"e AS (SELECT min(value) AS lo, (max(value) - min(value)) / {bins} AS w FROM {table}), h AS (SELECT CAST(bin AS INTEGER) AS bin, {r('lo + bin * w', 'lo')}, n FROM (SELECT CASE WHEN w > 0 THEN least(floor((value - lo) / w), {bins - 1}) ELSE 0 END AS bin, lo, w, count(*) AS n FROM {table}, e GROUP BY ALL))"


#: Points of the made-up streamlines in voxels, their nearest voxels' labels and their FA samples.
TRACTS = FA + """, vol AS (SELECT CAST(voxel // 400 AS INTEGER) AS x, CAST((voxel // 20) % 20 AS INTEGER) AS y, CAST(voxel % 20 AS INTEGER) AS z, label, fa / 0.977::DOUBLE AS fa FROM fa),
pts AS (SELECT l_orderkey % 5 AS subject, l_orderkey AS sl, l_linenumber::BIGINT * 100000000 + l_partkey AS ord, l_partkey // 400 + 0.1::DOUBLE + (l_linenumber % 5) * 0.05::DOUBLE AS sx, (l_partkey // 20) % 20 + 0.3::DOUBLE - (l_linenumber % 3) * 0.1::DOUBLE AS sy, l_partkey % 20 + 0.2::DOUBLE AS sz,
  CAST(l_partkey // 400 AS INTEGER) AS x, CAST((l_partkey // 20) % 20 AS INTEGER) AS y, CAST(l_partkey % 20 AS INTEGER) AS z FROM lineitem),
near AS (SELECT pts.*, label, fa FROM pts JOIN vol USING (x, y, z)),
ends AS (SELECT subject, sl, arg_min(label, ord) AS a, arg_max(label, ord) AS b FROM near GROUP BY ALL)"""


def tract_edges(samples: str) -> str:
    """Edge weights from samples (subject, sl, fa)."""
    return f"line AS (SELECT subject, sl, avg(fa) AS fa FROM ({samples}) GROUP BY ALL) SELECT subject, least(a, b) AS i, greatest(a, b) AS j, {r('avg(fa)', 'w')} FROM ends JOIN line USING (subject, sl) WHERE a <> 0 AND b <> 0 AND a <> b GROUP BY ALL"


def trilinear(limit: float) -> str:
    corners = " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, {c} AS c" for a, b, c in product((0, 1), repeat=3))
    weight = " * ".join(f"abs(1 - {o} - (s{c} - floor(s{c})))" for o, c in zip("abc", "xyz"))
    one = f"SELECT subject, sl, ord, CASE WHEN NOT coalesce(bool_or(fa < {limit}::DOUBLE), false) THEN sum(coalesce(fa, 0) * {weight}) END AS fa FROM pts CROSS JOIN ({corners}) c LEFT JOIN vol ON vol.x = floor(sx) + a AND vol.y = floor(sy) + b AND vol.z = floor(sz) + c GROUP BY ALL"
    return f"SELECT subject, sl, fa FROM ({one})"


def fc_partial(n: int = 9) -> str:
    """Minus the scaled inverse of the covariance, by sweeping one region after the other."""
    steps = ["m0 AS MATERIALIZED (SELECT a.label AS i, b.label AS j, covar_samp(a.v, b.v) AS a FROM region a JOIN region b USING (t) GROUP BY ALL)"]
    for k in range(1, n + 1):
        m = f"m{k - 1}"
        steps.append(f"m{k} AS MATERIALIZED (SELECT m.i, m.j, CASE WHEN m.i = {k} AND m.j = {k} THEN -1 / p.a WHEN m.i = {k} THEN c.a / p.a WHEN m.j = {k} THEN r.a / p.a ELSE m.a - r.a * c.a / p.a END AS a FROM {m} m JOIN {m} r ON r.i = m.i AND r.j = {k} JOIN {m} c ON c.i = {k} AND c.j = m.j JOIN {m} p ON p.i = {k} AND p.j = {k})")
    return f"WITH {LONG}, {REGION}, {', '.join(steps)} SELECT m.i, m.j, {r('m.a / sqrt(p.a * q.a)', 'w')} FROM m{n} m JOIN m{n} p ON p.i = m.i AND p.j = m.i JOIN m{n} q ON q.i = m.j AND q.j = m.j WHERE m.i < m.j"


#: Five subjects' series: labels moved on, the second one without every fifth voxel.
COHORT_FC = LONG + """, cl AS (SELECT k AS subject, (label + k) % 10 AS label, t, v FROM long, range(5) q(k) WHERE k <> 1 OR vec_id % 5 <> 0),
creg AS (SELECT subject, label, t, avg(v) AS v FROM cl WHERE label <> 0 GROUP BY ALL),
cfc AS (SELECT a.subject, a.label AS i, b.label AS j, corr(a.v, b.v) AS f FROM creg a JOIN creg b ON a.subject = b.subject AND a.t = b.t AND a.label < b.label GROUP BY ALL)"""


TARGET = "tgt AS (SELECT CAST(i // 50 AS INTEGER) AS x, CAST((i // 10) % 5 AS INTEGER) AS y, CAST(i % 10 AS INTEGER) AS z FROM range(0, 300) q(i))"


def _source(k: int) -> str:
    a = Q.INVERSE[k]
    return " + ".join(f"{v}::DOUBLE * {c}" for v, c in zip(a[:3], "xyz")) + f" + {a[3]}::DOUBLE"


FILES = "files AS (SELECT s_suppkey AS subject, 's' || s_suppkey || '/s' || s_suppkey || sfx AS path FROM supplier, (SELECT unnest(['_bold.nii.gz', '_rest.nii', '_FA.nii.gz', '_dwi.nii.gz', '.bval', '.bvec', '.trk', '_mask.nii.gz', '_T1w.nii']) AS sfx, unnest(range(9)) AS k) q WHERE (s_suppkey + k) % 5 <> 0)"
RESOLVED = FILES + ", res AS (SELECT subject, " + ", ".join(f"min(path) FILTER (WHERE regexp_matches(path, '{p}')) AS {k}" for k, p in Q.D.LAYOUT.items()) + " FROM files GROUP BY subject)"
IDS = "ids AS (SELECT s_suppkey + 5 AS subject FROM supplier WHERE s_suppkey % 3 = 0)"


def _mm(k: int) -> str:
    a = Q.MNI[k]
    return " + ".join(f"{v}::DOUBLE * {c}" for v, c in zip(a[:3], "xyz")) + f" + {a[3]}::DOUBLE"


MM = ", ".join(f"{_mm(k)} AS m{c}" for k, c in enumerate("xyz"))
SLICES = "sl AS (SELECT z, avg(m) AS mean, coalesce(stddev_samp(m), 0) AS sd, count(*) AS n FROM (SELECT {by}, z, avg(value) AS m FROM {t} GROUP BY ALL HAVING count(*) >= {least}) GROUP BY z)"
PER_T = "SELECT subject, avg(t) AS mean_t, max(abs(t)) AS max_abs_t, count(*) AS tested, count(*) FILTER (WHERE p < 0.05::DOUBLE) AS p_hits, count(*) FILTER (WHERE q < 0.05::DOUBLE) AS q_hits, max(threshold) AS p_threshold, stddev_pop(t) AS sd_t FROM fdr GROUP BY subject"


def oracle_sql() -> dict[str, str]:
    out = {
        "brain_mask": f"WITH {BOLD} SELECT vec_id, x, y, z, NOT (vec_id % 11 = 0 OR vec_id % 13 = 0) AS in_mask FROM bold",
        "masked_inflate": f"WITH {BOLD} SELECT x, y, z, {r('CASE WHEN label <> 0 THEN ts[1] ELSE 0 END', 'value')} FROM bold",
        "detrend": f"WITH {LONG}, {FLAT} SELECT vec_id, t, {r('d', 'v')} FROM flat",
        "amp_spectrum": f"WITH {spectrum()} SELECT vec_id, k, {r('amp')} FROM amp",
        "amp_spectrum_padded": f"WITH {spectrum(60)} SELECT vec_id, k, {r('amp')} FROM amp",
        "alff": band(1, 3, "alff", False),
        "falff": band(1, 3, "falff", True),
        "alff_slow4": band(2, 3, "alff", False),
        "alff_slow5": band(1, 1, "alff", False),
        "falff_slow4": band(2, 3, "falff", True),
        "falff_slow5": band(1, 1, "falff", True),
        "rsfa": f"WITH {spectrum()} SELECT vec_id, {r('sqrt(sum(2 * pow(amp * 32, 2)) FILTER (WHERE k BETWEEN 1 AND 3) / (64 * 63))', 'rsfa')} FROM amp GROUP BY vec_id",
        "rsfa_nofilter": f"WITH {LONG}, {FLAT} SELECT vec_id, {r('stddev_samp(d)', 'rsfa')} FROM flat GROUP BY vec_id",
        "ideal_filter": f"""WITH {LONG}, f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * t / 64)) AS re, sum(v * sin(2 * pi() * k * t / 64)) AS im FROM long, range(1, 4) q(k) GROUP BY ALL)
SELECT vec_id, CAST(t AS INTEGER) AS t, {r("sum(2 * (re * cos(2 * pi() * k * t / 64) + im * sin(2 * pi() * k * t / 64))) / 64", "v")} FROM f, range(0, 64) q(t) GROUP BY vec_id, t""",
        "ranks": f"WITH {LONG}, q AS (SELECT vec_id, t, floor(v * 20) AS v FROM long) SELECT vec_id, t, rank() OVER (PARTITION BY vec_id ORDER BY v) + (count(*) OVER (PARTITION BY vec_id, v) - 1) / 2.0::DOUBLE AS r FROM q",
        "reho_7": reho(7), "reho_19": reho(19), "reho_27": reho(27),
        "acf": f"""WITH {LONG}, c AS (SELECT vec_id, t, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM long)
SELECT a.vec_id, CAST(lag AS INTEGER) AS lag, {r("sum(a.v * b.v) / max(s)", "acf")} FROM c a, range(0, 21) q(lag) JOIN c b ON b.vec_id = a.vec_id AND b.t = a.t + lag JOIN (SELECT vec_id, sum(v * v) AS s FROM c GROUP BY vec_id) n ON n.vec_id = a.vec_id GROUP BY a.vec_id, lag""",
        "int_timescale": f"""WITH {LONG}, c AS (SELECT vec_id, t, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM long),
a AS (SELECT a.vec_id, lag, sum(a.v * b.v) AS s FROM c a, range(1, 20) q(lag) JOIN c b ON b.vec_id = a.vec_id AND b.t = a.t + lag GROUP BY a.vec_id, lag),
n AS (SELECT vec_id, sum(v * v) AS n FROM c GROUP BY vec_id), f AS (SELECT vec_id, coalesce(min(lag) FILTER (WHERE s <= 0), 99) AS stop FROM a GROUP BY vec_id)
SELECT vec_id, {r("0.72::DOUBLE * coalesce(sum(s / n) FILTER (WHERE lag < stop), 0)", "int_timescale")} FROM a JOIN n USING (vec_id) JOIN f USING (vec_id) GROUP BY vec_id""",
        "coarse_grain": f"WITH {LONG} SELECT vec_id, CAST(t // 3 AS INTEGER) AS t, {r('avg(v)', 'v')} FROM long WHERE t < 63 GROUP BY vec_id, t // 3",
        "mse": mse(0.5), "mse_default_r": mse(0.15),
        "coherence_reho": coherence(),
        "region_ts": f"WITH {LONG}, {REGION} SELECT label, t, {r('v')} FROM region",
        "fc_pearson": f"WITH {LONG}, {REGION} SELECT i, j, {r('w')} FROM fc",
        "fc_fisher": f"WITH {LONG}, {REGION} SELECT i, j, {r('atanh(greatest(least(w, 0.999999::DOUBLE), -0.999999::DOUBLE))', 'w')} FROM fc",
        "apply_threshold": f"WITH {FA} SELECT voxel, {r('CASE WHEN fa < 0.2::DOUBLE THEN 0 ELSE fa END', 'fa')} FROM fa",
        "roi_fa": f"WITH {FA} SELECT label, {r('avg(fa)', 'fa')} FROM fa WHERE label <> 0 GROUP BY label",
        "roi_fa_thr": f"WITH {FA} SELECT label, {r('avg(fa) FILTER (WHERE fa >= 0.2::DOUBLE)', 'fa')} FROM fa WHERE label <> 0 GROUP BY label",
        "roi_fa_bars": f"WITH {FA} SELECT label, {r('coalesce(avg(fa) FILTER (WHERE fa >= 0.99::DOUBLE), 0)', 'fa')} FROM fa WHERE label <> 0 GROUP BY label",
        "fa_stats": f"WITH {FA} SELECT before, after, {r('mean_kept')}, {r('100::DOUBLE * after / before', 'pct_kept')} FROM (SELECT count(*) FILTER (WHERE fa > 0) AS before, count(*) FILTER (WHERE fa >= 0.2::DOUBLE) AS after, avg(fa) FILTER (WHERE fa >= 0.2::DOUBLE) AS mean_kept FROM fa)",
        "fa_sc": f"WITH {sc()} SELECT i, j, {r('w')} FROM sc",
        "fa_sc_thr": f"WITH {sc(0.2)} SELECT i, j, {r('w')} FROM sc UNION ALL SELECT j, i, {r('w')} FROM sc",
        "coupling_global_spearman": f"WITH {ALIGNED}, q AS ({spearman('one', 'al')}) SELECT {r('CASE WHEN count(*) >= 3 THEN corr(rs, rf) END', 'value')} FROM q",
        "coupling_global_pearson": f"WITH {ALIGNED} SELECT {r('CASE WHEN count(*) >= 3 THEN corr(s, f) END', 'value')} FROM al WHERE s IS NOT NULL",
        "coupling_regional": f"WITH {ALIGNED}, ab AS (SELECT i AS region, s, f FROM al UNION ALL SELECT j, s, f FROM al), q AS ({spearman('region', 'ab')}) SELECT region, {r('CASE WHEN count(*) >= 3 THEN corr(rs, rf) END', 'value')} FROM q GROUP BY region",
        "extract_subject": f"WITH {LONG}, {REGION}, {sc(0.2)}, al AS (SELECT fc.i, fc.j, atanh(greatest(least(fc.w, 0.999999::DOUBLE), -0.999999::DOUBLE)) AS f, CASE WHEN sc.i IS NULL THEN 0 ELSE sc.w END AS s FROM fc LEFT JOIN sc USING (i, j)), ab AS (SELECT i AS region, s, f FROM al UNION ALL SELECT j, s, f FROM al) SELECT region, {r('CASE WHEN count(*) >= 3 THEN corr(s, f) END', 'value')} FROM ab WHERE s IS NOT NULL GROUP BY region",
        "matrix_range": f"WITH {LONG}, {REGION} SELECT 'plain' AS kind, {r('min(w)', 'low')}, {r('max(w)', 'high')} FROM fc UNION ALL SELECT 'symmetric', round(-max(abs(w)), 6), round(max(abs(w)), 6) FROM fc UNION ALL SELECT 'none', 0, 1 UNION ALL SELECT 'none symmetric', -1, 1",
        "coupling_ref": f"WITH {VALUES} SELECT region, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, count(*) AS n FROM vals WHERE subject <> 0 GROUP BY region",
        "compare_subject": f"WITH {VALUES}, {ODD}, g AS (SELECT region, avg(value) AS mean, stddev_samp(value) AS sd FROM vals WHERE subject <> 0 GROUP BY region), s AS (SELECT region, value, (value - mean) / sd AS zz FROM vals JOIN g USING (region) WHERE subject = 0) SELECT region, {r('value')}, {r('zz', 'z')}, {r('100 * (' + phi('zz') + ')', 'percentile')} FROM s",
        "empirical_pct": f"WITH {VALUES} SELECT a.region, {r('100::DOUBLE * count(*) FILTER (WHERE b.value < a.value) / count(*)', 'percentile')} FROM vals a JOIN vals b ON a.region = b.region AND b.subject <> 0 WHERE a.subject = 0 GROUP BY a.region",
        "ref_simple": f"WITH {MAPS}, c AS (SELECT * FROM maps WHERE subject % 10 <> 0), n AS (SELECT count(DISTINCT subject) AS n FROM c), vox AS (SELECT DISTINCT x, y, z FROM c), sub AS (SELECT DISTINCT subject FROM c), full_ AS (SELECT x, y, z, coalesce(value, 0) AS value, value IS NOT NULL AS there FROM vox CROSS JOIN sub LEFT JOIN c USING (subject, x, y, z)) SELECT x, y, z, {r('avg(value)', 'mean')}, {r('coalesce(stddev_samp(value), 0)', 'sd')}, bool_and(there) AS in_mask FROM full_ GROUP BY x, y, z",
        "summary": f"WITH {MAPS} SELECT subject, {r('avg(value)', 'summary')} FROM maps GROUP BY subject",
        "global_norm": f"WITH {REF} SELECT subject, x, y, z, {r('value')} FROM nmaps",
        "ref_runs_separate": f"WITH {RUNS} SELECT x, y, z, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, count(*) AS n_obs, coalesce(count(*) >= 2 AND stddev_samp(value) > 0, false) AS in_mask FROM nruns GROUP BY x, y, z",
        "ref_runs_average": f"WITH {RUNS}, k AS (SELECT subject, count(DISTINCT run) AS k FROM runs GROUP BY subject), s AS (SELECT subject, x, y, z, sum(value) / max(k) AS value FROM nruns JOIN k USING (subject) GROUP BY ALL) SELECT x, y, z, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, count(*) AS n_obs, coalesce(count(*) >= 2 AND stddev_samp(value) > 0, false) AS in_mask FROM s GROUP BY x, y, z",
        "cohort_size": "SELECT count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey % 10 <> 0",
        "cohort_size_average": f"WITH {RUNS}, s AS (SELECT x, y, z, count(DISTINCT subject) AS k FROM nruns GROUP BY ALL) SELECT quantile_cont(k, 0.5) AS n FROM s WHERE k >= 2",
        "slice_stats": f"WITH {RUNS}, {SLICES.format(by='subject, run', t='nruns', least=20)} SELECT z, {r('mean')}, {r('sd')}, n FROM sl",
        "median_cv": f"WITH {REF} SELECT {r('quantile_cont(sd / mean, 0.5)', 'median_cv')} FROM good",
        "wrap_group_map": f"WITH {REF} SELECT x, y, z, {r('mean')}, {r('sd')}, (SELECT max(n_obs) FROM ref) AS n FROM ref",
        "zmap": f"WITH {REF} SELECT x, y, z, {r('(value - mean) / sd', 'score')} FROM nmaps JOIN good USING (x, y, z) WHERE subject = 0",
        "summary_pct": f"WITH {MAPS}, s AS (SELECT subject, avg(value) AS v FROM maps GROUP BY subject) SELECT {r('100::DOUBLE * count(*) FILTER (WHERE v < (SELECT v FROM s WHERE subject = 0)) / count(*)', 'percentile')} FROM s WHERE subject % 10 NOT IN (0, 3, 4)",
        "ttest": f"WITH {TESTS} SELECT subject, x, y, z, {r('t')}, {r('p')} FROM tests",
        "fdr": f"WITH {TESTS} SELECT subject, x, y, z, {r('q')}, {r('threshold')} FROM fdr",
        "diff_map": f"WITH {MAPS}, g AS (SELECT x, y, z, avg(value) AS mean FROM maps WHERE subject % 10 <> 0 GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(value) > 0) SELECT x, y, z, {r('value - mean', 'diff')} FROM maps JOIN g USING (x, y, z) WHERE subject = 0",
        "t_summary": f"WITH {TESTS}, s AS ({PER_T}) SELECT subject, {r('mean_t')}, {r('max_abs_t')}, tested, p_hits, {r('100::DOUBLE * p_hits / tested', 'p_pct')}, q_hits, {r('100::DOUBLE * q_hits / tested', 'q_pct')}, {r('p_threshold')}, {r('sd_t')}, {r('p_hits / (0.05::DOUBLE * tested)', 'obs_chance')}, p_hits / (0.05::DOUBLE * tested) < 0.5 OR sd_t < 0.7 AS warning FROM s",
        "peaks": f"WITH {TESTS}, h AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM fdr WHERE q < 0.05::DOUBLE) SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY abs(t) DESC, x, y, z) AS INTEGER) AS rank, CASE WHEN t > 0 THEN 'above' ELSE 'below' END AS side, {r('t')}, {MM} FROM h WHERE n <= 20",
        "calibration": f"WITH {TESTS}, s AS (SELECT subject, avg(t) AS m, stddev_pop(t) AS s, count(*) FILTER (WHERE p < 0.05::DOUBLE) / (0.05::DOUBLE * count(*)) AS r FROM tests GROUP BY subject), a AS (SELECT count(*) AS maps, quantile_cont(m, 0.5) AS m, quantile_cont(s, 0.5) AS s, quantile_cont(r, 0.5) AS r FROM s) SELECT maps, {r('m', 'mean_t')}, {r('s', 'sd_t')}, {r('r', 'obs_chance')}, CASE WHEN s < 0.7 THEN 'sd too small' WHEN s > 1.4 THEN 'sd too large' WHEN r > 1.5 THEN 'too many' WHEN r < 0.5 THEN 'too few' ELSE 'calibrated' END AS verdict FROM a",
        "map_agreement": f"WITH {MAPS}, ab AS (SELECT a.value AS a, b.value AS b FROM maps a JOIN maps b USING (x, y, z) WHERE a.subject = 1 AND b.subject = 2) SELECT {r('max(abs(a - b))', 'max_diff')}, {r('avg(abs(a - b))', 'mean_diff')}, {r('corr(a, b)', 'r')}, CASE WHEN max(abs(a - b)) < 1e-4 OR corr(a, b) > 0.9999 THEN 'MATCH' ELSE 'DIFFERENT' END AS verdict FROM ab",
        "group_average": f"WITH {REF} SELECT x, y, z, {r('avg(value)', 'value')}, count(*) AS covered FROM nmaps WHERE subject % 10 = 0 AND (SELECT count(DISTINCT subject) FROM nmaps WHERE subject % 10 = 0) >= 2 GROUP BY x, y, z",
        "map_stats": f"WITH {MAPS} SELECT subject, {r('avg(value)', 'mean')}, {r('quantile_cont(value, 0.5)', 'median')}, count(*) AS voxels FROM maps GROUP BY subject",
        "mode_choice": f"WITH rm AS (SELECT l_suppkey AS subject, CAST(l_linenumber % 2 AS INTEGER) AS run, l_partkey % 200 AS v, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL), p AS (SELECT 0 AS measure, * FROM rm WHERE subject % 10 <> 0 UNION ALL SELECT 1, * FROM rm WHERE subject = 1 UNION ALL SELECT 2, * FROM rm WHERE subject = 2 AND run = 0), s AS (SELECT measure, coalesce(bool_or(sd > 0), false) AS has_sd FROM (SELECT measure, v, stddev_samp(value) AS sd FROM p GROUP BY ALL) GROUP BY measure), c AS (SELECT measure, count(DISTINCT subject) AS n FROM p GROUP BY measure) SELECT measure, has_sd, n, has_sd AND n > 1 AS can_ttest, CASE WHEN has_sd AND n > 1 THEN 't' WHEN has_sd THEN 'z' ELSE 'diff' END AS mode FROM s JOIN c USING (measure)",
        "hist40": f"WITH {MAPS}, kept AS (SELECT CASE WHEN x = 1 THEN 0 ELSE value END AS value FROM maps WHERE x = 1 OR (y <> 2 AND z <> 3)), m AS (SELECT value FROM kept WHERE value <> 0), {hist('m', 40)} SELECT bin, lo, n, (SELECT count(*) FROM kept WHERE value = 0) AS excluded FROM h",
        "cohort_hist": " UNION ALL ".join(f"SELECT * FROM (WITH {VALUES}, p AS (SELECT subject, avg(value) AS value FROM vals {w} GROUP BY subject), c AS (SELECT * FROM p WHERE subject <> 0), o AS (SELECT value AS v FROM p WHERE subject = 0), {hist('c', 25)} SELECT bin, lo, n, round((SELECT v FROM o), 6) AS own, CASE WHEN (SELECT v FROM o) IS NOT NULL THEN round((SELECT 100::DOUBLE * count(*) FILTER (WHERE value < (SELECT v FROM o)) / count(*) FROM c), 6) END AS percentile, {k} AS region FROM h)" for k, w in ((-1, ""), (3, "WHERE region = 3"))),
        "slice_profile": f"WITH {MAPS}, co AS (SELECT * FROM maps WHERE subject % 10 <> 0), {SLICES.format(by='subject', t='co', least=10)}, p AS (SELECT z, avg(value) AS value FROM maps WHERE subject = 0 GROUP BY z HAVING count(*) >= 10) SELECT z, {r('value')}, {r('mean')}, {r('mean - sd', 'low')}, {r('mean + sd', 'high')} FROM p JOIN sl USING (z) WHERE sd > 0 AND n >= 2",
        "montage": f"WITH {MAPS}, e AS (SELECT min(z) AS a, max(z) AS b FROM maps) SELECT CAST(i AS INTEGER) AS tile, CAST(floor(a + i * (b - a) / 23::DOUBLE) AS INTEGER) AS z FROM e, range(0, 24) q(i)",
        "range_2_98": f"WITH {MAPS} SELECT {r('quantile_cont(value, 0.02)', 'low')}, {r('quantile_cont(value, 0.98)', 'high')} FROM maps",
        "range_symmetric": f"WITH {MAPS}, g AS (SELECT x, y, z, avg(value) AS mean FROM maps WHERE subject % 10 <> 0 GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(value) > 0), d AS (SELECT abs(value - mean) AS v FROM maps JOIN g USING (x, y, z) WHERE subject = 0) SELECT {r('-quantile_cont(v, 0.99)', 'low')}, {r('quantile_cont(v, 0.99)', 'high')} FROM d WHERE v <> 0",
        "fullest_slice": f"WITH {MAPS} SELECT z, count(*) AS n FROM maps WHERE subject % 10 = 0 GROUP BY z ORDER BY n DESC, z LIMIT 1",
        "affine_mm": f"WITH {BOLD} SELECT vec_id, {MM} FROM bold",
        "strip_ids": f"WITH {MAPS} SELECT x, y, z, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, count(*) AS n_obs, coalesce(count(*) >= 2 AND stddev_samp(value) > 0, false) AS in_mask FROM maps WHERE subject % 10 <> 0 GROUP BY x, y, z",
        "strip_verify": "SELECT * FROM (VALUES ('stripped', true, true), ('not stripped', true, false), ('changed', false, true), ('short', false, true)) q(\"case\", same, clean)",
        "cohort_filter": f"WITH {MAPS}, {IDS} SELECT subject, count(*) AS voxels FROM maps WHERE subject IN (SELECT subject FROM ids) GROUP BY subject",
        "cohort_missing": f"WITH {MAPS}, {IDS} SELECT subject FROM ids EXCEPT SELECT subject FROM maps",
        "held_out": f"WITH {MAPS}, {IDS} SELECT subject, count(*) AS voxels FROM maps WHERE subject NOT IN (SELECT subject FROM ids) GROUP BY subject",
        "subject_id_norm": "SELECT s_suppkey, 'sub' || s_suppkey AS subject FROM supplier",
        "discovery": f"WITH {FILES} SELECT 's' || subject AS subject, arg_min(path, (CASE WHEN contains(path, 'bold') THEN '0' ELSE '1' END) || path) AS path FROM files WHERE regexp_matches(path, '\\.nii(\\.gz)?$') GROUP BY subject",
        "resolve_files": f"WITH {RESOLVED} SELECT * FROM res",
        "conformance": f"WITH {RESOLVED} SELECT subject, concat_ws('; ', CASE WHEN bold_path IS NULL THEN 'no BOLD file' END, CASE WHEN fa_path IS NULL AND dwi_path IS NULL THEN 'neither FA nor DWI file' END, CASE WHEN tractogram_path IS NULL THEN 'no tractogram' END) AS problems FROM res",
        "region_count": f"WITH {FA} SELECT count(DISTINCT label) AS regions, count(DISTINCT label) = 24 AS ok FROM fa WHERE label <> 0",
        "resample_nearest": f"WITH {REF}, {TARGET}, pos AS (SELECT x AS tx, y AS ty, z AS tz, " + ", ".join(f"round_even({_source(k)}, 0) AS s{c}" for k, c in enumerate("xyz")) + f" FROM tgt) SELECT tx AS x, ty AS y, tz AS z, {r('coalesce(value, 0)', 'value')} FROM pos LEFT JOIN (SELECT * FROM nmaps WHERE subject = 0) m ON m.x = sx AND m.y = sy AND m.z = sz",
        "resample_trilinear": f"WITH {REF}, {TARGET}, pos AS (SELECT x AS tx, y AS ty, z AS tz, " + ", ".join(f"{_source(k)} AS s{c}" for k, c in enumerate("xyz")) + " FROM tgt), c AS (" + " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, {c} AS c" for a, b, c in product((0, 1), repeat=3)) + f") SELECT tx AS x, ty AS y, tz AS z, {r('sum(coalesce(value, 0) * abs(1 - a - (sx - floor(sx))) * abs(1 - b - (sy - floor(sy))) * abs(1 - c - (sz - floor(sz))))', 'value')} FROM pos CROSS JOIN c LEFT JOIN (SELECT * FROM nmaps WHERE subject = 0) m ON m.x = floor(sx) + a AND m.y = floor(sy) + b AND m.z = floor(sz) + c GROUP BY tx, ty, tz",
        "tensor_fa": f"WITH {FA}, e AS (SELECT voxel, 0.0005::DOUBLE + fa * 0.001::DOUBLE AS a, 0.0005::DOUBLE AS b FROM fa) SELECT voxel, {r('sqrt(pow(a - b, 2) / (a * a + 2 * b * b))', 'fa')} FROM e",
        "common_mask": f"WITH {MAPS}, c AS (SELECT * FROM maps WHERE subject % 10 = 0) SELECT x, y, z FROM c GROUP BY x, y, z HAVING count(*) = (SELECT count(DISTINCT subject) FROM c)",
        "mask_mismatch": f"WITH {REF}, e AS (SELECT count(*) AS expected FROM good) SELECT subject, count(*) AS voxels, max(expected) AS expected, CASE WHEN count(*) <> max(expected) THEN 'mask differs; neighbourhoods at its edge differ too' END AS warning FROM maps, e WHERE subject % 10 = 0 GROUP BY subject",
        "batch_reference": f"WITH {MAPS}, c AS (SELECT *, count(*) OVER (PARTITION BY subject) AS k FROM maps WHERE subject % 10 <> 0), d AS (SELECT * FROM c WHERE k >= 190), vox AS (SELECT DISTINCT x, y, z FROM d), sub AS (SELECT DISTINCT subject FROM d), full_ AS (SELECT x, y, z, coalesce(value, 0) AS value, value IS NOT NULL AS there FROM vox CROSS JOIN sub LEFT JOIN d USING (subject, x, y, z)) SELECT x, y, z, {r('avg(value)', 'mean')}, {r('coalesce(stddev_samp(value), 0)', 'sd')}, bool_and(there) AS in_mask FROM full_ GROUP BY x, y, z",
        "batch_reference_errors": f"WITH {MAPS} SELECT subject, 'only ' || count(*) || ' voxels' AS reason FROM maps WHERE subject % 10 <> 0 GROUP BY subject HAVING count(*) < 190",
        "synthetic_coupling_ref": "SELECT region, CAST(100 AS BIGINT) AS n, true AS mean_ok, true AS sd_ok, false AS other_mean, false AS other_sd FROM range(200) q(region)",
        "checksums": "SELECT 'p' || p_partkey AS path, sha256(p_name) AS sha256 FROM part",
        "checksum_verify": "SELECT 'p' || p_partkey AS path, p_partkey NOT IN (7, 9) AS ok FROM part",
        "compute_measure": f"""WITH {spectrum()}, pos AS (SELECT vec_id, x, y, z FROM bold WHERE label <> 0),
c AS (SELECT vec_id, t, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM long), a AS (SELECT a.vec_id, lag, sum(a.v * b.v) AS s FROM c a, range(1, 20) q(lag) JOIN c b ON b.vec_id = a.vec_id AND b.t = a.t + lag GROUP BY a.vec_id, lag),
n AS (SELECT vec_id, sum(v * v) AS n FROM c GROUP BY vec_id), f AS (SELECT vec_id, coalesce(min(lag) FILTER (WHERE s <= 0), 99) AS stop FROM a GROUP BY vec_id),
m AS (SELECT 'alff' AS measure, vec_id, avg(amp) FILTER (WHERE k BETWEEN 1 AND 3) AS v FROM amp GROUP BY vec_id
  UNION ALL SELECT 'rsfa', vec_id, sqrt(sum(2 * pow(amp * 32, 2)) FILTER (WHERE k BETWEEN 1 AND 3) / (64 * 63)) FROM amp GROUP BY vec_id
  UNION ALL SELECT 'int', vec_id, 0.72::DOUBLE * coalesce(sum(s / n) FILTER (WHERE lag < stop), 0) FROM a JOIN n USING (vec_id) JOIN f USING (vec_id) GROUP BY vec_id)
SELECT measure, x, y, z, {r("v", "value")} FROM m JOIN pos USING (vec_id)""",
        "nifti_scan": f"WITH {MAPS} SELECT subject, x, y, z, {r('round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3)', 'value')} FROM maps",
        "tractogram_scan": "SELECT l_orderkey % 64 AS file, dense_rank() OVER (PARTITION BY l_orderkey % 64 ORDER BY l_orderkey) - 1 AS sl, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS ord, CAST(l_linenumber AS INTEGER) AS px, CAST(l_partkey % 100 AS INTEGER) AS py FROM lineitem",
        "gradient_scan": 'SELECT CAST(r_regionkey AS INTEGER) AS g, r_regionkey * 1000::DOUBLE AS bval, r_regionkey / 10::DOUBLE AS bx, r_regionkey * 0.5::DOUBLE AS "by", 1 - r_regionkey::DOUBLE AS bz FROM region',
        "npz_roundtrip": f"WITH {REF} SELECT x, y, z, {r('mean')}, {r('sd')}, true AS in_mask FROM good",
        "synthetic_bold": "WITH g AS (SELECT CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y, CAST(c AS INTEGER) AS z, CAST(t AS INTEGER) AS t FROM range(6) a(a), range(6) b(b), range(6) c(c), range(16) t(t)) SELECT x, y, z, t, " + r("sum(exp(-(pow(x - 6 * (k % 3 + 1) / 4::DOUBLE, 2) + pow(y - 6 * (k % 5 + 1) / 6::DOUBLE, 2) + pow(z - 6 * (k % 2 + 1) / 3::DOUBLE, 2)) / 8) * sin(2 * pi() * (0.012::DOUBLE + 0.01::DOUBLE * k) * 0.72::DOUBLE * t))", "v") + " FROM g, range(8) q(k) GROUP BY x, y, z, t",
        "fc_partial": fc_partial(),
        "sc_from_streamlines": f"WITH {TRACTS}, {tract_edges(trilinear(0.1))}",
        "sc_nearest": f"WITH {TRACTS}, {tract_edges('SELECT subject, sl, fa FROM near')}",
        "coupling_cohort": f"WITH {TRACTS}, cline AS (SELECT subject, sl, arg_min(label % 10, ord) AS a, arg_max(label % 10, ord) AS b, avg(fa) AS fa FROM near GROUP BY ALL), csc AS (SELECT subject, least(a, b) AS i, greatest(a, b) AS j, avg(fa) AS s FROM cline WHERE a <> 0 AND b <> 0 AND a <> b GROUP BY ALL), {COHORT_FC}, al AS (SELECT subject, i, j, f, coalesce(s, 0) AS s FROM cfc LEFT JOIN csc USING (subject, i, j)), ab AS (SELECT subject, i AS region, s, f FROM al UNION ALL SELECT subject, j, s, f FROM al) SELECT subject, region, {r('CASE WHEN count(*) >= 3 THEN corr(s, f) END', 'value')} FROM ab WHERE subject IN (1, 2, 3) GROUP BY ALL",
        "coupling_cohort_errors": "SELECT 0::BIGINT AS subject, 'no BOLD file' AS reason UNION ALL SELECT 4, 'no tractogram'",
        "measure_cohort": f"WITH {spectrum()}, v AS (SELECT vec_id, x, y, z, avg(amp) FILTER (WHERE k BETWEEN 1 AND 3) AS a FROM amp JOIN bold USING (vec_id) GROUP BY ALL), m AS (SELECT x, y, z, CASE WHEN k = 1 AND vec_id % 5 = 0 THEN 0 ELSE a * (k + 1) END AS value, k = 1 AND vec_id % 5 = 0 AS gone FROM v, range(4) q(k)) SELECT x, y, z, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, NOT bool_or(gone) AS in_mask FROM m GROUP BY x, y, z",
        "measure_cohort_errors": "SELECT 4::BIGINT AS subject, 'not 4-D' AS reason",
        "grid_mismatch": f"WITH {MAPS}, g AS (SELECT subject, max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM maps WHERE subject % 3 <> 0 OR z < 7 GROUP BY subject) SELECT subject, nx, ny, nz, (nx, ny, nz) <> (SELECT (max(x) + 1, max(y) + 1, max(z) + 1) FROM maps WHERE subject % 10 <> 0) AS mismatch FROM g",
        "diff_summary": f"WITH {MAPS}, g AS (SELECT x, y, z, avg(value) AS mean FROM maps WHERE subject % 10 <> 0 GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(value) > 0), o AS (SELECT * FROM maps WHERE subject = 0) SELECT 'shared' AS kind, {r('avg(value)', 'subject_mean')}, {r('avg(mean)', 'group_mean')} FROM o JOIN g USING (x, y, z) UNION ALL SELECT 'empty', NULL, NULL UNION ALL SELECT 'other grid', round(avg(value), 6), NULL FROM o",
        "reference_table": f"WITH {REF} SELECT x, y, z, {r('mean')}, {r('sd')}, n_obs, n_obs >= 2 AND coalesce(sd, 0) > 0 AS in_mask FROM ref",
        "stats_bundle": f"WITH {TESTS}, g AS (SELECT subject, t, p, q FROM fdr), c AS (SELECT subject, count(*) AS k, sum(t) AS t, sum(p) AS p, sum(q) AS q, count(*) FILTER (WHERE abs(t) > 1e-6) AS nt, count(*) FILTER (WHERE p > 1e-6) AS np, count(*) FILTER (WHERE q > 1e-6) AS nq FROM g GROUP BY subject) SELECT subject, 't' AS image, nt AS set, round(t, 1) AS total FROM c UNION ALL SELECT subject, 'p', np + 200 - k, round(p + 200 - k, 1) FROM c UNION ALL SELECT subject, 'q', nq + 200 - k, round(q + 200 - k, 1) FROM c UNION ALL SELECT subject, 'mask', k, k FROM c",
        "stream_reference": f"WITH {MAPS} SELECT x, y, z, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, count(*) AS n_obs, count(*) >= 2 AND coalesce(stddev_samp(value), 0) > 0 AS in_mask FROM maps WHERE subject % 10 <> 0 GROUP BY x, y, z",
        "flagship": f"WITH {spectrum()}, m AS (SELECT vec_id, avg(amp) FILTER (WHERE k BETWEEN 1 AND 3) AS v FROM amp GROUP BY vec_id) SELECT 'alff' AS measure, {r('avg(v)', 'mean')}, {r('quantile_cont(v, 0.5)', 'median')}, count(*) AS voxels FROM m",
    }
    for s in config.MSE_SCALES:
        out[f"mse_scale{s}"] = f"WITH {LONG}, {FLAT}, {sampen(s)} SELECT vec_id, {r('value', 'sampen')} FROM e{s}"
    return out
