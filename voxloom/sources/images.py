"""NIfTI-1 images, gradient tables, tractograms and npz references as DataFrames, and back to bytes.

Files come in through Spark's binaryFile reader, so any store it can read will do; parsing runs
on the executors, one file a task, and voxels leave in bounded batches.
"""

from __future__ import annotations

import gzip
import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# NIfTI-1 data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
ROWS = 4096
POINTS = 65536


def parse_nifti(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(data as doubles, affine) of a NIfTI-1 file, plain or gzipped."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    dim = struct.unpack_from(order + "8h", raw, 40)
    kind = struct.unpack_from(order + "h", raw, 70)[0]
    start, slope, shift = (struct.unpack_from(order + "f", raw, at)[0] for at in (108, 112, 116))
    if kind not in NIFTI_TYPES:
        raise ValueError(f"NIfTI data type {kind} is not read")
    size = dim[1 : 1 + dim[0]]
    data = np.frombuffer(raw, order + NIFTI_TYPES[kind], int(np.prod(size)), int(start)).astype(float).reshape(size, order="F")
    if slope not in (0.0, 1.0) or shift:
        data = data * (slope or 1.0) + shift
    affine = np.eye(4)
    if struct.unpack_from(order + "h", raw, 254)[0] > 0:
        affine[:3] = np.array(struct.unpack_from(order + "12f", raw, 280)).reshape(3, 4)
    else:
        affine[[0, 1, 2], [0, 1, 2]] = struct.unpack_from(order + "3f", raw, 80)
    return data, affine


def nifti_bytes(data: np.ndarray, affine: np.ndarray | None = None, compress: bool = True) -> bytes:
    """A float32 NIfTI-1 file (uint8 for booleans)."""
    a = np.eye(4) if affine is None else affine
    kind, code, bits = ("u1", 2, 8) if data.dtype == bool else ("<f4", 16, 32)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, code, bits)
    struct.pack_into("<8f", head, 76, 1, *np.linalg.norm(a[:3, :3], axis=0), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *a[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + data.astype(kind).tobytes(order="F")
    return gzip.compress(raw) if compress else raw


def binary(spark, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _voxels(it):
    for b in it:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
            data, _ = parse_nifti(raw.as_py())
            flat = data.reshape(int(np.prod(data.shape[:3])), -1)
            where = np.stack(np.unravel_index(np.arange(len(flat)), data.shape[:3]), 1).astype(np.int32)
            for at in range(0, len(flat), ROWS):
                w = where[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(w)), *[pa.array(w[:, k]) for k in range(3)], pa.array(list(flat[at : at + ROWS]), pa.list_(pa.float64()))], ["path", "x", "y", "z", "ts"])


def voxels(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, x, y, z, ts): a row for each voxel; a 3-D image has series of one."""
    return files.select("path", "content").mapInArrow(_voxels, "path string, x int, y int, z int, ts array<double>")


def images(maps: DataFrame, by: str, shape: tuple[int, int, int]) -> DataFrame:
    """maps (by, x, y, z, value) -> (path, content): one float32 image each, 0 where there is no row. An image is one grid, a bounded group."""

    def run(t: pa.Table) -> pa.Table:
        grid = np.zeros(shape)
        grid[tuple(t[c].to_numpy() for c in "xyz")] = t["value"].to_numpy()
        return pa.table({"path": [f"{t[by][0].as_py()}.nii.gz"], "content": [nifti_bytes(grid)]})

    return maps.select(by, "x", "y", "z", "value").groupBy(by).applyInArrow(run, "path string, content binary")


def bundle(tests: DataFrame, by: str, shape: tuple[int, int, int], prefix: str = "") -> DataFrame:
    """tests (by, x, y, z, t, p, q) -> (path, content): t, p and q maps as float32 images and the mask they hold in as uint8, a folder a subject."""

    def run(t: pa.Table) -> pa.Table:
        at = tuple(t[c].to_numpy() for c in "xyz")
        rows = []
        for name in ("t", "p", "q"):
            grid = np.full(shape, 1.0 if name != "t" else 0.0)
            grid[at] = t[name].to_numpy()
            rows.append((f"{t[by][0].as_py()}/{prefix}{name}.nii.gz", nifti_bytes(grid)))
        mask = np.zeros(shape, bool)
        mask[at] = True
        rows.append((f"{t[by][0].as_py()}/{prefix}mask.nii.gz", nifti_bytes(mask)))
        return pa.table({"path": [r[0] for r in rows], "content": [r[1] for r in rows]})

    return tests.select(by, "x", "y", "z", "t", "p", "q").groupBy(by).applyInArrow(run, "path string, content binary")


def save_files(files: DataFrame, folder: str) -> int:
    """Writes (path, content) rows as files below a folder of any store that Spark writes to, one at a time; gives their number."""
    spark, n = files.sparkSession, 0
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in files.select("path", "content").toLocalIterator(prefetchPartitions=False):
        out = fs.create(path(f"{folder.rstrip('/')}/{r.path}"), True)
        out.write(bytearray(r.content))
        out.close()
        n += 1
    return n


def gradients(spark, bval_path: str, bvec_path: str) -> DataFrame:
    """(g, bval, bx, by, bz) from white-space separated text; 3 x N vectors are turned."""
    read = lambda p: np.array([[float(x) for x in r.value.split()] for r in spark.read.text(p).collect() if r.value.strip()])  # noqa: E731  a few hundred numbers
    vectors = read(bvec_path)
    return spark.createDataFrame(gradient_rows(read(bval_path), vectors), "g int, bval double, bx double, by double, bz double")


def gradient_rows(bvals, bvecs) -> list[tuple]:
    b, v = np.ravel(bvals), np.atleast_2d(bvecs)
    if v.shape[0] == 3 and len(b) != 3:
        v = v.T
    if v.shape != (len(b), 3):
        raise ValueError("gradient tables don't fit each other")
    return [(k, float(b[k]), *map(float, v[k])) for k in range(len(b))]


def tck_points(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(points, points a streamline) of a .tck file: float32 triplets, NaN between streamlines, infinity at the end. Streamlines without points are left out."""
    head, _, _ = raw.partition(b"END")
    fields = dict(line.split(b":", 1) for line in head.split(b"\n") if b":" in line)
    kind = ">f4" if b"BE" in fields.get(b"datatype", b"") else "<f4"
    points = np.frombuffer(raw, kind, offset=int(fields[b"file"].split()[-1]))
    points = points[: len(points) // 3 * 3].reshape(-1, 3)
    end = np.flatnonzero(np.isinf(points[:, 0]))
    points = points[: end[0]] if len(end) else points
    between = np.isnan(points[:, 0])
    size = np.diff(np.flatnonzero(between), prepend=-1, append=len(points)) - 1
    return points[~between], size[size > 0]


def parse_tck(raw: bytes) -> list[np.ndarray]:
    """Streamlines of a .tck file."""
    points, size = tck_points(raw)
    return np.split(points.astype(float), np.cumsum(size)[:-1]) if len(size) else []


def tck_of(points: np.ndarray, size: np.ndarray) -> bytes:
    """A .tck file of streamlines one after the other, size points each."""
    body = np.full((len(points) + len(size) + 1, 3), np.nan, "<f4")
    body[np.arange(len(points)) + np.repeat(np.arange(len(size)), size)] = points
    body[-1] = np.inf
    head = f"mrtrix tracks\ndatatype: Float32LE\ncount: {len(size)}\nfile: . 128\nEND\n".encode()
    return head.ljust(128, b"\0") + body.tobytes()


def tck_bytes(lines: list[np.ndarray]) -> bytes:
    return tck_of(np.concatenate([np.asarray(x, "<f4").reshape(-1, 3) for x in lines] or [np.zeros((0, 3), "<f4")]), np.array([len(x) for x in lines], int))


def trk_points(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, points a streamline, voxel size, affine) of a .trk file (version 2); points in voxel-millimetres."""
    order = "<" if struct.unpack_from("<i", raw, 996)[0] == 1000 else ">"
    scale = np.array(struct.unpack_from(order + "3f", raw, 12))
    scalars, properties = struct.unpack_from(order + "h", raw, 36)[0], struct.unpack_from(order + "h", raw, 238)[0]
    affine = np.array(struct.unpack_from(order + "16f", raw, 440)).reshape(4, 4)
    if not affine[3, 3]:
        affine = np.eye(4)
    words = np.frombuffer(raw, order + "f4", max(0, len(raw) - 1000) // 4, 1000)
    count, at, size, starts = words.view(order + "i4"), 0, [], []
    while at < len(words):
        n = int(count[at])
        if n < 0 or at + 1 + n * (3 + scalars) > len(words):
            raise ValueError("a streamline of the .trk file is cut off")
        size.append(n)
        starts.append(at)
        at += 1 + n * (3 + scalars) + properties
    size, starts = np.array(size, int), np.array(starts, int)
    kept = np.ones(min(at, len(words)), bool)
    kept[starts] = False
    for k in range(properties):
        last = starts + 1 + size * (3 + scalars) + k
        kept[last[last < len(kept)]] = False
    return words[: len(kept)][kept].reshape(-1, 3 + scalars)[:, :3], size, scale, affine


def parse_trk(raw: bytes) -> list[np.ndarray]:
    """Streamlines of a .trk file (version 2): voxel-millimetres taken to the header's world space."""
    points, size, scale, affine = trk_points(raw)
    world = (points.astype(float) / scale - 0.5) @ affine[:3, :3].T + affine[:3, 3]
    return np.split(world, np.cumsum(size)[:-1]) if len(size) else []


def _streamlines(it):
    for b in it:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
            content, scale, affine = raw.as_py(), None, None
            if content[:5] == b"TRACK":
                points, size, scale, affine = trk_points(content)
            else:
                points, size = tck_points(content)
            start = np.cumsum(size) - size
            for at in range(0, len(points), POINTS):  # bounded batches, streamlines of any length side by side
                p = points[at : at + POINTS].astype(float)
                if affine is not None:
                    p = (p / scale - 0.5) @ affine[:3, :3].T + affine[:3, 3]
                n = np.arange(at, at + len(p))
                sl = np.searchsorted(start, n, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.repeat(path, len(p)), pa.array(sl, pa.int64()), pa.array((n - start[sl]).astype(np.int32)), *[pa.array(np.ascontiguousarray(p[:, c])) for c in range(3)]], ["path", "sl", "ord", "px", "py", "pz"])


def streamlines(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, sl, ord, px, py, pz): a row for each point, in millimetres."""
    return files.select("path", "content").mapInArrow(_streamlines, "path string, sl long, ord int, px double, py double, pz double")


def reference_npz(reference: DataFrame, shape: tuple[int, int, int], n: int, measure: str) -> bytes:
    """A voxel reference as npz bytes: one grid, for exchange with array tools."""
    t = reference.select("x", "y", "z", "mean", "sd", F.col("in_mask").cast("int").alias("m")).toArrow()
    at = tuple(t[c].to_numpy() for c in "xyz")
    grids = {k: np.zeros(shape) for k in ("mean_map", "sd_map", "group_mask")}
    for name, col in (("mean_map", "mean"), ("sd_map", "sd"), ("group_mask", "m")):
        grids[name][at] = np.nan_to_num(t[col].to_numpy(zero_copy_only=False).astype(float))
    out = io.BytesIO()
    np.savez(out, measure=measure, shape=shape, n=n, **grids | {"group_mask": grids["group_mask"] > 0})
    return out.getvalue()


def npz_reference(spark, raw: bytes) -> DataFrame:
    """(x, y, z, mean, sd, in_mask) of an npz reference; pickled members are not read."""
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        mean, sd, mask = f["mean_map"], f["sd_map"], f["group_mask"].astype(bool)
    x, y, z = (v.astype(np.int32) for v in np.nonzero(mask | (mean != 0)))
    table = pa.table({"x": x, "y": y, "z": z, "mean": mean[x, y, z], "sd": sd[x, y, z], "in_mask": mask[x, y, z]})
    return spark.createDataFrame(table)


def save_reference(reference: DataFrame, path: str, measure: str) -> None:
    """The table form: a partition for each measure, so reading one prunes the others; saving again replaces that one alone."""
    reference.withColumn("measure", F.lit(measure)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("measure").parquet(path)


def load_reference(spark, path: str, measure: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("measure") == measure).drop("measure")


def synthetic_bold(spark, shape: tuple[int, int, int], times: int, tr: float = 0.72, sources: int = 8, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(x, y, z, ts): smooth blobs, each with its own slow sine, and seeded noise."""
    nx, ny, nz = shape
    i = F.col("id")
    grid = spark.range(nx * ny * nz).select(F.floor(i / (ny * nz)).cast("int").alias("x"), (F.floor(i / nz) % ny).cast("int").alias("y"), (i % nz).cast("int").alias("z"), F.randn(seed).alias("e"))
    value = lambda t: sum((F.exp(-(F.pow(F.col("x") - nx * (k % 3 + 1) / 4, 2) + F.pow(F.col("y") - ny * (k % 5 + 1) / 6, 2) + F.pow(F.col("z") - nz * (k % 2 + 1) / 3, 2)) / 8) * F.sin(2 * 3.141592653589793 * (0.012 + 0.01 * k) * tr * t) for k in range(sources)), F.lit(0.0))
    series = F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda t: value(t) + (F.sin(F.col("e") * 1000 * (t + 1)) * noise if noise else F.lit(0.0)))
    return grid.select("x", "y", "z", series.alias("ts"))
