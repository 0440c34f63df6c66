"""Shared helpers: scratch tables in the cluster's shared folder and null-safe document input."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Text batches are kept small, since one document may hold many megabytes.
TEXT_BATCH = 2048


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where it is unset, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="voxloom-"))
        d = _own[0]
    return d.rstrip("/")


class Scratch:
    """Tables of one query in the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and frees."""
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def free(self) -> None:
        """Lets Spark delete the shuffle files of finished jobs: it does so when the driver's garbage is
        collected, which may else be long after."""
        gc.collect()
        self.spark._jvm.System.gc()


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from the repository, wherever the driver was started."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): null texts are empty; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def plain(docs: DataFrame) -> DataFrame:
    """docs without columns whose names start with two underscores: those names are the operators' own."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__")])


def batches(it, rows: int = TEXT_BATCH, nbytes: int = 8 << 20):
    """Arrow batches cut to a bounded number of rows, and of about nbytes at most unless one row is larger."""
    for b in it:
        step = max(1, min(rows, int(b.num_rows * nbytes / max(1, b.nbytes)))) if b.num_rows else 1
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
    pa.default_memory_pool().release_unused()  # the worker lives on


def gathered(it, rows: int, nbytes: int):
    """Arrow batches put together, or cut, to about so many rows and bytes."""
    held, n, size = [], 0, 0
    for b in batches(it, rows, nbytes):
        if held and (n + b.num_rows > rows or size + b.nbytes > nbytes):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, size = [], 0, 0
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def hashed_sample(df: DataFrame, rows: int, total: int, *cols: str) -> DataFrame:
    """The rows with the smallest hashes of cols, at most rows of them. Where there are more, a
    hash filter leaves little over that many first, so no task meets more than it has to."""
    h = F.xxhash64(*cols)
    if total > rows:
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < min(1 << 30, int(1.1 * rows / total * (1 << 30)) + 1))
    return df.orderBy(h, *cols).limit(rows)
