"""Cohort reference over a stream of maps: the same aggregation as the batch one, kept up to date.

State is one row of moments for each voxel; it doesn't grow with the number of maps. Each batch
writes the reference as it stands to a folder of its own, from the executors; the last one is
the result, and those before it go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cohort import VOXEL, usable

SCHEMA = "subject long, x int, y int, z int, value double"
#: Map files that a batch reads at most.
FILES = 4


def stream_reference(maps: DataFrame) -> DataFrame:
    v = usable()
    out = maps.groupBy(*VOXEL).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n_obs")).filter("n_obs > 0")
    return out.withColumn("in_mask", F.coalesce((F.col("n_obs") >= 2) & (F.col("sd") > 0), F.lit(False)))


def run_to_end(spark, path: str, out: str, checkpoint: str) -> DataFrame:
    """Reads the map files below path, FILES a batch, and gives the reference after the last one."""
    last = []

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{k}")
        while last:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{last.pop()}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        last.append(k)

    maps = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", FILES).parquet(path)
    query = stream_reference(maps).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/{last[-1]}")
