"""Stand-ins on the test tables for the data model: voxel series, cohort maps, FA and streamlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TR = 0.72
BOOST = (100, 104)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bold(spark, sf_dir) -> DataFrame:
    """(vec_id, x, y, z, label, ts): one voxel for each embedding."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(v / 100).cast("int").alias("x"), (F.floor(v / 10) % 10).cast("int").alias("y"), (v % 10).cast("int").alias("z"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("ts")
    )


def masked_bold(spark, sf_dir) -> DataFrame:
    """The voxels inside the atlas: label 0 is the background."""
    return bold(spark, sf_dir).filter("label <> 0")


def shape(df: DataFrame) -> tuple[int, int, int]:
    """The grid's size: one row."""
    r = df.agg(F.max("x"), F.max("y"), F.max("z")).first()
    return tuple(int(v or 0) + 1 for v in r)


def run_maps(spark, sf_dir) -> DataFrame:
    """(subject, run, x, y, z, value): mean price per supplier, run and voxel; held-out subjects have an effect put in. Prices are divided by a prime, so that means have no ties in rounding."""
    v = F.col("l_partkey") % 200
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), (F.col("l_linenumber") % 2).cast("int").alias("run"), v.alias("v"), "l_extendedprice")
    per = line.groupBy("subject", "run", "v").agg(F.avg("l_extendedprice").alias("value"))
    return _placed(per, "run")


def maps(spark, sf_dir) -> DataFrame:
    v = F.col("l_partkey") % 200
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), v.alias("v"), "l_extendedprice")
    return _placed(line.groupBy("subject", "v").agg(F.avg("l_extendedprice").alias("value")))


def _placed(per: DataFrame, *more: str) -> DataFrame:
    boosted = (F.col("subject") % 10 == 0) & F.col("v").between(*BOOST)
    at = [F.floor(F.col("v") / 40).cast("int").alias("x"), (F.floor(F.col("v") / 8) % 5).cast("int").alias("y"), (F.col("v") % 8).cast("int").alias("z")]
    return per.select("subject", *more, *at, (F.col("value") / 977.0 * F.when(boosted, 3.0).otherwise(1.0)).alias("value"))


def cohort(m: DataFrame) -> DataFrame:
    return m.filter("subject % 10 <> 0")


def held_out(m: DataFrame) -> DataFrame:
    return m.filter("subject % 10 = 0")


def fa(spark, sf_dir) -> DataFrame:
    """(voxel, label, fa) on parts; label 25 is the background."""
    n = F.split("p_brand", "#")[1].cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"), F.when(n == 25, 0).otherwise(n).alias("label"), (F.col("p_size") / 50.0).alias("fa"))


def points(spark, sf_dir) -> DataFrame:
    """(sl, ord, label, fa): an order's lines are a streamline's points."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sl"), (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey")).alias("ord"), F.col("l_partkey").alias("voxel"))
    return line.join(fa(spark, sf_dir), "voxel").select("sl", "ord", "label", "fa")


#: The affine under which made-up streamlines and volumes lie.
AFFINE = [[2.0, 0.0, 0.0, -90.0], [0.0, 2.0, 0.0, -126.0], [0.0, 0.0, 2.0, -72.0], [0.0, 0.0, 0.0, 1.0]]


def fa_volume(spark, sf_dir) -> DataFrame:
    """(x, y, z, label, fa): the FA table on a grid of 20 x 20 planes; divided, so that means have no ties in rounding."""
    v = F.col("voxel")
    return fa(spark, sf_dir).select(F.floor(v / 400).cast("int").alias("x"), (F.floor(v / 20) % 20).cast("int").alias("y"), (v % 20).cast("int").alias("z"), "label", (F.col("fa") / 0.977).alias("fa"))


def tracts(spark, sf_dir) -> DataFrame:
    """(subject, sl, ord, px, py, pz): orders as streamlines in millimetres, each point off its part's voxel; five subjects."""
    line, v, n = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_linenumber")
    at = [F.floor(v / 400) + 0.1 + (n % 5) * 0.05, F.floor(v / 20) % 20 + 0.3 - (n % 3) * 0.1, v % 20 + 0.2]
    mm = [(2.0 * c + row[3]).alias(f"p{a}") for c, row, a in zip(at, AFFINE, "xyz")]
    return line.select((F.col("l_orderkey") % 5).alias("subject"), F.col("l_orderkey").alias("sl"), (n.cast("long") * 100_000_000 + v).alias("ord"), *mm)


def cohort_bold(spark, sf_dir) -> DataFrame:
    """(subject, x, y, z, label, ts): the series with labels moved on and amplitudes of their own, for five subjects;
    the second one lacks every fifth voxel."""
    b = bold(spark, sf_dir).withColumn("subject", F.explode(F.array(*[F.lit(k).cast("long") for k in range(5)]))).filter("subject <> 1 or vec_id % 5 <> 0")
    return b.select("subject", "x", "y", "z", ((F.col("label") + F.col("subject")) % 10).cast("int").alias("label"), F.transform("ts", lambda v: v * (F.col("subject") + 1)).alias("ts"))


def regional_values(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy((F.col("c_custkey") % 50).alias("subject"), F.col("c_nationkey").alias("region")).agg(F.avg("c_acctbal").alias("value"))


def files(spark, sf_dir) -> DataFrame:
    """(subject, path): made-up listing; some subjects lack files."""
    s = F.col("s_suppkey")
    names = F.array(*[F.lit(x) for x in ("_bold.nii.gz", "_rest.nii", "_FA.nii.gz", "_dwi.nii.gz", ".bval", ".bvec", ".trk", "_mask.nii.gz", "_T1w.nii")])
    each = table(spark, sf_dir, "supplier").select(s.alias("subject"), F.posexplode(names).alias("k", "suffix")).filter((F.col("subject") + F.col("k")) % 5 != 0)
    return each.select("subject", F.concat(F.lit("s"), F.col("subject"), F.lit("/s"), F.col("subject"), "suffix").alias("path"))
