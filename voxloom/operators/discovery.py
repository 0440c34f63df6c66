"""Subjects and their files, from a listing of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The file layout of a subject's folder, and suffixes that name a processing step.
LAYOUT = {
    "bold_path": r"bold[^/]*\.nii(\.gz)?$",
    "fa_path": r"FA[^/]*\.nii(\.gz)?$",
    "dwi_path": r"dwi[^/]*\.nii(\.gz)?$",
    "bval_path": r"\.bval$",
    "bvec_path": r"\.bvec$",
    "dwi_mask_path": r"mask[^/]*\.nii(\.gz)?$",
    "tractogram_path": r"\.(trk|tck)$",
    "t1_path": r"T1w[^/]*\.nii(\.gz)?$",
}
STEPS = "finproc|bold|rest|clean"


def subject_id(path="path"):
    """File name without .nii.gz or .nii, then without a processing step."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"\.nii(\.gz)?$", ""), f"_({STEPS})$", "")


def resolve(files: DataFrame) -> DataFrame:
    """files (subject, path) -> one row per subject with the first path of each field, null where none fits."""
    return files.groupBy("subject").agg(*[F.min(F.when(F.col("path").rlike(p), F.col("path"))).alias(k) for k, p in LAYOUT.items()])


def bold_files(files: DataFrame) -> DataFrame:
    """files (path relative to the root) -> (subject, path): first image of each subfolder; flat files only if no subfolder has one."""
    images = files.filter(F.col("path").rlike(r"\.nii(\.gz)?$")).withColumn("folder", F.regexp_extract("path", r"^([^/]+)/", 1))
    nested = images.filter("folder <> ''").select(F.col("folder").alias("subject"), "path", F.when(F.col("path").rlike("bold"), 0).otherwise(1).alias("o"))
    flat = images.filter("folder = ''").select(subject_id().alias("subject"), "path", F.lit(0).alias("o"))
    flat = flat.join(nested.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti")
    first = F.row_number().over(W.partitionBy("subject").orderBy("o", "path"))
    return nested.unionByName(flat).withColumn("k", first).filter("k = 1").select("subject", "path")


def listing(spark, root: str, pattern: str = "*") -> DataFrame:
    """Paths below a folder, from any store that Spark reads; contents are not read. A folder that is not there is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(root)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")


def conformance(subjects: DataFrame, fa_measure: str = "fa_weighted_sc") -> DataFrame:
    """Adds problems: what each subject lacks."""
    lacks = lambda c: F.col(c).isNull()
    checks = [F.when(lacks("bold_path"), "no BOLD file"), F.when(lacks("fa_path") & lacks("dwi_path"), "neither FA nor DWI file")]
    if fa_measure == "fa_weighted_sc":
        checks.append(F.when(lacks("tractogram_path"), "no tractogram"))
    return subjects.withColumn("problems", F.array_compact(F.array(*checks)))


def region_problem(atlas: DataFrame, expected: int) -> DataFrame:
    return atlas.filter("label <> 0").agg(F.count_distinct("label").alias("regions")).withColumn("ok", F.col("regions") == expected)
