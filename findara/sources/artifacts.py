"""Artefacts that are built once: tables in Parquet, a manifest that says what they were built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row, ``rows`` and ``digest``: the same for the same identifiers and texts in any order and partitioning.

    Every row is hashed where it is; the hashes, as numbers, add up to two sums.  Nothing but sums is moved.
    """
    row = F.sha2(F.concat(F.col(id_col).cast("string"), F.lit("\0"), F.coalesce(F.col(text_col), F.lit("")), F.lit("\0")), 256)
    part = lambda k: F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(part(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", "s0", "s1", "s2", "s3"), 256).alias("digest"))


def save(tables: dict[str, DataFrame], folder: str, manifest: dict[str, str]) -> None:
    """Write the tables and, last, the manifest: a folder with a manifest is whole."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame(sorted(manifest.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def load(spark: SparkSession, folder: str, names: list[str], manifest: dict[str, str]) -> dict[str, DataFrame] | None:
    """The tables if the folder has them all and was built from the same, else None."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: fs_path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path(p))
    if not all(there(f"{folder}/{n}/_SUCCESS") for n in [*names, "manifest"]):
        return None
    found = {r["key"]: r["value"] for r in spark.read.parquet(f"{folder}/manifest").collect()}  # a few rows
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names} if found == manifest else None


def get_or_build(spark: SparkSession, folder: str, names: list[str], manifest: dict[str, str], build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Saved tables if they are valid; otherwise they are built, saved and read back."""
    found = load(spark, folder, names, manifest)
    if found is None:
        save(build(), folder, manifest)
        found = load(spark, folder, names, manifest)
    return found
