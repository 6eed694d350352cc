"""Daily event files, one folder per day, with a strict completeness check on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_day(path) -> F.Column:
    return F.try_to_date(F.nullif(F.regexp_extract(path, r"file_day=(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def read_days(spark: SparkSession, base: str, schema) -> DataFrame:
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(base)
    return rows.withColumn("file_day", file_day(F.col("_metadata.file_path")))


def day_violations(
    rows: DataFrame, first_day: str, last_day: str, excluded: tuple[str, str] | None = None,
) -> DataFrame:
    """What is wrong with a daily tree: absent days, and rows of another day in a file."""
    spark = rows.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(
        F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("file_day"))
    if excluded:
        lo, hi = (F.lit(x).cast("date") for x in excluded)
        calendar = calendar.where((F.col("file_day") < lo) | (F.col("file_day") >= hi))
    per_file = rows.groupBy("file_day").agg(
        F.count_if(F.to_date("timestamp") != F.col("file_day")).alias("n_rows"))
    absent = calendar.join(per_file, "file_day", "left_anti").select(
        "file_day", F.lit("absent_day").alias("violation"), F.lit(0).cast("bigint").alias("n_rows"))
    stray = per_file.join(calendar, "file_day", "left_semi").where("n_rows > 0").select(
        "file_day", F.lit("rows_of_another_day").alias("violation"), "n_rows")
    return absent.unionByName(stray)


def require_complete(rows: DataFrame, first_day: str, last_day: str, excluded=None) -> DataFrame:
    """The rows, or an error naming the first violations; a missing day is never skipped."""
    found = day_violations(rows, first_day, last_day, excluded).orderBy("file_day").limit(5).collect()
    if found:
        raise ValueError("incomplete daily files: " + ", ".join(f"{r.file_day} {r.violation}" for r in found))
    return rows
