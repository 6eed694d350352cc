"""Send-log CSV files, one folder per edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.schemas import SEND_LOG
from gapspark.session import shared_dir


def write_edge_logs(send_log: DataFrame, edges: int) -> list[str]:
    """Writes a send log as CSV with a header, split by edge; returns the folders."""
    base = shared_dir(send_log.sparkSession, "send-logs")
    (
        send_log.withColumn("edge", F.concat(F.lit("edge"), F.col("inject_id").cast("bigint") % edges))
        .withColumn("timestamp", F.col("timestamp").cast("string"))
        .select("inject_id", "timestamp", "event_type", "target", "sent_ok", "edge")
        .write.partitionBy("edge").option("header", True).csv(base)
    )
    return [f"{base}/edge=edge{i}" for i in range(edges)]


def read_send_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of send logs under one header; ``edge`` comes from the folder name.

    Columns are read by position under the fixed header; a log of the older format without
    ``sent_ok`` yields NULL there, which counts as sent.
    """
    logs = spark.read.schema(SEND_LOG).option("header", True).option("enforceSchema", True).csv(paths)
    return logs.withColumn("edge", F.regexp_extract(F.col("_metadata.file_path"), r"edge=([^/]+)/", 1))
