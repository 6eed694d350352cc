"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Application id -> its temporary folder, for local sessions without a shared folder.
LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "gapspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # sessions of one input partition merge before the shuffle
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """All calendar maths is UTC; expressions take the zone when they are analysed."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local master may leave it
    unset: one temporary folder of the session then takes its place. On a cluster executors would
    write to their own disks and a later read would miss rows, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        base = LOCAL_DIRS.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="gapspark-")
        LOCAL_DIRS[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df, purpose: str):
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    Used where several branches read the same expensive intermediate result. A written table
    survives the loss of executors, unlike cached blocks.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
