"""Session settings that the engine's queries expect, and where they keep intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tapeloom", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` adds to it (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only a session that names none (a local test) gets a temporary folder, and only if its master is local.
    """
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if not shared:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    if not set_.isDefined():
        sc.setCheckpointDir(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of `df` by writing it to the session's shared folder: what follows reads it instead of doing it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out by `key` into as many partitions as shuffles have: for rows that are few in bytes but take long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
