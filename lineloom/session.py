"""Session defaults."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Settings that results depend on (time zone) or that plans at scale want.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "lineloom", **settings: str) -> SparkSession:
    """A session with DEFAULTS, then `settings` (underscores for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share.

    Only a local session, whose executors are the driver, may leave it unset: then a folder of this machine serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def with_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder to the shared one, unless one is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_base(spark))
