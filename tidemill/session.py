"""Session settings shared by the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "tidemill", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC.

    ``master`` and the shuffle width are left to the cluster unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_base(spark: SparkSession) -> str | None:
    """The folder the cluster shares; on a local session without one, a folder of this machine."""
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if base is None and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return base


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name for one run of a job, under the folder the cluster shares."""
    base = _shared_base(spark)
    if base is None:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by the cluster")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared folder, for steps that read it several times.

    A reliable checkpoint: it survives lost executors and cuts the lineage. A
    cluster session must name a shared folder.
    """
    spark = df.sparkSession
    base = _shared_base(spark)
    if base is None:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by the cluster")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()
