"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Arrow batches between an executor and its Python workers hold about so many bytes; both sides keep
#: one whole, and the executor's buffers double as they grow. Spark's own value is 64 MB.
ARROW_BATCH = "16m"


def build_session(app: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BATCH,
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepared(spark: SparkSession, batch: str = ARROW_BATCH) -> SparkSession:
    """A session that was built elsewhere, with the settings that bind results and a worker's memory."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local folder is made only where the setting is absent and the master is local, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="folioscope-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's written tables and streaming checkpoints."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialized(df, name: str):
    """Write an intermediate table once into the shared folder and read it back.

    Later steps read only the columns they need, and a lost executor never replays the past.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
