"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "revtide", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` as the cluster set it.

    Only where it is unset and the master is local (tests) a temporary folder is chosen and recorded
    there. On a cluster a machine-local folder would hide rows from other executors, so that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="revtide-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    Used where a costly result has several consumers: the stage is computed once, and a lost
    executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """`settle`, with the rows hashed by `keys` into `buckets` files.

    Plans know how the files are hashed, so joins and sums by these keys read them without a shuffle. The
    table's name goes at once; its files stay in the shared folder like those of any settled stage.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    hashed = df.repartition(buckets, *keys).write.format("parquet").option("path", scratch_path(spark, "bucketed"))
    hashed.bucketBy(buckets, *keys).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
