"""The session that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTC makes instants and oracles agree; LAST_WIN is how repeated headers behave; AQE splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "sparkdigest", **settings: str) -> SparkSession:
    """A session with SETTINGS; settings (dots as double underscores) override them."""
    found = SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=found).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Put SETTINGS on a session that someone else has made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, to be sent to every task, once Spark has found that it has `most` rows at most; more are refused."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; where that is unset, on a local master only
    (tests), below a temporary one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkdigest-"))
        where = sc.getCheckpointDir()
    path = f"{where}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
