"""Session settings and shared helpers for reading tables and cutting lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: How many times their files' size settled tables are taken to hold: names and texts that repeat shrink to a thirtieth and less.
PACKED = 100
#: Measured size up to which a table is sent out to a join, where the session leaves this to Spark.
SENT = "1m"


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; shuffle partitions are left to it and to the cluster."""
    builder = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a folder of its own; a cluster has none that its
    executors share, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is not None:
            return context.getCheckpointDir().rsplit("/", 1)[0]
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def unpacked_sizes(spark: SparkSession) -> Iterator[None]:
    """What is planned meanwhile takes files to hold PACKED times their size, and sends out tables that a join has measured only up to SENT.

    Otherwise tables that pack well go whole through the driver, for each of many joins, until their files reach Spark's threshold.
    """
    factor, sent = "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in (factor, sent)}
    spark.conf.set(factor, str(max(PACKED, float(spark.conf.get(factor)))))
    if before[sent] is None and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b":  # as Spark sets it
        spark.conf.set(sent, SENT)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def settled(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: cuts the lineage, and later joins know the table's size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-settled-{uuid.uuid4().hex}"
    with unpacked_sizes(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settings(path: str | None = None) -> dict[str, str]:
    """Plain ``key: value`` lines of a settings file, over which environment variables of the same upper-case name win.

    Fixed names: model_provider, model_enabled, model_threshold, source_dir, output_dir.
    """
    out = {"model_provider": "offline", "model_enabled": "false", "model_threshold": "0.6", "source_dir": "", "output_dir": ""}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, _, value = line.partition(":")
                if key.strip() in out and not line.startswith("#"):
                    out[key.strip()] = value.strip().strip("\"'")
    return {k: os.environ.get(k.upper(), v) for k, v in out.items()}
