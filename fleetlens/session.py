"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Every timestamp of the data model is a local wall-clock reading without an
# offset.  A UTC session makes casts to and from TIMESTAMP_NTZ the identity.
SESSION_TIME_ZONE = "UTC"

# Spark takes a file's size for that of its rows, but keys and short words shrink to a few bytes a row:
# a table of some MB may hold a hundred as a broadcast.  Estimates are multiplied by this.
COMPRESSION_FACTOR_CONF = "spark.sql.sources.fileCompressionFactor"
COMPRESSION_FACTOR = 16
# Split a skewed partition of a join also where an aggregate by the join's key follows.
FORCE_SKEW_CONF = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def build_session(app_name: str = "fleetlens", master: str | None = None, **conf: object) -> SparkSession:
    """Session with the settings the operators expect; ``conf`` wins."""
    settings: dict[str, object] = {
        "spark.sql.session.timeZone": SESSION_TIME_ZONE,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        FORCE_SKEW_CONF: "true",
        COMPRESSION_FACTOR_CONF: COMPRESSION_FACTOR,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites of column expressions are not needed; recording them slows plan building.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that decide results on a session we did not build.

    A factor for compressed files that the user chose stays.
    """
    spark.conf.set("spark.sql.session.timeZone", SESSION_TIME_ZONE)
    spark.conf.set(FORCE_SKEW_CONF, "true")
    if float(spark.conf.get(COMPRESSION_FACTOR_CONF)) == 1:
        spark.conf.set(COMPRESSION_FACTOR_CONF, str(COMPRESSION_FACTOR))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: executors of a
    cluster cannot read each other's local disks.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    folder = tempfile.mkdtemp(prefix="fleetlens-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` once to the shared folder so several results can read it.

    Used for scopes that feed many named results of one report.  Unlike a
    cache, the written rows outlive the executors that computed them.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
