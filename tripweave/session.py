"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


PARTITION_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Partitions of about 128 MB for the given input, and at least two per core."""
    return max(2 * cores, -(-input_bytes // PARTITION_BYTES))


def build_session(app: str = "tripweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    Wall-clock times are kept as they come, so the session zone is UTC.
    Skewed joins are split even where the split costs one more exchange.
    For large inputs pass `shuffle_partitions` of their size as
    spark.sql.shuffle.partitions; adaptive execution merges what turns out too small.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Limits the bytes of an Arrow batch for the session, so that a task holds little of its
    texts at a time however long they are. A lower limit stays."""
    now, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(BATCH_SETTING).lower()).groups()
    if not 0 < int(now) * 1024 ** " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only for local sessions that name none."""
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
