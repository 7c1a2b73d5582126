"""Session helpers: a local session for tests, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(name: str = "tertulia", cores: int = 8) -> SparkSession:
    """A small local session with the settings the library assumes (UTC, adaptive execution)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _named_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session with a local master gets
    a temporary folder that goes with the process; any other raises RuntimeError, as executors
    would write to disks of their own."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"{CHECKPOINT_KEY} is unset: it must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tertulia-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set(CHECKPOINT_KEY, named)
    return named


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path for files that all executors are to see, in the folder of checkpoints."""
    return f"{_named_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_named_folder(df.sparkSession))
    return df.checkpoint(eager=True)
