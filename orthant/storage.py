"""Shared folders: lineage is cut by tables written where every executor can read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ONE_MACHINE = "/tmp/checkpoints/orthant"
#: Whether Spark drops the shuffled files of a job as soon as it has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the session's ``spark.checkpoint.dir``.

    The cluster names that folder; where the setting is missing a local one serves sessions that
    run in one process (tests), and any other session is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = ONE_MACHINE
    return f"{root.rstrip('/')}/orthant-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` below ``folder`` and read it again: later steps, and retries after a
    lost executor, start from the files. What was shuffled for it is freed at once."""
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.unset(FREED) if before is None else conf.set(FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, name: str) -> None:
    """Remove a table of ``materialize`` that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
