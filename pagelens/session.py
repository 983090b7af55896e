"""What operators need of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def with_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder of spark.checkpoint.dir, or a temporary one where that is unset and Spark runs in one process (tests, local runs)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pagelens-checkpoint-"))
