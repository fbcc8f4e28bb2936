"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints `df` in the folder that spark.checkpoint.dir names; a local session without one takes its warehouse."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/checkpoints")
    return df.checkpoint()
