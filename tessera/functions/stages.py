"""Ends of lineage in the folder that the cluster's driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, set for checkpoints; a temporary one only in local mode where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
        held = sc._jsc.sc().getCheckpointDir()
    return named or held.get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are in the shared folder, lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
