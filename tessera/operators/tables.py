"""Intermediate tables: written once in the folder that all machines share, so that what is read several times is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet below spark.checkpoint.dir, read back. A local session without the setting gets a temporary folder; a cluster without it is
    refused, as a machine's own folder isn't seen by the others. The files belong to the session's folder and go with it."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        at = spark.sparkContext.getCheckpointDir()
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
