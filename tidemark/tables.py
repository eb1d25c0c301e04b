"""Tables that are used again: lineage is cut where every executor can read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A session that runs on this machine alone may leave it unset and then
    uses its warehouse; on a cluster there is no folder known to be shared, and that is an error."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-scratch"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own in the shared folder. Columns are packed and read one by one, so it takes a fraction of
    what a checkpoint of whole rows does."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
