"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.tables import shared_folder

#: A word is a maximal run of code points other than space, tab, line feed, vertical tab,
#: form feed and carriage return. ``SPACES`` lists the separators for translate() and strip().
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage at a table that outlives any executor and, unlike checkpoint(), computes the
    last stage once. The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has already ended; the folder belongs to the cluster's cleaner
        pass


def unused(df_columns: list[str], base: str) -> str:
    """A column name that does not clash with those present (compared without case)."""
    taken, name = {c.lower() for c in df_columns}, base
    while name.lower() in taken:
        name += "_"
    return name
