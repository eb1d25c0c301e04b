"""Writing: upserts, append-only logs, and publishing whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_per_key(batch: DataFrame, key: str, position: str) -> DataFrame:
    return batch.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(position)))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, batch: DataFrame, key: str = "match_id", position: str = "position") -> DataFrame:
    """All rows of ``old`` with those of ``batch`` in their place or added; the last of a key in the batch wins.

    ``change`` says new, changed or same (the same also where a batch row equals what is there). One full outer
    join on the key.
    """
    new = last_per_key(batch, key, position).drop(position)
    body = [c for c in old.columns if c != key]
    a = old.select(F.col(key).alias("_ka"), F.struct(*body).alias("_a"))
    b = new.select(F.col(key).alias("_kb"), F.struct(*body).alias("_b"))
    both = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    change = F.when(F.col("_ka").isNull(), "new").when(F.col("_kb").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    return both.select(F.coalesce("_ka", "_kb").alias(key), F.coalesce("_b", "_a").alias("_v"), change.alias("change")).select(key, "_v.*", "change")


def never_regress(old_status: Column, new_status: Column) -> Column:
    """Whether a later record may replace an earlier one: status only moves forward."""
    order = F.array(F.lit("upcoming"), F.lit("live"), F.lit("completed"))
    return F.array_position(order, new_status) >= F.array_position(order, old_status)


def new_only(batch: DataFrame, log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of ``batch`` whose identity is neither in the log nor earlier in the batch; null parts are equal."""
    first = batch.dropDuplicates(list(keys))
    known = log.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return first.join(known, on, "left_anti")


def append(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path) if partitions else df.write.mode("append").parquet(path)


def publish(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace a table: write beside it, set the old one aside and rename the new one into its place.

    The old table is deleted only when the new one stands; if that rename fails, the old one is put back. Between
    the two renames a reader finds no table for a moment: file systems don't swap folders.
    """
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.format(form).save(beside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    fs = new.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old.{uuid.uuid4().hex}")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"could not publish {path}")
    if had:
        fs.delete(aside, True)


def evolve(*versions: DataFrame) -> DataFrame:
    """Rows of all versions of a table; columns that a version lacks are null."""
    out = versions[0]
    for v in versions[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    return out


def newest_first_bound(log: DataFrame, overlap_days: int = 3, bootstrap_days: int = 30, now: Column | None = None) -> DataFrame:
    """From when to fetch again: the newest completed start less an overlap, or a bootstrap span without one."""
    now = now if now is not None else F.current_timestamp()
    return log.agg(F.max(F.when(F.col("status") == "completed", F.col("start_ts"))).alias("_m")).select(F.coalesce(F.col("_m") - F.make_dt_interval(days=F.lit(overlap_days)), now - F.make_dt_interval(days=F.lit(bootstrap_days))).alias("since"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
