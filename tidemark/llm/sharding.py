"""Sharding by rendezvous hashing over weighted shards.

Every (record key, shard) pair hashes to a uniform number u; the shard with the smallest
``-ln(u) / weight`` owns the record, so a shard gets records in proportion to its weight, and adding a
shard moves only the records that the new shard wins. Copies of one key always share a shard; that is
the law of this method, so a key that repeats without end fills its shard.

Slots are numbered without gaps in each shard. Rows are dealt to salted buckets of bounded size,
numbered inside the bucket and offset by the sizes of the buckets before it, so no shard is sorted
in one task, however large it is or however often a key repeats.

Defined results: a null key is a key of its own; null text counts zero bytes; repeated rows get one
slot each; an empty table gives an empty result; shards of weight zero or less get nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table, unused

#: Rows that one numbering bucket holds on average.
BUCKET_ROWS = 50_000


def rendezvous(key: Column, weights: Mapping[int, float] | Sequence[float]) -> Column:
    """The owning shard of ``key``."""
    pairs = weights.items() if isinstance(weights, Mapping) else enumerate(weights)
    scores = []
    for shard, weight in sorted(pairs):
        if weight > 0:
            # 52 bits of the hash, moved off zero, as a number between 0 and 1
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(int(shard))), 12).cast("double") + 0.5) / float(2**52)
            scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("s"), F.lit(int(shard)).alias("k")))
    if not scores:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*scores))["k"]


def number_in_groups(df: DataFrame, group: str, slot: str = "slot", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add gapless numbers from 0 in each ``group`` without gathering a group in one task."""
    salt, bucket, held, inner, g, b, offset = (unused([*df.columns, slot], x) for x in ("salt", "bucket", "held", "inner", "of_group", "of_bucket", "offset"))
    salted = df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
    rows = materialize(salted, "numbering")  # the salt must not change between the two uses below
    buckets = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn(bucket, F.pmod(salt, F.lit(buckets)))
    # groups x buckets rows: one for every bucket_rows rows of input in each group
    sizes = rows.groupBy(group, bucket).agg(F.count("*").alias(held))
    before = F.sum(held).over(W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(F.col(group).alias(g), F.col(bucket).alias(b), F.coalesce(before, F.lit(0)).alias(offset))
    inside = F.row_number().over(W.partitionBy(group, bucket).orderBy(salt)) - 1
    numbered = rows.withColumn(inner, inside).join(offsets, F.col(group).eqNullSafe(F.col(g)) & (F.col(bucket) == F.col(b)))
    return numbered.withColumn(slot, (F.col(offset) + F.col(inner)).cast("long")).drop(salt, bucket, inner, g, b, offset)


def assign_shards(df: DataFrame, key: str, weights: Mapping[int, float] | Sequence[float], shard: str = "shard") -> DataFrame:
    return df.withColumn(shard, rendezvous(F.col(key), weights))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    sharded = assign_shards(assign_shards(docs, "doc_id", [1.0] * 16), "doc_id", [1.0] * 17, "grown_shard")
    numbered = number_in_groups(sharded, "shard")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
