"""The registered queries of the training-data operators and the whole pipeline on small tables."""

import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import registry, sharding

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
QUERIES, ORACLES = registry.collect()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = lambda found: sorted(map(repr, map(tuple, found)))
    assert rows(df.select(*columns).collect()) == rows(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


@needs_tables
def test_quality_on_rows_it_has_not_seen(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").where("quality IS NOT NULL").collect()}
    rows = QUERIES["op2_quality"](spark, LARGER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    told = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(told) > 20 and sum(told) / len(told) > 0.9


@needs_tables
def test_sharding_equals_a_plain_version(spark):
    def owner(key, shards):
        def score(k):
            h = xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest()
            h = xxhash.xxh64(k.to_bytes(4, "little"), seed=h).intdigest()
            return -math.log(((h >> 12) + 0.5) / 2**52)

        return min(range(shards), key=lambda k: (score(k), k))

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    slots = defaultdict(list)
    for r in QUERIES["op10_sharding"](spark, SF).collect():
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "key", owner(r.doc_id, 16), owner(r.doc_id, 17))
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_of_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (5, None, 3), (5, "x" * 300_000, 4)], "k long, salt string, held int")
    out = sharding.number_in_groups(sharding.assign_shards(df, "k", [1.0] * 3), "shard", bucket_rows=1).collect()
    assert len(out) == 4 and {(r.salt or "")[:1] for r in out} == {"a", "", "x"} and Counter((r.shard, r.slot) for r in out).most_common(1)[0][1] == 1


@needs_tables
def test_pipeline_stage_by_stage(spark):
    """Each stage on what the one before kept: what goes, what stays, and what is changed."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, LARGER), name)
        kept[name] = docs
        if name != "packing":
            assert docs.schema == before.schema
        if name == "quality":
            labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality")
            good = before.join(labels.where("quality = 1"), "doc_id", "left_semi").count()
            assert 0.97 * good <= docs.join(labels.where("quality = 1"), "doc_id", "left_semi").count() <= good
            assert docs.count() < before.count() and docs.subtract(before).isEmpty()
        if name == "near_dedup":
            assert docs.subtract(before).isEmpty() and docs.where("length(text) > 30").groupBy("text").count().where("count > 1").isEmpty()
        if name == "pii":
            assert docs.count() == before.count() and docs.where(r"text RLIKE '[a-z0-9]@[a-z0-9-]+[.][a-z]'").isEmpty()
            same = docs.join(before.select("doc_id", F.col("text").alias("was")), "doc_id").where(r"NOT was RLIKE '[0-9@]'")
            assert same.where("NOT text <=> was").isEmpty() and docs.where("n_chars <> length(text)").isEmpty()
        if name == "mixing":
            assert docs.distinct().count() == before.distinct().count() and docs.count() >= before.count()
    pieces, rows = kept["packing"], kept["mixing"].count()
    assert pieces.where("start = 0").count() == rows
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).select("n").distinct()
    assert all(r.n == 1024 or r.n < 1024 and r.n & (r.n - 1) == 0 for r in used.collect())
