from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.time import estimated_end
from tidemark.operators import ratings as batch
from tidemark.sources import records
from tidemark.streaming import ratings, slots

T0 = datetime(2024, 1, 1)
SCHEMA = "captured_at timestamp, source string, capture_kind string, market string, line double, match_id string"


def rows(spark):
    return spark.createDataFrame([(T0 + timedelta(hours=i % 5), "s", "freeze" if i % 3 else "close", "m", None, str(i % 4)) for i in range(20)], SCHEMA)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_append_is_idempotent(spark, tmp_path):
    at = str(tmp_path)
    rows(spark).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{at}/in")
    keys = ("source", "capture_kind", "market", "line", "match_id")
    for k in range(2):  # the second run starts over and must add nothing
        slots.ingest(stream, f"{at}/log", keys, f"{at}/c{k}").awaitTermination()
        assert spark.read.parquet(f"{at}/log").count() == rows(spark).dropDuplicates(list(keys)).count()


def test_slot_changes_equal_the_batch(spark, tmp_path):
    at = str(tmp_path)
    rows(spark).repartition(3).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    got = {(r.slot, r.capture_kind) for r in run(slots.slot_changes(stream, F.col("match_id")), "slot_changes").collect()}
    assert got == {(r.match_id, r.capture_kind) for r in rows(spark).select("match_id", "capture_kind").distinct().collect()}


def test_stream_ratings_equal_the_replay(spark, tmp_path):
    at = str(tmp_path)
    games = records.synthetic_contests(spark, 40, teams=5).where("team1_score <> team2_score").withColumn("won", (F.col("team1_score") > F.col("team2_score")).cast("int")).withColumn("end_ts", estimated_end("start_ts", "best_of"))
    games = games.withColumn("universe", F.lit("u"))
    late = games.orderBy(F.desc("start_ts")).limit(1).withColumns({"start_ts": F.col("start_ts") + F.expr("INTERVAL 30 DAY"), "end_ts": F.col("end_ts") + F.expr("INTERVAL 30 DAY"), "match_id": F.lit(10_000).cast("long")})
    games.coalesce(1).write.parquet(f"{at}/in/a")
    late.coalesce(1).write.parquet(f"{at}/in/b")
    later = late.withColumn("match_id", F.lit(10_001).cast("long")).withColumn("start_ts", F.col("start_ts") + F.expr("INTERVAL 60 DAY"))
    later.coalesce(1).write.parquet(f"{at}/in/c")
    stream = spark.readStream.schema(games.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    got = {(r.match_id, r.team): r.rating for r in run(ratings.rating_changes(stream), "rating_changes").where("match_id < 10000").collect()}
    want = {(r.match_id, str(r.team)): r.rating for r in batch.rating_log(batch.single_map(games)).where("kind = 'change'").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_late_predictions(spark):
    df = spark.createDataFrame([(T0, T0 - timedelta(seconds=299)), (T0, T0 - timedelta(seconds=300))], "start_ts timestamp, made_at timestamp")
    assert [r.status for r in slots.frozen_or_late(df).collect()] == ["too_late", "open"]
