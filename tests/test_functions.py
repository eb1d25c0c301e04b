from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import odds, series, stats, text, time


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_prices_that_are_none(spark):
    rows = spark.createDataFrame([(2.0, 2.0), (1.0, 2.0), (0.0, 2.0), (-3.0, 2.0), (float("nan"), 2.0), (float("inf"), 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in rows.select(odds.priceable(F.col("a"), F.col("b"))).collect()] == [True] + [False] * 6


def test_american_prices(spark):
    got = one(spark, a=odds.american_to_decimal(F.lit(150.0)), b=odds.american_to_decimal(F.lit(-200.0)), c=odds.american_to_decimal(F.lit(50.0)), d=odds.price_to_decimal(F.lit(1.85)))
    assert (got.a, got.b, got.c, got.d) == (2.5, 1.5, None, 1.85)


def test_shin_two_outcomes_equals_bisection(spark):
    rows = spark.createDataFrame([(1.5, 2.5), (1.9, 1.9), (1.05, 11.0), (2.2, 2.1)], "a double, b double")
    for r in rows.select(odds.shin(F.col("a"), F.col("b")).alias("x"), odds.shin_many(F.array("a", "b")).alias("y")).collect():
        assert r.x == pytest.approx(r.y[0], abs=1e-9)
    three = one(spark, p=odds.shin_many(F.array(F.lit(2.0), F.lit(3.0), F.lit(4.0)))).p
    assert sum(three) == pytest.approx(1) and three == sorted(three, reverse=True)


def test_stakes(spark):
    got = one(spark, a=odds.stake_units(F.lit(0.05), F.lit(2.0)), b=odds.stake_units(F.lit(0.5), F.lit(1.1)), c=odds.stake_units(F.lit(-0.1), F.lit(2.0)))
    assert (got.a, got.b, got.c) == (pytest.approx(1.25), 3.0, 0.0)


def test_over_is_strict(spark):
    d = F.create_map(F.lit("2"), F.lit(0.6), F.lit("3"), F.lit(0.4))
    got = one(spark, a=odds.over_probability(d, F.lit(2.5)), b=odds.over_probability(d, F.lit(2.0)), c=odds.over_probability(d, F.lit(1.0)))
    assert (got.a, got.b, got.c) == (0.4, 0.4, 1.0)


def test_wilson_and_buckets(spark):
    lo, hi = stats.wilson(F.lit(8), F.lit(10))
    none = stats.wilson(F.lit(0), F.lit(0))
    got = one(spark, lo=lo, hi=hi, a=none[0], b=none[1])
    assert (round(got.lo, 4), round(got.hi, 4), got.a, got.b) == (0.4902, 0.9433, 0.0, 1.0)
    rows = spark.createDataFrame([(x,) for x in (0.1, 0.15, 0.35, 0.36, 0.5, 0.88, 0.9)], "p double")
    assert [r[0] for r in rows.select(stats.probability_bucket(F.col("p"))).collect()] == ["extrapolation_low", "[0.15,0.35]", "[0.15,0.35]", "[0.35,0.50]", "[0.35,0.50]", "[0.65,0.88]", "extrapolation_high"]


def test_series_closed_forms(spark):
    p = 0.6
    probs = lambda n: F.array(*[F.lit(p)] * n)
    got = one(spark, a=series.series_prob(probs(3)), b=series.series_prob(probs(5)), c=series.length_distribution(probs(5)), d=series.constant_length_distribution(F.lit(p), F.lit(5)), e=series.series_prob(F.array(F.lit(0.9), F.lit(0.2), F.lit(0.5))))
    assert got.a == pytest.approx(p * p * (3 - 2 * p)) and got.b == pytest.approx(p**3 * (10 - 15 * p + 6 * p * p))
    assert sum(got.c.values()) == pytest.approx(1) and all(got.c[k] == pytest.approx(got.d[k]) for k in "345")
    assert got.e == pytest.approx(0.9 * 0.2 + 0.9 * 0.8 * 0.5 + 0.1 * 0.2 * 0.5)


def test_veto_and_sequence(spark):
    known = F.array(*map(F.lit, ("Haven", "Pearl", "Split", "Fracture")))
    veto = F.lit("A ban Haven; B ban Bind; A pick pearl; B pick Fracture; split remains")
    got = one(spark, v=series.parse_veto(veto, known), n=series.parse_veto(F.lit(" ; A ban Haven"), known), e=series.parse_veto(F.lit(None).cast("string"), known), s=series.complete_sequence(F.array(F.lit("Pearl"), F.lit("fracture")), series.parse_veto(veto, known), F.lit(3)), f=series.complete_sequence(F.array(F.lit("Haven")), series.parse_veto(veto, known), F.lit(3)), w=series.complete_sequence(F.array(F.lit("Haven"), F.lit("Split")), series.parse_veto(veto, known), F.lit(2)))
    assert got.v == ["Pearl", "Fracture", "Split"] and got.n is None and got.e is None
    assert got.s.maps == ["Pearl", "fracture", "Split"] and got.s.source == "veto"
    assert got.f.maps == ["Haven", None, None] and (got.f.source, got.f.n_fallback) == ("fallback", 2)
    assert got.w.source == "played"


def test_names(spark):
    cases = [("Team Liquid", "Liquid", 1.0), ("G2", "G2 Academy", 0.0), ("Rex Regum Qeon", "RRQ", 0.9), ("Paper Rex", "Paper", 0.92), ("Fnatic", "Fnatik", 2 * 5 / 12), ("", "x", 0.0), ("Team", "Team", 1.0)]
    rows = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(text.similarity("a", "b").alias("s"))
    assert [r.s for r in rows.collect()] == pytest.approx([c[2] for c in cases])
    got = one(spark, n=text.normalize_name(F.lit("Straße-99 É")), t=text.tier(F.lit("VCT\n 2024:\tGame Changers")), u=text.tier(F.lit("VCT 2024 Masters")), w=text.tier(F.lit("evct cup")), x=text.tournament(F.lit("Cup 2024 - Playoffs: Final")), y=text.tournament(F.lit(None).cast("string")), p=text.parse_number(F.lit("+12%"), "int"), q=text.parse_number(F.lit("–")), e=text.pair_of_numbers(F.lit("14 (9)")), k=text.team_key(F.lit(""), F.lit(" Abc ")))
    assert (got.n, got.t, got.u, got.w, got.x, got.y, got.p, got.q, got.k) == ("strasse99", "game_changers", "tier1", "other", "Cup 2024", "(unknown event)", 12, None, "abc")
    assert (got.e.n, got.e.won) == (14, 9)


def test_times(spark):
    got = one(spark, s=time.zone_to_utc(F.lit("2024-07-01 12:00:00").cast("timestamp")), w=time.zone_to_utc(F.lit("2024-01-01 12:00:00").cast("timestamp")), b=time.scope_bound(F.lit("2024-02-03"), True), n=time.scope_bound(F.lit("nonsense")), z=time.parse_moment(F.lit("2024-01-01T00:00:00Z")), e=time.estimated_end(F.lit("2024-01-01").cast("timestamp"), F.lit(7)))
    assert (got.s, got.w) == (datetime(2024, 7, 1, 16), datetime(2024, 1, 1, 17))
    assert (got.b, got.n, got.z, got.e) == (datetime(2024, 2, 3, 23, 59, 59), None, datetime(2024, 1, 1), datetime(2024, 1, 1, 3))
