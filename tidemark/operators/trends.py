"""Form tables: per team rates over a scope of its recent facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_rows(facts: DataFrame, key: str, n: int, order: list[str]) -> DataFrame:
    """The ``n`` newest rows of each key, by ``order`` descending; only n rows a key leave each task."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return facts.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def ratio(numerator: Column, denominator: Column, ok: Column | None = None) -> Column:
    """Ratio of sums over rows that have the input, null without any."""
    pick = (lambda x: F.when(ok, x)) if ok is not None else (lambda x: x)
    return F.sum(pick(numerator)) / F.nullif(F.sum(pick(denominator)), F.lit(0))


def trends(facts: DataFrame, *, min_maps: int = 5, window_maps: int | None = None, active_days: int | None = None, date_from: Column | None = None, date_to: Column | None = None, event: str | None = None, now: Column | None = None, order: tuple[str, ...] = ("start_ts", "match_id", "map_index")) -> DataFrame:
    """One row per team over the facts in scope (``facts`` as from trends_facts, or with its main columns).

    Lifetime counts and the last appearance look at all facts; ``min_maps`` counts facts in scope. An event
    nobody knows gives an empty table. Missing inputs leave their fact out of that ratio on both sides.
    """
    have = set(facts.columns)
    scope = F.lit(True)
    if event is not None:
        scope = scope & (F.col("event") == event)
    if date_from is not None:
        scope = scope & (F.col("start_ts") >= date_from)
    if date_to is not None:
        scope = scope & (F.col("start_ts") <= date_to)
    life = facts.groupBy("team").agg(F.count("*").alias("n_lifetime"), F.max("start_ts").alias("last_any"), F.count(F.when(scope, 1)).alias("n_scope"))
    keep = F.col("n_scope") >= max(min_maps, 1)
    if active_days is not None:
        keep = keep & (F.col("last_any") >= now - F.make_dt_interval(days=F.lit(active_days)))
    used = facts.where(scope)
    by = [c for c in order if c in have]
    used = last_rows(used, "team", window_maps, by) if window_maps else used
    n = F.count("*")
    measures = [n.alias("n_window"), F.max("start_ts").alias("last_ts"), (F.sum("won") / n).alias("win_rate"), (F.sum("spread") / n).alias("spread_avg")]
    if "name" in have:
        measures.append(F.max_by("name", F.struct("start_ts", "match_id")).alias("name"))
    if "metric" in have:
        measures.append(ratio(F.col("metric"), F.col("rounds"), F.col("metric").isNotNull()).alias("metric_share"))
    if "pistols_played" in have:
        measures.append(ratio(F.col("pistols_won"), F.col("pistols_played")).alias("pistol_wr"))
    if "kills" in have:
        measures.append(F.avg("kills").alias("comb_kills_avg"))
    if "fk" in have:
        measures.append((F.lit(12.0) * ratio(F.col("fk") - F.col("fd"), F.col("rounds"), F.col("fk").isNotNull())).alias("fk_diff12"))
    if "methods" in have:
        measures += [F.sum(F.get("methods", F.lit(i))).alias(f"_m{i}") for i in range(4)]
    out = used.groupBy("team").agg(*measures).join(life.where(keep).drop("last_any", "n_scope"), "team")
    if "methods" in have:
        total = F.nullif(sum(F.col(f"_m{i}") for i in range(4)), F.lit(0))
        out = out.withColumn("method_mix", F.when(total.isNotNull(), F.array(*(F.col(f"_m{i}") / total for i in range(4))))).drop(*(f"_m{i}" for i in range(4)))
    if "agents" in have:
        counted = used.select("team", F.explode("agents").alias("agent")).groupBy("team", "agent").agg(F.count("*").alias("n"))
        top = counted.withColumn("_r", F.row_number().over(W.partitionBy("team").orderBy(F.desc("n"), "agent"))).where("_r <= 5")
        agents = top.groupBy("team").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "agent", "n"))), lambda x: F.struct(x["agent"].alias("agent"), x["n"].alias("n"))).alias("agents_top"))
        out = out.join(agents, "team", "left")
    return out


def ranked(table: DataFrame, name: str = "team") -> DataFrame:
    return table.orderBy(F.desc("n_window"), F.desc("spread_avg"), name)


#: Current form: the last ten facts of teams seen in sixty days with five in all.
CURRENT_FORM = {"min_maps": 5, "window_maps": 10, "active_days": 60}
