"""Similarity join of names: all pairs whose similarity reaches a threshold, without meeting all pairs.

Every rung of the ladder has keys under which its pairs meet. Equal names share their core tokens; of two sets of
tokens of which one holds the other, the larger holds the rarest token of the smaller; an acronym equals the other
name's initials. What the ratio of matching blocks decides meets under pairs of letters:

If texts of lengths x and y have a ratio of t or more, their blocks hold m >= t * (x + y) / 2 letters. Between two blocks
at least one text has a letter of its own, of which there are x + y - 2m in all, so there are at most that many blocks
and one. A block of n letters has n - 1 pairs of neighbours, hence the texts share at least c = 3m - 1 - x - y of them.
So the rarest (x - 1) - c + 1 pairs of the one and the rarest (y - 1) - c + 1 of the other must have one in common: for
each length that the other side has, a name is entered under just these. Of candidates, all shared pairs are counted,
and then all shared letters, of which there must be m, before the ratio is computed. Where c is not positive the texts are short, and they meet under
single letters.

Thresholds are a column, so that each name of one side may ask for its own. They must be above 2/3 for the bound to hold.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import core_tokens, initials, similarity, tokens
from tidemark.tables import written

LEAST = 2 / 3
#: Guards ceilings against rounding.
EPS = 1e-9


def described(names: DataFrame) -> DataFrame:
    """Distinct names (null and wordless ones left out, as they are like nothing) with what the rungs compare."""
    spoken = names.withColumns({"core": core_tokens("name"), "raw": tokens("name")}).where("size(core) > 0")
    text = F.array_join("core", " ")
    return spoken.select(*names.columns, "core", text.alias("text"), F.length(text).alias("size"), F.array_distinct(F.array(initials(F.col("raw")), initials(F.col("core")))).alias("initials"))


def _met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.join(right, list(keys)).select("a", "b")


def by_rule(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of names (a, b) that a rung before the ratio may join, from described names. ``least`` of a bounds them by
    the value of the rung."""
    one, two = left.withColumnRenamed("name", "a"), right.withColumnRenamed("name", "b")
    equal = _met(one.select("a", "text"), two.select("b", "text"), "text")
    lower = one.where("least <= 0.92")
    words = lower.select("a", F.explode(F.array_distinct("core")).alias("w")), two.select("b", F.explode(F.array_distinct("core")).alias("w"))
    held = words[0].unionByName(words[1].withColumnRenamed("b", "a")).groupBy("w").agg(F.count("*").alias("held"))
    rarest = lambda rows, name: rows.join(held, "w").groupBy(name).agg(F.min_by("w", F.struct("held", "w")).alias("w"))
    inside = _met(rarest(words[0], "a"), words[1], "w").unionByName(_met(words[0], rarest(words[1], "b"), "w"))
    single = lambda rows, name: rows.where("size(core) = 1").select(name, F.get("core", F.lit(0)).alias("w"))
    short = lambda rows, name: rows.select(name, F.explode("initials").alias("w"))
    lowest = one.where("least <= 0.90")
    acronym = _met(single(lowest, "a"), short(two, "b"), "w").unionByName(_met(short(lowest, "a"), single(two, "b"), "w"))
    return equal.unionByName(inside).unionByName(acronym).distinct()


def shared_pairs(x: Column, y: Column, least: Column) -> Column:
    """How many pairs of neighbouring letters two texts of these lengths share at least; null if their ratio can't be ``least``."""
    m = F.ceil(least * (x + y) / 2 - EPS)
    return F.when(m <= F.least(x, y), 3 * m - 1 - x - y)


def shared_letters(a: Column, b: Column) -> Column:
    """How many letters two texts have in common, in any order."""
    held = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(held(a, c), held(b, c)))


def letter_pairs(rows: DataFrame, width: int = 2) -> DataFrame:
    """(name, gram, rank): the pairs (or single letters) of each text, n-th occurrences told apart, with their number in it."""
    places = F.sequence(F.lit(1), F.greatest(F.col("size") - (width - 1), F.lit(1)))
    each = rows.where(F.col("size") >= width).select("name", F.explode(F.transform(places, lambda i: F.substring("text", i, F.lit(width)))).alias("g"))
    counted = each.groupBy("name", "g").agg(F.count("*").alias("n"))
    return counted.select("name", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.concat("g", i.cast("string")))).alias("gram"))


def entered(rows: DataFrame, other_sizes: DataFrame, ranked: DataFrame, side: str, least: DataFrame) -> DataFrame:
    """(name, gram, x, y): the grams under which a name of length x looks for names of length y. ``least`` has the distinct
    thresholds, with which the side that has none of its own is entered."""
    own = rows.select("name", "size", "least") if "least" in rows.columns else rows.select("name", "size").join(F.broadcast(least))
    sized = own.join(F.broadcast(other_sizes), (F.col("other") >= F.col("size") * F.col("least") / (2 - F.col("least")) - EPS) & (F.col("other") <= F.col("size") * (2 - F.col("least")) / F.col("least") + EPS))
    most = sized.withColumn("c", shared_pairs(F.col("size"), F.col("other"), F.col("least"))).where("c > 0").withColumn("most", F.col("size") - F.col("c")).drop("c")
    x, y = ("size", "other") if side == "a" else ("other", "size")
    return most.join(ranked, "name").where("place <= most").select(F.col("name").alias(side), "gram", F.col(x).alias("x"), F.col(y).alias("y"), "least")


class Index(NamedTuple):
    """Described names of both sides and (side, name, grams): the letter pairs of each, the rarest first."""

    left: DataFrame
    right: DataFrame
    listed: DataFrame


def index(left: DataFrame, right: DataFrame) -> Index:
    """``left`` (name, least) and ``right`` (name), of which the former may be many times in it, ready to be joined."""
    if (low := left.agg(F.min("least")).first()[0]) is not None and low <= LEAST:
        raise ValueError("thresholds must be above 2/3")
    lefts, rights = written(described(left.groupBy("name").agg(F.min("least").alias("least")))), written(described(right.select("name").distinct()))
    grams = written(letter_pairs(lefts).withColumn("side", F.lit(0)).unionByName(letter_pairs(rights).withColumn("side", F.lit(1))))
    held = grams.groupBy("gram").agg(F.count("*").alias("held"))
    listed = grams.join(held, "gram").groupBy("side", "name").agg(F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("all"))
    return Index(lefts, rights, written(listed.select("side", "name", F.transform("all", lambda g: g["gram"]).alias("grams"))))


def _entries(ix: Index) -> tuple[DataFrame, DataFrame]:
    """The grams under which the names of both sides look for each other."""
    left, right, listed = ix
    least = left.select("least").distinct()
    place = lambda k: listed.where(F.col("side") == k).select("name", F.posexplode("grams").alias("at", "gram")).select("name", "gram", (F.col("at") + 1).alias("place"))
    sizes = lambda rows: rows.select(F.col("size").alias("other")).distinct()
    return entered(left, sizes(right), place(0), "a", least), entered(right, sizes(left), place(1), "b", least)


def meetings(ix: Index) -> DataFrame:
    """(name, met): about how many names each of the left side meets under letters, counted without meeting them."""
    one, two = _entries(ix)
    keys = ["gram", "x", "y", "least"]
    by_pairs = one.join(two.groupBy(*keys).agg(F.count("*").alias("n")), keys).select(F.col("a").alias("name"), "n")
    brief = lambda t: F.ceil(2 / (3 * t - 2))
    others = ix.right.join(F.broadcast(ix.left.agg(F.min("least").alias("lowest")))).where(F.col("size") <= brief(F.col("lowest"))).agg(F.count("*").alias("n"))
    by_letters = ix.left.where(F.col("size") <= brief(F.col("least"))).join(F.broadcast(others)).select("name", "n")
    return by_pairs.unionByName(by_letters).groupBy("name").agg(F.sum("n").alias("met"))


def by_ratio(ix: Index) -> DataFrame:
    """Pairs of names (a, b) whose ratio may reach ``least`` of a: few more than do, none that does is left out."""
    left, right, listed = ix
    one, two = _entries(ix)
    met = one.join(two, ["gram", "x", "y", "least"]).select("a", "b", "x", "y", "least").distinct()
    whole = lambda k, name: listed.where(F.col("side") == k).select(F.col("name").alias(name), F.col("grams").alias(f"grams_{name}"))
    text = lambda rows, name: rows.select(F.col("name").alias(name), F.col("text").alias(f"text_{name}"))
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    counted = met.join(whole(0, "a"), "a").join(whole(1, "b"), "b").where(common >= shared_pairs(F.col("x"), F.col("y"), F.col("least"))).select("a", "b", "x", "y", "least")
    spelled = counted.join(text(left, "a"), "a").join(text(right, "b"), "b").where(shared_letters(F.col("text_a"), F.col("text_b")) >= F.ceil(F.col("least") * (F.col("x") + F.col("y")) / 2 - EPS))
    return spelled.select("a", "b").unionByName(_short(left, right)).distinct()


def _short(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of texts for which the bound on letter pairs says nothing: they share a letter."""
    # c <= 0 means 3m <= 1 + x + y; with m >= t (x + y) / 2 and t above 2/3 the sum of lengths is bounded
    brief = lambda rows, t: rows.where(F.col("size") <= F.ceil(2 / (3 * t - 2)))
    weakest = F.col("least")
    one = brief(left, weakest).select(F.col("name").alias("a"), F.col("size").alias("x"), "least", F.explode(F.array_distinct(F.split("text", ""))).alias("w"))
    lowest = left.agg(F.min("least").alias("lowest"))
    two = brief(right.join(F.broadcast(lowest)), F.col("lowest")).select(F.col("name").alias("b"), F.col("size").alias("y"), F.explode(F.array_distinct(F.split("text", ""))).alias("w"))
    return one.where("w <> ''").join(two, "w").where(shared_pairs(F.col("x"), F.col("y"), F.col("least")) <= 0).select("a", "b").distinct()


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``left`` (name, least) and ``right`` (name), both distinct, that ``similar`` computes."""
    return _candidates(index(left, right))


def _candidates(ix: Index) -> DataFrame:
    return by_rule(ix.left, ix.right).unionByName(by_ratio(ix)).distinct()


def found(ix: Index, names: DataFrame | None = None) -> DataFrame:
    """(a, b, s) as ``similar``, of the left names that are in ``names`` if that is given."""
    if names is not None:
        ix = ix._replace(left=written(ix.left.join(names.select("name").distinct(), "name", "left_semi")))
    met = _candidates(ix).join(ix.left.select(F.col("name").alias("a"), "least"), "a")
    return met.withColumn("s", similarity("a", "b")).where("s >= least").select("a", "b", "s")


def similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, s): all pairs of ``left`` (name, least) and ``right`` (name) whose similarity s is at least ``least``."""
    return found(index(left, right))
