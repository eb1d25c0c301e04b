"""Best-of-n series from per-game probabilities, and the sequence of maps they are played on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a veto's statements: a map is named behind the first, or before the second kind at the end.
PICK, REMAIN = "pick", ("remain", "remains")


def win_counts(probs: Column) -> Column:
    """Probabilities of 0, 1, ... n wins when all n games are played."""

    def played(mass: Column, p: Column) -> Column:
        lost = F.transform(F.concat(mass, F.array(F.lit(0.0))), lambda x: x * (1 - p))
        won = F.transform(F.concat(F.array(F.lit(0.0)), mass), lambda x: x * p)
        return F.zip_with(lost, won, lambda a, b: a + b)

    return F.aggregate(probs, F.array(F.lit(1.0)), played)


def series_prob(probs: Column) -> Column:
    """Chance to win more than half. Games after the decision cannot change the winner, so all are played."""
    need = F.floor(F.size(probs) / 2).cast("int") + 1
    return F.aggregate(F.slice(win_counts(probs), need + 1, F.size(probs)), F.lit(0.0), lambda s, x: s + x)


def filled(probs: Column) -> Column:
    """Games whose chance is unknown get the mean of the known ones; even odds if none is known."""
    known = F.filter(probs, lambda p: p.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(F.lit(0.5))
    return F.transform(probs, lambda p: F.coalesce(p, mean))


def length_distribution(probs: Column) -> Column:
    """Map from games played to probability, the series ending when one side has won more than half.

    The series is over by game k exactly if a majority is reached in the first k games, so P(length = k) is
    the difference of that chance between k and k - 1.
    """
    need = F.floor(F.size(probs) / 2).cast("int") + 1

    def over_by(k: Column) -> Column:
        mass = win_counts(F.slice(probs, F.lit(1), k))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
        return total(F.transform(mass, lambda x, i: F.when((i >= need) | (k - i >= need), x).otherwise(0.0)))

    games = F.sequence(need, F.size(probs))
    chance = F.transform(games, lambda k: over_by(k) - F.when(k > need, over_by(k - 1)).otherwise(0.0))
    return F.map_from_arrays(F.transform(games, lambda k: k.cast("string")), chance)


def constant_length_distribution(p: Column, best_of: Column) -> Column:
    """The same for one probability and best of 1, 3 or 5, in closed form."""
    q = 1 - p
    three = p * p + q * q
    sweep = p * p * p + q * q * q
    four = 3 * p * q * three
    return (
        F.when(best_of == 1, F.create_map(F.lit("1"), F.lit(1.0)))
        .when(best_of == 3, F.create_map(F.lit("2"), three, F.lit("3"), 1 - three))
        .when(best_of == 5, F.create_map(F.lit("3"), sweep, F.lit("4"), four, F.lit("5"), 1 - sweep - four))
    )


def parse_veto(veto: Column, known: Column) -> Column:
    """Maps picked, in order, then the one that remains; spelled as in ``known`` where it is there; null if none.

    Only the last statement of what remains counts.
    """
    statements = F.split(F.coalesce(veto, F.lit("")), ";")
    words = F.transform(statements, lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    low = lambda ws: F.transform(ws, lambda w: F.lower(w))
    rests = lambda ws: F.lower(F.coalesce(F.try_element_at(ws, F.lit(-1)), F.lit(""))).isin(*REMAIN)
    spelled = lambda name: F.coalesce(F.get(F.filter(known, lambda k: F.lower(k) == F.lower(name)), F.lit(0)), name)

    def named(ws: Column) -> Column:
        at = F.array_position(low(ws), PICK).cast("int")
        head, tail = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, at + 1, F.greatest(F.size(ws) - at, F.lit(0)))
        name = F.array_join(F.when(rests(ws), head).when(at > 0, tail).otherwise(F.slice(ws, 1, 0)), " ")
        # a map has letters and apostrophes only
        return F.struct(rests(ws).alias("rest"), F.when(~name.rlike("[^A-Za-z'’ ]"), name).otherwise("").alias("name"))

    told = F.filter(F.transform(words, named), lambda x: x["name"] != "")
    names = lambda rest: F.transform(F.filter(told, lambda x: x["rest"] == rest), lambda x: spelled(x["name"]))
    left = names(F.lit(True))
    every = F.concat(names(F.lit(False)), F.slice(left, F.greatest(F.size(left), F.lit(1)), 1))
    return F.when(F.size(every) > 0, every)


def complete_sequence(played: Column, veto: Column, best_of: Column) -> Column:
    """struct(maps, n_filled, n_fallback, source): what was played, then the veto's tail if its head agrees
    with that and it names all games, else nulls."""
    n = F.size(played)
    missing = F.greatest(best_of - n, F.lit(0))
    low = lambda a: F.transform(a, lambda m: F.lower(m))
    fits = F.coalesce((F.size(veto) == best_of) & (low(F.slice(veto, F.lit(1), n)) == low(played)), F.lit(False))
    tail = F.when(fits, F.slice(veto, n + 1, missing)).otherwise(F.array_repeat(F.lit(None).cast("string"), missing))
    maps = F.concat(F.slice(played, F.lit(1), best_of), F.when(missing > 0, tail).otherwise(F.array().cast("array<string>")))
    filled = F.when(fits & (missing > 0), missing).otherwise(0)
    fallback = missing - filled
    source = F.when(fallback > 0, "fallback").when(filled > 0, "veto").otherwise("played")
    return F.struct(maps.alias("maps"), filled.alias("n_filled"), fallback.alias("n_fallback"), source.alias("source"))
