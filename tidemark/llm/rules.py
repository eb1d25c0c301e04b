"""Quality rules by weak supervision.

Each rule looks at one measurement of a text and votes good, votes bad or abstains. Why texts get bad votes is
hidden: a text is plain, or there is a cause that several rules see at once. Causes are declared with the rules that
see them, and a cause may be a fault of quality (noise, repetition, shouting) or not (a text that is only short). Given its
cause, rules vote independently; so rules that see one fault count once, not twice, and a false alarm that comes with
a harmless cause does not add up. Expectation-maximisation over the counts of all vote patterns estimates, without
labels, how frequent every cause is and how often each rule votes bad under it; the posterior probability that a text's
cause is harmless replaces a chain of must-pass filters. No rule is trusted beforehand, and none is taken to be right
on more than ``MOST_SURE`` of texts, so that a bad vote which no other rule shares can be outvoted.

Everything per row is a DataFrame expression. At most 3**len(rules()) pattern counts reach the driver, where the
estimation runs on plain numbers; they are counts over all rows. Texts are measured once: the measurements are
written to the shared folder, counted, and read again for the verdict.

Defined results: null and empty texts have zero measurements and only vote where that means something; repeated
rows are judged each; an empty table gives an empty result; input columns that clash with the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table, unused

SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
#: Upper bound of every accuracy: what is estimated never says that a rule can't be wrong.
MOST_SURE = 0.99
#: Where the estimation starts: chances of a bad vote on plain texts, from a rule that sees the cause, and from one that does not.
START_PLAIN, START_SEEN, START_UNSEEN = 0.02, 0.4, 0.05
START_GOOD = 0.8


class Cause(NamedTuple):
    """Why texts get bad votes: the names of the rules that see it, and whether texts are good all the same."""

    name: str
    seen_by: tuple[str, ...]
    good: bool


#: The first stands for texts without any cause.
CAUSES = (
    Cause("plain", (), True),
    Cause("short", ("length",), True),
    Cause("noise", ("symbols", "letters", "word_length"), False),
    Cause("repetition", ("repeats", "variety", "dup_lines"), False),
    Cause("shouting", ("capitals", "letters"), False),
)


class Estimate(NamedTuple):
    """Share of each cause, whether it is good, and under each the chance of a bad vote of every rule that votes."""

    shares: list[float]
    good: list[bool]
    bad: list[list[float]]

    @property
    def prior(self) -> float:
        return sum(s for s, g in zip(self.shares, self.good) if g)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows which the text holds at least twice, first ones included.

    Windows are compared by 64-bit hash. Texts without a repeated window stop after one hash set; others
    sort their windows, so the cost is n log n.
    """

    def covered(hashes: Column) -> Column:
        paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(paired, lambda p: F.transform(F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"])), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(F.array_sort(twice), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def measured(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 6, F.when(F.size(w) > 3, let(hashes, covered)).otherwise(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return let(words, measured)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_kinds", "n_upper", "n_letters")


def measurements(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns MEASURES: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides."""
    words, lines = unused([*df.columns, *MEASURES], "words"), unused([*df.columns, *MEASURES], "lines")
    whole = F.coalesce(F.col(text), F.lit(""))
    split = F.filter(F.split(whole, SPACE_RUN), lambda w: w != "")
    told = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    chars = F.length(F.array_join(words, ""))
    left = lambda drop: F.length(F.regexp_replace(whole, drop, ""))
    made = {
        "n_words": F.size(words), "word_chars": chars, "n_symbols": left(NOT_SYMBOLS), "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": repeat_words(F.col(words)),
        "n_kinds": F.size(F.array_distinct(words)), "n_upper": left(r"[^\p{Lu}]+"), "n_letters": left(r"[^\p{L}\p{M}\p{N}]+"),
    }
    spoken = df.withColumns({words: split, lines: told})
    return spoken.withColumns({k: made[k].cast("long") for k in MEASURES}).drop(words, lines)


def vote(value: Column, good_below: float, bad_above: float) -> Column:
    return F.when(value <= good_below, 1).when(value >= bad_above, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """The labelling functions over measurements: 1 good, -1 bad, 0 no opinion."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    length, letters = F.col("word_chars") / words, F.col("n_letters") / chars
    # how fast the vocabulary grows: the logarithm of different words over that of words
    growth = F.when(F.col("n_words") >= 20, F.log(F.col("n_kinds")) / F.log(F.col("n_words")))
    return {
        "length": F.when(F.col("n_words") >= 60, 1).when(F.col("n_words") < 20, -1).otherwise(0),
        "word_length": F.when(length.between(3, 8), 1).when((length < 2) | (length > 14), -1).otherwise(0),
        "symbols": vote(F.col("n_symbols") / words, 0.02, 0.15),
        "letters": F.when(F.col("n_words") == 0, 0).when(letters >= 0.92, 1).when(letters < 0.88, -1).otherwise(0),
        "repeats": vote(F.col("n_repeat_words") / words, 0.15, 0.4),
        "variety": F.when(growth >= 0.8, 1).when(growth < 0.75, -1).otherwise(0),
        "dup_lines": vote(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), 0.2, 0.4),
        "capitals": vote(F.col("n_upper") / chars, 0.15, 0.4),
    }


def estimate(patterns: Mapping[tuple[int, ...], int], causes: Sequence[tuple[Sequence[int], bool]] | None = None, rounds: int = 200) -> Estimate:
    """The causes' shares and the rules' habits that make the counts of vote ``patterns`` likely.

    ``causes`` are the numbers of the rules that see each, and whether it is good; the first is the plain one. Without
    any there is one fault that all rules see. Starting values and pseudo-counts of two votes fix which cause is which. A
    rule votes bad on at most half of plain texts, and under a fault at least as often as on plain texts, so that no bad
    vote speaks for a text.
    """
    width = len(next(iter(patterns))) if patterns else 0
    causes = list(causes or [((), True), (range(width), False)])
    good = [g for _, g in causes]
    first = [[START_PLAIN if not k else START_SEEN if j in seen else START_UNSEEN for j in range(width)] for k, (seen, _) in enumerate(causes)]
    even = lambda want: sum(g == want for g in good)
    rest = [(1 - START_GOOD) / 2 / max(1, even(True) - 1) if g else (1 - START_GOOD) / max(1, even(False)) for g in good]
    shares = [1 - sum(rest[1:]), *rest[1:]]
    if not patterns:
        return Estimate(shares, good, first)
    bad = first
    for _ in range(rounds):
        held = [2 * s for s in shares]
        against = [[2 * x for x in row] for row in first]
        voted = [[2.0] * width for _ in causes]
        for v, n in patterns.items():
            for k, p in enumerate(belonging(v, shares, bad)):
                held[k] += n * p
                for j, x in enumerate(v):
                    if x:
                        voted[k][j] += n * p
                        against[k][j] += n * p * (x < 0)
        total = sum(held)
        shares = [max(1e-4, h / total) for h in held]
        shares = [s / sum(shares) for s in shares]
        rate = [[min(MOST_SURE, max(1 - MOST_SURE, a / n)) for a, n in zip(*rows)] for rows in zip(against, voted)]
        plain = [min(0.5, x) for x in rate[0]]
        bad = [plain] + [row if g else [max(x, y) for x, y in zip(row, plain)] for row, g in zip(rate[1:], good[1:])]
    return Estimate(shares, good, bad)


def _logs(shares: Sequence[float], bad: Sequence[Sequence[float]], votes: Sequence[int]) -> list[float]:
    return [math.log(s) + sum(math.log(p if x < 0 else 1 - p) for x, p in zip(votes, row) if x) for s, row in zip(shares, bad)]


def belonging(votes: Sequence[int], shares: Sequence[float], bad: Sequence[Sequence[float]]) -> list[float]:
    """The probability of each cause, given the votes."""
    z = _logs(shares, bad, votes)
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def posterior(votes: tuple[int, ...], found: Estimate) -> float:
    """The probability that a text with these votes is good."""
    return sum(p for p, g in zip(belonging(votes, found.shares, found.bad), found.good) if g)


def weigh(measured: DataFrame, least: float = 0.5) -> DataFrame:
    """Add ``posterior`` and ``kept`` (posterior of at least ``least``) to rows with the columns MEASURES, which are read twice."""
    made = rules()
    names = list(made)
    counts = measured.select(*(v.alias(k) for k, v in made.items())).groupBy(*made).count().collect()
    found = estimate({tuple(r[k] for k in made): r["count"] for r in counts}, [([names.index(n) for n in c.seen_by], c.good) for c in CAUSES])
    logs = []
    for share, row in zip(found.shares, found.bad):
        z = F.lit(math.log(share))
        for column, p in zip(made.values(), row):
            z = z + F.when(column < 0, math.log(p)).when(column > 0, math.log(1 - p)).otherwise(0.0)
        logs.append(z)
    good = F.array(*(F.lit(g) for g in found.good))

    def chance(z: Column) -> Column:
        e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        return total(F.transform(F.arrays_zip(e.alias("e"), good.alias("g")), lambda x: F.when(x["g"], x["e"]).otherwise(0.0))) / total(e)

    return measured.withColumn("posterior", let(F.array(*logs), chance)).withColumn("kept", F.col("posterior") >= least)


def judge(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """Add measurements, ``posterior`` and ``kept`` to every row; all columns are written once on the way."""
    return weigh(materialize(measurements(df, text), "measured"), least)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = measurements(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    judged = weigh(materialize(measured, "measured"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "posterior")


QUERIES = {"op7_rules": op7_rules}
ORACLES: dict[str, str] = {}
