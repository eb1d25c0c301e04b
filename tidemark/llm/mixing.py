"""Mixing sources to target weights with soft membership.

A naive Bayes classifier over hashed words, fitted on a labelled table, gives every document a posterior over
domains. A document then adds to each domain its tokens times that posterior. Projected gradient descent finds
a rate for every document, never below ``least_rate`` (0), so that the expected domain token totals match the
targets in least squares. Steps are scaled by the inverse of the domains' token-weighted Gram matrix, which
makes a unit step safe; one step is one distributed sum of as many numbers as there are domains. A document's
rate follows from the steps so far, so no per-document state is written between them. Copies are drawn from
the rate by a hash of the document.

All of it is DataFrame expressions; the driver sees the classifier's table (buckets times domains) and sums
over domains.

Defined results: null and empty texts have no tokens, the prior as posterior and rate 1; a posterior counts at
most ``evidence`` words, so it stays soft; without labels, or with one domain only, the posterior is the prior;
targets of domains the labels lack are spread over the others; repeated rows get equal rates and draws; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table, unused

BUCKETS = 4096
#: Target shares of query op3 and of the pipeline.
PRODUCTION_TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


class Classifier(NamedTuple):
    """Domains, their log priors and, of each domain, the log likelihoods of the BUCKETS hashed words."""

    domains: list[str]
    priors: list[float]
    likely: list[list[float]]


class Solution(NamedTuple):
    """The steps that lead to the rates, the domain token totals aimed at and those reached."""

    steps: list[list[float]]
    goal: list[float]
    reached: list[float]

    @property
    def residual(self) -> float:
        """What is missed, as a share of all tokens; rates that may not fall below a bound can leave some."""
        total = sum(self.goal)
        return sum(abs(a - b) for a, b in zip(self.goal, self.reached)) / total if total else 0.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    """Words of the lower-cased text. Only the first and the last piece of a split can be empty."""
    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    ends = lambda w: (F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0), F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0))
    return let(pieces, lambda w: F.slice(w, ends(w)[0] + 1, F.size(w) - ends(w)[0] - ends(w)[1]))


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def fit_domains(docs: DataFrame, labelled: DataFrame, sample_docs: int = 4096) -> Classifier:
    """Naive Bayes on hashed words.

    ``labelled`` has doc_id and domain; at most ``sample_docs`` of its documents, by hash of the id, are used. The
    model has BUCKETS numbers for each domain, whatever the input.
    """
    known = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    counted = texts.select("domain", F.explode(_words(F.col("text"))).alias("w")).groupBy("domain", _bucket(F.col("w")).alias("bucket")).count()
    sizes = {r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()}
    domains = sorted(sizes) or ["all"]
    counts = {d: [1] * BUCKETS for d in domains}
    for r in counted.collect():
        counts[r["domain"]][r["bucket"]] += r["count"]
    total = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    return Classifier(domains, priors, [[math.log(n / sum(counts[d])) for n in counts[d]] for d in domains])


def posteriors(docs: DataFrame, model: Classifier, evidence: float = 64.0) -> DataFrame:
    """doc_id, print (hash of the text), n_tokens and p (posterior by domain) of every row.

    A text's words are folded inside its row: hashed to buckets once, then summed domain by domain over tables that
    are literals of the plan, so nothing is exploded, joined or shuffled.
    """
    tables = [F.split(F.lit(",".join(map(repr, row))), ",").cast("array<double>") for row in model.likely]

    def total(buckets: Column, likely: Column) -> Column:
        return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(likely, b))

    seen = let(F.transform(_words(F.col("text")), _bucket), lambda b: F.struct(F.size(b).alias("n"), F.array(*(total(b, t) for t in tables)).alias("s")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), seen.alias("seen"))
    share = F.least(F.lit(1.0), F.lit(evidence) / F.greatest("seen.n", F.lit(1)))
    logs = F.array(*(F.lit(p) + share * F.get("seen.s", F.lit(k)) for k, p in enumerate(model.priors)))
    shares = let(logs, lambda z: let(F.transform(z, lambda x: F.exp(x - F.array_max(z))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(e, lambda x: x / t))))
    return rows.select("doc_id", "print", F.col("seen.n").cast("long").alias("n_tokens"), shares.alias("p"))


def rate_of(steps: list[list[float]], least_rate: float) -> Column:
    """The rate after ``steps``, each clipped at the least rate."""
    rate = F.lit(1.0)
    if steps:
        history = F.array(*(F.array(*map(F.lit, map(float, u))) for u in steps))
        moved = lambda r, u: F.greatest(F.lit(float(least_rate)), r - F.aggregate(F.zip_with("p", u, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
        rate = F.aggregate(history, F.lit(1.0), moved)
    return F.when(F.col("n_tokens") > 0, rate).otherwise(1.0)


def solve_rates(scored: DataFrame, domains: list[str], targets: Mapping[str, float], least_rate: float = 0.0, keep_all: bool = False, rounds: int = 40, tolerance: float = 1e-6) -> Solution:
    """Rates by projected gradient steps; the result says how far the totals reached are from those aimed at.

    Totals add up to the tokens there are; with ``keep_all`` to as many as it takes that no domain must shrink.
    """
    k = range(len(domains))
    n, p = F.col("n_tokens"), F.col("p")
    cells = [F.sum(n * F.get(p, F.lit(a)) * F.get(p, F.lit(b))).alias(f"g{a}_{b}") for a in k for b in k if a <= b]
    row = scored.agg(*(F.sum(n * F.get(p, F.lit(a))).alias(f"t{a}") for a in k), *cells).first()
    have = np.array([row[f"t{a}"] or 0.0 for a in k])
    if have.sum() == 0:
        return Solution([], have.tolist(), have.tolist())
    gram = np.array([[row[f"g{min(a, b)}_{max(a, b)}"] for b in k] for a in k])
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    weight = weight / weight.sum() if weight.sum() > 0 else have / have.sum()
    total = max(have.sum(), np.max(have[weight > 0] / weight[weight > 0])) if keep_all else have.sum()
    goal = weight * total
    steps: list[list[float]] = []
    now = have
    for _ in range(rounds):
        error = now - goal
        if np.abs(error).sum() <= tolerance * total:
            break
        steps.append((inverse @ error).tolist())
        row = scored.select(n, p, rate_of(steps, least_rate).alias("r")).agg(*(F.sum(n * F.col("r") * F.get(p, F.lit(a))).alias(f"t{a}") for a in k)).first()
        now = np.array([row[f"t{a}"] for a in k])
    return Solution(steps, goal.tolist(), now.tolist())


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies and, with the chance of the remainder, one more; the same draw for the same key."""
    drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit("copies")), 12).cast("double") / float(2**52)
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def labelled_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The labelled table of the query and the stage: the language of documents whose quality label is 1.

    The tables have no other domain labels. All documents carry a language, but the posterior is learned from the
    words of the labelled ones alone and may differ from it.
    """
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(good, "doc_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_domains(docs, labelled_domains(spark, docs, sf_dir))
    scored = materialize(posteriors(docs, model), "posteriors")
    rated = scored.withColumn("rate", rate_of(solve_rates(scored, model.domains, PRODUCTION_TARGETS).steps, 0.0))
    shares = [F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(model.domains)]
    return rated.select("doc_id", "n_tokens", *shares, "rate", copies_of(F.col("rate"), F.col("doc_id")).alias("copies"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents repeat by their copies. No document is dropped: totals are set so that no
    language must shrink, and rates stay at 1 or above. Null and empty texts have rate 1; rows with a null doc_id
    share one draw; repeated rows get equal copies each; all columns are kept as they are."""
    slim = docs.select("doc_id", "text", "lang")
    model = fit_domains(slim, labelled_domains(spark, slim, sf_dir))
    scored = materialize(posteriors(slim, model), "posteriors")
    steps = solve_rates(scored, model.domains, PRODUCTION_TARGETS, least_rate=1.0, keep_all=True).steps
    key, of_id, of_text, copies, copy = (unused(docs.columns, x) for x in ("key", "of_id", "of_text", "copies", "copy"))
    rated = scored.select(F.col("doc_id").alias(of_id), F.col("print").alias(of_text), copies_of(rate_of(steps, 1.0), F.col("doc_id")).alias(copies)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(rated, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_text)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
