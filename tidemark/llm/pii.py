"""Personal data by bootstrapped contextual extraction.

Four patterns (e-mail, IP address, card, phone) give seed entities. The two words before the white-space token that
holds an entity are a lexical pattern, digits and white space in it replaced; words of over 64 characters make
none. Patterns and the identifier-like tokens they introduce (seeds or not) form a graph, which Spark scores
iteratively: a pattern is as reliable as the average of what it introduces, and an unseen token as reliable as the
average of the patterns that introduce it. A pattern with enough different seeds of one kind and a high score marks
unseen identifiers behind it as that kind; in the next round these count as seeds too and bring their own
contexts in, until no round finds a new pattern (at most ROUNDS of them). Base spans always stay.

Everything is a DataFrame expression. Positions are code points, got from the lengths of what the
pattern matches and of what lies between; a scan of a text is linear in its length. The expressions below
find the same leftmost matches as the plain patterns, but start only where a match can start and give
nothing back, so no text makes them quadratic.

Defined results: null text is empty; a match that fails its test is dropped, without another try at that
place; repeated rows count as one observation and get a result each; an empty table gives an empty result;
added spans never overlap base spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table, unused
from tidemark.llm.rules import let

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Identifier-like tokens: runs without white space, of six or more, with a digit or @.
TOKEN = r"(?:(?<![^\x20\x09-\x0D])|\G)(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]{6,}+"
SPAN = "array<struct<start:long,end:long,text:string,left:string>>"
#: Patterns need so many different seeds of their kind, and so high a score.
MIN_SEEDS, MIN_SCORE, ROUNDS = 5, 0.8, 4
#: The two words before a token; the last 160 characters before a match hold them and the start of its token.
LEFT = r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]{1,64}[\x20\x09-\x0D]{1,8}[^\x20\x09-\x0D]{1,64})[\x20\x09-\x0D]{1,8}[^\x20\x09-\x0D]{0,14}$"
_BLOCK = 256


def running(values: Column) -> Column:
    """0 and the running sums of ``values``."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(values, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def running_ends(values: Column) -> Column:
    """Running sums in blocks, so that long arrays are not copied once per element."""

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))
        total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
        return let(blocks, lambda bs: let(running(F.transform(bs, total)), lambda base: F.flatten(F.transform(bs, lambda x, b: F.transform(F.slice(running(x), F.lit(2), F.size(x)), lambda y: y + F.get(base, b))))))

    return let(values, whole)


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as start, end, text and left context."""

    def left(m: Column, g: Column, i: Column) -> Column:
        # two earlier matches and the text around them hold two words, whatever stands there
        parts = [F.coalesce(F.get(a, i - k), F.lit("")) for k, a in ((2, g), (2, m), (1, g), (1, m), (0, g))]
        before = F.regexp_extract(F.lower(F.substring(F.concat(*parts), -160, 160)), LEFT, 1)
        return F.nullif(F.regexp_replace(before, r"[0-9]|[\x20\x09-\x0D]+", "_"), F.lit(""))

    def placed(m: Column, g: Column) -> Column:
        steps = F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(g, i))).cast("long"))
        return let(running_ends(steps), lambda ends: F.transform(m, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("text"), left(m, g, i).alias("left"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: placed(m, g))).otherwise(F.lit(None).cast(SPAN)))


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0").cast("int") <= 255))
    return let(F.regexp_replace(match, "[^0-9]", ""), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False) if kind == "card" else F.length(d).between(8, 15))


def base_spans(text: Column, kind: str) -> Column:
    found = located(text, PATTERNS[kind])
    tested = F.filter(found, lambda s: _passes(kind, s["text"]))
    may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    if kind != "email":
        may = may & F.rlike(text, F.lit("[0-9]"))
    return F.coalesce(F.when(may, tested), F.array().cast(SPAN))


def identifiers(text: Column) -> Column:
    """Identifier-like tokens without the punctuation that closes or quotes them; not those that hold a base span."""
    found = F.when(F.rlike(text, F.lit("[0-9@]")), located(text, TOKEN))

    def trimmed(s: Column) -> Column:
        head = F.length(F.regexp_extract(s["text"], r"^[\"'(\[{<]*", 0))
        core = F.regexp_extract(s["text"], r"^[\"'(\[{<]*+(.*?)[.,;:!?\"')\]}>]*$", 1)
        return F.struct((s["start"] + head).alias("start"), (s["start"] + head + F.length(core)).alias("end"), core.alias("text"), s["left"].alias("left"))

    def covers_a_seed(kind: str, token: Column) -> Column:
        may = F.contains(token, F.lit(NEEDS[kind])) if NEEDS[kind] else F.length(token) >= 16
        match = F.regexp_extract(token, PATTERNS[kind], 0)
        return may & (match != "") & _passes(kind, match)

    seen = lambda s: reduce(Column.__or__, (covers_a_seed(k, s["text"]) for k in KINDS))
    return F.coalesce(F.filter(F.filter(F.transform(found, trimmed), lambda s: F.length(s["text"]) >= 6), lambda s: ~seen(s)), F.array().cast(SPAN))


def found_in(text: Column) -> Column:
    """A struct of a hash of the text, base spans by kind and identifier-like tokens."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("print"), *(base_spans(whole, k).alias(k) for k in KINDS), identifiers(whole).alias("tokens"))


def observe(docs: DataFrame) -> DataFrame:
    """doc_id and what ``found_in`` finds, of every row; no text."""
    return docs.select("doc_id", found_in(F.col("text")).alias("found")).select("doc_id", "found.*")


def learn_patterns(seen: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> DataFrame:
    """left, kind and score of reliable patterns."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["left"].alias("left"), F.lower(s["text"]).alias("instance")))

    based = materialize(seen.select(F.explode(F.flatten(F.array(*map(named, KINDS)))).alias("s")).select("s.*").distinct(), "seeds")
    seeds = based.select("instance", "kind").distinct()
    tokens = seen.select(F.explode("tokens").alias("t")).select(F.col("t.left").alias("left"), F.lower("t.text").alias("instance"))
    graph = materialize(tokens.unionByName(based.select("left", "instance")).where("left is not null").distinct(), "graph")
    known, patterns, found = seeds, None, -1
    for _ in range(rounds):
        # contexts of what is known so far, and all that they introduce
        support = graph.join(known, "instance").groupBy("left", "kind").agg(F.count("*").alias("seeds"))
        edges = materialize(graph.join(support.select("left").distinct(), "left", "left_semi"), "edges")
        degree = edges.groupBy("left").agg(F.count("*").alias("degree"))
        sure = edges.join(known, "instance").groupBy("left", "kind").agg(F.count("*").cast("double").alias("mass"))
        scores = materialize(sure.join(degree, "left").select("left", "kind", (F.col("mass") / (F.col("degree") + 1)).alias("score")), "scores")
        # an unseen token is as reliable as its patterns on average
        unseen = edges.join(known, "instance", "left_anti")
        spread = unseen.groupBy("instance").agg(F.count("*").alias("patterns"))
        told = unseen.join(scores, "left").groupBy("instance", "kind").agg(F.sum("score").alias("s")).join(spread, "instance").select("instance", "kind", (F.col("s") / F.col("patterns")).alias("trust"))
        gained = unseen.join(told, "instance").groupBy("left", "kind").agg(F.sum("trust").alias("mass"))
        scores = sure.unionByName(gained).groupBy("left", "kind").agg(F.sum("mass").alias("mass")).join(degree, "left").select("left", "kind", (F.col("mass") / (F.col("degree") + 1)).alias("score"))
        good = scores.join(support, ["left", "kind"]).where((F.col("seeds") >= min_seeds) & (F.col("score") >= min_score))
        patterns = materialize(good.groupBy("left").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")), "patterns")
        if (now := patterns.count()) <= found or now == 0:
            break
        found = now
        accepted = edges.join(patterns, "left").join(seeds.select("instance").distinct(), "instance", "left_anti")
        accepted = accepted.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        known = materialize(seeds.unionByName(accepted), "known")
    return patterns


def discover(seen: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, print and ``added`` (kind, start, end) for texts with unseen identifiers behind a good pattern."""
    tokens = seen.select("doc_id", "print", F.explode("tokens").alias("t")).withColumn("left", F.col("t.left"))
    hit = tokens.join(patterns.select("left", "kind"), "left").groupBy("doc_id", "print").agg(F.collect_set(F.struct("kind", F.col("t.start").alias("start"), F.col("t.end").alias("end"))).alias("hits"))
    # only texts with a hit meet their base spans again
    base = F.flatten(F.array(*(F.transform(F.col(k), lambda s: F.struct(s["start"], s["end"])) for k in KINDS)))
    spans = seen.select(F.col("doc_id").alias("of_id"), F.col("print").alias("of_print"), base.alias("base")).dropDuplicates(["of_id", "of_print"])
    met = hit.join(spans, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("print") == F.col("of_print")))
    free = F.filter("hits", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return met.select("doc_id", "print", F.array_sort(free).alias("added")).where(F.size("added") > 0)


def _joined(left: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("doc_id").alias("of_id"), F.col("print").alias("of_print"), "added")
    return left.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("print") == F.col("of_print")), "left").drop("of_id", "of_print")


def _all_spans(added: Column | None = None, at: str = "") -> Column:
    """(rank of kind, start, end) in order of kind, then start, of the columns of ``found_in`` (under ``at``)."""

    def ranked(rank: int) -> Column:
        return F.transform(f"{at}{KINDS[rank]}", lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))

    parts = [ranked(r) for r in range(len(KINDS))]
    if added is not None:
        rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1
        parts.append(F.coalesce(F.transform(added, lambda s: F.struct(rank(s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast("array<struct<rank:int,start:long,end:long>>")))
    return F.array_sort(F.flatten(F.array(*parts)))


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): counts and digest of base spans, and all spans."""
    seen = materialize(observe(docs), "observed")
    whole = _joined(seen, materialize(discover(seen, learn_patterns(seen)), "added"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return whole.select("doc_id", *counts, F.sha2(_told(_all_spans()), 256).alias("base_sha256"), _told(_all_spans(F.col("added"))).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each span, overlapping ones as one, replaced by the kind of its first."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))

    def fold(merged: Column, s: Column) -> Column:
        last = F.element_at(merged, -1)
        widened = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["rank"].alias("rank"))
        return F.when((F.size(merged) > 0) & (s["start"] < F.try_element_at(merged, F.lit(-1))["end"]), F.concat(F.slice(merged, F.lit(1), F.greatest(F.size(merged) - 1, F.lit(0))), F.array(widened))).otherwise(F.concat(merged, F.array(s)))

    merged = F.aggregate(ordered, F.array().cast("array<struct<start:long,end:long,rank:int>>"), fold)

    def rebuilt(m: Column) -> Column:
        end = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0).cast("long"))
        parts = F.transform(m, lambda s, i: F.concat(F.substring(text, (end(i) + 1).cast("int"), (s["start"] - end(i)).cast("int")), F.get(names, s["rank"])))
        rest = F.substring(text, (F.element_at(m, -1)["end"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    return F.when(F.size(spans) > 0, let(merged, rebuilt)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all found spans masked in ``text``; every other column stays as it is, whatever its name."""
    f, of_id, of_print, more = (unused(docs.columns, x) for x in ("found", "of_id", "of_print", "added"))
    # texts are written beside their spans, so that neither is computed again nor shuffled
    held = materialize(docs.withColumn(f, found_in(F.col("text"))), "observed")
    seen = held.select("doc_id", f"{f}.*")
    added = discover(seen, learn_patterns(seen)).select(F.col("doc_id").alias(of_id), F.col("print").alias(of_print), F.col("added").alias(more))
    marked = held.join(materialize(added, "added"), F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(f"{f}.print") == F.col(of_print)), "left")
    return marked.withColumn("text", F.when(F.col("text").isNotNull(), mask(F.col("text"), _all_spans(F.col(more), f"{f}.")))).select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced by the name of its kind, and n_chars follows the text. Null text
    stays null with null n_chars, empty text stays; every row is kept, and so are other columns."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
