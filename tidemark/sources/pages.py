"""Fields out of stored web pages, with expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import pair_of_numbers, parse_number


def visible(html: Column) -> Column:
    """Markup without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")


def inner_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def first_element(html: Column, tag: str) -> Column:
    """The text of the first element of a kind, empty if there is none."""
    return inner_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, first heading, and number of links of each page."""
    body = pages.withColumn("_v", visible(F.coalesce("html", F.lit(""))))
    return body.select("page_id", first_element(F.col("_v"), "title").alias("title"), first_element(F.col("_v"), "h1").alias("heading"), F.regexp_count("_v", F.lit(r"(?i)<a\s[^>]*href")).alias("n_links"))


def links(pages: DataFrame) -> DataFrame:
    """One row per link: position, address and own text."""
    found = F.regexp_extract_all(visible(F.coalesce("html", F.lit(""))), F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a\s*>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("position", "a"))
    return rows.select("page_id", "position", F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), inner_text(F.col("a")).alias("text"))


def cards(pages: DataFrame, pattern: str = r"/(\d+)(?:[/?#.]|$)") -> DataFrame:
    """Listing entries: links whose address holds an id, the first of each id on a page."""
    found = links(pages).withColumn("id", F.nullif(F.regexp_extract("href", pattern, 1), F.lit(""))).where("id IS NOT NULL")
    return found.groupBy("page_id", "id").agg(F.min_by("text", "position").alias("text"), F.min("position").alias("position"))


def status_of(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("live"), "live").when(low.contains("final") | low.contains("completed"), "completed").otherwise("upcoming")


def table_cells(html: Column) -> Column:
    """Rows of the first table as arrays of cell texts."""
    body = F.regexp_extract(html, r"(?is)<table\b[^>]*>(.*?)</table\s*>", 1)
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), inner_text))


def best_of(note: Column, score1: Column, score2: Column) -> Column:
    """Length of a series: as its note says, else the least odd length that its score allows."""
    said = F.regexp_extract(F.lower(F.coalesce(note, F.lit(""))), r"(?:bo|best of )\s*(\d)", 1).try_cast("int")
    return F.coalesce(said, 2 * F.greatest(score1, score2) - 1)


def own_text(html: Column) -> Column:
    """Text outside nested elements: labels inside a name do not belong to it."""
    inner = F.regexp_extract(html, r"(?s)^<[^>]*>(.*)</[^>]*>$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<(\w+)\b[^>]*>.*?</\1\s*>", " "), r"\s+", " "))


def rounds(block: Column) -> Column:
    """The round strip: number, winner (team1, team2 or empty) and how it was won, from marked cells in order."""
    cells = F.regexp_extract_all(block, F.lit(r"(?is)<div class=\"rnd[^\"]*\"[^>]*>.*?</div>"), F.lit(0))
    won = lambda c: F.when(c.rlike(r"win-1"), "team1").when(c.rlike(r"win-2"), "team2").otherwise("")
    how = lambda c: F.regexp_extract(c, r"(elim|boom|defuse|time)", 1)
    return F.transform(cells, lambda c, i: F.struct((i + 1).alias("number"), won(c).alias("winner"), how(c).alias("win_method")))


def economy(cells: Column) -> Column:
    """Team, full-buy and low-buy pairs from the rows of an economy table."""
    return F.transform(cells, lambda r: F.struct(F.get(r, F.lit(0)).alias("team"), pair_of_numbers(F.get(r, F.lit(1))).alias("lowbuy"), pair_of_numbers(F.get(r, F.lit(2))).alias("fullbuy")))


def players(cells: Column) -> Column:
    """Name and numbers from the rows of a player table (name, agent, kills, first kills, first deaths)."""
    n = lambda r, i: parse_number(F.get(r, F.lit(i)), "int")
    return F.transform(cells, lambda r: F.struct(F.get(r, F.lit(0)).alias("name"), F.get(r, F.lit(1)).alias("agent"), n(r, 2).alias("kills"), n(r, 3).alias("fk"), n(r, 4).alias("fd")))


def attach_performance(players_: DataFrame, performance: DataFrame) -> DataFrame:
    """Multi-kills and clutches by lower-cased player name within a match; players without a row keep nulls."""
    extra = performance.select("match_id", F.lower("name").alias("_n"), "multikills", "clutches").dropDuplicates(["match_id", "_n"])
    return players_.withColumn("_n", F.lower("name")).join(extra, ["match_id", "_n"], "left").drop("_n")
