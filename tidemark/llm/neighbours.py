"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees the pivots, a bounded sample of the vectors. Every vector is
posted, with its positions, in the inverted files of its ``posted`` nearest pivots. The files are a Spark table:
one row per block of vectors and pivot. A query walks the files of its own ``walked`` nearest pivots and adds up
the footrule distance of the two orders (a pivot that a vector is not posted under stands at position ``posted``).
The candidates with the least footrule of all blocks together, about ``depth`` times the square root of the number
of vectors, are measured exactly, in double precision; nothing else is. A block hands on its even share of these
and six standard deviations more, as vectors are dealt to blocks by hash.

Blocks hold ``block_vectors`` distinct vectors and meet the query set in blocks of ``block_queries``. Copies of one
vector are searched once and only their ``k + 1`` smallest ids are carried, since no more can appear in a list of
``k``.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of
different lengths don't meet; a repeated (id, vector) row counts once; equal distances are ordered by id; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table

RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first, ties to the earlier pivot."""
    far = (pivots**2).sum(1) - 2 * (vectors @ pivots.T)
    return np.argsort(far, axis=1, kind="stable")[:, :prefix]


def invert(seen: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The file of each pivot, from the rows of ``seen``: the rows that name it, and where, by position."""
    order = np.argsort(seen.T, axis=None, kind="stable")
    at, row = np.divmod(order, len(seen))
    bounds = np.searchsorted(seen.T.ravel()[order], np.arange(pivots + 1))
    return [(row[a:b].astype(np.int32), at[a:b].astype(np.int16)) for a, b in zip(bounds, bounds[1:])]


def footrules(files: dict[int, tuple[np.ndarray, np.ndarray]], order: np.ndarray, vectors: int, posted: int) -> np.ndarray:
    """Footrule distance of a query's ``order`` of pivots to every vector of the block."""
    far = np.full(vectors, sum(max(posted - b, 0) for b in range(len(order))), dtype=np.int64)
    for b, pivot in enumerate(order):
        row, at = files.get(int(pivot), (None, None))
        if row is not None:
            far[row] += np.abs(at.astype(np.int32) - b) - max(posted - b, 0)
    return far


def nearest(vectors: DataFrame, queries: Column, k: int = 10, **parameters) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for every row where ``queries`` holds."""
    rows = vectors.where(usable(F.col("embedding"))).withColumn("asks", F.coalesce(queries, F.lit(False)))
    rows = rows.select("vec_id", "asks", F.col("embedding").cast("array<double>").alias("v"))
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect()]
    parts = [_nearest(rows.where(F.size("v") == n), k, **parameters) for n in sorted(lengths)]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], RESULT)


def _nearest(rows: DataFrame, k: int, pivots: int = 512, posted: int = 256, walked: int = 128, depth: float = 2.2, block_vectors: int = 8192, block_queries: int = 4096) -> DataFrame:
    """The same for vectors (vec_id, asks, v) of one length. ``pivots`` bounds the sample the index is fitted on."""
    rows = rows.dropDuplicates(["vec_id", "v"])
    copies = W.partitionBy("v").orderBy("vec_id")
    few = rows.select("v", "vec_id", F.row_number().over(copies).alias("r")).where(F.col("r") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = materialize(distinct.select("v", "ids", F.get("ids", F.lit(0)).alias("vec"), F.xxhash64("v").alias("h")), "vectors")
    asked = rows.where("asks").select("v", F.col("vec_id").alias("query_id"))
    # rows that ask with one vector ask once, in the name of the smallest
    asked = materialize(asked.join(asked.groupBy("v").agg(F.min("query_id").alias("q")), "v"), "queries")
    searches = asked.where(F.col("query_id") == F.col("q")).select("q", F.col("v").alias("w"))

    chosen = np.array([r["v"] for r in distinct.orderBy("h", "v").limit(pivots).collect()])
    there = distinct.count()
    keep = max(k + 1, int(np.ceil(depth * np.sqrt(there))))
    width = min(posted, len(chosen))
    blocks, query_blocks = max(1, -(-there // block_vectors)), max(1, -(-searches.count() // block_queries))
    # vectors are dealt to blocks by hash, so a block has its even share of the best, give or take its square root
    share = min(keep, int(np.ceil(keep / blocks + 6 * np.sqrt(keep / blocks)))) + k

    def post(block: pd.DataFrame) -> pd.DataFrame:
        """The block's files, and in a last row the vectors that its row numbers mean."""
        files = invert(permutations(np.stack(block["v"].to_list()), chosen, width), len(chosen))
        out = [(p, row.tobytes(), at.tobytes()) for p, (row, at) in enumerate(files) if len(row)]
        out.append((-1, block["vec"].to_numpy(np.int64).tobytes(), b""))
        return pd.DataFrame(out, columns=["pivot", "members", "at"]).assign(b=block["b"].iloc[0])[["b", "pivot", "members", "at"]]

    posts = distinct.select("v", "vec", F.pmod("h", F.lit(blocks)).cast("int").alias("b")).groupBy("b").applyInPandas(post, "b int, pivot int, members binary, at binary")
    posts = materialize(posts, "posts")

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            files = {p: (np.frombuffer(m, np.int32), np.frombuffer(a, np.int16)) for p, m, a in zip(left["pivot"], left["members"], left["at"]) if p >= 0}
            vec = np.frombuffer(left["members"][left["pivot"] == -1].iloc[0], np.int64)
            orders = permutations(np.stack(right["w"].to_list()), chosen, min(walked, len(chosen)))
            for q, order in zip(right["q"], orders):
                far = footrules(files, order, len(vec), width)
                best = _least(far, vec, min(share, len(far)))
                out.append(pd.DataFrame({"q": q, "vec": vec[best], "footrule": far[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "vec": [], "footrule": []}).astype("int64")

    # every block of vectors meets every block of the stated query set
    data = posts.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    ask = searches.select("q", "w", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    walks = data.groupBy("b", "qb").cogroup(ask.groupBy("b", "qb")).applyInPandas(walk, "q long, vec long, footrule long")
    ranked = walks.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("footrule", "vec"))).where(F.col("r") <= keep).select("q", "vec")
    pairs = ranked.join(distinct.select("vec", "v", "ids"), "vec").join(searches, "q")
    square = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    measured = pairs.select("q", F.sqrt(square).alias("score"), F.explode("ids").alias("vec_id"))
    best = measured.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    own = asked.select("query_id", "q").join(best, "q").where(F.col("vec_id") != F.col("query_id"))
    placed = own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return placed.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _least(far: np.ndarray, vec: np.ndarray, keep: int) -> np.ndarray:
    """Where the ``keep`` least of ``far`` are, ties to the smaller ``vec``."""
    near = np.flatnonzero(far <= np.partition(far, keep - 1)[keep - 1])
    return near[np.lexsort((vec[near], far[near]))[:keep]]


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


QUERIES = {"op4_neighbours": op4_neighbours}
ORACLES: dict[str, str] = {}
