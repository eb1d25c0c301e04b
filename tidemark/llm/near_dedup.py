"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct five-word shingles. One pass sketches all documents: in every round each
shingle hashes to one bin with a value that is larger in later rounds, so a bin keeps the earliest arrival;
rounds go on until all bins of a document are filled (after as many rounds as bins, each shingle visits the
remaining bins in turn, which fills them for certain). Bands of bins then deal documents to buckets. The band
width is the largest whose chance to miss a pair at the threshold is at most ``MISS``.

Documents with equal sets are one class, named by its smallest id; only classes are compared. Members of a
bucket are joined to its smallest class, and the connected components of those candidate links hold every
pair that shares a bucket. Inside a component all pairs are counted exactly on the full sets, in blocks of
bounded size, and only links that join two groups are emitted. Components of several blocks are first
contracted block by block; then what lies outside the largest group is held against all other blocks.

Defined results: null or empty text has an empty set and is linked with nothing; rows that repeat a doc_id
are one document; a row with a null doc_id is linked with nothing, has a null component_id and is kept; an empty
table gives an empty result; extra columns are ignored. Shingles are compared as 64-bit hashes and whole sets by two
64-bit sums of hashes: two different shingles of one pair of texts fall together with a chance of about n*n/2**64,
two different sets with one of 2**-128. A task holds one Arrow batch of texts and, of a text, about a hundred
bytes of work arrays for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table
from tidemark.llm.graph import components

WIDTH = 5
BINS = 256
MISS = 1e-6
#: Shingles that one verification block holds on average.
BLOCK_SHINGLES = 400_000

_RNG = np.random.default_rng(85)
_BYTE = _RNG.integers(0, 2**64, (64, 256), dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**63, WIDTH, dtype=np.uint64) * 2 + 1
_SEEDS = _RNG.integers(0, 2**64, 2 * BINS, dtype=np.uint64)
_LONG, _BAND = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, sorted within each text, and the text of each."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return empty
    doc = np.repeat(np.arange(len(raw)), sizes)
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(start)
    if not len(at):
        return empty
    place = np.arange(len(data)) - at[np.maximum(np.cumsum(start) - 1, 0)]
    value = _BYTE[place & 63, data]
    if place.max() > 63:  # long words: another factor for every further 64 bytes
        value = value * np.power(_LONG, (place >> 6).astype(np.uint64))
    word = mix(np.add.reduceat(np.where(space, np.uint64(0), value), at))
    owner = doc[at]
    count = np.bincount(owner, minlength=len(raw))
    first = np.concatenate([[0], np.cumsum(count)])
    # windows of WIDTH words, and the whole sequence of texts with fewer
    windows = np.maximum(count - WIDTH + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(raw)), windows)
    begin = first[text] + np.arange(len(text)) - np.concatenate([[0], np.cumsum(windows)])[text]
    shingle = np.minimum(count, WIDTH)[text].astype(np.uint64)
    for k in range(WIDTH):
        there = begin + k < first[text + 1]
        shingle += np.where(there, word[np.minimum(begin + k, len(word) - 1)] * _PLACE[k], np.uint64(0))
    shingle = mix(shingle)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    return shingle[new], text[new]


def sketch(shingle: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """(texts, BINS) bin values. Texts without a shingle keep the largest value everywhere."""
    out = np.full(texts * BINS, np.uint64(2**64 - 1))
    filled = np.zeros(texts * BINS, dtype=bool)
    left = np.where(np.bincount(text, minlength=texts) > 0, BINS, 0)
    for i in range(2 * BINS):
        x = mix(shingle ^ _SEEDS[i])
        bins = (x >> np.uint64(56)).astype(np.int64) if i < BINS else i - BINS
        key = text * BINS + bins
        free = ~filled[key]
        key = key[free]
        np.minimum.at(out, key, np.uint64(i << 48) | (x[free] & np.uint64(2**48 - 1)))
        key = np.unique(key)
        filled[key] = True
        left -= np.bincount(key // BINS, minlength=texts)
        active = left[text] > 0
        if not active.any():
            break
        shingle, text = shingle[active], text[active]
    return out.reshape(texts, BINS)


def band_rows(threshold: float, miss: float = MISS) -> int:
    """The widest band with which a pair at the threshold shares no bucket with a chance of ``miss`` at most."""
    return max([1, *(r for r in range(1, 33) if (1 - threshold**r) ** (BINS // r) <= miss)])


def _runs(sizes: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` characters each."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


SKETCH = "doc_id long, n_shingles long, print1 long, print2 long, bands array<long>"


def sketch_documents(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, n_shingles, the 128-bit fingerprint of the set (null if empty or without a doc_id) and the band hashes."""
    rows = band_rows(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _runs([len(t or "") for t in texts]):
                ids = batch.column(0).slice(lo, hi - lo)
                shingle, text = shingle_sets(texts[lo:hi])
                n = np.bincount(text, minlength=hi - lo)
                s = sketch(shingle, text, hi - lo)
                bands = np.zeros((hi - lo, BINS // rows), dtype=np.uint64)
                for b in range(BINS // rows):
                    h = np.full(hi - lo, np.uint64((b + 1) * _BAND % 2**64))
                    for k in range(b * rows, (b + 1) * rows):
                        h = mix(h ^ s[:, k])
                    bands[:, b] = h
                prints = [np.zeros(hi - lo, np.uint64) for _ in range(2)]
                begin = np.searchsorted(text, np.flatnonzero(n))
                for k, p in enumerate(prints):
                    if len(begin):
                        p[n > 0] = np.add.reduceat(mix(shingle ^ _SEEDS[k]), begin)
                none = (n == 0) | ids.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * bands.shape[1], pa.int32()), pa.array(bands.view(np.int64).ravel()))
                first, second = (p.view(np.int64) for p in prints)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(first, mask=none), pa.array(second), lists], ["doc_id", "n_shingles", "print1", "print2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def links_in(nodes: np.ndarray, labels: np.ndarray, asks: np.ndarray, texts: list[str | None], percent: int) -> list[tuple[int, int]]:
    """Links between rows that ask and any other row, at ``percent`` similarity or more on the full sets;
    of them only those that join groups which were still apart (``labels`` name the groups so far)."""
    shingle, text = shingle_sets(texts)
    size = np.bincount(text, minlength=len(texts))
    values, inverse, df = np.unique(shingle, return_inverse=True, return_counts=True)
    by_value = np.argsort(inverse, kind="stable")
    posts, bounds = text[by_value], np.concatenate([[0], np.cumsum(df)])
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i in np.flatnonzero(asks):
        own = inverse[first[i] : first[i + 1]]
        own = own[df[own] > 1]
        if not len(own):
            continue
        lengths = df[own]
        ends = np.cumsum(lengths)
        flat = np.arange(ends[-1]) + np.repeat(bounds[own] - (ends - lengths), lengths)
        common = np.bincount(posts[flat], minlength=len(texts))
        for j in np.flatnonzero(100 * common >= percent * (size + size[i] - common)):
            a, b = root(int(labels[i])), root(int(labels[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _links(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Links (u, v) of rows (node, label, asks, text) that share ``key``; a key's rows fit one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> list[tuple[int, int]]:
            group = pd.concat(held)
            held.clear()
            return links_in(group["node"].to_numpy(), group["label"].to_numpy(), group["asks"].to_numpy(), group["text"].tolist(), percent) if len(group) > 1 else []

        last, out = None, []
        for batch in batches:
            ids = list(zip(*(batch[k] for k in key)))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and ids[lo] != last:
                    out += flush()
                held.append(batch.iloc[lo:hi])
                last = ids[lo]
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
            out = []
        if held:
            yield pd.DataFrame(flush(), columns=["u", "v"], dtype="int64")

    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    sketches = materialize(sketch_documents(docs, percent / 100), "sketches")
    classes = sketches.where(F.col("print1").isNotNull()).groupBy("print1", "print2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    # the smallest class of each bucket stands for it; buckets are aggregated before they meet their members again
    shared = materialize(buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1").select("bucket", "least"), "buckets")
    stars = buckets.join(shared, "bucket").where("node > least").select("node", "least").distinct()
    groups = components(stars.select(F.col("node").alias("u"), F.col("least").alias("v"))).withColumnRenamed("component", "candidate")
    sized = groups.join(classes.groupBy("node").agg(F.sum("n").alias("n")), "node")
    mass = sized.groupBy("candidate").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    placed = materialize(sized.join(mass, "candidate").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    # texts of candidates are written once: what compares blocks of one group must not shuffle all texts to find them
    rows = materialize(texts.join(placed, "node").dropDuplicates(["node", "text"]), "texts")
    links = materialize(_links(rows.select("candidate", "block", "node", F.col("node").alias("label"), F.lit(True).alias("asks"), "text"), ["candidate", "block"], percent), "links")
    found = components(links)
    wide = placed.where("blocks > 1")
    if not wide.isEmpty():
        links = materialize(links.unionByName(_across(wide, found, rows.where("blocks > 1").select("node", "text"), percent, block_shingles)), "links")
        found = components(links)
    of_class = classes.join(found, "node", "left").select("print1", "print2", F.coalesce("component", "node").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "print1", "print2").join(of_class, ["print1", "print2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _across(wide: DataFrame, found: DataFrame, texts: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Links between blocks of one candidate group, where one side is outside the group's largest component; ``texts`` are
    those of ``wide`` groups."""
    labelled = wide.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    largest = labelled.groupBy("candidate", "label").agg(F.sum("n").alias("n")).groupBy("candidate").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    labelled = labelled.join(largest, "candidate")
    asking = labelled.where(F.col("label") != F.col("main"))
    parts = asking.groupBy("candidate").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("parts"))
    data = labelled.join(parts, "candidate").select("candidate", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "label", F.lit(False).alias("asks"))
    ask = asking.join(parts, "candidate").select("candidate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int").alias("part"), "node", "label", F.lit(True).alias("asks"))
    rows = data.unionByName(ask).join(texts, "node").dropDuplicates(["candidate", "block", "part", "node", "asks", "text"])
    return _links(rows.select("candidate", "block", "part", "node", "label", "asks", "text"), ["candidate", "block", "part"], percent)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the smallest id stays. Rows with a null or
    empty text or a null doc_id stay, rows that repeat a kept doc_id too; all columns are kept as they are."""
    found = near_duplicates(docs.select("doc_id", "text"))
    gone = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLES = {
    "op8_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words
), items AS (SELECT doc_id, unnest(s) AS x FROM sets), sizes AS (SELECT doc_id, len(s) AS n FROM sets), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM least JOIN sizes USING (doc_id)
"""
}
