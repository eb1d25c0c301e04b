"""Fill-in-middle transformation: texts cut at two code points and put together in another order.

Cuts are given in code points, while texts are UTF-8 bytes. Counting a text's code points also leaves a sparse
checkpoint index: how many code points stand before every ``every``-th byte. A cut is found by binary search in
these checkpoints and a scan of the ``every`` bytes behind one, so no offset of each code point is ever kept and
no text is decoded.

Where the cuts lie and which form a text gets follow from the hash of its key alone, so a lost task repeats with
the same result and rows need no order. The forms are ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix,
middle) and ``plain``, the text as it is, which also stands for empty texts and for texts that hold a mark
themselves. Marks can therefore be found again, and ``restored`` rebuilds every text from output and form.

Defined results: null text is an empty text, which is plain; a null key hashes as an empty one and stays null;
repeated rows are transformed alike, as often as they occur; an empty table gives an empty result; other columns
are carried, and those that bear the name of a result column are replaced. A task holds one Arrow batch of texts, and
of one text its bytes, a byte for each of them and eight for every ``every``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import table, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes between two checkpoints.
EVERY = 512
#: Bytes of output that one batch to Spark holds, unless a single text is longer.
BATCH_BYTES = 8_000_000
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def checkpoints(data: bytes, every: int = EVERY) -> tuple[int, np.ndarray]:
    """The number of code points of UTF-8 ``data``, and how many begin before each byte that is a multiple of ``every``."""
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    held = np.add.reduceat(begins, np.arange(0, len(begins), every), dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
    return int(held.sum()), np.cumsum(held) - held


def byte_at(data: bytes, before: np.ndarray, unit: int, every: int = EVERY) -> int:
    """The byte at which code point ``unit`` (from 0) begins; the length of ``data`` for the one after the last."""
    if not len(before):
        return 0
    block = int(np.searchsorted(before, unit, "right")) - 1
    start = block * every
    near = np.frombuffer(data, np.uint8, min(every, len(data) - start), start)
    at = np.flatnonzero((near & 0xC0) != 0x80)
    k = unit - int(before[block])
    return start + int(at[k]) if k < len(at) else len(data)


def draw(key: str, seed: int, n: int) -> tuple[int, int, int, int]:
    """Two cuts of ``n`` units in order, and two numbers below 100 for the form."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    a, b, c, d = (int.from_bytes(h[k : k + 4], "big") for k in range(0, 16, 4))
    first, second = sorted((a % (n + 1), b % (n + 1)))
    return first, second, c % 100, d % 100


def transform(key: str, data: bytes, seed: int, percent: int, spm_percent: int) -> tuple:
    """(units, form, units of the prefix, units of the middle, output) of one text."""
    n, before = checkpoints(data)
    first, second, chance, order = draw(key, seed, n)
    if not n or chance >= percent or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    a, b = byte_at(data, before, first), byte_at(data, before, second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if order < spm_percent:
        return n, "spm", first, second - first, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first, second - first, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs`` with the columns of ``RESULT``: ``percent`` of texts are cut, ``spm_percent`` of these suffix first."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    rest = [c for c in docs.columns if c.lower() not in names]
    k, t = unused(docs.columns, "key_text"), unused(docs.columns, "raw_text")
    rows = docs.select(*rest, F.coalesce(F.col(key).cast("string"), F.lit("")).alias(k), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias(t))
    schema = StructType([*rows.select(*rest).schema.fields, *StructType.fromDDL(RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(len(rest)), batch.column(len(rest) + 1)
            begin, held, done = 0, 0, []
            for i in range(batch.num_rows):
                done.append(transform(keys[i].as_py(), texts[i].as_py(), seed, percent, spm_percent))
                held += len(done[-1][-1])
                if held > BATCH_BYTES or i + 1 == batch.num_rows:
                    n, form, first, middle, output = zip(*done)
                    out = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([c.slice(begin, len(done)) for c in batch.columns[: len(rest)]] + out, [*rest, *names])
                    begin, held, done = i + 1, 0, []

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given. No text in another form than plain holds a mark, so the three marks
    are the only ones."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {
    "op13_fill_middle": """
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS chance, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS turn FROM given
), formed AS (
  SELECT doc_id, t, n, least(a, b) AS x, greatest(a, b) AS y,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR chance >= 90 THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1, n - y) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM cut
"""
}
