"""Whitening and fill-in-middle against plain versions, on awkward rows."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_middle, whitening

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables are not here")
VECTORS = "vec_id long, embedding array<float>, label string, x string, n int"


def plain_whitening(vectors, keep):
    """Exact sums in Python, one covariance, one decomposition."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x)]
    away = [sum((n * c - s) ** 2 for c, s in zip(row, total)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, total)] for row in x])
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1][:keep], parts[:, ::-1][:, :keep]
    return away, centred @ parts / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((300, 6)) * np.array([9, 7, 5, 4, 2, 1]) + 1000).astype(np.float32)
    vectors[10] = vectors[11]
    rows = [(i, v.tolist(), "clash", "x", 1) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(7), "vec_id", "embedding", keep=4).orderBy("vec_id", "component").collect()
    away, white, explained = plain_whitening(vectors, 4)
    assert len(got) == 1200 and {r.n for r in got} == {300}
    assert [r.deviation for r in got[::4]] == away
    mine = np.array([r.whitened for r in got]).reshape(300, 4)
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-8
    assert np.allclose([r.explained for r in got[:4]], explained, rtol=1e-9) and 0 <= got[0].identity_error < 1e-8


def test_merging_is_the_same_in_any_split():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**20), 2**20, (500, 5)) + 2**40  # far from zero: sums of squares would lose all digits
    whole = whitening.measured(x)
    for cuts in ([1], [499], [100, 101, 350], list(range(1, 500, 7))):
        state = None
        for part in np.split(x, cuts):
            state = whitening.merged(state, whitening.measured(part))
        assert state.n == 500 and state.total == whole.total == [int(c) for c in x.sum(axis=0)]
        assert np.abs(state.scatter - whole.scatter).max() < 1e-9 * whole.scatter.max() and np.allclose(state.mean, whole.mean, rtol=1e-12)
    assert whitening.merged(None, whole) is whole and whitening.merged(whole, None) is whole


def test_whitening_of_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, -inf]), (7, [1e30, 0.0]), (8, [1.0]), (9, [1.0, 2.0, 3.0])]
    good = [(10, [0.0, 0.0]), (None, [1.0, 0.0]), (12, [0.0, 3.0]), (12, [0.0, 3.0])]
    df = spark.createDataFrame([(i, v, None, "x", 0) for i, v in odd + good], VECTORS)
    got = whitening.whiten(df, "vec_id", "embedding").orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in got] == [(None, 1), (None, 2), (10, 1), (10, 2), (12, 1), (12, 1), (12, 2), (12, 2)]
    assert all(r.n == 4 for r in got) and got[0].identity_error < 1e-9
    assert whitening.whiten(df.limit(0), "vec_id", "embedding").count() == 0
    assert whitening.whiten(df.where("vec_id < 8"), "vec_id", "embedding").count() == 0


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], None, "", 0) for i in range(6)], VECTORS)
    got = whitening.whiten(df, "vec_id", "embedding").collect()
    assert {r.component for r in got} == {1, 2, 3} and all(r.whitened == 0 and r.explained == 0 for r in got if r.component > 1)
    assert got[0].identity_error < 1e-9 and abs(got[0].explained - 1) < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [5.0, 5.0], None, "", 0)] * 3, VECTORS), "vec_id", "embedding").collect()
    assert len(same) == 6 and all((r.deviation, r.whitened, r.explained) == (0, 0, 0) for r in same)


def plain_cut(key, text, seed=1, percent=90, spm=20):
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    t = text or ""
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= percent:
        return len(t), "plain", None, None, t
    if h4 % 100 < spm:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


ODD = [None, "", "a", "é", "\U0001f600" * 700, "ab<", "<S", "P>x<", "<P>", "x<M>y", "S>\n\n<", "\u0000 null", "é" * 300, "ä" * 511 + "b" * 513 + "中" * 2000, "x" * 1_000_000 + "ß" * 1_000_000]


def test_cuts_equal_a_plain_version(spark):
    rows = [(k, ODD[k % len(ODD)], "old", 5) for k in range(12 * len(ODD))] + [(None, "no key", "old", 1), (7, ODD[7], "old", 1), (7, ODD[7], "old", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, key_text int").repartition(5)
    for percent, spm in ((90, 20), (100, 50), (0, 0)):
        made = fill_middle.fill_in_middle(df, percent=percent, spm_percent=spm)
        got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert len(got) == len(rows) and made.columns == ["doc_id", "text", "key_text", "n", "form", "prefix_chars", "middle_chars", "output"]
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.doc_id, r.text, 1, percent, spm)
            assert r.back == (r.text or "")
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_checkpoints_find_every_code_point():
    for text in ("", "a", "é" * 40, "aé中😀" * 50, "x" * 33, "😀" * 16):
        data = text.encode()
        for every in (1, 4, 7, 32, 1000):
            n, before = fill_middle.checkpoints(data, every)
            assert n == len(text)
            assert [fill_middle.byte_at(data, before, k, every) for k in range(n + 1)] == [len(text[:k].encode()) for k in range(n + 1)]


@needs_tables
def test_whitening_query_on_the_tables(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [r.embedding for r in table.orderBy("vec_id").collect()]
    got = whitening.QUERIES["op11_whitening"](spark, SF).orderBy("vec_id", "component").collect()
    away, white, explained = plain_whitening(vectors, 32)
    mine = np.array([r.whitened for r in got]).reshape(len(vectors), 32)
    assert [r.deviation for r in got[::32]] == away
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-7
    assert np.allclose([r.explained for r in got[:32]], explained, rtol=1e-8) and got[0].identity_error < 1e-4
