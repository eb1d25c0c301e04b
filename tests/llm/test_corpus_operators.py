"""The operators against plain versions, on awkward rows: nulls, empty and long texts, ties, repeats, no rows,
extra columns with clashing names."""

import itertools
import json
import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidemark.llm import chat, graph, mixing, near_dedup, neighbours, packing, pii, quality, rules, sharding, url_filter

PROSE = "the quick brown fox jumps over the lazy dog while seven old men watch from a green hill and say nothing at all about it".split()


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(PROSE, n)) if n else ""


LONG = words(40_000, 3)
ODD = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "a b c d", 5: words(80, 1), 6: words(80, 1), 7: words(80, 2) + "\n" + words(80, 2), 8: LONG, 9: "É ß \x0b x\x0cy #*$ |<>&\n\nline\nline\n", 10: "++ 1.2.3.4 a@b.co +1 (462) 555-4285 4242 4242 4242 4242", 11: "x" * 100_000, 12: "7" * 50_000, 13: "\u00a0nbsp\u00a0 is a word"}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, v, "en", None, len(v or "")) for k, v in ODD.items()] + [(None, "no id", None, "s", 5), (5, ODD[5], "en", None, 1)], DOCS)


def none(spark, schema):
    return spark.createDataFrame([], schema)


# --- url filters


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://a.Example.COM/en/71?x#y"), (4, "http://example.com/en/8"), (5, "http://notexample.com/en/7"), (6, "https://x.net/de/#f"), (7, "http://xnet/de/"), (8, "x://example.net/de/8"), (9, "http://org/es/"), (10, "http://É.org/es/a"), (10, "http://É.org/es/a"), (11, "http://com?/en/"), (12, "a://b://com/en/")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/71", "example.com/en/7", "allow"), (4, "example.com", "/en/8", "com/en/", "block"), (5, "notexample.com", "/en/7", "com/en/", "block"), (6, "x.net", "/de/", "net/de/", "block"), (7, "xnet", "/de/", None, "allow"), (8, "example.net", "/de/8", "example.net/de/8", "block"), (9, "org", "/es/", "org/es/", "block"), (10, "É.org", "/es/a", "org/es/", "block"), (10, "É.org", "/es/a", "org/es/", "block"), (11, "com", "", None, "allow"), (12, "b:", "//com/en/", None, "allow")]
    for most in (100, 0):  # shipped index, and joined by token
        got = url_filter.judge_urls(df, url_filter.PRODUCTION_RULES, max_shipped=most).select("page_id", "host", "path", "rule", "verdict")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert url_filter.judge_urls(none(spark, "page_id long, url string"), url_filter.PRODUCTION_RULES, max_shipped=most).count() == 0
    assert url_filter.judge_urls(df, []).where("verdict = 'allow'").count() == len(rows)


def test_words_of_the_rules_are_those_of_the_contract(spark):
    df = spark.createDataFrame([(1, "http://x.com/en/"), (2, "http://example.com/en/7"), (3, "http://x.net/de/"), (4, "http://a.example.net/de/81"), (5, "http://example.net/de/7"), (6, "http://org/es/")], "page_id long, url string")
    want = {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("net/de/", "allow"), 6: ("org/es/", "block")}
    for most in (100, 0):
        got = url_filter.judge_urls(df, url_filter.PRODUCTION_RULES, max_shipped=most)
        assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want


def test_both_ways_of_fetching_rules_agree_on_line_ends(spark):
    rules_ = [url_filter.Rule("com", "/a*b/rare/", "block"), url_filter.Rule("org", "", "block")]
    df = spark.createDataFrame([("http://x.com/a\nq\u2028b/rare/1",), ("http://x.org",), ("http://x.org\n",), ("http://x.org\u0085/a",), ("http://org/a",), ("http://xorg",)], "url string")
    found = [[(r.url, r.rule) for r in url_filter.judge_urls(df, rules_, max_shipped=most).orderBy("url").collect()] for most in (100, 0)]
    assert found[0] == found[1] and dict(found[0]) == {"http://x.com/a\nq\u2028b/rare/1": "com/a*b/rare/", "http://x.org": "org", "http://x.org\n": None, "http://x.org\u0085/a": None, "http://org/a": "org", "http://xorg": None}


def test_rarest_token_and_wildcards(spark):
    rules_ = [url_filter.Rule("com", "/*/rare-page", "block"), url_filter.Rule("com", "/a*b", "allow")]
    assert rules_[0].tokens() == {"com", "rare"} and rules_[1].tokens() == {"com"}
    index, loose = url_filter.index_rules(rules_, {"com": 9, "rare": 1})
    assert set(index) == {"rare", "com"} and not loose
    df = spark.createDataFrame([("http://x.com/q/rare-page2",), ("http://x.com/a1b",), ("http://x.com/rare-page",)], "url string")
    assert [r.verdict for r in url_filter.judge_urls(df, rules_, default="-").collect()] == ["block", "allow", "-"]


# --- quality


def test_quality_learns_and_scores_anything(spark, docs):
    good = [(i, words(120, i)) for i in range(100)]
    bad = [(1000 + i, words(60, i) + " ### $$$ ***" * 30) for i in range(100)]
    train = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5000, None), (good[0][0], 0)], "doc_id long, quality int")
    model = quality.learn(train, labels, sample_docs=150)
    held = spark.createDataFrame([(1, words(100, 900)), (0, words(50, 901) + " ### $$$ ***" * 40)], "y int, text string")
    assert all((r.score >= 0.5) == (r.y == 1) for r in quality.score(held, model).collect())
    scored = quality.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(none(spark, DOCS), model).count() == 0
    assert {r.score for r in quality.score(docs, quality.learn(train, labels.where("false"))).collect()} == {0.5}
    assert quality.learn(train, labels.where("quality = 1 AND doc_id > 50")).constant > 0.9


def test_attention_weights_sum_to_one_and_gradient_is_right():
    rng = np.random.default_rng(1)
    x, counts, y = rng.standard_normal((7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    w = {"W": rng.standard_normal((5, 4)), "b": rng.standard_normal(4), "V": rng.standard_normal((4, 3)), "U": rng.standard_normal((4, 3)), "a": rng.standard_normal(3), "c": rng.standard_normal(4), "d": np.zeros(1)}
    assert np.allclose(np.add.reduceat(quality._forward(w, x, counts)[4], [0, 3, 4]), 1)

    def loss(u):
        z = quality._forward(u, x, counts)[0]
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    g = quality._gradient(w, x, counts, y, 0.0)
    for k, v in w.items():
        at = tuple(0 for _ in v.shape)
        up, down = ({**w, k: v.copy()} for _ in range(2))
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


# --- near duplicates


def test_sketch_fills_every_bin():
    for text in ("one", "a b c d e f g", LONG):
        shingle, owner = near_dedup.shingle_sets([text])
        s = near_dedup.sketch(shingle, owner, 1)
        assert (s < np.uint64(2**64 - 1)).all()
    a, b = words(300, 5), words(300, 5) + " " + words(30, 6)
    sets = [brute.shingles(x) for x in (a, b)]
    shingle, owner = near_dedup.shingle_sets([a, b])
    s = near_dedup.sketch(shingle, owner, 2)
    assert abs((s[0] == s[1]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15
    assert [int((owner == i).sum()) for i in range(2)] == [len(x) for x in sets]
    assert near_dedup.band_rows(0.85) == 7 and near_dedup.band_rows(0.8) == 5


@pytest.mark.parametrize("block", [near_dedup.BLOCK_SHINGLES, 600])
def test_near_duplicates_equal_all_pairs(spark, docs, block):
    """Also with blocks so small that groups span several."""
    rng = np.random.default_rng(4)
    texts = dict(ODD)
    key = 100
    vocabulary = [f"w{i}" for i in range(3000)]
    for base in range(6):
        start = list(rng.choice(vocabulary, 150))
        for copy in range(12):
            w = list(start)
            for _ in range(int(rng.integers(0, 7))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(vocabulary))
            texts[key] = " ".join(w)
            key += 1
    texts[key] = texts[100].upper()
    df = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(None, "no id"), (5, ODD[5])], "doc_id long, text string")
    for percent in (85, 80):
        got = near_dedup.near_duplicates(df, percent, block).collect()
        want = brute.near_components(texts, percent)
        assert len(got) == len(texts) + 2
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(None, 1, None, True)} | {(k, len(brute.shingles(v)), want[k], want[k] == k) for k, v in texts.items()}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(none(spark, DOCS)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_dedup_stage_keeps_columns_and_clean_rows(spark, docs):
    kept = near_dedup.stage_near_dedup(spark, docs, "").collect()
    ids = sorted((r.doc_id for r in kept), key=str)
    assert ids.count(6) == 0 and ids.count(5) == 2 and None in ids and len(kept) == docs.count() - 1


# --- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0] * 15 + [float("nan")], 1), (2003, [1.0] * 15 + [None], 1), (2004, [1.0], 1), (2020, [2.0], 1), (2100, [float("inf")] * 16, 1), (60, x[50].tolist(), 3)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, depth=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    y = x.astype(float)
    for q in range(0, 700, 20):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        found = [got[q][k] for k in sorted(got[q])]
        assert len(found) == 10 and sorted(got[q]) == list(range(1, 11))
        assert all(s == pytest.approx(d[i], abs=1e-12) for i, s in found) and [s for _, s in found] == sorted(s for _, s in found)
        hits += len({i for i, _ in found} & set(want))
        if q in (60, 80):
            assert [i for i, _ in found] == [i for i in range(50, 90) if i != q][:10]
    assert set(got) - {2020} == set(range(0, 700, 20)) and hits / 350 >= 0.9
    assert got[2020] == {1: (2004, 1.0)}  # vectors of another length are neighbours of each other
    few = df.where("vec_id IN (0, 1, 2)")
    assert neighbours.nearest(few, F.col("vec_id") == 0).count() == 2
    assert neighbours.nearest(df.where("vec_id >= 2000"), F.lit(True)).count() == 2
    assert neighbours.nearest(none(spark, "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(3)
    x, pivots = rng.standard_normal((40, 6)), rng.standard_normal((12, 6))
    full = neighbours.permutations(x, pivots, 12)
    files = dict(enumerate(neighbours.invert(full[:, :8], 12)))
    assert sum(len(row) for row, _ in files.values()) == 40 * 8
    place = np.minimum(np.argsort(full, 1), 8)
    want = [sum(abs(int(place[v, p]) - b) for b, p in enumerate(full[0, :5])) for v in range(40)]
    assert neighbours.footrules(files, full[0, :5], 40, 8).tolist() == want


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_the_query_at_its_own_parameters(spark, size):
    """At least 0.9 of the ten nearest, while at sf0.1 fewer than one in twenty vectors are measured."""
    at = Path("/root/testdata") / size
    if not at.is_dir():
        pytest.skip("tables are not here")
    rows = spark.read.parquet(f"{at}/embeddings.parquet").where(neighbours.usable(F.col("embedding"))).select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = {}
    for r in neighbours.op4_neighbours(spark, str(at)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [int(ids[j]) for j in np.lexsort((ids, d)) if j != i][:10]
        hits.append(len(found[int(ids[i])] & set(want)) / 10)
    assert np.mean(hits) >= 0.9 and (len(rows) < 2000 or 2.2 * np.sqrt(len(rows)) < 0.05 * len(rows))


def test_blocks_find_the_same(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    one = neighbours.nearest(df, F.col("vec_id") % 10 == 0)
    many = neighbours.nearest(df, F.col("vec_id") % 10 == 0, block_vectors=40, block_queries=7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


# --- packing


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, block_docs=3).collect()
    parts = {}
    for r in rows:
        parts.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length >= 1
    for k, text in ODD.items():
        ids = np.array([*bpe.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(parts[(k, len(ids))], key=lambda r: r.start)
        times = 2 if k == 5 else 1
        assert sum(r.length for r in mine) == times * len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        total = 0
        for r in s:
            assert r.offset == total
            total += r.length
        assert total == 1024 or total & (total - 1) == 0 and total < 1024
    assert packing.pack(none(spark, DOCS)).count() == 0


def test_ids_beside_nulls_and_of_odd_texts(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = packing.pack(spark.createDataFrame([(2**53 + 1, "a b"), (None, "c"), (7, None)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {7, 2**53 + 1, None}
    ours, named = packing.ByteBPE(packing.default_vocabulary()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(8)
    odd = ["".join(chr(c) for c in rng.choice([32, 10, 9, 13, 39, 48, 65, 97, 0xE9, 0x200B, 0x3000, 0x4E2D, 0x1F600, 0x301], 60)) for _ in range(200)]
    real = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] if Path("/root/testdata/sf0.001").is_dir() else []
    for t in odd + real + ["<|endoftext|> x<|endoftext|>", "can't I'VE  we'll\n\n "]:
        assert ours.encode(t) == named.encode(t, add_special_tokens=False).ids


def test_balance_evens_costs():
    lengths = np.array([1000, 500, 500, 24, 24, 1, 1, 1022])
    placed = packing.balance(lengths, 1024, 1.0, 1 / 1024)
    assert sorted(sum(n for i, _, n, _ in placed if i == k) for k in range(8)) == sorted(lengths)
    fill = {}
    for _, _, n, b in placed:
        fill[b] = fill.get(b, 0) + n
    assert sorted(fill.values()) == [1024, 1024, 1024]


# --- personal data


def test_base_spans_equal_plain_patterns(spark, docs):
    more = {20: "a@b.c_d@e.f x..y@z-.q-.w 1.2.3.4.5.6.7.8 300.1.1.1 1.1.1.001 00000001.2.3.4", 21: "4111 1111 1111 1111 2 4111-1111-1111-1111 5500000000000004 +49 (0) 30-1234-5 +1 2 +123456789012345678", 22: "é" * 50 + " ü@x.de é1.1.1.1é +4930123456é", 23: "@@@ a@ @b.c a@b a@b. a@b.c. +1", 24: "4" * 19 + " " + "0" * 16, 25: " ".join(f"u{i}@x{i}.com +1 (462) 555-42{i % 10}5" for i in range(700))}
    df = docs.unionByName(spark.createDataFrame([(k, v, None, None, None) for k, v in more.items()], DOCS))
    texts = ODD | more
    got = pii.find(df).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            continue
        base = brute.base_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in brute.KINDS), r.doc_id
        assert r.base_sha256 == brute.digest(brute.told(base)) and set(filter(None, brute.told(base).split(","))) <= set(filter(None, r.spans.split(",")))
    assert pii.find(none(spark, DOCS)).count() == 0


def test_bootstrapping_finds_unseen_identifiers(spark):
    seeds = [(i, f"Well, please write to user{i}@mail{i}.com about it.") for i in range(9)]
    mixed = [(100 + i, f"some of the a{i}@x{i}.com here") for i in range(4)] + [(200 + i, f"some of the 10.0.0.{i} here") for i in range(4)]
    unseen = [(300, "Now please write to bob77(at)mail.org, or not."), (301, "some of the zq88(at)mail.org here"), (302, "write to nobody in particular")]
    df = spark.createDataFrame(seeds + mixed + unseen, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    text = unseen[0][1]
    at = text.index("bob77")
    assert spans[300] == f"email:{at}:{at + len('bob77(at)mail.org')}"
    assert spans[301] == "" and spans[302] == "" and spans[0].count(":") == 2
    full = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.stage_pii(spark, full, "").collect()}
    assert masked[300] == ("Now please write to <EMAIL>, or not.", len("Now please write to <EMAIL>, or not.")) and masked[302][0] == unseen[2][1] and "<IP>" in masked[200][0]


def test_contexts_of_wrapped_glued_and_numbered_neighbours(spark):
    """Seeds and unseen tokens get their context from the same place, and accepted ones bring in new contexts."""
    made = [(i, f"acct-{2000 + i} no: <user{i}@mail{i}.com> is noted") for i in range(60)] + [(100, "acct-2099 no: bob77(at)mail.org is noted")]
    made += [(200 + i, f"please ring email:who{i}@mail{i}.com today") for i in range(8)] + [(300, "please ring carl99(at)mail.org today")]
    # behind "reach me" stand only identifiers that the first pattern finds
    made += [(400 + i, f"acct-{2100 + i} no: anna{i}x(at)post.org and reach me anna{i}x(at)post.org") for i in range(9)] + [(500, "reach me zoe123(at)post.org")]
    made += [(600, "x " * 30 + "a" * 90 + " w: user1@mail1.com")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    lefts = {r.doc_id: r.email[0].left for r in pii.observe(df).where("size(email) > 0").collect()}
    assert lefts[3] == "acct-_____no:"
    assert lefts[203] == "please_ring" and lefts[600] is None
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    for k, word in ((100, "bob77(at)mail.org"), (300, "carl99(at)mail.org"), (500, "zoe123(at)post.org")):
        at = dict(made)[k].index(word)
        assert spans[k] == f"email:{at}:{at + len(word)}", k


def test_stage_keeps_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", 15, "mine", 7, [1], "x"), (None, None, None, None, None, None, None)], "doc_id long, text string, n_chars long, email string, print long, found array<int>, added string")
    rows = pii.stage_pii(spark, df, "").orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert tuple(rows[0]) == (1, "mail <EMAIL> now", 16, "mine", 7, [1], "x") and set(rows[1]) == {None}


def test_masking_overlaps_and_positions(spark, docs):
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    # the phone pattern runs on through the card and has too many digits, and the card pattern takes the phone's
    # last digits in; both matches fail and are not tried again
    assert brute.base_spans(ODD[10])["phone"] == brute.base_spans(ODD[10])["card"] == []
    assert out[10] == "++ <IP> <EMAIL> +1 (462) 555-4285 4242 4242 4242 4242"
    assert out[0] is None and out[8] == LONG and out[9] == ODD[9]


def plain_score(model, text):
    """The network for one text, passage by passage, in plain Python."""
    x, _ = quality.encode([text])
    w = {k: np.asarray(v, dtype=float).tolist() for k, v in model.weights.items()}
    dot = lambda row, matrix, j: sum(a * b[j] for a, b in zip(row, matrix))
    hidden, asked = [], []
    for row in ((x - model.mean) / model.scale).tolist():
        h = [math.tanh(dot(row, w["W"], j) + b) for j, b in enumerate(w["b"])]
        gate = [math.tanh(dot(h, w["V"], j)) / (1 + math.exp(-dot(h, w["U"], j))) for j in range(len(w["a"]))]
        hidden.append(h)
        asked.append(sum(g * a for g, a in zip(gate, w["a"])))
    weights = [math.exp(e - max(asked)) for e in asked]
    pooled = [sum(a * h[j] for a, h in zip(weights, hidden)) / sum(weights) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(z * c for z, c in zip(pooled, w["c"])) + w["d"][0])))


def test_scores_equal_a_plain_forward_pass(spark, docs):
    rng = np.random.default_rng(2)
    texts = [words(int(n), int(n)) if n % 2 else " ".join(w + "#" for w in words(int(n), 1).split()) for n in rng.integers(5, 400, 60)]
    labels = spark.createDataFrame([(i, len(t) and int("#" not in t)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.learn(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels)
    assert model.constant is None
    for r in quality.score(docs, model).collect():
        if len(r.text or "") < 60_000:
            assert r.score == pytest.approx(plain_score(model, r.text or ""), abs=1e-4), r.doc_id


def test_attention_finds_the_one_passage_that_spoils_a_text():
    """Bags of twenty good passages, half of them with one bad one: equal weights drown it."""
    rng = np.random.default_rng(6)
    good = lambda: words(90, int(rng.integers(1e6)))[:512].ljust(512, "a")
    spoiled = lambda: "".join(rng.choice(list("#$%&*abcdefgh "), 512))

    def bag(bad):
        passages = [good() for _ in range(20)]
        if bad:
            passages[rng.integers(20)] = spoiled()
        return "".join(passages)

    y = rng.random(500) < 0.5
    x, counts = quality.encode([bag(not ok) for ok in y])
    assert (counts == 20).all()
    cut = 20 * 350
    model = quality.fit(x[:cut], counts[:350], y[:350].astype(float))
    flat = model._replace(weights=model.weights | {"a": 0 * model.weights["a"]})
    right = lambda m: float(((m.score(x[cut:], counts[350:]) >= 0.5) == y[350:]).mean())
    assert right(model) > 0.95 and right(model) > right(flat) + 0.1


def test_passages_of_long_texts_are_not_stretched():
    text = words(260_000, 4).encode()[:1_000_000].decode()
    text = text[:512_000] + "#" * 2048 + text[514_048:]
    x, counts = quality.encode([text, text[:512]])
    assert counts.tolist() == [1954, 1] and x[1000:1004, ord("#")].min() == 1.0
    assert x[0] == pytest.approx(x[-1])
    few = quality.sampled(x[:-1], 5)
    assert len(few) == 64 and (few == quality.sampled(x[:-1], 5)).all() and len(quality.sampled(x[:64], 5)) == 64


# --- quality rules


def test_measurements_equal_plain_counts(spark, docs):
    extra = {30: "a b c a b c a b c", 31: "x y z x y z", 32: "a a a a", 33: "one two three four five one two three", 34: "l1 a\n\nl1 a\n \nl1 a\nl2", 35: ("p q r s t " * 3000)}
    df = docs.unionByName(spark.createDataFrame([(k, v, None, None, None) for k, v in extra.items()], DOCS)).withColumn("n_words", F.lit("clash"))
    texts = ODD | extra
    for r in rules.judge(df).collect():
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.rule_counts(texts[r.doc_id]), r.doc_id
            assert 0 <= r.posterior <= 1
    assert rules.judge(none(spark, DOCS)).count() == 0


def test_estimation_recovers_planted_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.85
    catch = (0.4, 0.3, 0.35)
    votes = np.stack([np.where(y, np.where(rng.random(20_000) < 0.02, -1, 1), np.where(rng.random(20_000) < c, -1, 1)) for c in catch], 1)
    patterns = {}
    for v in map(tuple, votes.tolist()):
        patterns[v] = patterns.get(v, 0) + 1
    found = rules.estimate(patterns)
    assert abs(found.prior - 0.85) < 0.1 and all(abs(p - 0.02) < 0.02 for p in found.bad[0])
    assert rules.posterior((1, 1, 1), found) > 0.5 > rules.posterior((-1, -1, 1), found) and rules.estimate({}).bad == [[], []]


def _expected(good, wrong, catch):
    """Counts of vote patterns of 1M texts: rule k is wrong on a share wrong[k] of good texts and catches catch[k] of the bad."""
    patterns = {}
    for v in itertools.product((1, -1), repeat=len(wrong)):
        on_good = np.prod([w if x < 0 else 1 - w for x, w in zip(v, wrong)])
        on_bad = np.prod([c if x < 0 else 1 - c for x, c in zip(v, catch)])
        patterns[v] = 1_000_000 * (good * on_good + (1 - good) * on_bad)
    return patterns


@pytest.mark.parametrize("good", [0.7, 0.85, 0.98])
@pytest.mark.parametrize("catch", [0.2, 0.4])
def test_texts_that_only_a_noisy_rule_rejects_are_kept(good, catch):
    found = rules.estimate(_expected(good, [0.05] + [0.01] * 5, [catch] * 6))
    assert abs(found.prior - good) < 0.02 and abs(found.bad[0][0] - 0.05) < 0.01
    assert rules.posterior((-1, 1, 1, 1, 1, 1), found) > 0.5 > rules.posterior((1, -1, -1, 1, 1, 1), found)


def test_causes_beat_filters_majorities_and_independent_rules():
    """Two faults and a harmless cause, each seen by rules of its own: what filters and counts of votes get wrong."""
    rng = np.random.default_rng(8)
    n = 40_000
    cause = rng.choice(4, n, p=[0.76, 0.1, 0.08, 0.06])  # plain, harmless, fault one, fault two
    chance = np.full((4, 8), 0.02)
    chance[1, [0, 1]], chance[2, [2, 3, 4]], chance[3, [5, 6, 7]] = 0.9, 0.75, 0.75
    votes = np.where(rng.random((n, 8)) < chance[cause], -1, 1)
    patterns = dict(Counter(map(tuple, votes.tolist())))
    good = cause < 2
    right = lambda verdict: float((np.array([verdict(v) for v in map(tuple, votes.tolist())]) == good).mean())
    causes = [((), True), ((0, 1), True), ((2, 3, 4), False), ((5, 6, 7), False)]
    found = rules.estimate(patterns, causes)
    alike = rules.estimate(patterns)
    ours = right({v: rules.posterior(v, found) >= 0.5 for v in patterns}.get)
    # what can be known from votes alone, if shares and chances were given
    best = rules.Estimate([0.76, 0.1, 0.08, 0.06], [True, True, False, False], chance.tolist())
    assert ours > right({v: rules.posterior(v, best) >= 0.5 for v in patterns}.get) - 0.002
    # two rules alone don't tell how plain and harmless texts divide, which no verdict depends on
    assert np.abs(np.array(found.shares[2:]) - [0.08, 0.06]).max() < 0.01 and np.abs(np.array(found.bad) - chance).max() < 0.2
    assert ours > right(lambda v: min(v) > 0) + 0.15 and ours > right(lambda v: sum(v) >= 0) + 0.05 and ours > right({v: rules.posterior(v, alike) >= 0.5 for v in patterns}.get) + 0.02


def _plain_em(votes, seen, good, rounds=200):
    """The same estimation over single texts, in arrays, written from the formulas."""
    k, width = len(good), votes.shape[1]
    start = np.array([[0.02 if i == 0 else 0.4 if j in seen[i] else 0.05 for j in range(width)] for i in range(k)])
    share = np.array([0.0] + [0.1 / (sum(good) - 1) if g else 0.2 / (k - sum(good)) for g in good[1:]])
    share[0] = 1 - share.sum()
    bad = start

    def told():
        z = np.log(share) + (votes == -1) @ np.log(bad).T + (votes == 1) @ np.log(1 - bad).T
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(rounds):
        p = told()
        share = np.maximum(1e-4, (2 * share + p.sum(0)) / (2 + len(votes)))
        share = share / share.sum()
        rate = np.clip((2 * start + p.T @ (votes == -1)) / (2 + p.T @ (votes != 0)), 0.01, 0.99)
        rate[0] = np.minimum(0.5, rate[0])
        bad = np.array([r if g else np.maximum(r, rate[0]) for r, g in zip(rate, good)])
    return told() @ np.array(good)


def test_verdicts_equal_a_plain_estimation_and_differ_from_all_must_pass(spark, tmp_path):
    """The query op7, with rules that share faults and texts on which one rule alone votes bad."""
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = [prose(120) for _ in range(300)]
    texts += [" ".join(w + "###" for w in prose(120).split()) for _ in range(40)]  # two rules see the symbols
    texts += ["\n".join([prose(10)] * 12).upper() for _ in range(40)]  # several rules see the repeats
    texts += ["\n".join(["next page"] * 9) + "\n" + "\n".join(prose(20) for _ in range(9)) for _ in range(12)]  # one rule alone is against these
    texts += [None, "", "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in rules.op7_rules(spark, str(tmp_path)).collect()}
    rows = {r.doc_id: r for r in rules.measurements(df).select("doc_id", *(v.alias(k) for k, v in rules.rules().items())).collect()}
    votes = np.array([[rows[i][k] for k in rules.rules()] for i in range(len(texts))])
    named = list(rules.rules())
    posterior = _plain_em(votes, [{named.index(n) for n in c.seen_by} for c in rules.CAUSES], [c.good for c in rules.CAUSES])
    for i in range(len(texts)):
        assert got[i].posterior == pytest.approx(posterior[i], abs=1e-6)
        assert got[i].kept == (not got[i].base_failed and posterior[i] >= 0.5)
    outvoted = [i for i in range(len(texts)) if got[i].kept and (votes[i] < 0).any()]
    assert set(outvoted) == set(range(380, 392)) and not any(got[i].kept for i in range(300, 380)) and all(got[i].kept for i in range(300))


def test_texts_that_the_fast_tokenizer_refuses_are_packed(spark):
    """Runs of blanks and line ends that its pattern can't go back in."""
    from tokenizers import Tokenizer
    import public_tokenizers

    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: " " * 2_000_000, 2: "\n" * 2_000_000, 3: "a" + "\r\n" * 1_000_000 + " b", 4: "short"}
    rows = packing.pack(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    for k, text in texts.items():
        ids = np.array([*named.encode(text, add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        pieces = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)


# --- chat


def test_layouts_and_round_trip(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "hi <b>"}, {"role": "assistant", "content": None}]},
        2: {"prompt": "p", "completion": "c"}, 3: {"instruction": "do", "input": "", "output": "done"}, 4: {"instruction": "do", "input": "this", "output": "done"},
        5: {"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}, 6: {"unknown": 1}, 7: {"role": "user", "text": None}, 8: {"prompt": "p", "chosen": "a", "rejected": "b"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [(9, "not json"), (10, None), (11, '{"completion": "c", "prompt": 5}')]
    got = {r.id: r for r in chat.canonical_turns(spark.createDataFrame(rows, "id int, record string"), "record").collect()}
    assert {k: got[k].layout for k in range(1, 12)} == {1: "messages", 2: "prompt", 3: "instruction_input", 4: "instruction_input", 5: "conversations", 6: None, 7: "turn", 8: "chosen", 9: None, 10: None, 11: "prompt"}
    assert [tuple(t) for t in got[1].turns] == [("user", "hi <b>"), ("assistant", "")]
    assert [tuple(t) for t in got[3].turns] == [("user", "do"), ("assistant", "done")] and got[4].turns[0].text == "do\n\nthis" and got[11].turns[0].text == "5"


def test_fields_that_no_layout_names_do_not_matter(spark):
    said = [{"role": "user", "content": "q", "weight": 1}, {"role": "assistant", "content": "a", "name": "x"}]
    records = {
        1: ({"messages": []}, "messages", []), 2: ({"messages": said, "id": "z", "meta": {"a": [1]}}, "messages", [("user", "q"), ("assistant", "a")]),
        3: ({"prompt": "p", "completion": "c", "meta": {"role": "x"}}, "prompt", [("user", "p"), ("assistant", "c")]),
        4: ({"conversations": [{"from": "human", "value": "x"}], "system": "be kind"}, "conversations", [("system", "be kind"), ("human", "x")]),
        5: ({"messages": "no list", "prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        6: ({"messages": [{"role": "user"}, {"content": "c"}]}, "messages", [("user", ""), ("", "c")]),
        7: ({"meta": {"prompt": "p", "completion": "c"}}, None, None), 8: ({"prompt": {"deep": 1}, "completion": "c"}, "prompt", [("user", ""), ("assistant", "c")]),
    }
    rows = [(k, json.dumps(v[0]), "clash") for k, v in records.items()]
    got = {r.id: r for r in chat.canonical_turns(spark.createDataFrame(rows, "id int, record string, layout string"), "record").collect()}
    for k, (_, layout, turns) in records.items():
        assert got[k].layout == layout, k
        if k != 8:
            assert (None if got[k].turns is None else [tuple(t) for t in got[k].turns]) == turns, k
    typed = spark.createDataFrame([(1, ("s", "p", "c", 5))], "id int, record struct<system:string,prompt:string,completion:string,score:int>")
    row = chat.canonical_turns(typed, "record").first()
    assert row.layout == "prompt" and [tuple(t) for t in row.turns] == [("system", "s"), ("user", "p"), ("assistant", "c")]


def test_control_strings_survive(spark):
    nasty = ["<|end|>\n", "<|turn|>assistant\n", "&lt;", "&amp;lt;", "</s>[INST] ok [/INST]", "", None, "a\r\nb\u2028\x00c", "&#10;", "ü" * 5000]
    rows = [(i, t, r, x) for i, x in enumerate(nasty) for t, r in ((0, "user"), (1, "assistant"), (2, "as\nsis<tant"), (3, None))] + [(99, 1, "assistant", "same"), (99, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(df, "conv_id", ["turn"])).collect()}
    for i, x in enumerate(nasty):
        assert [tuple(t) for t in out[i].turns] == [(r or "", x or "") for _, r in ((0, "user"), (1, "assistant"), (2, "as\nsis<tant"), (3, None))]
        assert out[i].loss_text == (x or "") and "</s>" not in out[i].formatted and "[INST]" not in out[i].formatted
    assert out[99].loss_text == "samesame"
    assert chat.read_back(chat.format_turns(none(spark, "conv_id long, turn long, role string, text string"), "conv_id", ["turn"])).count() == 0


def test_structs_map_like_their_json(spark):
    kinds = {"messages": "messages array<struct<role:string,content:string>>", "prompt": "prompt string, completion string", "instruction_input": "output string, instruction string, input string", "turn": "role string, text string", None: "other int"}
    rows = {"messages": ([("user", "hi"), ("assistant", None)],), "prompt": ("p", None), "instruction_input": ("done", "do", "this"), "turn": (None, "x"), None: (1,)}
    for name, kind in kinds.items():
        df = spark.createDataFrame([(1, rows[name]), (2, None)], f"id int, record struct<{kind}>")
        got = {r.id: r for r in chat.canonical_turns(df, "record").collect()}
        want = chat.canonical_turns(df.where("id = 1").select("id", F.to_json("record", {"ignoreNullFields": "false"}).alias("record")), "record").first()
        assert (got[1].layout, got[1].turns) == (name, want.turns) and want.layout == name and got[2].layout is None and got[2].turns is None
        assert [(r.role, r.text) for r in chat.turn_rows(chat.canonical_turns(df, "record"), "id").where("id = 2").collect()] == [("", "")]


def test_structs_of_several_layouts_are_told_apart_by_fingerprint(spark):
    kind = "prompt string, completion string, role string, text string, messages array<struct<role:string,content:string>>"
    rows = [(1, ("p", "c", None, None, None)), (2, (None, None, "user", None, None)), (3, (None, None, None, None, [("user", "q"), ("assistant", "a")])), (4, ("p", None, "user", "x", None)), (5, (None,) * 5), (6, None), (7, (None, None, None, None, []))]
    mapped = chat.canonical_turns(spark.createDataFrame(rows, f"id int, record struct<{kind}>"), "record")
    assert {r.id: r.layout for r in mapped.collect()} == {1: "prompt", 2: "turn", 3: "messages", 4: "turn", 5: "turn", 6: None, 7: "messages"}
    assert [(r.id, r.position, r.role, r.text) for r in chat.turn_rows(mapped, "id").where("id IN (2, 3, 7)").orderBy("id", "position").collect()] == [(2, 0, "user", ""), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (7, 0, "", "")]


def test_chat_query_meets_two_layouts_and_orders_ties_by_plain_text(spark, tmp_path):
    import duckdb

    ties = ["5", "<", "%", "&", "Z", "[", "a", "", None, "<", "&amp;", "\u00e9", "&lt;"]
    rows = [(1, 0, "assistant", x) for x in ties] + [(2, 0, r, x) for r in ("a", "<", "&", "%", "5", None) for x in ties[:5]] + [(None, None, None, None), (3, 1, "user", "q"), (3, None, "user", "null turn")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    layouts = {r.layout for r in chat.canonical_turns(chat.conversation_records(spark, str(tmp_path)), "record").collect()}
    assert layouts == {"turn", "messages"}
    out = chat.op9_chat(spark, str(tmp_path))
    assert "xxhash64(" in out._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    columns = sorted(out.columns)
    rows_ = lambda found: sorted(map(repr, map(tuple, found)))
    # turns without a number come last in the one and first in the other; they have no place in the contract
    keep = "conv_id IS DISTINCT FROM 3"
    assert rows_(out.where(keep.replace("IS DISTINCT FROM 3", "<=> 3 = false")).select(*columns).collect()) == rows_(con.sql(f"SELECT {', '.join(columns)} FROM ({chat.ORACLES['op9_chat']}) WHERE {keep}").fetchall())


def test_very_long_turns_stay(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    long = F.when(F.col("turn") == 1, F.repeat(F.lit("x"), F.lit(20_000_001))).otherwise(F.col("text"))
    rows.withColumn("text", long).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in chat.op9_chat(spark, str(tmp_path)).collect()}
    assert (out[1].n_turns, out[1].loss_chars, out[2].n_turns) == (2, 20_000_001, 1)


# --- sharding


def test_rendezvous(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    both = sharding.assign_shards(sharding.assign_shards(df, "k", [1.0] * 16), "k", [1.0] * 17, "grown")
    moved = both.where("shard <> grown")
    assert moved.where("grown <> 16").count() == 0 and 20_000 / 17 * 0.85 < moved.count() < 20_000 / 17 * 1.15
    sizes = {r.shard: r["count"] for r in sharding.assign_shards(df, "k", {0: 1.0, 1: 3.0, 2: 0.0}).groupBy("shard").count().collect()}
    assert set(sizes) == {0, 1} and 2.7 < sizes[1] / sizes[0] < 3.3


def test_slots_are_gapless(spark, docs):
    df = sharding.assign_shards(docs.unionByName(docs), "doc_id", [1.0] * 4)
    rows = sharding.number_in_groups(df, "shard", bucket_rows=3).collect()
    assert len(rows) == 2 * docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.number_in_groups(sharding.assign_shards(none(spark, DOCS), "doc_id", [1.0]), "shard").count() == 0


# --- mixing


def _mix_docs(spark):
    german = "der die und das ist nicht ein von mit auf".split()
    rng = np.random.default_rng(6)
    rows = [(i, words(50 + i % 40, i), "en") for i in range(150)] + [(1000 + i, " ".join(rng.choice(german, 60)), "de") for i in range(50)] + [(2000, words(30, 1) + " " + " ".join(rng.choice(german, 30)), None), (2001, None, "en"), (2002, "", "de"), (2003, words(40, 9), "en"), (2003, words(40, 9), "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_mixing_meets_targets(spark):
    df = _mix_docs(spark)
    labelled = df.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    model = mixing.fit_domains(df, labelled)
    scored = mixing.posteriors(df, model).cache()
    assert scored.count() == df.count() and model.domains == ["de", "en"] and [len(x) for x in model.likely] == [mixing.BUCKETS] * 2
    p = {r.doc_id: r for r in scored.collect()}
    for k in (2001, 2002):  # no words: the prior
        assert p[k].p == pytest.approx(np.exp(model.priors) / np.exp(model.priors).sum())
    assert p[1001].p[0] > 0.9 and p[1].p[1] > 0.9 and p[2001].n_tokens == 0 and p[2000].n_tokens == 60 and p[2003].n_tokens == 40
    for targets in ({"de": 0.5, "en": 0.5}, {"de": 0.05, "en": 0.95}, {"de": 0.0, "en": 1.0}, {"xx": 1.0}):
        found = mixing.solve_rates(scored, model.domains, targets)
        rated = scored.withColumn("r", mixing.rate_of(found.steps, 0.0)).collect()
        have = [sum(r.n_tokens * r.r * r.p[k] for r in rated) for k in range(2)]
        assert min(r.r for r in rated) >= 0 and have == pytest.approx(found.goal, rel=1e-3, abs=0.01 * sum(found.goal))
        assert have == pytest.approx(found.reached) and found.residual < 0.01
    steps = mixing.solve_rates(scored, model.domains, {"de": 0.5, "en": 0.5}, least_rate=1.0, keep_all=True).steps
    assert min(r.r for r in scored.select(mixing.rate_of(steps, 1.0).alias("r")).collect()) >= 1.0
    empty = mixing.posteriors(none(spark, "doc_id long, text string, lang string"), model)
    assert empty.count() == 0 and mixing.solve_rates(empty, model.domains, {"en": 1.0}).steps == []


def test_mixing_equals_a_plain_version(spark, docs):
    """Posteriors and projected gradient of the query against plain loops, on awkward texts too."""
    df = _mix_docs(spark).unionByName(docs.select("doc_id", "text", "lang"))
    model = mixing.fit_domains(df, df.where("doc_id < 100 OR doc_id >= 1000").select("doc_id", F.col("lang").alias("domain")))
    buckets = {r.w: r.b for r in df.select(F.explode(F.split(F.lower("text"), "[ \\t\\n\x0b\\f\\r]+")).alias("w")).distinct().select("w", F.expr(f"pmod(hash(w), {mixing.BUCKETS})").alias("b")).collect()}
    rows = []
    for r in df.collect():
        w = brute.WORD.findall((r.text or "").lower())
        logs = [p + min(1, 64 / max(len(w), 1)) * sum(table[buckets[x]] for x in w) for p, table in zip(model.priors, model.likely)]
        e = np.exp(np.array(logs) - max(logs))
        rows.append((r.doc_id, len(w), e / e.sum()))
    scored = mixing.posteriors(df, model).cache()
    got = sorted(((r.doc_id, r.n_tokens, r.p) for r in scored.collect()), key=str)
    for (i, n, p), (j, m, q) in zip(got, sorted(((i, n, p.tolist()) for i, n, p in rows), key=str)):
        assert (i, n) == (j, m) and p == pytest.approx(q, rel=1e-6, abs=1e-9)
    n, p = np.array([x[1] for x in rows], float), np.stack([x[2] for x in rows])
    have, gram = (n[:, None] * p).sum(0), (p * n[:, None]).T @ p
    goal, rate = np.array([0.3, 0.7]) * have.sum(), np.ones(len(rows))
    found = mixing.solve_rates(scored, model.domains, {"de": 0.3, "en": 0.7})
    for _ in found.steps:
        error = (n[:, None] * p * rate[:, None]).sum(0) - goal
        rate = np.where(n > 0, np.maximum(0, rate - p @ (np.linalg.pinv(gram) @ error)), 1)
    mine = sorted((str(x[0]), round(float(y), 6)) for x, y in zip(rows, rate))
    assert sorted((str(r.doc_id), round(r.r, 6)) for r in scored.withColumn("r", mixing.rate_of(found.steps, 0.0)).collect()) == [(a, pytest.approx(b, abs=2e-6)) for a, b in mine]


def test_mixing_stage_repeats_but_never_drops(spark, tmp_path):
    df = _mix_docs(spark).withColumn("n_chars", F.length("text"))
    spark.createDataFrame([(i, 1) for i in (*range(0, 150, 2), *range(1000, 1050, 2))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = mixing.stage_mixing(spark, df, str(tmp_path))
    assert out.columns == df.columns and out.select("doc_id").distinct().count() == df.select("doc_id").distinct().count() and out.count() > df.count()
