"""URL filter, packing, LM scores, near-duplicates and the Bloom filter against brute force."""

import binascii
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import duckdb
from weekpanel.llm import bloom, components, lm_score, packing, queries
from weekpanel.llm.components import connected_components
from weekpanel.llm.elias_fano import Trie, build_trie
from weekpanel.llm.minhash import Circulant, near_duplicates
from weekpanel.llm.text import byte_words, shingle_set, table, WordHashes
from weekpanel.llm.url_filter import judge_urls

from . import brute
from .conftest import EDGES, LONG, SF001, SF01, document_frame

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark, sf=SF01):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


# ------------------------------------------------------------------ URL filter
def test_url_filter_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF01}/pages.parquet'")
    want = con.sql(queries.SQL["op1_url_filter"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["op1_url_filter"](spark, SF01).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_url_filter_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "ftp://example.org/en/12", "x://notexample.org/es/", "http://u.com",
            "http://u.com/fr/", "http://u.com?/fr/", "http://bad.net/p/", "http://bad.net/p?x", "http://bad.net/q", "http://example.org:80/es/", "http://a://b.org/"]
    pages = spark.createDataFrame([(i, u, "h", "rule?") for i, u in enumerate(urls)] * 2, "page_id long, url string, h string, rule string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("net", None, "block"), ("com", "/fr/", "allow")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("https://BAD.net/p",), (None,), ("",)], "url string")
    rows = judge_urls(pages, rules, listed).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 2 * len(urls) and rows[0].h == "h"
    assert [got[i] for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"), ("u.com", "", None, "allow"), ("u.com", "/fr/", "com/fr/", "allow"), ("u.com", "", None, "allow"),
        ("bad.net", "/p/", None, "block"), ("bad.net", "/p", None, "block"), ("bad.net", "/q", None, "allow"),
        ("example.org:80", "/es/", None, "allow"), ("a:", "//b.org/", None, "allow"),
    ]
    assert judge_urls(pages.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS k")
    f = bloom.build(keys, "k", 1 << 10)
    hit = spark.range(20000).selectExpr("id", "concat('k', id) AS k")
    got = hit.select("id", bloom.maybe_listed(hit, f, hit.k).alias("m")).toPandas()
    assert got[got.id < 5000].m.all() and got[got.id >= 5000].m.mean() < 0.1


# --------------------------------------------------------------------- packing
def _check_pieces(rows, docs, window=2048):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = {}
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append(ids)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == want.keys()
    for i, copies in want.items():
        pieces = sorted(by[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(map(len, copies))
        for r in pieces:
            assert any(r.doc_tokens == len(c) and r.ids_crc32 == binascii.crc32(c[r.start : r.start + r.length].tobytes()) for c in copies)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    return sequences


def test_packing_round_trip(spark):
    rows = queries.QUERIES["op2_packing"](spark, SF01).collect()
    sequences = _check_pieces(rows, _docs(spark))
    assert sum(r.length for r in rows) > 0.97 * 2048 * len(sequences)


def test_packing_edges(spark, edges, empty):
    _check_pieces(packing.pack(edges, VOCABULARY).collect(), [(i, t) for i, t, *_ in EDGES])
    assert packing.pack(empty, VOCABULARY).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=12, max_size=12))
def test_plan_uses_the_histogram_exactly(histogram):
    used = np.zeros(12, int)
    for counts, repeats in packing.plan(np.array(histogram)):
        assert repeats > 0 and sum(k * c for k, c in counts.items()) <= 12
        for k, c in counts.items():
            used[k - 1] += c * repeats
    assert used.tolist() == histogram


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    a, y = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, y)
    slope = a.T @ (y - a @ x)
    assert (x >= 0).all() and (slope < 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


# ------------------------------------------------------------------- LM scores
@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.sets(st.tuples(st.integers(0, 59), st.integers(0, 5000)), max_size=300))
def test_trie_finds_exactly_its_entries(contexts, entries):
    entries = sorted(e for e in entries if e[0] < contexts)
    level = np.arange(len(entries)) % 256
    c, w = (np.array([e[k] for e in entries], np.int64) for k in (0, 1))
    trie = Trie(build_trie(c, w, level, contexts))
    asked = entries + [(x, y) for x in range(contexts) for y in (0, 17, 4999, 5001)]
    known = dict(zip(entries, level.tolist(), strict=True))
    got = trie.find(np.array([a[0] for a in asked]), np.array([a[1] for a in asked]))
    assert got.tolist() == [known.get(a, -1) for a in asked]


def test_trie_keeps_levels_of_very_common_contexts():
    level = np.array([0, 255, 256, 300, 6000])
    trie = Trie(build_trie(np.zeros(5, np.int64), np.arange(5), level, 1))
    assert trie.find(np.zeros(5, np.int64), np.arange(5)).tolist() == level.tolist()


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_lm_scores_match_brute_force_and_beat_the_base(spark):
    rows = queries.QUERIES["op3_lm_score"](spark, SF001).collect()
    want = brute.lm(_docs(spark, SF001), _held_out, lm_score.HEAD, lm_score.VOCABULARY, order=3)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == _held_out(r.doc_id)
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_lm_other_words_and_edges(spark, edges, empty):
    from pyspark.sql import functions as F

    docs = [(i, t) for i, t, *_ in EDGES if i is not None]
    rows = lm_score.lm_scores(edges.filter("doc_id IS NOT NULL"), F.col("doc_id") < 9, head=200, vocabulary=50).collect()
    want = brute.lm(docs, lambda i: i >= 9, 200, 50)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])
    assert lm_score.lm_scores(empty, F.lit(True)).count() == 0
    assert {r.score for r in lm_score.lm_scores(edges, F.lit(False)).collect()} == {0.0}


def test_lm_pairs_hold_words_beyond_the_head(spark):
    """Every word forms pairs, however few words a task has at hand."""
    docs = table(spark, SF001, "documents")
    want = brute.lm(_docs(spark, SF001), _held_out, lm_score.HEAD, None)
    for head in (60, 3):  # 3: the start mark and hardly any word
        rows = lm_score.lm_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2, head=head).collect()
        assert len(rows) == len(want)
        for r in rows:
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
            assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])


@pytest.mark.parametrize("head", [lm_score.HEAD, 60, 3])
@pytest.mark.parametrize("spread", [False, True])
def test_lm_triples_match_brute_force(spark, monkeypatch, head, spread):
    """The third level of the trie, with words outside the head, and with contexts spread over shards."""
    if spread:
        monkeypatch.setattr(lm_score, "SPREAD", 150)
        monkeypatch.setattr(lm_score, "WORDS_A_SHARD", 9_000)
        monkeypatch.setattr(lm_score, "AT_ONCE", 2_000)
    docs = table(spark, SF001, "documents")
    want = brute.lm(_docs(spark, SF001), _held_out, lm_score.HEAD, None, order=3)
    rows = lm_score.lm_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2, head=head, order=3).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])
    pairs = brute.lm(_docs(spark, SF001), _held_out, lm_score.HEAD, None)
    assert sum(w[4] for w in want.values()) > sum(w[4] for w in pairs.values())


def test_lm_triples_of_edge_texts(spark, edges, empty):
    docs = [(i, t) for i, t, *_ in EDGES if i is not None]
    rows = lm_score.lm_scores(edges.filter("doc_id IS NOT NULL"), F.col("doc_id") < 9, head=200, vocabulary=50, order=3).collect()
    want = brute.lm(docs, lambda i: i >= 9, 200, 50, order=3)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])
    assert lm_score.lm_scores(empty, F.lit(True), order=3).count() == 0
    assert {r.score for r in lm_score.lm_scores(edges, F.lit(False), order=3).collect()} == {0.0}


class _Shared:
    def __init__(self, value):
        self.value = value


def _lm_model(words, shards, seen=None):
    start = len(words)
    return _Shared(lm_score.Model(words, np.ones(start, np.int64), start, start, start, seen, 2, 3, np.full(start + 1, shards)))


def _lm_batch(texts, ids):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array([True] * len(texts))], ["doc_id", "text", "learned"])


def test_lm_pairs_of_spread_contexts_are_exchanged_by_bucket():
    """Rows follow the buckets, not the pairs, and hold every pair once with its count."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(400)) for _ in range(20)]
    model, want = _lm_model([b" ", *(b"w%d" % i for i in range(300))], 4), Counter()
    ranks = {w: i for i, w in enumerate(model.value.head)}
    for t in texts:
        own = [model.value.start, *(ranks[w] for w in t.encode().split()), 0]
        want.update(zip(own, own[1:], strict=False))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 5])], ["text"]) for i in (0, 5, 10, 15)]
    out = pa.Table.from_batches(lm_score._count_spread(model, 4)(iter(batches)))
    assert out.num_rows <= 4 and len(want) > 5000
    spread = np.arange(model.value.start + 1)
    total = np.full(len(spread), 8000)
    got = {}
    for bucket in range(4):
        packed = lm_score._pack_pairs(spread, total, 1)((pa.scalar(bucket),), out.filter(pc.equal(out["bucket"], bucket)))
        for blob in packed["blob"]:
            raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
            n = (len(raw) - 8) // 16
            context = int(np.frombuffer(raw, np.int64, 1)[0])
            word, level = (lm_score._unplaned(raw, np.int64, n, 8 + 8 * i * n) for i in range(2))
            assert not got.keys() & {(context, w) for w in word.tolist()}
            got |= {(context, w): x for w, x in zip(word.tolist(), level.tolist(), strict=True)}
    n = np.array(list(want.values()))
    assert got == dict(zip(want, lm_score._level(n, np.full(len(n), 8000)).tolist(), strict=True))


def test_lm_shards_return_a_row_a_chunk():
    """Rows and bytes a text costs must not grow with the shards its words go to."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(200)]
    model = _lm_model([b" ", *(b"w%d" % i for i in range(300))], 1)
    asked = pa.Table.from_batches(lm_score._asked(model, 8)(iter([_lm_batch(texts, range(200))])))
    assert asked.num_rows == 9 and len(set(asked["chunk"].to_pylist())) == 1
    rows = numbered = 0
    for shard in range(8):
        out = lm_score._score_shard(model)((pa.scalar(shard),), asked.filter(pc.equal(asked["shard"], shard)))
        lists = out.filter(pc.is_valid(out["more"]))
        rows += lists.num_rows
        numbered += sum(map(len, lists["numbers"].to_pylist()))
        assert [len(x) for x in lists["more"].to_pylist()] == [len(x) for x in lists["numbers"].to_pylist()]
    assert rows == 8 and 1000 < numbered <= 1600


def test_lm_many_short_texts_fill_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "TEXTS", 7)
    docs = [(i, ["", "a b", "a b a c", "c"][i % 4]) for i in range(30)]
    rows = lm_score.lm_scores(document_frame(spark, [(*d, None, None) for d in docs]), F.lit(True), order=3).collect()
    want = brute.lm(docs, lambda i: False, lm_score.HEAD, None, order=3)
    assert sorted(r.doc_id for r in rows) == list(range(30))
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])


# ------------------------------------------------------------- near-duplicates
def test_near_duplicates_match_brute_force(spark):
    rows = queries.QUERIES["op8_minhash"](spark, SF01).collect()
    want = brute.components(_docs(spark))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_a_hot_group_and_a_chain(spark):
    """Copies of one text with few to many edits (some unlinked), a chain, and exact copies."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(250):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 7)):
            w[k] = f"e{rng.randrange(10**6)}"
        docs.append((1000 + i, " ".join(w)))
    docs += [(5000 + i, "the same text of seven words here") for i in range(300)]
    docs += [(9000 + i, " ".join(f"c{k}" for k in range(8 * i, 8 * i + 80))) for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(document_frame(spark, [(i, t, None, None) for i, t in docs])).collect()}
    assert got == brute.components(docs)


def test_near_duplicate_edges(spark, edges, empty):
    rows = near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True) and by[3].component_id == 3 and by[2].kept
    assert by[None].component_id is None and by[None].kept
    assert by[6].component_id == 5 and not by[6].kept and by[5].n_shingles == len(brute.shingles(LONG))
    assert by[4].n_shingles == 1 and by[4].component_id == 4
    assert near_duplicates(empty).count() == 0
    tied = near_duplicates(document_frame(spark, [(7, "alpha beta gamma", None, None), (8, "alpha beta gamma", None, None), (8, "another text", None, None), (9, "another text", None, None)]))
    assert {(r.doc_id, r.component_id) for r in tied.collect()} == {(7, 7), (8, 7), (9, 7)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(500, 600)] + [(3, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(500, 600)}, 7: 7, 3: 3}


def test_components_of_random_graphs(spark):
    """A path of 1,000 nodes in random order, whose labels must not travel a node a round, and random graphs."""
    rng = random.Random(9)
    path = rng.sample(range(10**6), 1000)
    edges = list(zip(path, path[1:])) + [(a + 10**7, b + 10**7) for a, b in (rng.sample(range(300), 2) for _ in range(140))]
    parent = {i: i for e in edges for i in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for buffer in (components.BUFFER, 20):  # the second leaves nearly all work to the rounds
            assert {r.node: r.component for r in connected_components(table, buffer).collect()} == {i: root(i) for i in parent}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_empty_null_and_repeated_edges(spark):
    schema = "a long, b long"
    assert connected_components(spark.createDataFrame([], schema)).count() == 0
    edges = [(None, 1), (2, None), (None, None), (5, 4), (4, 5), (5, 4), (-3, -3), (-(1 << 63), (1 << 63) - 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, schema)).collect()}
    assert got == {4: 4, 5: 4, -3: -3, -(1 << 63): -(1 << 63), (1 << 63) - 1: -(1 << 63)}


def test_near_duplicates_of_a_long_chain_in_random_order(spark):
    """1,000 documents, neighbours at a similarity of about 0.8, ids shuffled."""
    rng = random.Random(4)
    ids = rng.sample(range(10**9), 1000)
    docs = [(ids[i], " ".join(f"c{k}" for k in range(8 * i, 8 * i + 80))) for i in range(1000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(document_frame(spark, [(i, t, None, None) for i, t in docs])).collect()}
    assert got == brute.components(docs)


def test_lm_ids_of_equal_texts_stay_apart(spark):
    ids = [1, 4294967297, -1, -2, 0, None, 1]
    docs = document_frame(spark, [(i, "one text of several words", None, None) for i in ids])
    rows = lm_score.lm_scores(docs, F.lit(True)).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(i for i in ids if i is not None) and len(rows) == len(ids)
    assert len({round(r.score, 9) for r in rows}) == 1


def test_circulant_signatures_estimate_similarity():
    circulant, hashes = Circulant(), WordHashes()
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        v = [x if rng.random() > 0.04 else "z" + x for x in w]
        a, b = (shingle_set(hashes.of(byte_words(" ".join(x).encode()))) for x in (w, v))
        same = len(np.intersect1d(a, b))
        errors.append((circulant.signature(a) == circulant.signature(b)).mean() - same / (len(a) + len(b) - same))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_lm_rows_of_one_id_and_text_with_and_without_training(spark):
    """Words seen once count as known in every row, whichever way a row gets their counts."""
    once = "alpha beta " + " ".join(f"only{i}" for i in range(40))
    rows = [(1, once, "t", None), (1, once, None, None), (2, "alpha beta alpha beta never", None, None), (3, "gamma gamma gamma beta", "t", None)]
    got = lm_score.lm_scores(document_frame(spark, rows), F.col("lang") == "t", head=3).collect()
    ones = [r for r in got if r.doc_id == 1]
    assert [(r.n_tokens, r.n_known) for r in ones] == [(43, 43)] * 2
    assert len({round(r.base_score, 9) for r in ones}) == len({round(r.score, 9) for r in ones}) == 1
    assert {r.doc_id: r.n_known for r in got}[2] == 5 and {r.train_tokens for r in got} == {48}
