"""Operators 1, 2, 3, 5, 6, 9 and 10 against brute force, oracle SQL or round trips."""

import hashlib
import json
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from comparo.llm import backoff_lm, nb_toxicity, segment_topk, source_mix, warc_derive, words as W, wu_manber
from comparo.llm.kd_sharding import kd_shards
from comparo.llm.winnow import least_positions
from comparo.llm.queries import ORACLE, QUERIES
from .corpus import corpus

TABLES = ["documents", "embeddings"]


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_oracle(llm, con, sf_small, key):
    from comparo.checks.compare import compare

    ok, message, _ = compare(llm, con, key, QUERIES[key], ORACLE[key], sf_small)
    assert ok, message


# words and anchors

def test_words_follow_the_patterns():
    texts = ["Ab  c\td", "", None, "c d x", "d", "é1-é", "x" * 70 + " ab", "\x0b\x0c", "KK"]
    for members, pattern in ((W.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (W.ALPHANUMERIC, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for i, j, w in W.batches(pa.chunked_array([pa.array(texts[:4]), pa.array(texts[4:])]), members, lower=True):
            hashes = w.hashes()
            for d in range(j - i):
                own = [bytes(w.data[w.start[k]:w.end[k]]) for k in range(w.first[d], w.first[d + 1])]
                assert own == re.findall(pattern, (texts[i + d] or "").encode().lower())
                for k, x in enumerate(own):
                    assert seen.setdefault(x, hashes[w.first[d] + k]) == hashes[w.first[d] + k]
        assert len(set(map(int, seen.values()))) == len(seen)


@pytest.mark.parametrize("k", [1, 3, 8, 9, 40])
def test_window_hashes(k):
    values = np.random.default_rng(k).integers(0, 3, 200).astype(np.uint64)
    out, seen = W.windows(values, k), {}
    for i, h in enumerate(out.tolist()):
        assert seen.setdefault(tuple(values[i:i + k].tolist()), h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n,span", [(1, 1), (10, 3), (1000, 26), (50, 50), (49, 50)])
def test_least_positions(n, span):
    h = np.random.default_rng(n).integers(0, 1 << 40, n).astype(np.uint64) << np.uint64(20)
    want = [i + int(np.argmin(h[i:i + span] >> np.uint64(24))) for i in range(n - span + 1)]
    assert least_positions(h, span).tolist() == want


# 1 LM scoring

def brute_backoff(rows, corpus_rows, min_count=1):
    grams = {n: {} for n in (1, 2, 3)}
    total = 0
    for _, t in corpus_rows:
        w = (t or "").encode().split()
        total += len(w)
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                grams[n][tuple(w[k:k + n])] = grams[n].get(tuple(w[k:k + n]), 0) + 1
    out = []
    for d, t in rows:
        w, sum_ = (t or "").encode().split(), 0
        for k in range(len(w)):
            s = max(1, grams[1].get((w[k],), 0)) / max(1, total)
            for n in (2, 3):
                if k >= n - 1:
                    own = tuple(w[k - n + 1:k + 1])
                    c = grams[n].get(own, 0)
                    s = c / grams[n - 1][own[:-1]] if c >= min_count else 0.4 * s
            sum_ += int(np.rint(np.log10(s) * 1e6))
        out.append((d, len(w), sum_))
    return sorted(out, key=str)


def test_backoff_of_the_corpus_itself_and_of_another(frame, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(backoff_lm, "BUCKET_HASHES", 2000)
    rows, other = corpus(21), [(1, "one two three"), (2, None), (3, corpus(21)[1][1] + " unseen")]
    columns = ("doc_id", "n_words", "score_micro")
    got = lambda df: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got(backoff_lm.backoff_scores(frame(rows, extra=True))) == brute_backoff(rows, rows)
    assert got(backoff_lm.backoff_scores(frame(other), frame(rows))) == brute_backoff(other, rows)
    assert backoff_lm.backoff_scores(frame([])).collect() == []


# 2 exact top-k

def brute_top(vectors, k):
    out = []
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for qi, q in sorted({(i, tuple(v)) for i, v in whole if i % 20 == 0}):
        clamp = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
        s = sorted((-clamp(sum(a * b for a, b in zip(q, c))), i) for i, c in whole if i != qi and len(c) == len(q))
        out += [(qi, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("n,dim", [(30, 5), (700, 20)])
def test_top_k_with_ties_and_broken_vectors(llm, monkeypatch, n, dim):
    monkeypatch.setattr(segment_topk, "CANDIDATES", 150)
    monkeypatch.setattr(segment_topk, "QUERIES", 16)
    rng = np.random.default_rng(n)
    vectors = [(i, [float(x) for x in (rng.normal(size=dim) if i % 3 else np.ones(dim) * (i % 2))]) for i in range(n)]
    vectors += [(n + 1, None), (n + 2, [None] * dim), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] * dim),
                (None, [1.0] * dim), (n * 20, [1.0, 2.0]), (n * 20 + 1, [3.0, 4.0]), (n * 20 + 20, []),
                (n * 20 + 40, [1e15] * dim)]
    df = llm.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x"))
    out = segment_topk.top_k(df, df.where("vec_id % 20 = 0"), 7)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()) == brute_top(vectors, 7)


def test_top_k_with_repeated_rows(llm, monkeypatch):
    """A repeated query ranks its candidates once; a repeated candidate is one of its own; an id with two vectors has two
    rankings, and an id that comes in most rows is spread over the blocks."""
    monkeypatch.setattr(segment_topk, "CANDIDATES", 20)
    monkeypatch.setattr(segment_topk, "QUERIES", 8)
    rng = np.random.default_rng(8)
    plain = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    vectors = plain + [plain[20]] * 3 + [plain[7]] * 2 + [plain[33]] * 80
    df = llm.createDataFrame(vectors, "vec_id long, embedding array<double>")
    out = segment_topk.top_k(df, df.where("vec_id % 20 = 0"), 5)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()) == brute_top(vectors, 5)
    two = llm.createDataFrame(plain + [(20, [1.0] * 6)], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in segment_topk.top_k(two, two.where("vec_id = 20"), 5).collect()]
    assert sorted(r for r, _ in got) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and all(v != 20 for _, v in got)
    packed, n = segment_topk.blocks(segment_topk.integers(df), 20, "c")
    assert max(len(r.ids) // 8 for r in packed.collect()) < 60 and n > 5


def test_blocks_of_vectors_meet_in_parts_and_are_not_broadcast(llm, monkeypatch):
    """However small the tables look, no side's blocks are gathered for a broadcast; a block meets all blocks of a part, and each
    task returns a query's k best of them."""
    monkeypatch.setattr(segment_topk, "CANDIDATES", 6)
    monkeypatch.setattr(segment_topk, "QUERIES", 4)
    monkeypatch.setattr(segment_topk, "TOGETHER", 3)
    rng = np.random.default_rng(12)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(400)]
    df = llm.createDataFrame(vectors, "vec_id long, embedding array<double>")
    out = segment_topk.top_k(df, df.where("vec_id % 20 = 0"), 6)
    assert "Broadcast" not in out._jdf.queryExecution().toString()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()) == brute_top(vectors, 6)


def test_top_k_of_an_empty_table(llm):
    df = llm.createDataFrame([], "vec_id long, embedding array<double>")
    assert segment_topk.top_k(df, df).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, c = rng.integers(-40, 40, (30, 24)).astype(float), rng.integers(-40, 40, (50, 24)).astype(float)
    before = np.inf
    for s in (1, 4, 16):
        bound = segment_topk._statistics(q, s) @ segment_topk._statistics(c, s).T
        assert (bound + 1e-6 >= q @ c.T).all()
        assert bound.mean() <= before
        before = bound.mean()


# 3 mixing

def test_targets_reshare():
    assert source_mix.targets([10, 10, 10, 100]) == [20.0, 20.0, 20.0, 135.0]
    assert source_mix.targets([]) == []
    assert source_mix.targets([0, 4]) == [0.0, 6.0]


def test_flow_fills_quotas_of_overlapping_sources_with_few_repeats():
    patterns = [((0,), 10), ((0, 1), 10), ((1,), 5)]
    assert source_mix.cheapest_flow(patterns, [10, 15], 2) == [10, 10, 5]       # nothing twice
    assert source_mix.cheapest_flow(patterns, [15, 12], 2) == [12, 10, 5]
    sent = source_mix.cheapest_flow(patterns, [40, 40], 2)
    assert sent == [20, 20, 10]                                                # all capacity
    # the shared pattern goes where it is needed although it was routed elsewhere first
    assert source_mix.cheapest_flow([((0, 1), 10), ((0,), 10)], [10, 10], 1) == [10, 10]


def test_mix(frame):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 4}") for i in range(400)]
    rows += [(1000 + i, "w " * 30, None) for i in range(50)] + [(2000, None, "s1"), (2001, "", None), (2002, " ", "z")]
    out = source_mix.mixed(frame(rows, extra=True), F.array("source")).collect()
    again = source_mix.mixed(frame(rows, extra=True, partitions=7), F.array("source")).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, source_mix.targets([size[s] for s in order])))
    taken = dict.fromkeys(order, 0)
    source = {r[0]: r[2] for r in rows}
    for r in out:
        assert r.taken in (0, r["size"], 2 * r["size"])
        assert r.sizes == [size[source[r.doc_id]]] and r.targets == [goal[source[r.doc_id]]]
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert goal[s] - 12 <= taken[s] <= goal[s] + 1
    rows = source_mix.mixture(frame(rows, extra=True), F.array("source"))
    assert rows.columns == frame([], extra=True).columns
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r.doc_id for r in out for _ in range(r.copies))
    assert source_mix.mixed(frame([]), F.array("source")).collect() == []


def test_mix_of_overlapping_sources(llm):
    rows = [(i, "w " * 10, ["a"] if i < 30 else ["a", "b"] if i < 60 else ["b"] if i < 70 else []) for i in range(75)]
    df = llm.createDataFrame(rows, "doc_id long, text string, members array<string>")
    out = source_mix.mixed(df, F.col("members"), share=1.0, repeats=3).collect()
    assert {len(r.sources) for r in out} == {0, 1, 2}
    assert all(r.copies == 0 for r in out if not r.sources)
    assert sum(r.taken for r in out) == 1000     # 600 words of a, 400 of b: each its target


def test_mix_of_repeated_rows(frame):
    """A third of all rows are copies of one that together exceed what their source still needs: as many of them as fit are
    taken, and the search goes on behind them."""
    rows = [(5, "w " * 3, "a")] * 400 + [(100 + i, "w " * (2 + i % 7), "a") for i in range(300)] + [(1000 + i, "w " * 4, "b") for i in range(500)]
    rows += [(None, "w " * 9, "a")] * 40
    for share in (0.5, 1.5):
        out = source_mix.mixed(frame(rows), F.array("source"), share=share).collect()
        taken, goal = {}, {}
        for r in out:
            taken[r.sources[0]] = taken.get(r.sources[0], 0) + r.taken
            goal[r.sources[0]] = r.targets[0]
            assert r.taken <= 2 * r["size"]
        assert all(goal[s] - 9 <= taken[s] <= goal[s] + 1 for s in goal), (taken, goal)
        copies = [r.copies for r in out if r.doc_id == 5]
        assert max(copies) - min(copies) <= 1
    behind = [r.copies for r in source_mix.mixed(frame(rows), F.array("source"), share=0.5).collect() if (r.doc_id or 0) >= 100]
    assert any(behind)


def test_mix_network_is_bounded(frame, monkeypatch):
    monkeypatch.setattr(source_mix, "MAX_ARCS", 5)
    with pytest.raises(ValueError):
        source_mix.mixed(frame([(i, "w", f"s{i}") for i in range(9)]), F.array("source"))


# 5 decontamination

def brute_contamination(rows, items, n=10):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    patterns = {}
    for i, t in items:
        w = find(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            patterns.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, named = find(t), set(), set()
        for size in {len(p) for p in patterns}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in patterns:
                    hit.update(range(k, k + size))
                    named |= patterns[tuple(w[k:k + size])]
        out.append((d, len(w), len(hit), sorted(x for x in named if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_pass", [200_000, 700])
def test_decontamination(llm, frame, per_pass):
    rows = corpus(31)
    items = [(1, rows[3][1]), (2, rows[4][1][:200]), (3, "one, TWO"), (4, ""), (5, None), (6, "--"), (7, "zz9"),
             (8, "a"), (None, rows[9][1]), (10, "ONE two"), (1, rows[11][1]), (12, "é é é")]
    rows += [(5000, "x One-two y"), (5001, "zz9" * 2), (5002, "é É é é"), (5003, "w " * 400 + rows[3][1] + " w" * 400)]
    bench = llm.createDataFrame(items, "item_id long, text string").withColumn("hit", F.lit(1))
    found = wu_manber.decontaminate(frame(rows, extra=True), bench, patterns_per_pass=per_pass).collect()
    got = sorted(((r.doc_id, r.n_words, sum(bin(b).count("1") for b in r.hit), list(r["items"])) for r in found), key=str)
    assert got == brute_contamination(rows, items)
    clean = wu_manber.without_contaminated(frame(rows, extra=True), bench, patterns_per_pass=per_pass)
    assert clean.columns == frame([], extra=True).columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _, hit, _ in got if not hit)


def test_decontamination_of_empty_tables(llm, frame):
    none = llm.createDataFrame([], "item_id long, text string")
    assert wu_manber.decontaminate(frame([]), none).collect() == []
    assert [tuple(r) for r in wu_manber.decontaminate(frame([(1, "a b")]), none).collect()] == [(1, 2, b"", [])]


def test_contamination_query(llm, sf_small):
    import pandas as pd

    docs, bench = (pd.read_parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = [(d, n, hit, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), hit > 0)
            for d, n, hit, i in brute_contamination(list(zip(docs.doc_id, docs.text)), list(zip(bench.item_id, bench.text)))]
    out = QUERIES["op5_wu_manber"](llm, sf_small).collect()
    assert sorted((tuple(r) for r in out), key=str) == want


# 6 sharding

@pytest.mark.parametrize("shards", [1, 7])
def test_shards(frame, shards):
    rows = corpus(41) + [(9000 + i, "same text for all") for i in range(500)]
    out = kd_shards(frame(rows, extra=True), shards=shards).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == sorted(
        ((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    slots, bytes_ = {}, {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        bytes_[r.shard] = bytes_.get(r.shard, 0) + r["size"]
    assert sorted(slots) == list(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(bytes_.values()) / shards
    assert max(abs(b - mean) for b in bytes_.values()) <= 3 * max(r["size"] for r in out)
    again = kd_shards(frame(rows, partitions=5), shards=shards).collect()
    assert sorted(((r.doc_id, r.shard, r.slot) for r in out), key=str) == sorted(((r.doc_id, r.shard, r.slot) for r in again), key=str)


def test_shards_of_a_target_size_and_of_nothing(frame):
    rows = [(i, "x" * 92) for i in range(100)]
    out = kd_shards(frame(rows), target_bytes=1000).collect()
    assert {r.shard for r in out} == set(range(10))
    assert kd_shards(frame([]), shards=4).collect() == []
    assert {r.shard for r in kd_shards(frame([(1, None)]), shards=4).collect()} <= {0, 1, 2, 3}


# 9 toxicity

def test_toxicity_learns_from_the_other_folds_only(llm, sf_small):
    out = {r.doc_id: r for r in QUERIES["op9_nb_toxicity"](llm, sf_small).collect()}
    docs = llm.read.parquet(f"{sf_small}/documents.parquet")
    labels = llm.read.parquet(f"{sf_small}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(nb_toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(nb_toxicity.learn(docs, labels), nb_toxicity.learn(docs, turned))
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert len(out) == docs.count()


def test_toxicity_sample_is_bounded(frame, llm):
    """A labelled id in most rows gives each of its texts once; the texts of the fit stay within their bytes, one
    that is longer is left out whole."""
    clean, rude = "a calm and quiet text number ", "vile rotten insult number "
    rows = [(i, (rude if i % 2 else clean) + str(i)) for i in range(200)]
    labels = llm.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    once = nb_toxicity.learn(frame(rows), labels)
    assert np.allclose(nb_toxicity.learn(frame(rows + [rows[3]] * 300 + [rows[4]] * 30, extra=True), labels), once)
    long_ = [(1000, rude * 4000)]
    more = labels.unionByName(llm.createDataFrame([(1000, 0)], "doc_id long, toxic int"))
    assert np.allclose(nb_toxicity.learn(frame(rows + long_), more, sample_bytes=100_000), once)
    small = nb_toxicity.learn(frame(rows), labels, sample_bytes=3_000)
    assert not np.allclose(small, once) and np.array_equal(small, nb_toxicity.learn(frame(rows, partitions=5), labels, sample_bytes=3_000))
    scored = {r.doc_id: r.score for r in nb_toxicity.score(frame(rows + long_), once).collect()}
    assert scored[1000] > 0.5 > scored[0]


def test_toxicity_on_held_out_rows(llm):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op9_nb_toxicity"](llm, sf).join(llm.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    positive, taken = out.toxic == 1, out.predicted == 1
    rank = out.score.rank()
    auc = (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc > 0.94
    assert (positive & taken).sum() / taken.sum() > 0.93
    assert (positive & taken).sum() / positive.sum() > 0.8


def test_toxicity_edges(llm, frame):
    docs = frame([(1, None), (2, ""), (3, "a"), (None, "abc def ghi"), (4, "x" * 50_000)], extra=True)
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = nb_toxicity.learn(docs, none)
    assert [r.score for r in nb_toxicity.score(docs, weights).collect()] == [0.5] * 5
    one = llm.createDataFrame([(4, 1, 1), (4, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in nb_toxicity.score(docs, nb_toxicity.learn(docs, one)).collect())
    assert nb_toxicity.score(frame([]), weights).collect() == []
    kept = nb_toxicity.without_toxic(docs, weights, threshold=0.6)
    assert kept.columns == docs.columns and kept.count() == 5


# 10 WARC

PAGE = """<!DOCTYPE html><html><head><title>A &amp;\n B</title><meta charset=utf-8><script>var x = "<p>no</p>";</script>
<style>p{}</style></head><body><!-- <p>hidden</p> --><h1>Head &copy;</h1><p>One <b>two</b>
 three<br>four<a href='/x?a=1&amp;b=2' id=q>link</a><IMG SRC=pic.png><ul><li>i1<li>i2</ul>5 < 6 &lt;tag&gt;
<script>open"""


def test_plain_text_and_metadata():
    assert warc_derive.plain_text(PAGE) == "Head ©\nOne two\nthree\nfourlink\ni1\ni2\n5 < 6 <tag>"
    meta = warc_derive.page_metadata(PAGE)
    assert meta["Title"] == "A & B" and meta["Metas"] == [{"charset": "utf-8"}]
    assert {"path": "A@/href", "url": "/x?a=1&b=2"} in meta["Links"] and {"path": "IMG@/src", "url": "pic.png"} in meta["Links"]
    assert warc_derive.plain_text("") == "" and warc_derive.plain_text("<!-- open <p>x") == ""


def test_derivatives_round_trip(llm):
    rows = [(1, "http://a/x", PAGE), (2, None, "<p>x"), (None, "http://b", None), (4, "http://c", ""),
            (1, "http://a/x", PAGE), (5, "http://d\r\nX: y", "é" * 5000)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    sources = {r.record_id: r for r in warc_derive.responses(pages).collect()}
    out = warc_derive.derivatives(warc_derive.responses(pages)).collect()
    assert len(out) == 2 * len(rows) and len({r.record_id for r in out}) == 2 * len(sources)
    for r in out:
        (headers, block), = warc_derive.parse_records(bytes(r.record))
        source = sources[r.refers_to]
        assert block.decode() == r.block and len(block) == r.content_length
        assert headers["WARC-Type"] == r.warc_type and headers["WARC-Refers-To"] == r.refers_to
        assert headers["WARC-Block-Digest"] == r.block_digest == warc_derive.digest(block)
        assert headers["WARC-Source-Block-Digest"] == warc_derive.digest(bytes(source.block))
        assert headers["WARC-Source-Payload-Digest"] == warc_derive.digest(bytes(source.block).partition(b"\r\n\r\n")[2])
        assert ("WARC-Target-URI" in headers) == (r.target_uri is not None)
        if r.warc_type == "metadata":
            header = json.loads(r.block)["Envelope"]["WARC-Header-Metadata"]
            assert header["WARC-Record-ID"] == r.refers_to and header["Content-Length"] == str(len(bytes(source.block)))
    whole = b"".join(bytes(r.record) for r in out)
    assert len(warc_derive.parse_records(whole)) == len(out)


def test_markup_time_is_linear():
    import time

    for bad in ("<a " * 200_000, "<!-" * 200_000, "<script>" * 100_000, "<head>" * 100_000, '<a href="' * 100_000, "&" * 300_000):
        began = time.perf_counter()
        warc_derive.plain_text(bad)
        warc_derive.page_metadata(bad)
        assert time.perf_counter() - began < 5


def test_equal_texts_share_a_shard(frame):
    """Groups of equal texts with ids, sources and null ids from everywhere; only one that a cut must divide is parted."""
    rows = [(i, f"{i} " + "w" * (200 + i * 37 % 400), f"s{i % 4}") for i in range(4000)]
    rows += [(i * 31 % 2000, f"copied text {i % 60} " * 9, f"s{i % 5}" if i % 7 else None) for i in range(300)] + [(None, "copied text 3 " * 9, "s1")] * 4
    out = kd_shards(frame(rows), shards=7).collect()
    shards = {}
    for r in out:
        shards.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    groups = [g for g in shards.values()]
    assert sum(len(g) > 1 for g in groups) == 0
    total = [sum(r["size"] for r in out if r.shard == s) for s in range(7)]
    assert max(total) < 1.1 * min(total)


def test_a_text_of_a_third_of_all_rows_is_divided(frame):
    rows = [(i, "w" * (50 + i % 90), f"s{i % 4}") for i in range(600)] + [(5000 + i, "the same text " * 6, "s1") for i in range(300)]
    out = kd_shards(frame(rows), shards=8).collect()
    total = [sum(r["size"] for r in out if r.shard == s) for s in range(8)]
    assert max(total) < 1.1 * min(total)
    parted = {}
    for r in out:
        parted.setdefault(r.text_crc32, set()).add(r.shard)
    assert max(map(len, parted.values())) >= 2


def test_markup_as_browsers_read_it():
    text, links = warc_derive.plain_text, lambda p: warc_derive.page_metadata(p)["Links"]
    assert text("<svg/>after <math a='b' />it") == "after it"
    assert text("<svg width=1><text>no</text></svg>yes") == "yes"
    assert text('<a title="a > b" href="x">link</a>') == "link"
    assert links('<a title="a > b" href="x">link</a><img alt=\'>\' src=q>') == [
        {"path": "A@/href", "url": "x"}, {"path": "IMG@/src", "url": "q"}]
    assert text("<object data=o>shown instead</object> rest") == "shown instead rest"
    assert text('<p class="x>text</p> y') == "text\ny"
    assert text("<script/>gone</script>here") == "here"


def test_source_headers_are_kept():
    head = b"HTTP/1.1 301 Moved\r\nSet-Cookie: a=1\r\nX:y\r\nset-cookie: b=2\r\nLong: one\r\n  two\r\nnonsense\r\n\r\n"
    given = [("WARC-IP-Address", "10.0.0.1"), ("WARC-Warcinfo-ID", "<urn:uuid:w>"), ("WARC-Date", "2020-01-01T00:00:00Z"),
             ("X-Own", "line\r\nbreak"), ("Empty", None)]
    rows = warc_derive.derive("<urn:uuid:r>", "http://a", "2024-01-01T00:00:00Z", head + b"<p>x", given)
    meta = json.loads(rows[0][8])["Envelope"]
    http = meta["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["Headers"] == {"Set-Cookie": ["a=1", "b=2"], "X": "y", "Long": "one two"}
    assert http["Response-Message"] == {"Version": "HTTP/1.1", "Status": "301", "Reason": "Moved"}
    source = meta["WARC-Header-Metadata"]
    assert source["WARC-IP-Address"] == "10.0.0.1" and source["X-Own"] == "line break" and source["WARC-Date"].startswith("2020")
    assert "Empty" not in source and source["WARC-Record-ID"] == "<urn:uuid:r>"
    for row in rows:
        (headers, _), = warc_derive.parse_records(row[9])
        assert headers["WARC-Warcinfo-ID"] == "<urn:uuid:w>" and "X-Own" not in headers


def test_warc_files(llm, tmp_path):
    pages = llm.createDataFrame([(1, "http://a", "<p>one\r\n\r\ntwo</p>"), (2, None, None), (3, "http://ü", "<p>" + "é" * 3000)],
                                "page_id long, url string, html string").withColumn("record_id", F.lit("x")).withColumn("date", F.lit("y"))
    records = warc_derive.responses(pages).withColumn(
        "warc_headers", F.array(F.struct(F.lit("WARC-IP-Address").alias("name"), F.lit("10.1.1.1").alias("value"))))
    out = warc_derive.derivatives(records)
    warc_derive.write_warc(out, f"file://{tmp_path}/warc")
    written = [r for f in (tmp_path / "warc").glob("part-*") for r in warc_derive.parse_records(f.read_bytes())]
    want = [warc_derive.parse_records(bytes(r.record))[0] for r in out.collect()]
    assert sorted(map(str, written)) == sorted(map(str, want)) and len(written) == 6
    assert all(h["WARC-IP-Address"] == "10.1.1.1" for h, _ in written)
    empty = warc_derive.derivatives(warc_derive.responses(pages.limit(0)))
    assert empty.collect() == []


def test_the_fit_needs_little_more_than_its_entries():
    """The fit runs in one task: it works on stretches of the entries and makes no second copy of them."""
    rng = np.random.default_rng(6)
    columns = [np.sort(rng.integers(0, 1 << 12, 50_000)).astype(np.int32) for _ in range(40)]
    counts = [np.ones(50_000, np.int32) for _ in columns]
    tracemalloc.start()
    try:
        weights = nb_toxicity.fit(columns, counts, np.full(40, 50_000.0), np.arange(40) % 2 == 0, 12)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.isfinite(weights).all() and peak < 24 * 40 * 50_000


def test_the_fit_lets_go_of_its_entries():
    """Counts travel in a byte where they can, and the fit empties the lists that hold them."""
    for counts in ([], [1, 255], [1, 256], [70_000]):
        packed = nb_toxicity.packed_counts(np.array(counts, np.int64))
        assert nb_toxicity.unpacked_counts(packed, len(counts)).tolist() == counts
    assert len(nb_toxicity.packed_counts(np.array([1, 255]))) == 2
    columns, counts = [np.array([1, 2], np.int32), np.array([2], np.int32)], [np.array([1, 1], np.uint8), np.array([3], np.uint8)]
    weights = nb_toxicity.fit(columns, counts, np.array([2.0, 3.0]), np.array([True, False]), 4)
    assert np.isfinite(weights).all() and columns == [] and counts == []
