"""Operators 11 and 13 against the tokenizers themselves."""

import glob
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from comparo.llm import pieces as P
from comparo.llm import token_files as T
from comparo.llm import token_links as L
from comparo.llm.tables import WIDE_ROWS, write
from comparo.llm.words import text_column

from .corpus import corpus

ODD = ["", " ", "  a", "a  b", "a \n b", "it's  'twas 's", "a  b", "a  b", "　 x", "x  y", "a <|endoftext|> b",
       "<|endoftext|>", " <|endoftext|>", "123 45a", "\x00 \x01", "▁ a▁b", "<0x41> <s> </s><unk>", "é́ ﬁ Ａ",
       "\U0001f600 \U0001f600a", "tab\tand  \t blank ", "trailing  ", "\r\n \r\n"]


def _ids(texts, limit=P.KNOWN, special_as_text=False):
    made = P.Ids(T.VOCABULARY, special_as_text, limit)
    out = []
    for _, _, data, bounds in P.chunks_of(pa.array(texts, pa.string())):
        values, edges = made.of(data, bounds)
        out += [values[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=list(" \n\taé's1.,!?:\u3000▁<|>\u0085\u00a0\u2028x"), max_size=14), min_size=1, max_size=6))
def test_pieces_encode_as_whole_texts(texts):
    texts = [t.replace("x", "<|endoftext|>") for t in texts]
    for special_as_text in (False, True):
        assert _ids(texts, special_as_text=special_as_text) == P.encoder(T.VOCABULARY, special_as_text)(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_pieces_of_any_text(texts):
    assert _ids(texts) == P.encoder(T.VOCABULARY)(texts)


def test_odd_texts_and_a_small_memory():
    encode = P.encoder(T.VOCABULARY)
    texts = ODD + [t or "" for _, t in corpus()]
    assert _ids(texts) == encode(texts)
    assert _ids(texts, limit=3) == encode(texts)


def test_long_text_of_one_piece_and_of_many():
    encode = P.encoder(T.VOCABULARY)
    texts = ["ab" * 5000, "some words of a text " * 70_000, None, "x"]
    assert _ids(texts) == encode([t or "" for t in texts])


@pytest.mark.parametrize("width", [1, 8])
@pytest.mark.parametrize("top", [1, 255, 256, 50257, 1 << 31, (1 << 32) - 1])
def test_planes(width, top):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, top, 1000, dtype=np.uint64, endpoint=True).astype(np.uint32)
    doc_ids = pa.array([3, None, 5, -7], pa.int64())
    raw = T.pack(4, 2, doc_ids, np.array([0, 600, 399, 1]), ids, width=width, block=64)
    for content in (raw, raw + b"\n"):
        file = T.Segment(content)
        assert (file.part, file.segment, file.doc_ids.to_pylist(), file.lengths.tolist()) == (4, 2, doc_ids.to_pylist(), [0, 600, 399, 1])
        assert file.range(0, 1000).tolist() == ids.tolist()
        assert T.decode_range(content, 130, 131).tolist() == ids[130:131].tolist()
        assert T.decode_range(content, 60, 700).tolist() == ids[60:700].tolist()
    assert len(file.index) == 16 and file.index[0][0] == len(T.MAGIC)


def _expected(rows):
    encode = P.byte_bpe(T.VOCABULARY).encode
    made = [(d, encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]
    return made


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_files_round_trip(frame, tmp_path, planes):
    rows = corpus() + [(4000 + i, t) for i, t in enumerate(ODD)] + [(None, None)]
    path = f"file://{tmp_path}/ids"
    T.write_ids(frame(rows, extra=True), path, planes=planes, block=256, segment_ids=2000)
    got = sorted(T.read_ids(frame([]).sparkSession, path).collect(), key=lambda r: r.start)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == sorted(_expected(rows), key=str)
    assert [key((r.doc_id,)) for r in got] == sorted(key((r.doc_id,)) for r in got)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    files = list((tmp_path / "ids").glob("part-*"))
    assert len(files) > 3


def test_digests(frame, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(corpus())]
    path = f"file://{tmp_path}/ids"
    T.write_ids(frame(rows), path)
    at, want = 0, []
    for d, ids in _expected(rows):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = T.read_lengths(frame([]).sparkSession, path)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_one_id_holds_most_rows(frame, tmp_path):
    rows = [(5, "the same text")] * 200 + [(5, f"another {i}") for i in range(50)] + [(i, "x") for i in range(20)]
    path = f"file://{tmp_path}/ids"
    T.write_ids(frame(rows), path, segment_ids=64)
    got = T.read_ids(frame([]).sparkSession, path).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted(_expected(rows))
    assert len({r.start for r in got}) == len(rows)
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def test_empty_table(frame, tmp_path):
    path = f"file://{tmp_path}/ids"
    T.write_ids(frame([]), path)
    assert T.read_lengths(frame([]).sparkSession, path).collect() == []


# ---- operator 11 ----

def _brute_tokens(text):
    """Token ids and byte strings of space + text under both vocabularies, whole; None where they don't spell it."""
    if not text:
        return None
    va, vb = L.vocabulary_a(L.VOCABULARY_A), L.vocabulary_b(L.VOCABULARY_B)
    a, b = (v.encode([b" " + text.encode()])[0].tolist() for v in (va, vb))
    spell = lambda v, ids: [v.data[v.edges[i]:v.edges[i + 1]].tobytes() for i in ids]
    sa, sb = spell(va, a), spell(vb, b)
    if b"".join(sa) != (" " + text).encode() or b"".join(sb) != (" " + text).encode():
        return None
    return a, sa, b, sb


def brute_alignment(rows):
    made, held = [], {}
    for d, t in rows:
        tokens = _brute_tokens(t)
        if tokens is None:
            made.append((d, None))
            continue
        a, sa, b, sb = tokens
        spans = lambda parts: [(sum(map(len, parts[:0])) if not k else e[k - 1], e[k]) for e in [np.cumsum([len(p) for p in parts]).tolist()] for k in range(len(parts))]
        xa, xb = spans(sa), spans(sb)
        links, j = [], 0
        for i, (p, q) in enumerate(xa):
            while xb[j][1] <= p:
                j += 1
            k = j
            while k < len(xb) and xb[k][0] < q:
                links.append((i, k, min(q, xb[k][1]) - max(p, xb[k][0])))
                k += 1
        ends = sorted({q for _, q in xa} & {q for _, q in xb})
        group = lambda q: next(g for g, e in enumerate(ends) if q <= e)
        parts = [([], []) for _ in ends]
        for side, (ids, xs) in enumerate(((a, xa), (b, xb))):
            for i, (_, q) in zip(ids, xs):
                parts[group(q)][side].append(i)
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in parts)
        pairs = [(a[i], b[k]) for i, k, _ in links]
        for p in set(pairs):
            held[p] = held.get(p, 0) + 1
        made.append((d, (len(a), len(b), len(ends), pairs, text, links)))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for d, x in made:
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_g, pairs, text, _ = x
            out.append((d, n_a, n_b, n_g, len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs),
                        hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SHORT = [(d, (t or "")[:160] if t is not None else None) for d, t in corpus()]
LINKED = SHORT + [(4000 + i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "x y"), (4000, "x y")]


def test_alignment(frame):
    got = L.alignment(frame(LINKED, extra=True), block_bytes=3000)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == sorted(brute_alignment(LINKED), key=str)


def test_pairs_are_counted_packed_in_buckets(frame, monkeypatch):
    """Every bucket has all pairs of its ids of A; no pair becomes a row, so no task holds an object for each of a block's pairs."""
    monkeypatch.setattr(L, "COUNTED", 40)
    used, values = [], L.pair_values
    monkeypatch.setattr(L, "pair_values", lambda blocks, size_b, buckets: used.append((buckets, out := values(blocks, size_b, buckets))) or out)
    got = L.alignment(frame(LINKED), block_bytes=3000)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == sorted(brute_alignment(LINKED), key=str)
    (buckets, out), = used
    assert buckets > 5 and "Generate" not in out._jdf.queryExecution().toString()


def test_rows_of_some_mb_are_not_gathered_by_the_writer(llm):
    """Parquet would look at what it holds after a hundred rows."""
    wide = llm.range(24, numPartitions=1).selectExpr("id", "transform(sequence(1, 200000), x -> x * 7919 + id * 104729 * x) as many")
    files = {k: write(wide, "wide", **k_options) for k, k_options in (("plain", {}), ("wide", WIDE_ROWS))}
    groups = {k: [pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet")]
              for k, path in files.items()}
    assert groups["plain"] == [1] and groups["wide"][0] > 1
    assert llm.read.parquet(files["wide"]).exceptAll(wide).isEmpty()


def test_alignment_of_long_texts(frame):
    rows = [(1, "b" * 3000), (2, "it is a text of some words, " * 45_000), (3, "the end"), (4, "a ▁ " * 50 + "the end")]
    got = {r.doc_id: r for r in L.alignment(frame(rows)).collect()}
    tokens = _brute_tokens(rows[1][1])
    assert (got[2].n_a, got[2].n_b) == (len(tokens[0]), len(tokens[2])) and got[2].n_links >= got[2].n_a
    assert got[4].n_a == 0 and got[4].groups_sha256 == "" and got[3].n_best > 0
    assert (got[1].n_a, got[1].n_b) == tuple(len(_brute_tokens(rows[0][1])[k]) for k in (0, 2))


def test_alignment_of_empty_table_and_of_no_tokens(frame):
    assert L.alignment(frame([])).collect() == []
    assert [tuple(r) for r in L.alignment(frame([(1, None), (1, "")])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_links_of_every_document(frame):
    rows = [(i, t) for i, (_, t) in enumerate(LINKED)]
    got = {r.doc_id: r for r in L.token_links(frame(rows)).collect()}
    for d, t in rows:
        tokens = _brute_tokens(t)
        if tokens is None:
            assert not got[d].a_ids and not got[d].overlap and not got[d].shared
            continue
        a, sa, b, sb = tokens
        ea, eb = np.cumsum([len(x) for x in sa]), np.cumsum([len(x) for x in sb])
        shared = lambda i, k: min(ea[i], eb[k]) - max(ea[i] - len(sa[i]), eb[k] - len(sb[k]))  # noqa: E731, B023
        assert (got[d].a_ids, got[d].b_ids) == (a, b)
        assert {(x.a, x.b): x.bytes for x in got[d].overlap} == {
            (i, k): shared(i, k) for i in range(len(a)) for k in range(len(b)) if shared(i, k) > 0}
        ends = np.intersect1d(ea, eb)
        groups = np.searchsorted(ends, ea), np.searchsorted(ends, eb)
        assert sorted((x.a, x.b, x.group) for x in got[d].shared) == [
            (i, k, groups[0][i]) for i in range(len(a)) for k in range(len(b)) if groups[0][i] == groups[1][k]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=5), max_size=5), st.lists(st.lists(st.integers(0, 3), max_size=4), min_size=5, max_size=5))
def test_sparse_product(x, y):
    dense = lambda rows, n: np.array([[sum(v == c for v in r) for c in range(n)] for r in rows], int).reshape(len(rows), n)
    make = lambda rows, n: L.csr(np.cumsum([0] + [len(r) for r in rows]), np.array([v for r in rows for v in sorted(r)], int), n)
    got = L.product(make(x, 5), make(y, 4))
    out = np.zeros((len(x), 4), int)
    np.add.at(out, (got.rows(), got.indices), got.values)
    assert (out == dense(x, 5) @ dense(y, 4)).all()
    back = L.transpose(make(y, 4))
    out = np.zeros((4, 5), int)
    np.add.at(out, (back.rows(), back.indices), back.values)
    assert (out == dense(y, 4).T).all()
