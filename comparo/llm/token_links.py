"""Tokens of two tokenizers aligned by the bytes they cover.

Tokenizer A is a byte-level vocabulary of the tokenizers library, which encodes a blank and the text; B is a
sentencepiece vocabulary, which adds that blank itself. A token's bytes give its rows in two incidence
matrices, held as CSR arrays built here: A (tokens of A x bytes) and B (tokens of B x bytes). Row by row,
Gustavson's product A·Bᵀ gathers, for every byte of a token of A, the tokens of B that hold it: its entries are
the overlap links, their values the bytes that both share. Byte offsets where tokens of both end cut the tokens into groups; the
product of the incidences token of A x group and group x token of B gives the shared-group links.

:func:`token_links` returns these for every document. :func:`alignment` is the corpus view: how often each pair of ids is linked,
counted in documents, and what that says about each document. Pieces between blanks (see `pieces`) have
boundaries of both tokenizers at both ends, so the products of each distinct piece are computed once a
task and added up by document. Documents go in blocks: a block is one row with its documents and its distinct id
pairs. These are dealt out as packed arrays, by a hash of the id of A into buckets whose number follows their total: a bucket
has all pairs of its ids, counts them and answers every block it has pairs of. So no task or driver holds the counts of the corpus,
and no pair becomes a row or an object of the JVM.

Defined results: a text that is null or empty, or that the tokens of A or B do not spell byte for byte (such as one
with U+2581, which B reads as a blank), has no tokens: zeros, and '' for its groups. Repeated rows count as
documents of their own; a missing doc_id stays null; columns other than doc_id and text are not read. A very long text is a block by itself.
Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comparo.llm import pieces as P
from comparo.llm import words as W
from comparo.llm.tables import BATCH_BYTES, WIDE_ROWS, drop, materialize, table
from comparo.session import small_batches

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20       # text of a block
BLOCK_ROWS = 1 << 14        # documents of a block
KNOWN = 1 << 18             # distinct pieces that a task remembers at most
LEARNT = 1 << 13            # pieces whose matrices are multiplied at once
COUNTED = 1 << 20           # pairs of blocks that one task counts, about


# ---- sparse matrices ----

class Csr(NamedTuple):
    """Rows of column numbers: row i is indices[indptr[i]:indptr[i + 1]], ascending; values go with them."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def csr(indptr: np.ndarray, indices: np.ndarray, columns: int) -> Csr:
    return Csr(indptr, indices, np.ones(len(indices), np.int64), columns)


def token_bytes(lengths: np.ndarray) -> Csr:
    """Token x byte: each token holds the bytes after those of the token before it."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    return csr(ends, np.arange(ends[-1]), int(ends[-1]))


def token_groups(ends: np.ndarray, group_ends: np.ndarray) -> Csr:
    """Token x group: the group in which a token that ends at `ends` lies."""
    return csr(np.arange(len(ends) + 1), np.searchsorted(group_ends, ends), len(group_ends))


def transpose(m: Csr) -> Csr:
    indptr = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    order = np.argsort(m.indices, kind="stable")
    return Csr(indptr, m.rows()[order], m.values[order], len(m.indptr) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """Gustavson's row product: row i of the result adds up the rows of `b` that row i of `a` names."""
    n = b.indptr[a.indices + 1] - b.indptr[a.indices]
    columns, _ = P.ragged(b.indices, b.indptr, a.indices)
    values, _ = P.ragged(b.values, b.indptr, a.indices)
    keys = np.repeat(a.rows() * b.columns, n) + columns
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], (values * np.repeat(a.values, n))[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(values, first) if len(first) else values
    rows, columns = keys[first] // max(1, b.columns), keys[first] % max(1, b.columns)
    return Csr(np.searchsorted(rows, np.arange(len(a.indptr))), columns, sums, b.columns)


# ---- tokenizers ----

class Vocabulary(NamedTuple):
    encode: object          # list of texts, as bytes with a blank before each -> (ids, where each text's begin)
    data: np.ndarray        # bytes of all tokens, by id
    edges: np.ndarray
    at_blanks: bool         # whether texts can be encoded piece by piece

    @property
    def size(self) -> int:
        return len(self.edges) - 1


def _vocabulary(tokens: list[bytes], encode, at_blanks: bool) -> Vocabulary:
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in tokens], dtype=np.int64)])
    return Vocabulary(encode, np.frombuffer(b"".join(tokens), np.uint8), edges, at_blanks)


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def vocabulary_a(name: str) -> Vocabulary:
    made = P.byte_bpe(name, special_as_text=True)
    signs = byte_alphabet()
    tokens = [b""] * made.get_vocab_size()
    for token, number in made.get_vocab().items():
        tokens[number] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    encode, at_blanks = P.encoder(name, special_as_text=True), P.splits_at_blanks(name)
    bytes_of = P.byte_lengths(name) if at_blanks else None
    return _vocabulary(tokens, lambda texts: P.encoded(texts, encode, bytes_of), at_blanks)


@lru_cache(maxsize=2)
def vocabulary_b(name: str) -> Vocabulary:
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=P.place(name))
    entries = [made.id_to_piece(k) for k in range(made.get_piece_size())]
    tokens = [bytes([int(e[3:5], 16)]) if made.is_byte(k) else e.replace("▁", " ").encode()
              for k, e in enumerate(entries)]
    at_blanks = not any("▁" in e.lstrip("▁") for e in entries)

    def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = made.encode([t[1:].decode() for t in texts], num_threads=1)
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in ids], dtype=np.int64)])
        return np.array([i for x in ids for i in x], np.int64), first

    return _vocabulary(tokens, encode, at_blanks)


# ---- links of pieces ----

class Links(NamedTuple):
    """Tokens and links of some texts, each with the blank before it; `x_first[k]` is where those of text k begin."""

    spelled: np.ndarray     # whether the tokens of both spell the text; if not, it has none
    a: np.ndarray
    a_first: np.ndarray
    b: np.ndarray
    b_first: np.ndarray
    overlap: Csr            # token of A x token of B, bytes that both hold
    shared: Csr             # token of A x token of B in the same group
    a_group: np.ndarray
    b_group: np.ndarray
    g_first: np.ndarray


def _kept(ids: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.where(keep, np.diff(first), 0)
    return ids[np.repeat(keep, np.diff(first))], np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])


def _spells(voc: Vocabulary, ids: np.ndarray, first: np.ndarray, texts: list[bytes]) -> np.ndarray:
    data, edges = P.ragged(voc.data, voc.edges, ids)
    raw, e = data.tobytes(), edges[first].tolist()
    return np.array([raw[x:y] == t for x, y, t in zip(e[:-1], e[1:], texts)], bool)


def links_of(texts: list[bytes], va: Vocabulary, vb: Vocabulary) -> Links:
    """Links of texts that begin with a blank each."""
    (a, a_first), (b, b_first) = va.encode(texts), vb.encode(texts)
    a = a.astype(np.int64)
    spelled = _spells(va, a, a_first, texts) & _spells(vb, b, b_first, texts)
    if not spelled.all():
        (a, a_first), (b, b_first) = _kept(a, a_first, spelled), _kept(b, b_first, spelled)
    by_a = token_bytes(np.diff(va.edges)[a])
    by_b = token_bytes(np.diff(vb.edges)[b])
    a_ends, b_ends = by_a.indptr[1:], by_b.indptr[1:]
    group_ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    in_a, in_b = token_groups(a_ends, group_ends), token_groups(b_ends, group_ends)
    text_ends = np.concatenate([np.zeros(1, np.int64), a_ends])[a_first]
    return Links(spelled, a, a_first, b, b_first, product(by_a, transpose(by_b)), product(in_a, transpose(in_b)),
                 in_a.indices, in_b.indices, np.searchsorted(group_ends, text_ends, "right"))


def group_texts(x: Links) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text."""
    numbers = np.arange(int(x.g_first[-1]) + 1)
    a_at, b_at = np.searchsorted(x.a_group, numbers).tolist(), np.searchsorted(x.b_group, numbers).tolist()
    a, b = list(map(str, x.a.tolist())), list(map(str, x.b.tolist()))
    groups = [f"{a[i]}|{b[k]}" if j == i + 1 and m == k + 1 else f"{','.join(a[i:j])}|{','.join(b[k:m])}"
              for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:])]
    first = x.g_first.tolist()
    return [";".join(groups[i:j]).encode() for i, j in zip(first[:-1], first[1:])]


class Known:
    """Links of the distinct pieces of a task: numbers of tokens, groups and links, id pairs, groups as text."""

    def __init__(self, va: Vocabulary, vb: Vocabulary, limit: int = KNOWN):
        self.va, self.vb = va, vb
        self.pieces = P.Pieces(self._learn, self._forget, limit)
        self._forget()

    def _forget(self) -> None:
        self.counts = np.zeros((0, 4), np.int64)    # tokens of A, of B, groups, links
        self.spelled = np.zeros(0, bool)
        self.pairs, self.edges = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.texts: list[bytes] = []

    def _learn(self, new: list[bytes]) -> None:
        made = [(self.counts, self.spelled, self.pairs, self.edges)]
        end = self.edges[-1]
        for k in range(0, len(new), LEARNT):    # the products of some pieces at a time
            x = links_of(new[k:k + LEARNT], self.va, self.vb)
            edges = x.overlap.indptr[x.a_first]
            made.append((np.stack([np.diff(x.a_first), np.diff(x.b_first), np.diff(x.g_first), np.diff(edges)], 1), x.spelled,
                         x.a[x.overlap.rows()] * self.vb.size + x.b[x.overlap.indices], edges[1:] + end))
            end = made[-1][3][-1]
            self.texts += group_texts(x)
        self.counts, self.spelled, self.pairs, self.edges = (np.concatenate(column) for column in zip(*made))


@lru_cache(maxsize=2)
def known_pieces(a: str, b: str) -> Known:
    """One for all tasks of a worker, so a task starts with the pieces of those before it."""
    return Known(vocabulary_a(a), vocabulary_b(b))


class Docs(NamedTuple):
    """What some documents hold: four counts, groups, and distinct id pairs with how often each is linked."""

    counts: np.ndarray
    groups: list[str]
    first: np.ndarray
    pairs: np.ndarray
    often: np.ndarray


def documents(known: Known, data: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[Docs, np.ndarray]:
    """The documents of a chunk cut at `starts`, and marks of those with a piece that is not spelled."""
    n = len(bounds) - 1
    numbers = known.pieces.of(data, starts) if len(starts) else np.zeros(0, np.int64)
    first = np.searchsorted(starts, bounds)
    doc = np.repeat(np.arange(n), np.diff(first))
    odd = np.zeros(n, bool)
    odd[doc[~known.spelled[numbers]]] = True
    counts = np.zeros((n, 4), np.int64)
    np.add.at(counts, doc, known.counts[numbers])
    groups, at = [], first.tolist()
    for k in range(n):
        own = numbers[at[k]:at[k + 1]].tolist()
        groups.append(hashlib.sha256(b";".join([known.texts[i] for i in own])).hexdigest() if own else "")
    held, times = np.unique(doc * max(1, len(known.spelled)) + numbers, return_counts=True)
    doc, piece = held // max(1, len(known.spelled)), held % max(1, len(known.spelled))
    pairs, edges = P.ragged(known.pairs, known.edges, piece)
    span = known.va.size * known.vb.size
    keys = np.repeat(doc, np.diff(edges)) * span + pairs
    order = np.argsort(keys)
    keys, times = keys[order], np.repeat(times, np.diff(edges))[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    often = np.add.reduceat(times, new) if len(new) else times
    return Docs(counts, groups, np.searchsorted(keys[new] // span, np.arange(n + 1)), keys[new] % span, often), odd


def _led(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text that is not empty with a blank before it."""
    own = bounds[1:] > bounds[:-1]
    return (np.insert(data, bounds[:-1][own], np.uint8(0x20)),
            bounds + np.concatenate([np.zeros(1, np.int64), np.cumsum(own)]))


def _chunk(known: Known, data: np.ndarray, bounds: np.ndarray, whole: bool) -> Docs:
    data, bounds = _led(data, bounds)
    edges = bounds[:-1][bounds[1:] > bounds[:-1]]
    out, odd = documents(known, data, bounds, edges if whole else P.cuts(data, bounds))
    if not odd.any():
        return out
    # texts with an odd piece are taken whole; what is odd then has no tokens
    groups, counts = list(out.groups), out.counts.copy()
    keep = np.repeat(~odd, np.diff(out.first))
    pairs, often, sizes = out.pairs[keep], out.often[keep], np.where(odd, 0, np.diff(out.first))
    lists = np.split(pairs, np.cumsum(sizes)[:-1]), np.split(often, np.cumsum(sizes)[:-1])
    for d in np.flatnonzero(odd).tolist():
        own = Known(known.va, known.vb)
        one, bad = documents(own, data[bounds[d]:bounds[d + 1]], bounds[d:d + 2] - bounds[d], np.zeros(1, np.int64))
        counts[d], groups[d] = (0, "") if bad[0] else (one.counts[0], one.groups[0])
        lists[0][d], lists[1][d] = (one.pairs[:0], one.often[:0]) if bad[0] else (one.pairs, one.often)
    return Docs(counts, groups, np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in lists[0]])]),
                np.concatenate(lists[0]), np.concatenate(lists[1]))


# ---- tables ----

_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())),
    *[(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")],
    ("groups", pa.list_(pa.string())), ("first", pa.list_(pa.int32())), ("held", pa.list_(pa.int32())),
    ("often", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())),
    ("n_pairs", pa.int64())])


def _block(number: int, names: list[pa.Array], docs: list[Docs]) -> pa.RecordBatch:
    """One row: documents, their id pairs by place among the block's distinct pairs, and in how many documents each is."""
    sizes = np.concatenate([np.diff(d.first) for d in docs])
    pairs, held, n = np.unique(np.concatenate([d.pairs for d in docs]), return_inverse=True, return_counts=True)
    counts = np.concatenate([d.counts for d in docs])
    columns = [pa.concat_arrays(names), *[pa.array(counts[:, k]) for k in range(4)],
               pa.array([g for d in docs for g in d.groups], pa.string()),
               pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]).astype(np.int32)),
               pa.array(held.astype(np.int32)), pa.array(np.concatenate([d.often for d in docs]).astype(np.int32)),
               pa.array(pairs), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns],
         pa.array([len(pairs)], pa.int64())], schema=_BLOCK)


def _blocks(docs: DataFrame, a: str, b: str, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_pieces(a, b)
        whole = not (known.va.at_blanks and known.vb.at_blanks)
        number, names, made, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, j, data, bounds in P.chunks_of(batch.column("text")):
                names.append(batch.column("doc_id")[i:j])
                made.append(_chunk(known, data, bounds, whole))
                size += len(data)
                if size >= block_bytes or sum(map(len, names)) >= BLOCK_ROWS:
                    yield _block(number, names, made)
                    number, names, made, size = number + 1, [], [], 0
        if made:
            yield _block(number, names, made)

    return docs.mapInArrow(
        run, "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
             "groups array<string>, first array<int>, held array<int>, often array<int>, pairs array<long>, docs array<int>, n_pairs long")


def _by_bucket(pairs: np.ndarray, size_b: int, buckets: int) -> tuple[np.ndarray, list[int], list[slice]]:
    """Some pairs' order by bucket of their id of A, the buckets that have some of them, and where those are in that order."""
    bucket = (W.mix((pairs // size_b).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    full, first = np.unique(bucket[order], return_index=True)
    cut = [*first.tolist(), len(pairs)]
    return order, full.tolist(), [slice(i, j) for i, j in zip(cut, cut[1:])]


def pair_values(blocks: DataFrame, size_b: int, buckets: int) -> DataFrame:
    """(block, bucket, told): for each of a block's pairs in a bucket, packed, twice the number of documents that hold the
    pair linked, and one more if no pair of its id of A has more."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                pairs, docs = (batch.column(c)[r].values.to_numpy() for c in ("pairs", "docs"))
                order, full, where = _by_bucket(pairs, size_b, buckets)
                pairs, docs = pairs[order], docs[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([batch.column("block")[r].as_py()] * len(full), pa.int64()),
                     pa.array([W.packed(np.diff(pairs[at], prepend=0)) for at in where], pa.binary()),
                     pa.array([W.packed(docs[at]) for at in where], pa.binary())], names=["bucket", "block", "pairs", "docs"])

    def count(rows: pa.Table) -> pa.Table:
        own = [np.cumsum(W.unpacked(x.as_buffer(), np.int64)) for x in rows["pairs"]]
        docs = np.concatenate([W.unpacked(x.as_buffer(), np.int32) for x in rows["docs"]])
        pairs, at = np.unique(np.concatenate(own), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, docs)
        a = pairs // size_b
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(a))))
        value, cut = (2 * counts + (counts == most))[at], np.cumsum([0, *map(len, own)]).tolist()
        return pa.table({"block": rows["block"], "bucket": rows["bucket"],
                         "told": pa.array([W.packed(value[i:j]) for i, j in zip(cut, cut[1:])], pa.binary())})

    dealt = blocks.select("block", "pairs", "docs").mapInArrow(deal, "bucket long, block long, pairs binary, docs binary")
    return dealt.groupBy("bucket").applyInArrow(count, "block long, bucket long, told binary")


def alignment(docs: DataFrame, *, a: str = VOCABULARY_A, b: str = VOCABULARY_B,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`."""
    spark, size_b = docs.sparkSession, vocabulary_b(b).size
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with small_batches(spark, BATCH_BYTES):     # a block is a row of some MB
        blocks = materialize(_blocks(docs, a, b, block_bytes), "blocks", **WIDE_ROWS)
    buckets = (blocks.agg(F.sum("n_pairs")).first()[0] or 0) // COUNTED + 1
    told = pair_values(blocks, size_b, buckets).groupBy("block").agg(F.collect_list(F.struct("bucket", "told")).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                own = lambda c: batch.column(c)[r].values  # noqa: E731, B023
                first, often, held = (own(c).to_numpy().astype(np.int64) for c in ("first", "often", "held"))
                if batch.column("told")[r].is_valid:
                    order, _, _ = _by_bucket(own("pairs").to_numpy(), size_b, buckets)
                    parts = sorted(zip(own("told").field(0).to_pylist(), own("told").field(1)), key=lambda x: x[0])
                    value = np.zeros(len(order), np.int64)
                    value[order] = np.concatenate([W.unpacked(x.as_buffer(), np.int64) for _, x in parts])
                    value = value[held]
                else:
                    value = held
                sums = [np.concatenate([np.zeros(1, np.int64), np.cumsum(x)]) for x in (often * (value & 1), often * (value >> 1))]
                yield pa.RecordBatch.from_arrays(
                    [*[own(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")],
                     *[pa.array(np.diff(x[first])) for x in sums], own("groups")],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = blocks.drop("docs", "n_pairs").join(told, "block", "left").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    with small_batches(spark, BATCH_BYTES):
        out = materialize(out, "aligned")
    drop(spark, blocks)
    return out


def token_links(docs: DataFrame, *, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """(doc_id, a_ids, b_ids, overlap, shared) of every row: links are (place of the token of A, of B, shared bytes or group)."""
    link = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())])
    shared = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("group", pa.int64())])

    def lists(values: pa.Array, edges: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)

    def triples(x: Links, m: Csr, third: np.ndarray, kind: pa.StructType) -> pa.Array:
        edges = m.indptr[x.a_first]
        text = np.repeat(np.arange(len(x.spelled)), np.diff(edges))
        return lists(pa.StructArray.from_arrays(
            [pa.array(m.rows() - x.a_first[text]), pa.array(m.indices - x.b_first[text]), pa.array(third)],
            fields=list(kind)), edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabulary_a(a), vocabulary_b(b)
        for batch in batches:
            for i, j, data, bounds in P.chunks_of(batch.column("text")):
                data, bounds = _led(data, bounds)
                raw, e = data.tobytes(), bounds.tolist()
                x = links_of([raw[p:q] for p, q in zip(e[:-1], e[1:])], va, vb)
                text = np.repeat(np.arange(j - i), np.diff(x.shared.indptr[x.a_first]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], lists(pa.array(x.a), x.a_first), lists(pa.array(x.b), x.b_first),
                     triples(x, x.overlap, x.overlap.values, link),
                     triples(x, x.shared, x.a_group[x.shared.rows()] - x.g_first[text], shared)],
                    names=["doc_id", "a_ids", "b_ids", "overlap", "shared"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, a_ids array<long>, b_ids array<long>, "
                                "overlap array<struct<a: long, b: long, bytes: long>>, "
                                "shared array<struct<a: long, b: long, group: long>>")


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between the byte-level and the piece vocabulary."""
    return alignment(table(spark, sf_dir, "documents"))
