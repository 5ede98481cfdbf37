"""Benchmark decontamination by Wu-Manber search for many word windows at once.

A pattern is a window of `n` consecutive words of a benchmark item (a shorter item is one
pattern). Patterns of one length are searched together. A block is two neighbouring words (one,
for patterns of a word). The shift table says for a block how far the search may move on without
passing the end of a pattern; a block that no pattern holds skips all but one word of a pattern.
Where the shift is 0, the suffix-hash bucket of the block names the patterns that end with it, and
their words are compared with the document's, first as hashes of whole words, then byte by byte.
Many cursors, each with a stretch of end positions of its own, move through a chunk of documents
side by side, one array operation for all.

The documents are read once, in place, without a shuffle. The search tables are built from blocks
of at most `PATTERNS_PER_PASS` patterns and broadcast, so that a broadcast has a bounded size
however large the benchmark is; further blocks take further passes, which pass on the words
already hit as a bit set.

Defined results: a null or empty text has no words and is clean; an item without words is no
pattern; an item whose id is null contaminates but is not named or counted; repeated items and
items with equal windows are all named; repeated document rows each give a row; an empty
benchmark leaves everything clean; other columns pass by unread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.llm import words as W
from comparo.llm.tables import materialize, table

PATTERNS_PER_PASS = 200_000
SHIFT_BITS = 18
CURSOR_WORDS = 256
_TABLE = np.uint64(64 - SHIFT_BITS)


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block that ends at each word (the first words of a chunk have none)."""
    if size == 1 or len(hashes) < 2:
        return W.mix(hashes.copy())
    return np.concatenate([np.zeros(1, np.uint64), W.windows(hashes, size)])


class Patterns:
    """Shift table and suffix buckets of patterns with one number of words."""

    def __init__(self, length: int, patterns: dict[bytes, list[int]]):
        self.length, self.size = length, min(2, length)
        self.texts = sorted(patterns)
        self.items = [patterns[t] for t in self.texts]
        data, bounds = W.text_column(pa.array(self.texts, pa.large_binary()))
        words = W.split(data, bounds, W.ALPHANUMERIC)
        self.words = words.hashes().reshape(len(self.texts), length)
        self.shift = np.full(1 << SHIFT_BITS, length - self.size + 1, np.int64)
        blocks = _blocks(self.words.ravel(), self.size).reshape(self.words.shape)
        for at in range(self.size - 1, length):
            np.minimum.at(self.shift, (blocks[:, at] >> _TABLE).astype(np.int64), length - 1 - at)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.bucket, self.in_bucket = blocks[order, -1], order

    def occurrences(self, words: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of every occurrence in a chunk of documents."""
        blocks = _blocks(hashes, self.size)
        counts = np.diff(words.first)
        docs = np.flatnonzero(counts >= self.length)
        begin, stop = words.first[:-1][docs] + self.length - 1, words.first[1:][docs]
        pieces = -(-(stop - begin) // CURSOR_WORDS)
        number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(begin, pieces) + number * CURSOR_WORDS
        stop = np.minimum(at + CURSOR_WORDS, np.repeat(stop, pieces))
        ends = []
        while len(at):
            shift = self.shift[(blocks[at] >> _TABLE).astype(np.int64)]
            ends.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        at = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        low = np.searchsorted(self.bucket, blocks[at], "left")
        n = np.searchsorted(self.bucket, blocks[at], "right") - low
        at = np.repeat(at, n)
        tested = self.in_bucket[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        for back in range(self.length):  # the words from the last to the first
            same = hashes[at - back] == self.words[tested, self.length - 1 - back]
            at, tested = at[same], tested[same]
        raw = words.data.tobytes() if len(at) else b""
        sure = [b" ".join(raw[words.start[k]:words.end[k]] for k in range(e - self.length + 1, e + 1))
                == self.texts[t] for e, t in zip(at.tolist(), tested.tolist())]
        sure = np.array(sure, bool)
        return at[sure], tested[sure]


def windows_of(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, words: array<binary as text>) windows of every item, repeats included."""
    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            items, texts = [], []
            ids = batch.column(0).to_pylist()
            for i, j, w in W.batches(batch.column(1), W.ALPHANUMERIC, lower=True):
                raw = w.data.tobytes()
                for d in range(j - i):
                    own = [raw[w.start[k]:w.end[k]] for k in range(w.first[d], w.first[d + 1])]
                    for k in range(max(1, len(own) - n + 1) if own else 0):
                        items.append(ids[i + d])
                        texts.append(b" ".join(own[k:k + n]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(texts, pa.binary())],
                                             names=["item_id", "window"])
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "item_id long, window binary")


def _tables(rows: list) -> list[Patterns]:
    by_length: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    for r in rows:
        ids = by_length[bytes(r["window"]).count(b" ") + 1][bytes(r["window"])]
        if r["item_id"] is not None and r["item_id"] not in ids:
            ids.append(r["item_id"])
    return [Patterns(k, dict(v)) for k, v in sorted(by_length.items())]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
                     ("hit", pa.binary()), ("items", pa.list_(pa.int64()))])
_DDL = "doc_id long, text string, n_words long, hit binary, items array<long>"


def _pass(docs: DataFrame, tables, keep_text: bool) -> DataFrame:
    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tables.value
        for batch in rows:
            n = batch.num_rows
            n_words, hit = np.zeros(n, np.int64), [None] * n
            items = batch.column("items").to_pylist()
            earlier = batch.column("hit").to_pylist()
            for i, j, w in W.batches(batch.column("text"), W.ALPHANUMERIC, lower=True):
                hashes = w.hashes()
                marks = np.zeros(len(hashes) + 1, np.int64)
                of_doc = w.doc_of_word()
                found = defaultdict(set)
                for p in patterns:
                    last, which = p.occurrences(w, hashes)
                    np.add.at(marks, last - p.length + 1, 1)
                    np.add.at(marks, last + 1, -1)
                    for d, t in set(zip(of_doc[last].tolist(), which.tolist())):
                        found[d].update(p.items[t])
                covered = np.cumsum(marks)[:-1] > 0
                for d in range(j - i):
                    own = covered[w.first[d]:w.first[d + 1]]
                    n_words[i + d] = len(own)
                    if earlier[i + d]:
                        own = own | np.unpackbits(np.frombuffer(earlier[i + d], np.uint8),
                                                  count=len(own)).astype(bool)
                    hit[i + d] = np.packbits(own).tobytes() if own.any() else b""
                    if d in found:
                        items[i + d] = sorted(found[d] | set(items[i + d] or ()))
            text = batch.column("text") if keep_text else pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), text.cast(pa.string()), pa.array(n_words), pa.array(hit, pa.binary()),
                 pa.array(items, pa.list_(pa.int64()))], schema=_SCHEMA)
    return docs.mapInArrow(search, _DDL)


def _pattern_blocks(benchmark: DataFrame, n: int, patterns_per_pass: int) -> Iterator:
    """Search tables of the benchmark's windows, a bounded number at a time, each broadcast."""
    spark = benchmark.sparkSession
    windows = materialize(windows_of(benchmark, n).distinct(), "windows")
    blocks = max(1, -(-windows.count() // (patterns_per_pass * 3 // 4)))
    of = F.pmod(F.xxhash64("window"), F.lit(blocks))
    for b in range(blocks):
        own = windows.where(of == b).collect()       # about patterns_per_pass rows
        yield spark.sparkContext.broadcast(_tables(own)), b == blocks - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10,
                  patterns_per_pass: int = PATTERNS_PER_PASS) -> DataFrame:
    """Per document row: doc_id, n_words, hit (a bit for each word inside an occurrence, most
    significant first; empty if none), items (ids of the items with occurring windows, sorted)."""
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                      F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hit"),
                      F.array().cast("array<long>").alias("items"))
    for tables, last in _pattern_blocks(benchmark, n, patterns_per_pass):
        out = _pass(out, tables, keep_text=not last)
        if not last:
            out = materialize(out, "pass")
    return out.drop("text")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 10,
                         patterns_per_pass: int = PATTERNS_PER_PASS) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of the benchmark."""
    def cleaned(tables):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                clean = np.ones(batch.num_rows, bool)
                for i, _, w in W.batches(batch.column("text"), W.ALPHANUMERIC, lower=True):
                    hashes, of_doc = w.hashes(), w.doc_of_word()
                    for p in tables.value:
                        clean[i + of_doc[p.occurrences(w, hashes)[0]]] = False
                yield batch.filter(pa.array(clean))
        return run
    for tables, _ in _pattern_blocks(benchmark, n, patterns_per_pass):
        docs = docs.mapInArrow(cleaned(tables), docs.schema)
    return docs


def op5_wu_manber(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in 10-word windows of the benchmark."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    bits = F.expr("aggregate(sequence(1, greatest(length(hit), 1)), 0L, (n, i) -> n + coalesce("
                  "bit_count(conv(hex(substring(hit, i, 1)), 16, 10)::int), 0))")
    return found.select("doc_id", "n_words", bits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
                        (F.length("hit") > 0).alias("contaminated"))
