"""Substring deduplication by level-wise doubling of repeated word windows.

To find the repeated windows of `min_words` words, windows of half that length (halved again while
more than ``BASE`` words) come first; only where those are repeated in another document are windows
of twice the length looked at, until the last length gives the windows to remove. On the levels
below the last, one window stands for a whole candidate: the one with the least hash among those of
that length inside it. Equal candidates choose equal windows, so none is lost, and a level shuffles
one hash for many words.

A level is a grouped minimum and maximum of doc_id by window hash (summed before the shuffle, so a
passage that a third of the documents share is no hot task) and a join back. Documents with the same
word sequence are one class that its smallest doc_id stands for; the others lose every word that a
window covers, and take no part in the levels. Windows are compared by 64-bit hash at every level.

Defined results: a null text has no words; rows without doc_id come after all others; rows with the
same doc_id are not smaller than one another, so they do not remove each other's words; texts shorter
than a window keep everything; empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.llm import words as W
from comparo.llm.tables import drop, materialize, table, texts_of
from comparo.llm.winnow import least_positions

MIN_WORDS = 50
BASE = 25             # the first level has at most this many words
_LAST_ID = (1 << 63) - 1


def level_lengths(min_words: int, base: int = BASE) -> list[int]:
    lengths = [min_words]
    while lengths[0] > base:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def _choices(words: W.Words, length: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every candidate in a chunk: its first word, and the hash of the window that stands for it."""
    starts = W.whole_windows(words.first, min_words)
    hashed = W.windows(words.hashes(), length)
    if not len(starts):
        return starts, hashed[:0]
    return starts, hashed[least_positions(hashed, min_words - length + 1)[starts]]


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def _cut(values: np.ndarray, starts: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept values and where each document's begin."""
    return values[keep], np.searchsorted(starts[keep], first)


def _steps(words: W.Words, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Marks the first of neighbouring candidates with the same hash in the same document."""
    out = np.ones(len(starts), bool)
    out[1:] = (hashes[1:] != hashes[:-1]) | (starts[1:] != starts[:-1] + 1)
    return out


def measured(docs: DataFrame, length: int, min_words: int) -> DataFrame:
    """(doc_id, h: hash of the text, n_words, sha: of the words joined by a space, windows: hashes of the first level)."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()),
                        ("windows", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i, j, w in W.batches(batch.column(1)):
                raw, b = w.data.tobytes(), w.bounds.tolist()
                sha = [hashlib.sha256(b" ".join(raw[x:y].split())).digest() for x, y in zip(b[:-1], b[1:])]
                starts, hashes = _choices(w, length, min_words)
                values, edges = _cut(hashes, starts, w.first, _steps(w, starts, hashes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], pa.array(np.diff(w.first).astype(np.int64)), pa.array(sha, pa.binary()),
                     _lists(values.view(np.int64), edges)], schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(
        run, "doc_id long, h long, n_words long, sha binary, windows array<long>")


def _alive(batch: pa.RecordBatch, length: int, min_words: int) -> Iterator[tuple]:
    """(first row, row after the last, words, candidates whose window of `length` is repeated)."""
    repeated = batch.column("windows")
    for i, j, w in W.batches(batch.column("text")):
        starts, hashes = _choices(w, length, min_words)
        edges = np.searchsorted(starts, w.first)
        keep = np.zeros(len(starts), bool)
        for d in range(j - i):
            own = slice(edges[d], edges[d + 1])
            keep[own] = np.isin(hashes[own].view(np.int64), repeated[i + d].values.to_numpy())
        yield i, j, w, starts[keep]


def extended(alive: DataFrame, length: int, longer: int, min_words: int) -> DataFrame:
    """(did, sha, windows, places) of `longer` words where those of `length` words are repeated."""
    schema = pa.schema([("did", pa.int64()), ("sha", pa.binary()), ("windows", pa.list_(pa.int64())),
                        ("places", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i, j, w, starts in _alive(batch, length, min_words):
                all_starts, hashes = _choices(w, longer, min_words)
                hashes = hashes[np.searchsorted(all_starts, starts)]
                keep = _steps(w, starts, hashes) if longer < min_words else np.ones(len(starts), bool)
                values, edges = _cut(hashes, starts, w.first, keep)
                places = starts[keep] - np.repeat(w.first[:-1], np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did")[i:j], batch.column("sha")[i:j], _lists(values.view(np.int64), edges),
                     _lists(places, edges)], schema=schema)

    return alive.select("did", "sha", "text", "windows").mapInArrow(
        run, "did long, sha binary, windows array<long>, places array<long>")


def _repeated(rows: DataFrame) -> DataFrame:
    """(window, lowest doc) of the windows that are in documents with different ids."""
    return rows.groupBy("window").agg(F.min("did").alias("lowest"), F.max("did").alias("highest")).where(
        "lowest < highest").select("window", "lowest")


def _survivors(rows: DataFrame, *more: str) -> DataFrame:
    """(did, sha, windows) with the repeated windows of each document, and its columns `more`."""
    return rows.join(_repeated(rows).select("window"), "window").groupBy("did", "sha", *more).agg(
        F.collect_set("window").alias("windows"))


def remove_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, base: int = BASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; `kept` is the text that is left
    where words were removed from some but not all of it, null elsewhere."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lengths = level_lengths(min_words, base)
    did = F.coalesce(F.col("doc_id"), F.lit(_LAST_ID))
    whole = materialize(measured(docs, lengths[0], min_words).withColumn("did", did), "whole")
    classes = materialize(whole.where(F.col("n_words") >= min_words).groupBy("sha").agg(
        F.min(F.struct("did", "h")).alias("least")).selectExpr("sha", "least.did as first", "least.h as h"), "classes")
    stand = whole.join(classes.select("sha", F.col("first").alias("did"), "h"), ["sha", "did", "h"])
    rows = stand.dropDuplicates(["sha", "did"]).select("did", "sha", "h", F.explode("windows").alias("window"))
    kept = materialize(_survivors(rows, "h"), "level")
    alive = materialize(_same(texts_of(docs.withColumn("did", did), kept)), "alive")
    for length, longer in zip(lengths[:-1], lengths[1:]):
        found = extended(alive, length, longer, min_words)
        if longer < min_words:
            rows = found.select("did", "sha", F.explode("windows").alias("window")).distinct()
            before, alive = alive, materialize(alive.drop("windows").join(_survivors(rows), ["did", "sha"]), "alive")
            drop(spark, before)
    if len(lengths) == 1:   # a single level: its windows are the candidates
        found = extended(alive, min_words, min_words, min_words)
    rows = materialize(found.select("did", "sha", F.explode(F.arrays_zip("windows", "places")).alias("x")).select(
        "did", "sha", F.col("x.windows").alias("window"), F.col("x.places").cast("int").alias("place")), "windows")
    again = rows.join(_repeated(rows), "window").where("lowest < did").groupBy("did", "sha").agg(
        F.collect_set("place").alias("places"))
    cut = materialize(_removed(alive.select("did", "sha", "text").join(again, ["did", "sha"]), min_words), "cut")
    drop(spark, rows)
    out = (whole.select("doc_id", "did", "sha", "n_words")
           .join(classes.drop("h"), "sha", "left").join(cut.dropDuplicates(["did", "sha"]), ["did", "sha"], "left"))
    copy = F.col("first") < F.col("did")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))


def _same(rows: DataFrame) -> DataFrame:
    """Rows whose text has the word sequence `sha`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, sha = batch.column("text"), batch.column("sha").to_pylist()
            same = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split())).digest() == s
                    for t, s in zip(text, sha)]
            yield batch.filter(pa.array(same, pa.bool_()))
    rows = rows.select("did", "sha", "text", "windows")
    return rows.mapInArrow(run, rows.schema)


def _removed(rows: DataFrame, min_words: int) -> DataFrame:
    """(did, sha, n_removed, kept_sha256, kept) without the words of the windows at `places`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, kept = [], [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                own = text.as_buffer().to_pybytes().split()
                marks = np.zeros(len(own) + 1, np.int64)
                places = places.values.to_numpy()
                marks[places] += 1
                np.subtract.at(marks, places + min_words, 1)
                gone = np.cumsum(marks)[:-1] > 0
                left = b" ".join([own[k] for k in np.flatnonzero(~gone)])
                n.append(int(gone.sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("sha"), pa.array(n, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(kept, pa.string())], names=["did", "sha", "n_removed", "kept_sha256", "kept"])
    return rows.mapInArrow(run, "did long, sha binary, n_removed long, kept_sha256 string, kept string")


def op4_doubling_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the 50-word windows that a document with a smaller id holds too."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
