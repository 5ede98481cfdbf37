"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of the whole text (A-Z lower-cased, white space as a blank),
hashed into ``1 << BITS`` buckets. With smoothed counts p (toxic) and q (other) of each bucket,
r = log(p / |p|) - log(q / |q|); a document's value in a bucket is its count there divided by the
root of its number of n-grams, times r. A logistic regression is fitted on these values.

The fit uses a bounded sample, ``SAMPLE_ROWS`` labelled rows of ``SAMPLE_BYTES`` bytes at most (chosen by hash, about
that many; all if there are fewer; one row for each doc_id and text), never rows whose CRC-32 of doc_id falls in
the held-out fold. The sampled ids are broadcast (the parameter bounds them); their n-grams are counted where
the rows are, and the counts meet in one task.
Scoring covers every whole text, one pass without a shuffle; the broadcast weights have a fixed
size.

Defined results: an empty or null text has no n-grams and gets the score of the intercept; a null
label is no label; a document with several labels counts as toxic if one says so; without labels
of both classes the score is the smoothed share of toxic labels; a null doc_id counts as empty
text in the fold and cannot be labelled; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comparo.llm import words as W
from comparo.llm.tables import BATCH_BYTES, materialize, table
from comparo.session import small_batches

SAMPLE_ROWS = 8_000   # labelled rows of the fit
SAMPLE_BYTES = 64 << 20   # bytes of their texts; longer texts are scored, but not learned from
ORDERS = (5,)         # lengths of the n-grams
BITS = 19             # hashed buckets: 1 << BITS
STEPS = 100           # steps of the fit
RATE, PENALTY = 1.0, 1e-5
STRETCH = 500_000     # entries that a step of the fit works on at once
FOLDS = 5


def grams(data: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...], bits: int) -> list[tuple]:
    """For each order (bucket of the n-gram at each character, bounds of the documents)."""
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    chars[(chars >= 0x41) & (chars <= 0x5A)] += np.uint32(32)
    chars[(chars >= 9) & (chars <= 13)] = 32
    out, hashed = [], chars
    for n in range(1, max(orders) + 1):
        if n > 1:
            hashed = hashed[:-1] * np.uint32(0x01000193) + chars[n - 1:]
        if n in orders:
            x = hashed ^ np.uint32((n * 0x9E3779B9) & 0xFFFFFFFF)
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            out.append(((x >> np.uint32(32 - bits)).astype(np.int32), at[:-1], np.maximum(at[1:] - n + 1, at[:-1])))
    return out


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, one each where all are below 256."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32).tobytes()


def unpacked_counts(packed, n: int) -> np.ndarray:
    """The n counts of :func:`packed_counts`."""
    return np.frombuffer(packed, np.uint8 if len(packed) == n else np.int32)


def counted(sample: DataFrame, orders: tuple[int, ...], bits: int) -> DataFrame:
    """(doc_id, h, toxic, columns, counts, total) of the sampled rows: their n-gram buckets and counts, packed."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, bounds = W.text_column(batch.column("text"))
            for i, j in W.chunks(bounds):
                parts = grams(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], orders, bits)
                made = [np.unique(np.concatenate([h[first[d]:last[d]] for h, first, last in parts]), return_counts=True)
                        for d in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[i:j] for c in ("doc_id", "h", "toxic")],
                     pa.array([own.astype(np.int32).tobytes() for own, _ in made], pa.binary()),
                     pa.array([packed_counts(n) for _, n in made], pa.binary()),
                     pa.array([int(n.sum()) for _, n in made], pa.int64())],
                    names=["doc_id", "h", "toxic", "columns", "counts", "total"])

    return sample.select("doc_id", "h", "toxic", "text").mapInArrow(
        run, "doc_id long, h long, toxic int, columns binary, counts binary, total long")


def fit(columns: list[np.ndarray], counts: list[np.ndarray], total: np.ndarray, toxic: np.ndarray, bits: int) -> np.ndarray:
    """Weight of each bucket (log-count ratio included), then the intercept; `columns` and `counts` are the buckets
    of each document, `total` its number of n-grams. The two lists are emptied, so that what they held can go."""
    size = 1 << bits
    prior = (toxic.sum() + 1) / (len(toxic) + 2)
    weights = np.zeros(size + 1)
    weights[size] = np.log(prior / (1 - prior))
    if toxic.all() or not toxic.any():
        return weights
    # entries of the documents one after the other, worked on in stretches of documents
    length = np.array([len(c) for c in columns])
    begin = np.concatenate([[0], np.cumsum(length)])
    parts, columns = columns, np.concatenate(columns)
    parts.clear()
    value = np.concatenate(counts, dtype=np.float32, casting="unsafe")
    counts.clear()
    stretches = [(i, j, slice(begin[i], begin[j])) for i, j in W.chunks(begin, STRETCH)]
    p, q = np.ones(size), np.ones(size)
    for i, j, own in stretches:
        of = np.repeat(toxic[i:j], length[i:j])
        p += np.bincount(columns[own][of], value[own][of], size)
        q += np.bincount(columns[own][~of], value[own][~of], size)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    squares = 0.0
    for i, j, own in stretches:
        root = np.repeat(1 / np.sqrt(np.maximum(total[i:j], 1)), length[i:j])
        value[own] *= (ratio[columns[own]] * root).astype(np.float32)
        squares += float(np.dot(value[own], value[own]))
    scale = 1 / np.sqrt(max(squares / len(toxic), 1e-12))
    value *= np.float32(scale)
    # Adam on the penalised logistic loss of the whole sample
    w, bias = np.zeros(size), weights[size]
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        slope, miss = PENALTY * w, 0.0
        for i, j, own in stretches:
            z = np.bincount(np.repeat(np.arange(j - i), length[i:j]), value[own] * w[columns[own]], j - i) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - toxic[i:j]
            slope += np.bincount(columns[own], value[own] * np.repeat(error, length[i:j]), size) / len(toxic)
            miss += error.sum()
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope * slope
        rate = RATE * (1 - step / (STEPS + 1))
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        bias -= rate * miss / len(toxic)
    weights[:size] = w * ratio * scale
    weights[size] = bias
    return weights


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32(doc_id as text) mod 5 = 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _share(rows: DataFrame, key: str, part: float) -> DataFrame:
    """The rows whose hash lies in the first `part` of its range, so that the choice is the same each time."""
    return rows if part >= 1 else rows.where(F.xxhash64(key) < int(-(1 << 63) + (1 << 64) * part))


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
          orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Weights fitted on a bounded sample of the labelled documents outside the held-out fold."""
    known = (labels.select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
             .where("labelled is not null and toxic is not null").where(~held_out(F.col("labelled")))
             .groupBy("labelled").agg(F.max("toxic").alias("toxic")))
    n = known.count()
    known = _share(known, "labelled", sample_rows / max(1, n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(known), F.col("doc_id") == F.col("labelled")).withColumn("h", F.xxhash64("text"))
    # a labelled id that comes in many rows gives each of its texts once
    sample = materialize(texts.dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "toxic", "text"), "sample")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    sample = sample.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes).withColumn("key", F.xxhash64("doc_id", "h"))
    part = min(sample_rows / max(1, size["n"]), sample_bytes / max(1, size["bytes"] or 0))
    entries = counted(_share(sample, "key", part), orders, bits)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        # the order of the rows alone: a sorted copy would hold all counts a second time
        order = pc.sort_indices(rows.select(["doc_id", "h"]), [("doc_id", "ascending"), ("h", "ascending")]).to_numpy()
        columns = [np.frombuffer(x.as_buffer(), np.int32) for x in rows["columns"]]
        counts = [unpacked_counts(x.as_buffer(), len(own)) for x, own in zip(rows["counts"], columns)]
        total, toxic = rows["total"].to_numpy()[order].astype(float), rows["toxic"].to_numpy()[order] == 1
        columns, counts = ([own[k] for k in order] for own in (columns, counts))
        del rows        # the lists alone hold it, and `fit` empties them
        weights = fit(columns, counts, total, toxic, bits)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    one = entries.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "weights binary")
    with small_batches(docs.sparkSession, BATCH_BYTES):     # the entries of all rows go to one task
        got = materialize(one, "weights", "none").first()
    return fit([], [], np.zeros(0), np.zeros(0, bool), bits) if got is None else np.frombuffer(
        got["weights"], np.float64)


def _probabilities(column: pa.Array, w: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    z = np.full(len(column), w[-1])
    data, bounds = W.text_column(column)
    for i, j in W.chunks(bounds):
        total, sums = np.zeros(j - i), np.zeros(j - i)
        for hashed, first, last in grams(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], orders, bits):
            full = last > first
            if full.any():
                edges = np.stack([first[full], last[full]], 1).ravel()
                sums[full] += np.add.reduceat(np.append(w[hashed], 0.0), edges)[::2]
            total[full] += last[full] - first[full]
        z[i:j] += sums / np.sqrt(np.maximum(total, 1))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, weights: np.ndarray, *, orders: tuple[int, ...] = ORDERS,
          bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row; score is the probability of the label."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_probabilities(batch.column(1), shared.value, orders, bits))],
                names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")


def without_toxic(docs: DataFrame, weights: np.ndarray, *, threshold: float = 0.5,
                  orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.filter(pa.array(_probabilities(batch.column("text"), shared.value, orders, bits) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_nb_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
