"""Stupid-backoff scores of documents under an n-gram model of the whole corpus.

S(w | context) is count(context w) / count(context) if the n-gram comes `min_count` times or more,
else 0.4 times S(w | the context without its first word); for a single word count(w) / words. At the
start of a document contexts are as long as there are words. A document's score is the sum of
log10 S over its words, in millionths, each term rounded, so that sums do not depend on their order.

The relational plan is: n-grams of all orders by document block, each with its count there; summed
by hash into count tables; joined back to the blocks; terms summed for each document. Rows are packed:
a block (some MB of texts, written once, so that it stays the same when a task runs again) sends the
distinct hashes of its n-grams to hash-range buckets as arrays of differences, a bucket adds the
blocks' counts up and returns the totals in the order of the hashes, and the block, met with its
totals, reads each n-gram's count from them. The number of buckets follows the corpus. A block sends an
n-gram once however often it comes, so a frequent one weighs no more in its bucket than a rare one.

N-grams are told apart by 56 bits of a hash. Defined results: words are `[^\\x20\\x09-\\x0D]+`,
unchanged; n-grams do not cross documents; a null or empty text has no words, score 0 and no mean; a
word that the corpus does not hold counts as one that it holds once; repeated rows count and are
scored as often as they come; empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.llm import words as W
from comparo.llm.tables import drop, materialize, table

ORDER = 3
MIN_COUNT = 1          # n-grams of two words and more that come less often are backed off from
BACKOFF = 0.4
BLOCK_BYTES = 6 << 20  # text of a block
BUCKET_HASHES = 2_000_000  # hashes that one bucket adds up, about
_BITS = 56


def blocks_of(docs: DataFrame, counted: bool, scored: bool) -> DataFrame:
    """(block, n_words, counted, scored, payload) of whole documents, packed."""
    schema = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("counted", pa.bool_()),
                        ("scored", pa.bool_()), ("payload", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) + (int(counted) << 61) + (int(scored) << 60)
        for batch in rows:
            data, bounds = W.text_column(batch.column(1))
            for i, j in W.chunks(bounds, BLOCK_BYTES):
                part = data[bounds[i]:bounds[j]]
                words = sum(len(w.start) for _, _, w in W.batches(batch.column(1)[i:j]))
                ids = batch.column(0)[i:j]
                payload = pack(ids, part, bounds[i:j + 1] - bounds[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([words], pa.int64()), pa.array([counted]),
                     pa.array([scored]), pa.array([payload], pa.binary())], schema=schema)
                number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "block long, n_words long, counted boolean, scored boolean, payload binary")


def pack(ids: pa.Array, data: np.ndarray, bounds: np.ndarray) -> bytes:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    head = np.array([len(ids)], np.int64).tobytes()
    return zlib.compress(head + known.tobytes() + ids.fill_null(0).to_numpy().tobytes()
                         + bounds.astype(np.int64).tobytes() + data.tobytes(), 6)


def unpack(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    raw = zlib.decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    known = np.frombuffer(raw, bool, n, 8)
    ids = np.frombuffer(raw, np.int64, n, 8 + n)
    bounds = np.frombuffer(raw, np.int64, n + 1, 8 + 9 * n)
    return [i if k else None for i, k in zip(ids.tolist(), known)], np.frombuffer(raw, np.uint8, -1, 16 + 17 * n), bounds


def ngrams(words: W.Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of words n (last word, hash) of every n-gram of a block."""
    hashes = words.hashes()
    out = []
    for n in range(1, order + 1):
        starts = W.whole_windows(words.first, n)
        if n > 1 and len(starts):
            own = W.windows(hashes, n)[starts]
        else:
            own = hashes[starts]
        out.append((starts + n - 1, W.mix(own + np.uint64(n)) >> np.uint64(64 - _BITS)))
    return out


def planes(values: np.ndarray, even: bool = False) -> bytes:
    """Unsigned integers byte plane by byte plane, empty upper planes left out. Of evenly spread values only
    the highest plane is worth compressing, of counts all are."""
    n = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    grid = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T
    raw = n - 1 if even else 0
    return bytes([n, raw]) + len(values).to_bytes(4, "big") + grid[:raw].tobytes() + zlib.compress(grid[raw:].tobytes(), 1)


def from_planes(data: bytes) -> np.ndarray:
    n, raw, size = data[0], data[1], int.from_bytes(data[2:6], "big")
    lower = 6 + size * raw
    out = np.zeros((size, 8), np.uint8)
    out[:, :raw] = np.frombuffer(data, np.uint8, size * raw, 6).reshape(raw, size).T
    out[:, raw:n] = np.frombuffer(zlib.decompress(data[lower:]), np.uint8).reshape(n - raw, size).T
    return out.reshape(-1).view("<u8")


def _borders(buckets: int) -> np.ndarray:
    return np.array([(b << _BITS) // buckets for b in range(buckets)], np.uint64)


def _words(payload: bytes) -> tuple[list, W.Words]:
    ids, data, bounds = unpack(payload)
    return ids, W.split(data, bounds)


def sent(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, block, hashes, counts): the distinct n-grams of each block."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = _borders(buckets)
        for batch in rows:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):    # one block at a time
                _, words = _words(r["payload"])
                hashes = np.sort(np.concatenate([h for _, h in ngrams(words, order)]))
                if not len(hashes):
                    continue
                begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                counts = np.diff(begin, append=len(hashes)).astype(np.uint64) * np.uint64(r["counted"])
                hashes = hashes[begin]
                cut = np.append(np.searchsorted(hashes, borders), len(hashes))
                full = np.flatnonzero(np.diff(cut)).tolist()
                packed = [planes(np.diff(hashes[cut[b]:cut[b + 1]], prepend=borders[b]), even=True) for b in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([r["block"]] * len(full), pa.int64()), pa.array(packed, pa.binary()),
                     pa.array([planes(counts[cut[b]:cut[b + 1]]) for b in full], pa.binary())],
                    names=["bucket", "block", "hashes", "counts"])
    return blocks.select("block", "counted", "payload").mapInArrow(
        run, "bucket int, block long, hashes binary, counts binary")


def totals(packed: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, payload): for the hashes that a block sent, in order, their counts in the corpus."""
    def run(rows: pa.Table) -> pa.Table:
        border = _borders(buckets)[rows["bucket"][0].as_py()]
        hashes = [np.cumsum(from_planes(x.as_py()), dtype=np.uint64) + border for x in rows["hashes"]]
        ends = np.cumsum([len(h) for h in hashes])
        hashes = np.concatenate(hashes)
        counts = np.concatenate([from_planes(x.as_py()) for x in rows["counts"]])
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        total = np.empty(len(hashes), np.uint64)
        total[order] = sums[np.cumsum(new) - 1]
        return pa.table({"block": rows["block"], "bucket": rows["bucket"],
                         "payload": pa.array([planes(t) for t in np.split(total, ends[:-1])], pa.binary())})
    return packed.groupBy("bucket").applyInArrow(run, "block long, bucket int, payload binary")


def _terms(words: W.Words, order: int, counts: np.ndarray, grams: list, corpus_words: int, min_count: int,
           backoff: float) -> np.ndarray:
    """Millionths of log10 S of each word."""
    n = len(words.start)
    by_order, at = [], 0
    for last, hashes in grams:
        own = np.zeros(n)
        own[last] = counts[at:at + len(hashes)]
        by_order.append(own)
        at += len(hashes)
    value = np.maximum(by_order[0], 1) / max(1, corpus_words)
    place = np.arange(n) - np.repeat(words.first[:-1], np.diff(words.first))
    for k in range(1, order):
        kept = by_order[k] >= min_count
        context = np.append(0.0, by_order[k - 1][:-1])
        ratio = by_order[k] / np.maximum(context, 1)
        value = np.where(place < k, value, np.where(kept, ratio, backoff * value))
    return np.rint(np.log10(value) * 1e6).astype(np.int64)


def scores(blocks: DataFrame, answers: DataFrame, order: int, corpus_words: int, min_count: int, backoff: float) -> DataFrame:
    """(doc_id, n_words, score_micro) of the documents in the scored blocks."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")       # the texts have bucket -1
        ids, words = _words(rows["payload"][0].as_py())
        grams = ngrams(words, order)
        hashes = np.concatenate([h for _, h in grams])
        total = [from_planes(x.as_py()) for x in rows["payload"][1:]]
        _, inverse = np.unique(hashes, return_inverse=True)
        counts = np.concatenate(total).astype(np.float64)[inverse] if total else np.zeros(0)
        terms = _terms(words, order, counts, grams, corpus_words, min_count, backoff)
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(terms)])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(words.first).astype(np.int64)),
                         "score_micro": pa.array(np.diff(sums[words.first]))})
    texts = blocks.where("scored").select("block", F.lit(-1).alias("bucket"), "payload")
    wanted = answers.join(texts.select("block"), "block", "left_semi") if blocks.where("not scored").limit(1).count() else answers
    return texts.unionByName(wanted.select("block", "bucket", "payload")).groupBy("block").applyInArrow(
        run, "doc_id long, n_words long, score_micro long")


def backoff_scores(docs: DataFrame, corpus: DataFrame | None = None, *, order: int = ORDER, min_count: int = MIN_COUNT,
                   backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, score_micro, mean_log10) of every row of `docs`, under a model of `corpus`
    (of `docs` itself if there is none)."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, corpus is None, True)
    if corpus is not None:
        blocks = blocks.unionByName(blocks_of(corpus, True, False))
    blocks = materialize(blocks, "blocks", "none")
    size = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("all"),
                      F.coalesce(F.sum(F.when(F.col("counted"), F.col("n_words"))), F.lit(0)).alias("corpus")).first()
    buckets = size["all"] * order // BUCKET_HASHES + 1
    answers = materialize(totals(sent(blocks, order, buckets), buckets), "totals", "none")
    out = materialize(scores(blocks, answers, order, size["corpus"], min_count, backoff), "scores")
    drop(spark, blocks)
    drop(spark, answers)
    return out.withColumn("mean_log10", F.when(F.col("n_words") > 0, F.col("score_micro") / 1e6 / F.col("n_words")))


def op1_backoff_lm(spark, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff scores of all documents under the counts of all documents."""
    return backoff_scores(table(spark, sf_dir, "documents"))


SQL = """
with d as (select row_number() over () as r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
g as (select r, i, w as w3, lag(w) over (partition by r order by i) as w2,
             lag(w, 2) over (partition by r order by i) as w1 from w),
c1 as (select w3 as a, count(*) as n from g group by 1),
c2 as (select w2 as a, w3 as b, count(*) as n from g where i > 1 group by 1, 2),
c3 as (select w1 as a, w2 as b, w3 as c, count(*) as n from g where i > 2 group by 1, 2, 3),
t as (select count(*) as n from g),
s1 as (select g.*, u.n::double / t.n as s, v.n as n2, x.n as n1 from g cross join t join c1 u on u.a = g.w3
       left join c2 v on v.a = g.w2 and v.b = g.w3 left join c1 x on x.a = g.w2),
s2 as (select r, i, w1, w2, w3, n2,
              case when i = 1 then s when n2 >= 1 then n2::double / n1 else 0.4::double * s end as s from s1),
s3 as (select s2.r, case when i <= 2 then s when x.n >= 1 then x.n::double / v.n else 0.4::double * s end as s
       from s2 left join c3 x on x.a = s2.w1 and x.b = s2.w2 and x.c = s2.w3
       left join c2 v on v.a = s2.w1 and v.b = s2.w2),
p as (select r, sum(round_even(log10(s) * 1e6, 0)::bigint)::bigint as m from s3 group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(m, 0)::bigint as score_micro,
       case when len(ws) > 0 then m / 1e6::double / len(ws) end as mean_log10
from d left join p using (r)
"""
