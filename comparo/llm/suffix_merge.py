"""Exact byte-substring deduplication over a sparse suffix array, sorted by a distributed merge.

A string of `length` bytes is looked at from its anchor, the position inside it whose next ``GRAM``
bytes have the least hash; equal strings have equal anchors. So the suffixes that start at anchors
(about two for each `length - GRAM` bytes) are all that has to be sorted. An anchor's context is the
text of all strings that it is the anchor of; its sort key is the part from the anchor on, then the
part before it, backwards.

1. Documents with equal text are one class; of several, all bytes go where a string fits.
2. Anchors whose gram comes once are dropped, by grouped counts.
3. Equal contexts are counted by hash, summed before the shuffle: those that come again are covered
   as a whole, and only one of them goes on.
4. The sort: each task sorts the keys of its texts and sends them, front-coded (length of the common
   prefix with the key before, then the rest), to ranges given by sampled splitters. A range merges
   its runs with a loser tree that carries the common prefix of each head with the last key put out:
   heads with different prefixes are ordered without a look at their bytes, equal ones are compared
   from the prefix on only.
5. In the sorted order, neighbours that share a gram are a group; strings of a group that are equal
   are found by rolling hash. A range never splits a group, but where a group fills ranges of its
   own; such a group's strings are compared across its ranges in a further step, dealt by hash.
6. The covered bytes are cut from the documents.

64-bit hashes stand for grams, contexts and strings. Defined results: a null text is empty; texts
shorter than `length` keep everything; overlapping repeats within a text count; rows with equal text
are copies of each other whatever their doc_id; empty table: no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.llm import words as W
from comparo.llm.tables import drop, materialize, table, texts_of
from comparo.llm.winnow import least_positions

LENGTH = 400
GRAM = 160
RANGE_BYTES = 8 << 20    # bytes of keys that one range merges, about
SAMPLES = 24             # sampled keys for each splitter
WINDOWS_AT_ONCE = 400_000
_LAST_ID = (1 << 63) - 1


def _row_key(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of every run of strings with one anchor in a chunk: first string, last string, anchor, gram hash."""
    starts = W.whole_windows(bounds, length)
    if not len(starts):
        return starts, starts, starts, np.zeros(0, np.uint64)
    hashed = W.windows(W.mix(data.astype(np.uint64) + np.uint64(1)), gram)
    anchor = least_positions(hashed, length - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(starts)) - 1
    return starts[begin], starts[end], anchor[begin], hashed[anchor[begin]]


def measured(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, h: hash of the text, n_bytes, sha, rid: a key of the text, grams: hashes at its anchors)."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("rid", pa.int64()),
                        ("grams", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, bounds = W.text_column(batch.column(1))
            for i, j in W.chunks(bounds):
                own, at = data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
                raw = own.tobytes()
                sha = [hashlib.sha256(raw[x:y]).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                _, _, anchor, grams = _anchors(own, at, length, gram)
                edges = np.searchsorted(anchor, at).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], pa.array(np.diff(at).astype(np.int64)), pa.array(sha, pa.binary()),
                     pa.array([_row_key(s) for s in sha], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(edges), pa.array(grams.view(np.int64)))], schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(
        run, "doc_id long, h long, n_bytes long, sha binary, rid long, grams array<long>")


def _checked(rows: DataFrame) -> DataFrame:
    """Rows whose text is the one of their key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [_row_key(hashlib.sha256(t.as_buffer()).digest()) == r
                    for t, r in zip(batch.column("text"), batch.column("rid").to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_()))
    return rows.mapInArrow(run, rows.schema)


def contexts(alive: DataFrame, length: int, gram: int) -> DataFrame:
    """(rid, at, before, after, gram, context): anchors of repeated grams. The context reaches `before`
    bytes back from the anchor and up to `after` bytes on; `context` is its hash."""
    names = ["rid", "at", "before", "after", "gram", "context"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            rids = batch.column("rid").to_numpy()
            data, bounds = W.text_column(batch.column("text"))
            for i, j in W.chunks(bounds):
                own, at = data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
                first, last, anchor, grams = _anchors(own, at, length, gram)
                edges = np.searchsorted(anchor, at)
                keep = np.zeros(len(anchor), bool)
                for d in range(j - i):
                    mine = slice(edges[d], edges[d + 1])
                    keep[mine] = np.isin(grams[mine].view(np.int64), batch.column("grams")[i + d].values.to_numpy())
                doc = np.repeat(np.arange(j - i), np.diff(edges))[keep]
                first, last, anchor, grams = first[keep], last[keep], anchor[keep], grams[keep]
                raw = own.tobytes()
                text = [int.from_bytes(hashlib.blake2b(raw[f:e + length], digest_size=8,
                                                       key=(a - f).to_bytes(4, "big")).digest(), "big", signed=True)
                        for f, e, a in zip(first.tolist(), last.tolist(), anchor.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[i:j][doc], pa.int64()), pa.array((anchor - at[doc]).astype(np.int64)),
                     pa.array((anchor - first).astype(np.int64)), pa.array((last + length - anchor).astype(np.int64)),
                     pa.array(grams.view(np.int64)), pa.array(text, pa.int64())], names=names)

    return alive.mapInArrow(run, "rid long, at long, before long, after long, gram long, context long")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known to be equal."""
    most = min(len(a), len(b))
    while known < most:
        x, y = a[known:known + 64], b[known:known + 64]
        if x != y:
            size = min(len(x), len(y))
            odd = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            return known + size - (odd.bit_length() + 7) // 8
        known += 64
    return most


def front_coded(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefixes of sorted keys with the key before, and the rests."""
    shared = [0, *(common_prefix(a, b) for a, b in zip(keys[:-1], keys[1:]))][:len(keys)]
    return shared, [k[n:] for k, n in zip(keys, shared)]


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, common prefix with the key before, run, index in the run) of front-coded runs, in order."""
    size = 1 << max(1, len(runs) - 1).bit_length()
    heads: list[bytes | None] = [None] * size     # None: the run has ended, larger than any key
    known = [0] * size                            # common prefix of a head with the last key put out
    at = [-1] * size

    def advance(r: int) -> None:
        at[r] += 1
        if r < len(runs) and at[r] < len(runs[r][0]):
            known[r] = runs[r][0][at[r]]
            heads[r] = (heads[r] or b"")[:known[r]] + runs[r][1][at[r]]
        else:
            heads[r], known[r] = None, -1

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return a, b
        n = common_prefix(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    for r in range(size):
        advance(r)
    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if size > 1 else 0
    while heads[best] is not None:
        yield heads[best], known[best], best, at[best]
        advance(best)
        node = (best + size) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


class Strings:
    """Contexts gathered for a search of equal strings among them."""

    def __init__(self, length: int):
        self.length = length
        self.texts: list[bytes] = []
        self.rows: list[tuple] = []    # (rid, first byte, single, hot)
        self.windows = 0

    def add(self, text: bytes, row: tuple) -> None:
        self.texts.append(text)
        self.rows.append(row)
        self.windows += len(text) - self.length + 1

    def search(self) -> tuple[list[tuple], tuple[np.ndarray, ...]]:
        """(rid, from, to) covered in contexts that come once; (hash, rid, from) of the strings of split groups."""
        sizes = np.array([len(t) for t in self.texts])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        starts = W.whole_windows(bounds, self.length)
        hashed = W.windows(W.mix(data.astype(np.uint64) + np.uint64(1)), self.length)[starts]
        owner = np.repeat(np.arange(len(sizes)), sizes - self.length + 1)
        order = np.argsort(hashed, kind="stable")
        same = hashed[order][1:] == hashed[order][:-1]
        again = np.zeros(len(order), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        rid, begin, single, hot = (np.array([r[k] for r in self.rows]) for k in range(4))
        place = starts - bounds[owner] + begin[owner]
        hit = np.flatnonzero(again & single[owner])
        found = []
        if len(hit):
            cut = np.flatnonzero(np.append(True, owner[hit][1:] != owner[hit][:-1]))
            low, high = place[hit[cut]], place[hit[np.append(cut[1:], len(hit)) - 1]] + self.length
            found = list(zip(rid[owner[hit[cut]]].tolist(), low.tolist(), high.tolist()))
        own = order[np.append(True, ~same)] if len(order) else order   # one of each
        own = own[hot[owner[own]]]
        settled = again[own] | ~single[owner[own]]
        sent = (hashed[own].view(np.int64), np.where(settled, 0, rid[owner[own]]), np.where(settled, -1, place[own]))
        self.__init__(self.length)
        return found, sent


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple]]:
    """(key, (rid, anchor, before, single)) of the contexts listed with each text."""
    for rid, text, items in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("items").to_pylist()):
        raw = text.as_buffer().to_pybytes()
        for x in items:
            a = x["at"]
            back = raw[a - x["before"]:a]
            yield raw[a:a + x["after"]] + back[::-1], (rid, a, x["before"], x["single"])


def sampled(listed: DataFrame, one_in: int) -> list[bytes]:
    """Keys chosen by hash, about one in `one_in`."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys = [k for k, (rid, a, _, _) in _keyed(batch) if (rid * 31 + a) * 0x9E3779B97F4A7C15 % (1 << 64) % one_in == 0]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])
    return sorted(bytes(r["key"]) for r in listed.mapInArrow(run, "key binary").collect())


def splitters_of(sample: list[bytes], ranges: int, gram: int) -> tuple[list[bytes], set[bytes]]:
    """Range borders, at the border of a group but within groups that fill ranges; the grams of those."""
    picked = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    times = Counter(k[:gram] for k in picked)
    hot = {g for g, n in times.items() if n > 1}
    return sorted({k if k[:gram] in hot else k[:gram] for k in picked}), hot


def sorted_runs(listed: DataFrame, shared) -> DataFrame:
    """(part, prefixes, lengths, bytes, rids, ats, befores, singles): a front-coded run for each range and batch."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = shared.value[0]
        for batch in rows:
            keyed = sorted(_keyed(batch))
            parts, i = [], 0
            of = [bisect_right(borders, k) for k, _ in keyed]
            while i < len(keyed):
                j = bisect_right(of, of[i])
                prefixes, rests = front_coded([k for k, _ in keyed[i:j]])
                columns = list(zip(*(x for _, x in keyed[i:j])))
                parts.append((of[i], np.array(prefixes, np.int32).tobytes(), np.array([len(r) for r in rests], np.int32).tobytes(),
                              b"".join(rests), *(np.array(columns[k], t).tobytes() for k, t in enumerate(
                                  (np.int64, np.int64, np.int32, bool)))))
                i = j
            kinds = [pa.int32(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts) if parts else [[]] * 8, kinds)],
                                             names=["part", "prefixes", "lengths", "rests", "rids", "ats", "befores", "singles"])
    return listed.mapInArrow(run, "part int, prefixes binary, lengths binary, rests binary, rids binary, ats binary, "
                                  "befores binary, singles binary")


def merged(runs: DataFrame, shared, length: int, gram: int, buckets: int) -> DataFrame:
    """(rid, low, high) covered; (bucket, hashes, rids, places) strings of groups that several ranges hold."""
    schema = pa.schema([("rid", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("bucket", pa.int32()),
                        ("hashes", pa.binary()), ("rids", pa.binary()), ("places", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        hot = shared.value[1]
        coded, facts = [], []
        for r in rows.to_pylist():
            prefixes, sizes = (np.frombuffer(r[c], np.int32).tolist() for c in ("prefixes", "lengths"))
            ends = np.cumsum(sizes).tolist()
            coded.append((prefixes, [r["rests"][e - n:e] for e, n in zip(ends, sizes)]))
            facts.append([np.frombuffer(r[c], t).tolist() for c, t in (
                ("rids", np.int64), ("ats", np.int64), ("befores", np.int32), ("singles", bool))])
        found, sent, strings, group = [], [], Strings(length), []

        def close() -> None:
            if len(group) > 1 or (group and group[0][2][3]):
                for text, row, _ in ((g[0], g[2], g[1]) for g in group):
                    strings.add(text, row)
            group.clear()
            if strings.windows >= WINDOWS_AT_ONCE:
                flush()

        def flush() -> None:
            if strings.texts:
                covered, cross = strings.search()
                found.extend(covered)
                sent.append(cross)

        for key, prefix, r, k in merge_runs(coded):
            if prefix < gram:
                close()
            rid, a, before, single = (f[k] for f in facts[r])
            size = len(key) - before
            group.append((key[size:][::-1] + key[:size], key, (rid, a - before, single, key[:gram] in hot)))
        close()
        flush()
        out = [tuple(f) + (None,) * 4 for f in found]
        if sent:
            hashes, rids, places = (np.concatenate([s[k] for s in sent]) for k in range(3))
            hashes, first = np.unique(hashes, return_index=True) if len(sent) == 1 else (hashes, np.arange(len(hashes)))
            rids, places = rids[first], places[first]
            bucket = (hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                mine = bucket == b
                out.append((None, None, None, b, hashes[mine].tobytes(), rids[mine].tobytes(), places[mine].astype(np.int64).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 7, schema)], schema=schema)

    return runs.groupBy("part").applyInArrow(
        run, "rid long, low long, high long, bucket int, hashes binary, rids binary, places binary")


def across(strings: DataFrame, length: int) -> DataFrame:
    """(rid, low, high) of strings that more than one range has seen."""
    def run(rows: pa.Table) -> pa.Table:
        hashes, rids, places = (np.frombuffer(b"".join(rows[c].to_pylist()), np.int64) for c in ("hashes", "rids", "places"))
        _, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = (n[inverse] > 1) & (places >= 0)
        return pa.table({"rid": pa.array(rids[hit]), "low": pa.array(places[hit]), "high": pa.array(places[hit] + length)})
    return strings.select("bucket", "hashes", "rids", "places").groupBy("bucket").applyInArrow(
        run, "rid long, low long, high long")


def _cut(rows: DataFrame) -> DataFrame:
    """(rid, n_removed, n_spans, kept_sha256, kept) without the bytes of the `spans`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, text, spans in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                kept, at, runs, gone = [], 0, 0, 0
                end = -1
                for s in sorted((x["low"], x["high"]) for x in spans):
                    if s[0] > end:
                        kept.append(raw[max(end, 0):s[0]])
                        runs += 1
                        at = s[0]
                    else:
                        at = end
                    gone += max(0, s[1] - at)
                    end = max(end, s[1])
                kept = b"".join([*kept, raw[max(end, 0):]])
                out.append((rid, gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)],
                                             names=["rid", "n_removed", "n_spans", "kept_sha256", "kept"])
    return rows.mapInArrow(run, "rid long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeated_bytes(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM,
                          range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; `kept` holds the bytes
    that are left where some but not all were removed, null elsewhere."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    did = F.coalesce("doc_id", F.lit(_LAST_ID))
    whole = materialize(measured(docs, length, gram).withColumn("did", did), "whole")
    classes = materialize(whole.where(F.col("n_bytes") >= length).groupBy("rid").agg(
        F.min("did").alias("did"), F.count(F.lit(1)).alias("copies")), "classes")
    stand = whole.join(classes.select("rid", "did"), ["rid", "did"]).dropDuplicates(["rid"])
    rows = stand.select("rid", "did", "h", F.explode("grams").alias("gram"))
    repeated = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    kept = materialize(rows.join(repeated, "gram").groupBy("rid", "did", "h").agg(F.collect_set("gram").alias("grams")), "grams")
    alive = texts_of(docs.withColumn("did", did), kept).select("rid", "text", "grams")
    alive = materialize(_checked(alive), "alive")
    entries = materialize(contexts(alive, length, gram).distinct(), "entries")
    counts = materialize(entries.groupBy("context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at", "before", "after", "gram")).alias("x")), "contexts")
    covered = entries.join(counts.where("n > 1").select("context"), "context").selectExpr(
        "rid", "at - before as low", "at + after as high")
    open_ = counts.groupBy("x.gram").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    items = counts.select("x.*", (F.col("n") == 1).alias("single")).join(open_.select("gram"), "gram")
    listed = items.groupBy("rid").agg(F.collect_list(F.struct("at", "before", "after", "single")).alias("items"))
    listed = materialize(alive.select("rid", "text").join(listed, "rid").dropDuplicates(["rid"]), "listed")
    size = items.agg(F.sum(F.expr("before + after"))).first()[0] or 0
    ranges = int(size) // range_bytes + 1
    sample = sampled(listed, max(1, int(size) // (2 * length) // (SAMPLES * ranges))) if ranges > 1 else []
    shared = spark.sparkContext.broadcast(splitters_of(sample, ranges, gram))
    done = materialize(merged(sorted_runs(listed, shared), shared, length, gram, ranges), "merged")
    spans = covered.unionByName(done.where("rid is not null").select("rid", "low", "high")).unionByName(
        across(done.where("bucket is not null"), length))
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    cut = materialize(_cut(alive.select("rid", "text").join(spans, "rid")).dropDuplicates(["rid"]), "cut")
    drop(spark, listed)
    out = whole.join(classes.drop("did"), "rid", "left").join(cut, "rid", "left")
    copied = F.coalesce(F.col("copies"), F.lit(0)) > 1
    return out.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(
            F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


def op7_suffix_merge(spark, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that start elsewhere too."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")
