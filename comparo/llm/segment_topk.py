"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into 1, 4, then 16 segments; a segment of L components is known by its mean m and
its deviation s (root of the mean squared difference from m). With Cauchy-Schwarz on the centred
parts, <x, y> <= sum L (m_x m_y + s_x s_y), which is the lower bound of the squared distance
|x|^2 + |y|^2 - 2 <x, y> in other words. Per block of queries and block of candidates, the bounds
rise from coarse to fine; a candidate goes on only while its bound reaches the k-th best exact
score already seen for the query, and exact scores are computed for what is left.

Vectors are dealt to blocks of bounded size by a hash of the row. Blocks are dealt to parts of some blocks each, and every part of
the candidates meets every part of the queries in one task: a block travels once for each part of the other side, not once for each of its
blocks, and nothing is broadcast. Such a task returns at most k rows for a query; a last ranking keeps k of those. What is compared,
sent and returned grows with the product of the two sides, as the job does, and a task's memory does not grow.

Defined results: vectors that are null, hold a null or non-finite component or have no id take no
part; vectors are compared with those of as many components; rows with the query's own id are the
query's own row; ties go to the smaller id; repeated rows are candidates of their own, as queries they count
once; an id with several vectors has k rows for each of them; a query
without candidates has no rows; scores beyond 64 bits count as the nearest long; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.llm.tables import materialize, table

LEVELS = (1, 4, 16)    # segments, coarse to fine
CANDIDATES = 4096      # vectors of a candidate block
QUERIES = 512          # vectors of a query block
TOGETHER = 16          # blocks of a part, at most
CELL_BYTES = 32 << 20  # of the candidates of a part, about
SPARSE = 0.25          # below this share of survivors, pairs are evaluated one by one


def _pack(rows: pa.Table) -> pa.Table:
    """A block as one row: ids in order, the hash that tells the vectors of an id apart, and the values, 32-bit
    integers if they fit."""
    rows = rows.sort_by([("vec_id", "ascending"), ("key", "ascending")])
    ids, keys = rows["vec_id"].to_numpy(), rows["key"].to_numpy()
    flat = rows["value"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    small = not len(flat) or np.abs(flat).max() < 2 ** 31
    return pa.table({"ids": pa.array([ids.tobytes()], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary()),
                     "small": pa.array([small]),
                     "data": pa.array([flat.astype(np.int32 if small else np.float64).tobytes()], pa.binary())})


def blocks(vectors: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(dim, block, ids, keys, small, data) blocks of about `size` vectors, and how many numbers there are."""
    n = max(1, -(-vectors.count() // size))

    def pack(rows: pa.Table) -> pa.Table:
        out = _pack(rows)
        return pa.table({"dim": rows["dim"][:1], "block": rows["block"][:1], **{c: out[c] for c in out.column_names}})

    # by row, so that an id or a vector that comes very often is spread over the blocks
    cut = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "key", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    packed = cut.groupBy("dim", "block").applyInArrow(
        pack, "dim int, block int, ids binary, keys binary, small boolean, data binary")
    return materialize(packed, name, "none"), n


def integers(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, dim, value, key) with floor(scale * component) of the vectors that take part; key tells the vectors of
    an id apart."""
    whole = ("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null "
             "and not isnan(x) and abs(x) < double('infinity'))")
    return embeddings.where(whole).select(
        F.col("vec_id").cast("long"), F.size("embedding").cast("int").alias("dim"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("value")).withColumn(
        "key", F.xxhash64("value"))


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products are the bounds at a level."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        part = x[:, a:b]
        out += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(out, 1)


def _dot(q: np.ndarray, c: np.ndarray):
    """An exact function of (query rows, candidate rows) or of all pairs (None)."""
    bound = max(1, q.shape[1]) * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if bound >= 2 ** 53:  # beyond doubles; beyond longs Python's integers overflow on the way out
        kind = np.int64 if bound < 2 ** 62 else object
        q, c = (np.array([[int(v) for v in r] for r in x], kind).reshape(x.shape) for x in (q, c))
    return lambda i=None, j=None: q @ c.T if i is None else (np.atleast_2d(q[i]) * np.atleast_2d(c[j])).sum(1)


def best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple:
    """(query row, candidate row, score): the k best candidates of every query in a pair of blocks."""
    dot = _dot(q, c)
    own = qid[:, None] == cid[None, :]
    if len(cid) <= 2 * k or q.shape[1] == 0 or dot(0, 0).dtype == object:
        at = np.nonzero(~own)
        score = dot()[at]
    else:
        levels = [s for s in LEVELS if s < q.shape[1]]
        stats = [(_statistics(q, s), _statistics(c, s)) for s in levels]
        # exact scores of the k candidates with the best middle bound set the first threshold
        first = stats[len(stats) // 2][0] @ stats[len(stats) // 2][1].T if stats else dot().astype(np.float64)
        first[own] = -np.inf
        seed = np.argpartition(first, len(cid) - k, axis=1)[:, len(cid) - k:]
        i = np.repeat(np.arange(len(qid)), k)
        seen = dot(i, seed.ravel()).reshape(len(qid), k)
        seen_own = np.take_along_axis(own, seed, 1)
        floor = np.where(seen_own.any(1), -np.inf, seen.min(1).astype(np.float64))
        alive = ~own
        slack = 1e-9 * max(1.0, float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1])
        for a, b in stats:
            if alive.mean() < SPARSE:
                i, j = np.nonzero(alive)
                alive[i, j] = (a[i] * b[j]).sum(1) + slack >= floor[i]
            else:
                alive &= (a @ b.T) + slack >= floor[:, None]
        if alive.mean() < SPARSE:
            at = np.nonzero(alive)
            score = dot(*at)
        else:      # of many survivors, those that reach the k-th best score of the block
            whole = dot()
            least = -np.inf if whole.dtype == np.float64 else -(1 << 63)
            whole = np.where(alive, whole, least)
            reach = np.partition(whole, len(cid) - k, axis=1)[:, len(cid) - k]
            at = np.nonzero(alive & (whole >= reach[:, None]))
            score = whole[at]
    if score.dtype == object:
        score = np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in score], object)
        order = np.array(sorted(range(len(score)), key=lambda x: (at[0][x], -score[x], cid[at[1][x]])), np.int64)
    else:
        order = np.lexsort((cid[at[1]], -score, at[0]))
    i, j, score = at[0][order], at[1][order], score[order]
    start = np.searchsorted(i, np.arange(len(qid)))
    keep = np.arange(len(i)) - start[i] < k
    return i[keep], j[keep], score[keep]


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `embeddings` for every distinct row of `queries`."""
    candidates, n = blocks(integers(embeddings), CANDIDATES, "candidates")
    asked, m = blocks(integers(queries).distinct(), QUERIES, "queries")
    largest = candidates.agg(F.max(F.octet_length("data"))).first()[0] or 1
    some = max(1, min(TOGETHER, CELL_BYTES // largest, n // embeddings.sparkSession.sparkContext.defaultParallelism))
    n_parts, m_parts = -(-n // some), -(-m // TOGETHER)
    number = lambda parts: F.pmod("block", F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = candidates.select("dim", number(n_parts).alias("part"), every(m_parts).alias("asking"), "ids", "small", "data")
    right = asked.select("dim", every(n_parts).alias("part"), number(m_parts).alias("asking"), "ids", "keys", "small", "data")

    def read(rows: pa.Table, more: str = "ids") -> Iterator[tuple[np.ndarray, ...]]:
        for r in rows.to_pylist():
            ids, keys = (np.frombuffer(r[x], np.int64) for x in ("ids", more))
            yield ids, keys, (np.frombuffer(r["data"], np.int32 if r["small"] else np.float64).astype(np.float64).reshape(
                -1, r["dim"]) if r["dim"] else np.zeros((len(ids), 0)))

    def search(of: pa.Table, asking: pa.Table) -> pa.Table:
        held, found = list(read(of)), [(np.zeros(0, np.int64),) * 4]
        for ids, keys, values in read(asking, "keys"):
            for a in range(0, len(ids), QUERIES):
                qid, key, q = ids[a:a + QUERIES], keys[a:a + QUERIES], values[a:a + QUERIES]
                row, cid, score = (np.zeros(0, np.int64) for _ in range(3))
                for own, _, c in held:      # the best of the blocks so far and of the next one
                    i, j, more = best(qid, q, own, c, k)
                    row, cid, score = (np.concatenate(x) for x in ((row, i), (cid, own[j]), (score, more.astype(np.int64))))
                    order = np.lexsort((cid, ~score, row))
                    row, cid, score = row[order], cid[order], score[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, cid, score = row[keep], cid[keep], score[keep]
                found.append((qid[row], key[row], cid, score))
        return pa.table([np.concatenate(x) for x in zip(*found)], names=["query_id", "key", "vec_id", "score"])

    cell = ("dim", "part", "asking")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "query_id long, key long, vec_id long, score long")
    return found.withColumn("rank", F.expr(
        "row_number() over (partition by query_id, key order by score desc, vec_id)")).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_segment_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best rows for every embedding whose id is divisible by 20, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, q.e as query, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
  from (select distinct * from v) q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 20 = 0),
r as (
  select query_id, row_number() over (partition by query_id, query order by score desc, vec_id)::int as rank,
         vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
