"""Sharding by a k-d tree over document metadata.

The root holds all documents. A node is split at the weighted median (weight: bytes) of the
metadata dimension in which its documents spread widest; a node that stands for ``k`` leaves
gives ``k // 2`` of them to its left half, so its cut is the weighted ``(k // 2) / k`` quantile.
Splitting ends when every leaf holds the target bytes.

Medians are found for all nodes of a level together: a histogram of bytes by (node, interval of
the coordinate) is summed by Spark, the driver keeps the interval that holds each node's cut and
the next histogram divides that interval. Equal texts are a group: they have the coordinates of the group (the
least of its rows in each dimension), so no cut along a dimension parts them. Groups with equal coordinates are told apart by a
tie key (a hash of the text, then one of doc_id). A cut among ties falls between two groups, unless the group it falls into
holds more than ``GROUP`` of a leaf's bytes: such a group is divided like any other rows, so no text, however
frequent, has to go to one side as a whole. The driver holds at most ``MAX_BINS`` histogram rows; no row of the
table reaches it.

Defined results: a null text has 0 bytes of its own; a null in a dimension is its smallest
value; an empty table gives an empty result; rows that agree in text and doc_id cannot be told apart and share a
shard (they still get slots of their own); other columns pass by unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from comparo.llm.tables import drop, materialize
from comparo.operators.skew import spread_join

MAX_BINS = 1 << 18      # histogram rows that the driver reads at once
ROWS_PER_CHUNK = 50_000  # rows that one task numbers
TOLERANCE = 0.0002      # part of a leaf's bytes that a cut may miss
GROUP = 0.01            # part of a leaf's bytes from which on a group of equal texts may be divided
OVERHEAD = 8            # bytes of a record besides its text
_TIES = 31              # bits of a tie that tell the rows of a group apart


def _coordinate(df: DataFrame, name: str) -> Column:
    """A dimension as a long from 0 to 2**61; categories by the hash of their value."""
    kind = df.schema[name].dataType
    if isinstance(kind, StringType):
        return F.when(F.col(name).isNull(), F.lit(0)).otherwise(
            F.shiftrightunsigned(F.xxhash64(name), 32) + 1)
    clipped = F.greatest(F.lit(-(1 << 60)), F.least(F.lit((1 << 60) - 1), F.col(name).cast("long")))
    return F.coalesce(clipped + (1 << 60) + 1, F.lit(0))


def measured(docs: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(doc_id, size, text_crc32, coords, tie) of every document."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    named = [d for d in dims if d in docs.columns]
    out = docs.select("doc_id", (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                      F.xxhash64(raw, F.crc32(raw)).alias("group"),
                      *[_coordinate(docs, d).alias(f"c{k}") for k, d in enumerate(named)])
    rows = materialize(out, "measured")
    # the least coordinates of a group, back to its rows; a text that comes very often is split in that join
    own = [f"c{k}" for k in range(len(named))]
    if own:
        groups = rows.groupBy("group").agg(*[F.min(c).alias(c) for c in own])
        rows = spread_join(rows.drop(*own), groups, "group")
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("group"), 2 + _TIES), _TIES) + F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - _TIES)
    size = (F.log2(F.col("size")) * 4096).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.array(size, *own).alias("coords"), tie.alias("tie"))


def _small(df: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """Facts about the open nodes, a few longs each; broadcast, as there are fewer than leaves."""
    schema = StructType([StructField(n, LongType(), False) for n in names.split()])
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _cuts(df: DataFrame, spans: dict[int, list[tuple[int, int]]], nodes: dict[int, dict]) -> dict:
    """For each open node (dimension, coordinate, tie): what is smaller goes left."""
    total = {n: x["bytes"] for n, x in nodes.items()}
    widest = [max(s[d][1] for s in spans.values()) - min(s[d][0] for s in spans.values())
              for d in range(len(next(iter(spans.values()))))]
    found, open_ = {}, {}
    for n in nodes:
        dim = max(range(len(widest)), key=lambda d: (spans[n][d][1] - spans[n][d][0]) / max(1, widest[d]))
        lo, hi = spans[n][dim]
        left = nodes[n]["leaves"] // 2
        open_[n] = {"dim": dim, "lo": lo, "hi": hi, "value": None, "below": 0,
                    "goal": total[n] * left / nodes[n]["leaves"],
                    "near": TOLERANCE * total[n] / nodes[n]["leaves"], "group": GROUP * total[n] / nodes[n]["leaves"]}
    while open_:
        bins = max(16, min(4096, MAX_BINS // len(open_)))
        rows = []
        for n, o in open_.items():
            o["step"] = -(-(o["hi"] - o["lo"] + 1) // bins)
            if o["value"] is not None and o["hi"] - o["lo"] >= 1 << _TIES:     # whole groups first
                o["step"] = -(-o["step"] >> _TIES) << _TIES
            rows.append((n, o["dim"], o["lo"], o["hi"], o["step"],
                         -1 if o["value"] is None else o["value"]))
        at = F.element_at("coords", (F.col("dim") + 1).cast("int"))
        key = F.when(F.col("value") < 0, at).otherwise(F.col("tie"))
        sums = (df.join(_small(df, rows, "node dim lo hi step value"), "node")
                .where((F.col("value") < 0) | (at == F.col("value")))
                .withColumn("key", key).where("key between lo and hi")
                .groupBy("node", F.expr("(key - lo) div step").alias("bin"))
                .agg(F.sum("size").alias("bytes")).collect())
        held: dict[int, list] = {n: [] for n in open_}
        for r in sums:
            held[r["node"]].append((r["bin"], r["bytes"]))
        for n, o in list(open_.items()):
            below, chosen, weight = o["below"], 0, 0
            for chosen, weight in sorted(held[n]):
                if below + weight >= o["goal"]:
                    break
                below += weight
            lo = o["lo"] + chosen * o["step"]
            whole_group = o["value"] is not None and o["step"] == 1 << _TIES and weight <= o["group"]
            if weight <= o["near"] or whole_group or (o["step"] == 1 and o["value"] is not None):
                cut = lo + o["step"] if below + weight - o["goal"] < o["goal"] - below else lo
                found[n] = (o["dim"], cut, 0) if o["value"] is None else (o["dim"], o["value"], cut)
                del open_[n]
            elif o["step"] == 1:       # one coordinate holds the cut: divide its ties
                o |= {"value": lo, "lo": 0, "hi": (1 << 62) - 1, "below": below}
            else:
                o |= {"lo": lo, "hi": min(o["hi"], lo + o["step"] - 1), "below": below}
    return found


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None,
              dims: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): a leaf of the k-d tree for every document.

    Give the number of `shards`, or `target_bytes` of a leaf. The size in bytes (logarithm) is
    always a dimension; `dims` names more columns, those that are missing are left out.
    """
    spark = docs.sparkSession
    rows = materialize(measured(docs, dims).withColumn("node", F.lit(0).cast("long")), "rows")
    n_dims = 1 + sum(d in docs.columns for d in dims)
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    leaves = shards or max(1, -(-whole["b"] // target_bytes))
    nodes = {0: {"leaves": leaves, "first": 0, "bytes": whole["b"]}}
    final: dict[int, int] = {}                 # node -> shard
    fresh = 1
    while whole["n"]:
        final |= {n: x["first"] for n, x in nodes.items() if x["leaves"] == 1}
        nodes = {n: x for n, x in nodes.items() if x["leaves"] > 1}
        if not nodes:
            break
        at = [F.element_at("coords", d + 1) for d in range(n_dims)]
        stats = (rows.join(_small(rows, [(n,) for n in nodes], "node"), "node").groupBy("node")
                 .agg(F.sum("size").alias("b"), *[F.min(c).alias(f"lo{d}") for d, c in enumerate(at)],
                      *[F.max(c).alias(f"hi{d}") for d, c in enumerate(at)]).collect())
        spans = {r["node"]: [(r[f"lo{d}"], r[f"hi{d}"]) for d in range(n_dims)] for r in stats}
        for r in stats:
            nodes[r["node"]]["bytes"] = r["b"]
        nodes = {n: x for n, x in nodes.items() if n in spans}   # a node without rows has empty leaves
        if not nodes:
            break
        cuts, splits, children = _cuts(rows, spans, nodes), [], {}
        for n, x in nodes.items():
            left = x["leaves"] // 2
            splits.append((n, *cuts[n], fresh, fresh + 1))
            children[fresh] = {"leaves": left, "first": x["first"], "bytes": 0}
            children[fresh + 1] = {"leaves": x["leaves"] - left, "first": x["first"] + left, "bytes": 0}
            fresh += 2
        at = F.element_at("coords", (F.col("dim") + 1).cast("int"))
        goes_left = (at < F.col("cut")) | ((at == F.col("cut")) & (F.col("tie") < F.col("cut_tie")))
        moved = (rows.join(_small(rows, splits, "node dim cut cut_tie left right"), "node", "left")
                 .withColumn("node", F.when(F.col("left").isNull(), F.col("node"))
                             .when(goes_left, F.col("left")).otherwise(F.col("right")))
                 .select(rows.columns))
        before, rows = rows, materialize(moved, "rows")
        drop(spark, before)
        nodes = children
    shard_of = _small(rows, list(final.items()) or [(0, 0)], "node shard")
    placed = rows.join(shard_of, "node").select(
        "doc_id", "size", "text_crc32", "tie", F.col("shard").cast("int").alias("shard"))
    return numbered(placed, max(1, whole["n"] // ROWS_PER_CHUNK // leaves + 1)).select(
        "doc_id", "size", "text_crc32", "shard", "slot")


def numbered(placed: DataFrame, chunks: int) -> DataFrame:
    """Slots without gaps in each shard: rows are numbered in hashed chunks, chunk counts added up."""
    cut = placed.withColumn("chunk", F.pmod(F.xxhash64("tie", "doc_id"), F.lit(chunks)))
    counts = cut.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.selectExpr(
        "shard", "chunk",
        "coalesce(sum(n) over (partition by shard order by chunk rows between unbounded preceding "
        "and 1 preceding), 0) as before")
    slot = F.expr("before + row_number() over (partition by shard, chunk order by doc_id, tie) - 1")
    return cut.join(offsets, ["shard", "chunk"]).withColumn("slot", slot.cast("long"))


def op6_kd_tree_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    from comparo.llm.tables import table

    out = kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
