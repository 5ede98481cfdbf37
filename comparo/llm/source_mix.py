"""Mixing sources to target weights as a min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources (a pattern) are
interchangeable for the mix, so the flow network has one node for a pattern, not for a document:
from a pattern's words an arc for each repetition (capacity: the pattern's words; the cost rises
with the repetition, so it is convex), from a pattern to each of its sources, from a source to its
quota. A cheapest flow that fills the quotas repeats nothing while a first copy is to be had.
Spark sums up the patterns; the network (at most ``MAX_ARCS`` arcs) is solved on the driver.

A pattern that owes F words takes each document F // T times (T: its words) and, once more,
documents in seeded order: histograms of words over the seeded hash, summed by Spark for all
patterns together, close in on the document that no longer fits; behind it the search goes on among
documents that are small enough, until the gap is closed or no document is left. The rows of a
pattern stay spread over all tasks throughout.

Defined results: a null text has no words; a null source is a source of its own, last in order; a
document without any source is never taken; rows that agree in doc_id and size are neighbours in the
seeded order, and where not all of them fit as many are taken as do; documents without words have nothing to take; empty table: no rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from comparo.llm.tables import materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5        # words of the mix for a word of the sources
REPEATS = 2        # most copies of a document
SEED = 20
MAX_ARCS = 1_000_000
MAX_BINS = 1 << 17
CLOSE = 0.0002     # a gap below this part of the goal is closed
_TOP = 1 << 62


def words_of(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            repeats: int = REPEATS) -> list[float]:
    """Words for each source: shares by weight; what is over a source's limit goes to the others."""
    goal = [0.0] * len(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    open_, rest = set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if rest * weight[i] / total > repeats * sizes[i]]
        if not over:
            for i in open_:
                goal[i] = rest * weight[i] / total
            break
        for i in over:
            goal[i] = float(repeats * sizes[i])
        open_ -= set(over)
        rest -= sum(goal[i] for i in over)
    return goal


def cheapest_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[int]:
    """Words that each pattern (its sources, its words) sends so that the quotas are filled at least cost.

    The cost of an arc depends on its repetition alone and every path from the supply uses one such
    arc, so the cheapest paths of the residual network are those of the lowest repetition that still
    reaches an open quota: the arcs are opened one repetition at a time.
    """
    sent = [0] * len(patterns)
    left = list(quotas)
    flow: list[dict[int, int]] = [dict.fromkeys(p, 0) for p, _ in patterns]
    users: list[list[int]] = [[] for _ in quotas]
    for p, (members, _) in enumerate(patterns):
        for s in members:
            users[s].append(p)
    for repetition in range(1, repeats + 1):
        for start in range(len(patterns)):
            limit = repetition * patterns[start][1]
            while sent[start] < limit:
                # shortest way from the pattern to a source with an open quota, undoing flow where needed
                came: dict[tuple, tuple] = {("p", start): ()}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, x = queue.popleft()
                    nexts = [("s", s) for s in patterns[x][0]] if kind == "p" else [
                        ("p", p) for p in users[x] if flow[p][x] > 0]
                    for y in nexts:
                        if y not in came:
                            came[y] = (kind, x)
                            queue.append(y)
                            if y[0] == "s" and left[y[1]] > 0:
                                end = y
                                break
                if end is None:
                    break
                path, at = [], end
                while at:
                    path.append(at)
                    at = came[at]
                path.reverse()
                amount = min(limit - sent[start], left[end[1]])
                for a, b in zip(path[:-1], path[1:]):
                    if a[0] == "s":
                        amount = min(amount, flow[b[1]][a[1]])
                for a, b in zip(path[:-1], path[1:]):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += amount
                    else:
                        flow[b[1]][a[1]] -= amount
                sent[start] += amount
                left[end[1]] -= amount
    return sent


def _small(df: DataFrame, rows: list[tuple], schema: StructType) -> DataFrame:
    """A few facts on each pattern; broadcast, as patterns are bounded by MAX_ARCS."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _longs(names: str) -> StructType:
    return StructType([StructField(n, LongType(), False) for n in names.split()])


def _filled(rows: DataFrame, open_: dict[int, dict], value: str, where: str) -> dict[int, tuple[int, int, int, int]]:
    """For each pattern, whose rows from `lo` on are taken in order of `value` while their sizes fit into `gap`: (the value that does
    not fit, or _TOP, the words taken before it, its rows, their words). A histogram of the rest at each step
    finds the bin that does not fit, down to a single value."""
    ends = {}
    open_ = {p: o | {"sum": 0} for p, o in open_.items()}
    while open_:
        bins = max(16, min(4096, MAX_BINS // len(open_)))
        given = []
        for p, o in open_.items():
            o["step"] = -(-(o["hi"] - o["lo"] + 1) // bins)
            given.append((p, o["lo"], o["hi"], o["step"], o["gap"], o.get("at", 0)))
        held: dict[int, list] = {p: [] for p in open_}
        for r in (rows.join(_small(rows, given, _longs("pattern lo hi step most at")), "pattern")
                  .where(f"size > 0 and size <= most and {value} between lo and hi and {where}")
                  .groupBy("pattern", F.expr(f"({value} - lo) div step").alias("bin"))
                  .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min(value).alias("least")).collect()):
            held[r["pattern"]].append((r["bin"], r["words"], r["n"], r["least"]))
        for p, o in list(open_.items()):
            for b, words, n, least in sorted(held[p]):
                if o["sum"] + words > o["gap"]:
                    lo = o["lo"] + b * o["step"]
                    if n == 1 or o["step"] == 1:
                        ends[p] = (least, o["sum"], n, words)
                    else:
                        o |= {"hi": min(o["hi"], lo + o["step"] - 1), "lo": lo}
                    break
                o["sum"] += words
            else:
                ends[p] = (_TOP, o["sum"], 0, 0)
            if p in ends:
                del open_[p]
    return ends


def seeded_choice(rows: DataFrame, goals: dict[int, int]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each pattern stretches (from, to, largest, tie, tie_to): rows with `from <= h < to` and `size <= largest`
    are chosen, and of the rows with `h = tie` those of a row number below `tie_to`. Their sizes add up to the pattern's
    goal, or fall a little short.

    Documents are taken in order of the hash up to the first value whose rows do not all fit. If rows share it (copies),
    as many of them as fit are taken, in order of their row number. What is left goes on behind that value, among
    the documents that still fit, until the gap is closed or no document is left.
    """
    chosen: dict[int, list] = {p: [] for p in goals}
    gap, at = dict(goals), dict.fromkeys(goals, 0)
    active = {p for p, g in goals.items() if g > 0}
    while active:
        ends = _filled(rows, {p: {"lo": at[p], "hi": _TOP - 1, "gap": gap[p]} for p in active}, "h", "true")
        shared = {p: {"lo": 0, "hi": _TOP - 1, "gap": gap[p] - words, "at": end}
                  for p, (end, words, n, _) in ends.items() if n > 1}
        ties = _filled(rows, shared, "row", "h = at") if shared else {}
        for p, (end, words, n, _) in ends.items():
            tie = ties.get(p, (0, 0, 0, 0))
            chosen[p].append((at[p], end, gap[p], end if tie[1] else -1, tie[0]))
            gap[p] -= words + tie[1]
            at[p] = end + 1         # past the value that does not fit
            if end >= _TOP or gap[p] <= CLOSE * goals[p]:
                active.discard(p)
    return chosen


def mixed(docs: DataFrame, members: Column, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
          repeats: int = REPEATS, seed: int = SEED, keep: bool = False) -> DataFrame:
    """(doc_id, size, sources, sizes, targets, copies, taken) of every row, and the row itself, `kept`, if asked for.

    `members` is the array of a document's sources; `sources` comes back as their numbers (in code
    point order, null last) with the sizes and targets of each. `copies` is how often the mix takes
    the document, `taken` the words this makes.
    """
    kept = [F.struct(*docs.columns).alias("kept")] if keep else []
    rows = docs.select("doc_id", words_of(F.col("text")).alias("size"), members.alias("members"), *kept)
    rows = materialize(rows.withColumns({"h": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 2),
                                         "row": F.monotonically_increasing_id()}), "rows")
    sizes = (rows.select("size", F.explode(F.array_distinct("members")).alias("source"))
             .groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_ARCS + 1).collect())
    sizes = sorted(((r["source"], r["size"]) for r in sizes), key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in sizes], weights, share, repeats)
    number = {s: i for i, (s, _) in enumerate(sizes)}
    found = (rows.groupBy(F.array_sort(F.array_distinct("members")).alias("members"))
             .agg(F.sum("size").alias("size")).limit(MAX_ARCS + 1).collect())
    patterns = [(tuple(sorted(number[s] for s in set(r["members"] or ()))), r["size"]) for r in found]
    if max(len(sizes), len(patterns), sum(len(m) for m, _ in patterns)) > MAX_ARCS:
        raise ValueError("the flow network of these sources is too large for the driver; use coarser sources")
    sent = cheapest_flow(patterns, [round(g) for g in goal], repeats)
    key = F.array_sort(F.array_distinct("members"))
    facts = [(r["members"], p, list(m), [sizes[s][1] for s in m], [goal[s] for s in m],
              sent[p] // n if n else 0) for p, (r, (m, n)) in enumerate(zip(found, patterns))]
    names = _small(rows, facts, StructType.fromDDL(
        f"members {rows.schema['members'].dataType.simpleString()}, pattern long, sources array<long>, "
        "sizes array<long>, targets array<double>, full long"))
    rows = rows.withColumn("members", key).join(names.withColumnRenamed("members", "m"),
                                                F.col("members").eqNullSafe(F.col("m"))).drop("m")
    chosen = seeded_choice(rows, {p: sent[p] % n for p, (_, n) in enumerate(patterns) if n})
    stretch = ArrayType(StructType([StructField(x, LongType(), False) for x in ("lo", "hi", "most", "tie", "tie_to")]))
    cuts = _small(rows, list(chosen.items()) or [(-1, [])], StructType(
        [StructField("pattern", LongType(), False), StructField("cuts", stretch)]))
    again = F.coalesce(F.exists("cuts", lambda c: (F.col("size") <= c["most"]) & (
        ((F.col("h") >= c["lo"]) & (F.col("h") < c["hi"])) | ((F.col("h") == c["tie"]) & (F.col("row") < c["tie_to"])))), F.lit(False))
    rows = rows.join(cuts, "pattern", "left").withColumn("copies", F.when(
        F.col("size") == 0, F.lit(0)).otherwise(F.col("full") + again.cast("long")).cast("long"))
    return rows.select("doc_id", "size", "sources", "sizes", "targets", "copies",
                       (F.col("size") * F.col("copies")).alias("taken"), *["kept"] * keep)


def mixture(docs: DataFrame, members: Column, **options) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it."""
    rows = mixed(docs, members, keep=True, **options).where("copies > 0")
    return rows.select("kept", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("kept.*")


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, each a member of its own source."""
    out = mixed(table(spark, sf_dir, "documents"), F.array("source"))
    return out.select("doc_id", "size", F.element_at("sizes", 1).alias("source_size"),
                      F.element_at("targets", 1).alias("target"), "taken")
