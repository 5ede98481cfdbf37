"""Phrase collocations by relational mining of occurrence relations (SETM), level by level.

Level 1 is the relation of all word occurrences, sorted by slot: the slot of a word is its place in a block of
texts, pieces are an empty slot apart, so piece and position are one number. Its groups are the distinct words. A
level has three steps:

* group-count: the groups of all blocks, (row, id, n) rows, meet by id, where Spark sums them;
* semi-join: groups that are frequent in their language go back, as rows, to the blocks that hold them, the
  others' occurrences go;
* merge-join: what is left is joined with itself at the adjacent slot of the same piece, which gives the
  next level's occurrences; their groups are pairs of frequent phrases that share all but the outer words.

Each level's relation is written, sorted, to the shared folder, one row a block and language, its columns packed; the
merge-join runs inside a block, the counts and the semi-join are Spark's. A block is about ``BLOCK_BYTES``
of text, so a row stays small, and a phrase comes into a count once for each block that holds it.

Scores come from the counts of the frequent phrases alone, as every part of a frequent phrase is frequent.
Words and phrases of a language have 64-bit hashes as ids until the frequent ones are named.

Defined results: a null text is empty; a null language is `und`, which is the same as a language of that name; a text
of many blocks' size makes one large block; repeated rows count as often as they come; ties in the report
follow (score, count, phrase in byte order), and phrases are distinct in a language, so ranks are unique. Only `text` and `lang` are
read, whatever other columns there are. Empty table: no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comparo.llm import words as W
from comparo.llm.pieces import chunks_of
from comparo.llm.tables import drop, materialize, scratch_dir, table
from comparo.session import freed_shuffles

MIN_COUNT = 10
MAX_WORDS = 3
INSIDE_PERCENT = 50     # a candidate goes if a longer one around it has so many percent of its count
TOP = 2000
SCALE = 1_000_000
NO_LANG = "und"
BLOCK_BYTES = 16 << 20  # text of a block, all languages together
BATCH = 1 << 16         # rows of a batch that go to Spark at once
SALTS = 64

#: Bytes that end a piece, and bytes of words `[^\x20\x09]+` within it.
ENDS = W._table([*b".,;:!?", *range(0x0A, 0x0E)])
MEMBER = ~(ENDS | W._table(b"\x20\x09"))


# ---- blocks ----

def adjacent(slots: np.ndarray) -> np.ndarray:
    """Merge-join of a sorted relation with itself: places i whose slot + 1 is the slot at i + 1."""
    return np.flatnonzero(slots[1:] == slots[:-1] + 1)


def occurrences(data: np.ndarray, bounds: np.ndarray) -> tuple[W.Words, np.ndarray]:
    """Words of the documents, lower-cased, and their slots from 0: one more from word to word, two more between pieces."""
    words = W.split(W.LOWER[data], bounds, MEMBER)
    ended = np.concatenate([np.zeros(1, np.int64), np.cumsum(ENDS[data])])
    piece = ended[words.start] + words.doc_of_word() if len(words.start) else np.zeros(0, np.int64)
    parts = np.zeros(len(piece), np.int64)
    parts[1:] = np.cumsum(piece[1:] != piece[:-1])
    return words, np.arange(len(piece)) + parts


def packed(values: np.ndarray | bytes) -> bytes:
    """Compressed bytes; of integers byte by byte of all values, the lowest first, as the upper ones are much alike."""
    if not isinstance(values, bytes):
        values = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(values)


def unpacked(raw: pa.BinaryScalar, kind=None):
    out = zstandard.ZstdDecompressor().decompress(raw.as_buffer())
    if kind is None:
        return out
    rows = np.frombuffer(out, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(rows.T).view(kind).ravel()


def word_ids(words: list[bytes], lang: str) -> np.ndarray:
    """64-bit ids of the distinct words of a language."""
    def hashes(parts: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        return W.Words(data, ends, starts, ends, ends).hashes()
    return W.mix(hashes(words) + W.mix(hashes([lang.encode() + b"."])))


def pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(left.copy()) * np.uint64(3) + right)


class Gathered:
    """Word occurrences of one language, chunk after chunk."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.slots: list[np.ndarray] = []
        self.groups: list[np.ndarray] = []
        self.next = 0

    def add(self, raw: np.ndarray, lengths: np.ndarray, slots: np.ndarray) -> None:
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        distinct = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        own = [self.words.setdefault(w, len(self.words)) for w in distinct.dictionary.to_pylist()]
        self.groups.append(np.array(own, np.int32)[distinct.indices.to_numpy()])
        self.slots.append((slots - slots[0] + self.next).astype(np.int32))
        self.next = int(self.slots[-1][-1]) + 2


#: A level's relation: counts of the groups; slot steps and groups of the occurrences, sorted. What groups are: on level 1
#: words, with their ids; later `left` and `right`, places among the frequent groups of the level before, which are
#: told in `told_ids` and, for their names, `told_words` or `told_left` and `told_right` (ids).
_RELATION = ["row long", "lang string", "size long", "counts binary", "steps binary", "groups binary", "ids binary",
             "words binary", "left binary", "right binary", "told_ids binary", "told_words binary", "told_left binary",
             "told_right binary"]
_NAMES = [c.split()[0] for c in _RELATION]


def _row(row: int, lang: str, size: int, **columns) -> pa.RecordBatch:
    kind = {"row": pa.int64(), "lang": pa.string(), "size": pa.int64()}
    values = {"row": row, "lang": lang, "size": size} | {c: packed(v) for c, v in columns.items() if v is not None}
    return pa.RecordBatch.from_arrays([pa.array([values.get(c)], kind.get(c, pa.binary())) for c in _NAMES], names=_NAMES)


def word_occurrences(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The relation of level 1; `size` is its number of occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held, size = TaskContext.get().partitionId() << 32, {}, 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal row
            for lang, own in held.items():
                groups, slots, words = np.concatenate(own.groups), np.concatenate(own.slots), list(own.words)
                yield _row(row, lang, len(groups), ids=word_ids(words, lang), words=b"\n".join(words),
                           counts=np.bincount(groups, minlength=len(words)).astype(np.int32),
                           steps=np.diff(slots, prepend=np.int32(0)), groups=groups)
                row += 1

        for batch in batches:
            for i, j, data, bounds in chunks_of(batch.column("text")):
                words, slots = occurrences(data, bounds)
                langs = batch.column("lang")[i:j].dictionary_encode()
                of_word = langs.indices.to_numpy()[words.doc_of_word()]
                lengths = words.end - words.start
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    own = np.flatnonzero(of_word == k)
                    if len(own):
                        n = lengths[own]
                        ends = np.cumsum(n)
                        raw = words.data[np.repeat(words.start[own] - (ends - n), n) + np.arange(ends[-1])]
                        held.setdefault(lang, Gathered()).add(raw, n, slots[own])
                size += len(data)
                if size >= block_bytes:
                    yield from closed()
                    held, size = {}, 0
        yield from closed()

    return docs.mapInArrow(run, ", ".join(_RELATION))


def _of(table, column: str, kind=None, at: int = 0):
    """A packed value of a row; None if the level has none."""
    value = table.column(column)[at]
    return unpacked(value, kind) if value.is_valid else None


def _ids(table, at: int = 0) -> np.ndarray:
    """The ids of a row's groups."""
    own = _of(table, "ids", np.uint64, at)
    if own is not None:
        return own
    told = _of(table, "told_ids", np.uint64, at)
    return pair_ids(told[_of(table, "left", np.int32, at)], told[_of(table, "right", np.int32, at)])


def groups_of(relation: DataFrame) -> DataFrame:
    """(row, id, n) of every group of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.column("row").to_pylist()):
                ids, counts = _ids(batch, at).view(np.int64), _of(batch, "counts", np.int32, at)
                order = np.argsort(ids)     # neighbours are alike, so the shuffle packs them better
                ids, counts = ids[order], counts[order]
                for i in range(0, len(ids), BATCH):
                    n = len(ids[i:i + BATCH])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, row)), pa.array(ids[i:i + n]), pa.array(counts[i:i + n])], names=["row", "id", "n"])

    return relation.select("row", "ids", "told_ids", "left", "right", "counts").mapInArrow(run, "row long, id long, n int")


def frequent_groups(relation: DataFrame, min_count: int) -> DataFrame:
    """(row, id, a) of the groups that come `min_count` times or more, a, in all rows."""
    summed = groups_of(relation).withColumn("a", F.sum("n").over(Window.partitionBy("id")))
    return summed.where(F.col("a") >= min_count).select("row", "id", "a")


def extended(relation: DataFrame, frequent: DataFrame, last: bool = False) -> DataFrame:
    """The next level's relation, from the occurrences of the `frequent` groups (row, id) of `relation`; after the
    last level, no occurrences but the frequent groups alone."""
    def run(own: pa.Table, groups: pa.Table) -> pa.Table:
        if not own.num_rows or not groups.num_rows:
            return pa.Table.from_batches([], schema=_row(0, "", 0).schema)
        ids, all_groups, words = _ids(own), _of(own, "groups", np.int32), _of(own, "words")
        kept = np.flatnonzero(np.isin(ids.view(np.int64), groups.column("id").to_numpy()))
        told = {"told_ids": ids[kept]}
        if words is not None:
            words = words.split(b"\n")
            told["told_words"] = b"\n".join([words[k] for k in kept])
        else:
            before = _of(own, "told_ids", np.uint64)
            told |= {f"told_{side}": before[_of(own, side, np.int32)[kept]] for side in ("left", "right")}
        dense = np.full(len(ids), -1, np.int64)
        dense[kept] = np.arange(len(kept))
        inside = dense[all_groups] >= 0
        slots, at_groups = np.cumsum(_of(own, "steps", np.int32))[inside], dense[all_groups[inside]]
        at = adjacent(slots[:0] if last else slots)
        keys, joined, counts = np.unique(at_groups[at] * len(kept) + at_groups[at + 1], return_inverse=True, return_counts=True)
        return pa.Table.from_batches([_row(
            own.column("row")[0].as_py(), own.column("lang")[0].as_py(), len(at), counts=counts.astype(np.int32),
            steps=np.diff(slots[at], prepend=0).astype(np.int32), groups=joined.astype(np.int32),
            left=(keys // len(kept)).astype(np.int32), right=(keys % len(kept)).astype(np.int32), **told)])

    mine = relation.select("row", "lang", "steps", "groups", "ids", "words", "told_ids", "left", "right")
    return mine.groupBy("row").cogroup(frequent.groupBy("row")).applyInArrow(run, ", ".join(_RELATION))


def told_words(relation: DataFrame) -> DataFrame:
    """(id, lang, word) of the frequent words, from the relation of level 2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ids, words in zip(*batch.columns):
                ids, words = unpacked(ids, np.int64), unpacked(words).split(b"\n")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([lang.as_py()] * len(ids)), pa.array([w.decode() for w in words], pa.string())],
                    names=["id", "lang", "word"])

    return relation.select("lang", "told_ids", "told_words").mapInArrow(run, "id long, lang string, word string").distinct()


def told_pairs(relation: DataFrame) -> DataFrame:
    """(id, left, right) of the frequent phrases, from the relation of the level after theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in zip(*batch.columns):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(c, np.int64)) for c in columns], names=["id", "left", "right"])

    return relation.select("told_ids", "told_left", "told_right").mapInArrow(run, "id long, left long, right long").distinct()


# ---- levels ----

def stored(relation: DataFrame) -> tuple[DataFrame, str]:
    """The relation written in buckets of its rows' numbers, so that only the frequent groups move to meet it; and
    the name of its table."""
    spark, name = relation.sparkSession, f"level_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with freed_shuffles(spark):
        relation.write.bucketBy(buckets, "row").option("compression", "uncompressed").option(
            "path", f"{scratch_dir(spark)}/llm-{name}/level").saveAsTable(name)
    return spark.table(name), name


def frequent_phrases(docs: DataFrame, *, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                     block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, a) of the phrases of up to `max_words` words that come `min_count` times, (lang, n) word counts)."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string"))
    spark = docs.sparkSession
    relation, name = stored(word_occurrences(docs, block_bytes))
    sizes = materialize(relation.groupBy("lang").agg(F.sum("size").alias("n")), "words")
    level, levels = None, []
    for k in range(1, max_words + 1):
        frequent = materialize(frequent_groups(relation, min_count), "groups")
        counts = materialize(frequent.groupBy("id").agg(F.max("a").alias("a")), "counts")
        before = relation, name
        relation, name = stored(extended(relation, frequent.select("row", "id"), k == max_words))
        for done in (before[0], frequent):
            drop(spark, done)
        spark.sql(f"DROP TABLE IF EXISTS {before[1]}")
        if k == 1:
            named = told_words(relation).withColumn("phrase", F.col("word"))
        else:
            heads = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"))
            last = level.select(F.col("id").alias("right"), "word")
            named = told_pairs(relation).join(heads, "left").join(last, "right").withColumn(
                "phrase", F.concat_ws(" ", "head", "word"))
        level = materialize(named.join(counts, "id").select("id", "lang", "word", "phrase", "a"), "frequent")
        levels.append(level.select("lang", "phrase", F.lit(k).alias("words"), "a"))
    drop(spark, relation)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, sizes


def _part(words: Column, start: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words and more, by their lowest-scoring cut."""
    longer = phrases.where("words > 1")
    split = F.split("phrase", " ", -1)
    cut = longer.withColumn("parts", split).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", "words", "a", "cut", _part(F.col("parts"), 1, F.col("cut")).alias("first"),
                     _part(F.col("parts"), F.col("cut") + 1, F.col("words") - F.col("cut")).alias("rest"))
    of = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cut = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    # counts to 10^15, so that products stay exact
    score = F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast({SCALE} as decimal(7,0))) "
                   "div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "words", "a", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "x.words", "x.a", "x.l", "x.r", "x.score")


def _inner(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): the highest count of a longer candidate in which the phrase's words lie contiguously."""
    parts = F.split("phrase", " ", -1)
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda k: F.array_join(F.slice(F.col("parts"), k, n), " "))))
    return phrases.where("words > 2").withColumn("parts", parts).select("lang", "a", F.explode(inside).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, *, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP,
                 inside_percent: int = INSIDE_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of every language."""
    phrases, sizes = frequent_phrases(docs, max_words=max_words, min_count=min_count, block_bytes=block_bytes)
    rows = scored(phrases).join(_inner(phrases), ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < inside_percent * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each of some parts of a language first, so that no task ranks all of its phrases
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    rows = rows.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return rows.where(F.col("rank") <= top).join(sizes, "lang").select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two or three words of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as d,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from words, (values (1), (2), (3)) t(k) where len(w) >= k)),
counts as (select lang, k, phrase, count(*) as a from grams group by all having count(*) >= 10),
sizes as (select lang, sum(len(w)) as n from words group by lang),
cuts as (
  select c.lang, c.k, c.phrase, c.a, j, string_split(c.phrase, ' ') as p
  from counts c, (values (1), (2)) t(j) where c.k > 1 and j < c.k),
scores as (
  select x.lang, x.k, x.phrase, x.a, x.j, f.a as l, g.a as r,
         ((x.a::hugeint * x.a * 1000000) // (f.a::hugeint * g.a))::bigint as score
  from cuts x join counts f on f.lang = x.lang and f.phrase = array_to_string(x.p[1:x.j], ' ')
              join counts g on g.lang = x.lang and g.phrase = array_to_string(x.p[x.j + 1:], ' ')),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (
  select lang, phrase, max(a) as most from (
    select lang, a, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') as phrase
    from counts, (values (1), (2)) t(i) where k = 3) group by all),
kept as (
  select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase
  where b.k = 3 or i.most is null or 100 * i.most < 50 * b.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n::bigint as n, score from ranked join sizes using (lang) where rank <= 2000
"""
