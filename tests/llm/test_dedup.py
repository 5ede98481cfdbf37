"""Operators 4, 7 and 8 against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from comparo.llm import doubling_dedup, jaccard_skip, suffix_merge
from comparo.llm.doubling_dedup import level_lengths, remove_repeats
from comparo.llm.jaccard_skip import jaccard_components
from comparo.llm.suffix_merge import common_prefix, front_coded, merge_runs, remove_repeated_bytes, splitters_of
from comparo.llm.tables import texts_of

from .corpus import corpus

LARGE = (1 << 63) - 1


def brute_components(rows, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), LARGE), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [3])
def test_jaccard_components(frame, seed):
    rows = corpus(seed)
    assert got(jaccard_components(frame(rows, extra=True)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_jaccard_families_of_near_copies(frame):
    """Long lists: two families close to each other, and members at the border of the similarity."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(120)] = f"v{rnd.randrange(10**6)}"
        if i % 2:
            own[:10] = [f"u{k}" for k in range(10)]
        rows.append((i, " ".join(own)))
    assert got(jaccard_components(frame(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_jaccard_threshold_is_inclusive(frame):
    a = [f"a{k}" for k in range(11)]                       # 7 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1])), (3, " ".join(a[:-2]))]   # 6/7, 5/6 with 2, 5/7 with 1
    assert brute_components(rows) == [(1, 7, 1), (2, 6, 1), (3, 5, 1)]
    assert got(jaccard_components(frame(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def brute_repeats(rows, n=50):
    first = {}
    words = [(LARGE if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            first[key] = min(first.get(key, LARGE), d)
    out = []
    for (d, _), (key, w) in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < key:
                gone[k:k + n] = [True] * n
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"min_words": 20, "base": 4}, {"min_words": 7, "base": 10}])
def test_word_windows(frame, options):
    rows = corpus(5)
    out = remove_repeats(frame(rows, extra=True), **options)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, options.get("min_words", 50))


def test_kept_text_has_the_digest(frame):
    for r in remove_repeats(frame(corpus(6))).where("kept is not null").collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_levels_double():
    assert level_lengths(50) == [25, 50]
    assert level_lengths(100) == [25, 50, 100]
    assert level_lengths(50, 8) == [7, 13, 25, 50]


def brute_bytes(rows, n):
    raw = [(t or "").encode() for _, t in rows]
    times = {}
    for x in raw:
        for k in range(len(x) - n + 1):
            times[x[k:k + n]] = times.get(x[k:k + n], 0) + 1
    out = []
    for (d, _), x in zip(rows, raw):
        gone = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if times[x[k:k + n]] > 1:
                gone[k:k + n] = b"\1" * n
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"length": 90, "gram": 30}, {"length": 90, "gram": 30, "range_bytes": 4000}])
def test_byte_strings(frame, options):
    rows = corpus(9, docs=40)
    out = remove_repeated_bytes(frame(rows, extra=True), **options)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, options.get("length", 400))


def test_a_passage_in_every_document_fills_several_ranges(frame):
    """One gram with more contexts than a range holds: its strings are compared across ranges."""
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = noise(100)
    rows = [(i, noise(80) + passage[: 88 + rnd.randint(0, 12)] + noise(80)) for i in range(120)]
    out = remove_repeated_bytes(frame(rows), length=90, gram=30, range_bytes=2000)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 90)


def test_splitters_cut_only_groups_that_fill_ranges():
    sample = sorted([b"aaa1", b"bbb1", b"bbb2", b"bbb3", b"bbb4", b"ccc1", b"ddd1", b"eee1"])
    borders, hot = splitters_of(sample, 8, 3)
    assert hot == {b"bbb"} and b"bbb2" in borders and b"ccc" in borders


@pytest.mark.parametrize("k", [1, 2, 3, 5, 9])
def test_loser_tree_merge(k):
    rnd = random.Random(k)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 25)))
            for _ in range(k)]
    out = list(merge_runs([front_coded(r) for r in runs]))
    keys = [o[0] for o in out]
    assert keys == sorted(x for r in runs for x in r)
    assert [o[1] for o in out] == ([0] + [common_prefix(a, b) for a, b in zip(keys[:-1], keys[1:])] if keys else [])
    assert all(runs[o[2]][o[3]] == o[0] for o in out)


def test_empty_tables(frame):
    assert jaccard_components(frame([])).collect() == []
    assert remove_repeats(frame([])).collect() == []
    assert remove_repeated_bytes(frame([])).collect() == []


def test_texts_are_fetched_by_id_and_hash(frame):
    """Rows without id share one did; each wanted text comes once a row that has it."""
    rows = [(None, f"text {i}") for i in range(40)] + [(7, "a"), (7, "b"), (7, "b")]
    docs = frame(rows).select(F.coalesce("doc_id", F.lit(LARGE)).alias("did"), "text")
    wanted = docs.select("did", F.xxhash64("text").alias("h"), F.col("text").alias("asked")).where("text <> 'a'").distinct()
    out = texts_of(docs, wanted).collect()
    assert all(r.text == r.asked for r in out)
    assert sorted(r.text for r in out) == sorted(t for _, t in rows if t != "a")


@pytest.mark.parametrize("operator", ["op4", "op7", "op8"])
def test_no_pairs_of_rows_without_id(frame, operator, monkeypatch):
    """The rows that an operator fetches texts into do not grow with the square of the rows without id."""
    rnd = random.Random(8)
    passage = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(90))
    rows = [(None, f"{passage} {i} {rnd.random()}") for i in range(50)] + [(3, passage)] * 3 + [(3, passage + " x")]
    module = {"op4": doubling_dedup, "op7": suffix_merge, "op8": jaccard_skip}[operator]
    fetched = []

    def counted(docs, wanted):
        out = texts_of(docs, wanted)
        fetched.append(out.count())
        return out
    monkeypatch.setattr(module, "texts_of", counted)
    if operator == "op4":
        assert got(remove_repeats(frame(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)
    elif operator == "op7":
        assert got(remove_repeated_bytes(frame(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 400)
    else:
        assert got(jaccard_components(frame(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert fetched and max(fetched) <= len(rows)


def test_open_lists_whose_comparisons_are_known_are_answered(frame, monkeypatch):
    """Hybrids of a boilerplate and a passage, twice each. The first depth leaves all of a centre's members to
    one list more, whose comparisons are all known by then."""
    rnd = random.Random(5)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    boilerplates, passages = [text(48) for _ in range(5)], [text(72) for _ in range(3)]
    texts = [f"{b} {p} {text(2)}" for b in boilerplates for p in passages for _ in range(2)]
    rows = list(enumerate(texts))
    outside, level, left = jaccard_skip.outside_lists, jaccard_skip.level_pairs, [True, True]

    def outside_lists(members):
        if not left[0]:
            return outside(members)
        left[0] = False
        own = members.selectExpr("x", "0L as token", "y as sid", "n", "o", "component")
        centres = members.selectExpr("x", "0L as token", "x as sid", "n_x as n", "n_x as o", "centre_component as component")
        return own.unionByName(centres).distinct().selectExpr("*", "1000L as m")

    def level_pairs(members, percent):
        first, left[1] = left[1], False
        return level(members, percent).where(F.lit(not first))
    monkeypatch.setattr(jaccard_skip, "outside_lists", outside_lists)
    monkeypatch.setattr(jaccard_skip, "level_pairs", level_pairs)
    assert got(jaccard_components(frame(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert left == [False, False]


def test_lists_with_equal_members_give_their_pairs_once(spark):
    """Forty shingles that the same three members share outside their centre are one list, and a pair must still reach
    its overlap after the shingle that it is found by."""
    shared, n = list(range(100, 140)), 100
    members = spark.createDataFrame(
        [(0, y, n, 60, [y, *shared] if y < 3 else [*shared, y], y) for y in (1, 2, 3)],
        "x long, y long, n long, o long, own array<long>, component long")
    lists = jaccard_skip.outside_lists(members)
    assert sorted(map(tuple, lists.select("token", "sid", "p", "m").collect())) == [(100, 1, 1, 3), (100, 2, 1, 3), (100, 3, 0, 3)]
    assert sorted(map(tuple, jaccard_skip.sharing_pairs(lists, 75).collect())) == [(1, 2), (1, 3), (2, 3)]
    late = lists.withColumn("p", F.col("p") + 20)        # 60 + 100 - 60 - 21 shingles do not reach 86
    assert jaccard_skip.sharing_pairs(late, 75).isEmpty()


def test_packed_lists_are_the_plain_ones(spark):
    """Lists outside a centre travel packed; those of a centre with more entries than a task takes as rows. Both ways agree."""
    rnd = random.Random(3)
    rows = [(x, 100 * x + y, 60, 20 + y % 7, sorted(rnd.sample(range(40), rnd.randint(0, 12))), 100 * x + y % 3)
            for x in range(9) for y in range(rnd.randint(1, 9))]
    members = spark.createDataFrame(rows, "x long, y long, n long, o long, own array<long>, component long")
    plain = sorted(map(tuple, jaccard_skip.plain_lists(members).collect()))
    assert plain and plain == sorted(map(tuple, jaccard_skip.packed_lists(members, 4).collect()))
    for entries in (1, 40, 10**6):     # all, some and no centres are wide
        assert sorted(map(tuple, jaccard_skip.outside_lists(members, entries).collect())) == plain
    # a member's place comes once for each of its shingles, packed: no row for each of them is exchanged
    assert "explode" not in jaccard_skip.outside_lists(members)._jdf.queryExecution().toString().lower()


def test_sets_are_packed_and_unpacked():
    rnd = random.Random(4)
    for n in (0, 1, 7, 700):
        own = np.array(sorted({rnd.randrange(1 << 64) for _ in range(n)} | ({0, (1 << 64) - 1} if n == 7 else set())), np.uint64)
        packed = jaccard_skip.packed_set(own)
        assert len(packed) == 8 * len(own) and np.array_equal(jaccard_skip.unpacked_set(packed), own)


@pytest.mark.parametrize("open_", [0, 1000])
def test_open_lists_at_every_depth(frame, monkeypatch, open_):
    """Chains of texts that change a little from one to the next, with a common beginning: the components do not depend
    on how soon open lists give all their pairs; sets are read from the texts once."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows, common = [], [word() for _ in range(60)]
    for chain in range(4):
        words = [word() for _ in range(60)]
        for _ in range(9):
            at = rnd.randrange(60)
            words = words[:at] + [word()] + words[at + 1:]
            rows.append((len(rows), " ".join(common + words)))
    read, whole = [], jaccard_skip.whole_sets
    monkeypatch.setattr(jaccard_skip, "OPEN", open_)
    monkeypatch.setattr(jaccard_skip, "whole_sets", lambda *a: read.append(1) or whole(*a))
    assert got(jaccard_components(frame(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert len(read) == 1


def test_components_take_in_further_links(spark):
    comps = spark.createDataFrame([(2, 1), (3, 1), (8, 7)], "id long, component long")
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert jaccard_skip.merged(comps, links([(2, 3), (7, 8)])) is None
    assert sorted(map(tuple, jaccard_skip.merged(comps, links([(3, 8), (9, 10)])).collect())) == [
        (2, 1), (3, 1), (7, 1), (8, 1), (10, 9)]


def test_pairs_with_whole_sets_travel_in_small_batches(llm, frame, monkeypatch):
    """A pair carries two sets: a task's Arrow batch of pairs is bounded in bytes, and the session keeps its own bound."""
    key, held = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, write = llm.conf.get(key), jaccard_skip.materialize

    def watched(df, name, *codec):
        held.append((name, int(llm.conf.get(key).rstrip("b"))))
        return write(df, name, *codec)

    monkeypatch.setattr(jaccard_skip, "materialize", watched)
    jaccard_skip.jaccard_components(frame(corpus())).collect()
    assert {x for name, x in held if name == "known"} == {jaccard_skip.BATCH_BYTES} and llm.conf.get(key) == before


def test_pairs_by_cells_are_those_by_joins(llm, monkeypatch):
    """Few sets with many pairs: dealt to cells, a set travels to each cell once, and every pair has the same overlap."""
    rnd = random.Random(8)
    sets = {k: np.array(sorted(rnd.sample(range(1, 60), rnd.randint(1, 40))), np.uint64) for k in range(1, 13)}
    stored = llm.createDataFrame([(k, bytearray(jaccard_skip.packed_set(v))) for k, v in sets.items()], "sid long, tokens binary")
    chosen = [(a, b, (a + b) % 3 == 0) for a in sets for b in sets if a != b and rnd.random() < 0.7]
    pairs = llm.createDataFrame(chosen, "a long, b long, star boolean")
    often = np.arange(1, 20).astype(np.uint64)
    keys = jaccard_skip.keys_of(often)
    ranks = llm.sparkContext.broadcast(jaccard_skip.Ranks(keys.view(np.int64), often.view(np.int64)))
    joined, dealt = (sorted(map(tuple, jaccard_skip.overlaps(pairs, stored, ranks, 75, g).collect())) for g in (0, 3))
    assert joined == dealt and len(dealt) == len(chosen)
    assert {(a, b): o for a, b, _, _, _, o, _ in dealt} == {(a, b): len(set(sets[a]) & set(sets[b])) for a, b, _ in chosen}
    monkeypatch.setattr(jaccard_skip, "FEW_PAIRS", 50)
    assert jaccard_skip.cell_groups(90, stored) == 0            # 12 sets in 4 groups would travel 96 times
    assert jaccard_skip.cell_groups(90, stored.limit(3)) == jaccard_skip.CELLS and jaccard_skip.cell_groups(49, stored.limit(3)) == 0


def test_a_depth_reads_the_sets_of_the_depth_before(frame, monkeypatch):
    """All sets are read for the first depth's pairs and once more; what follows goes on with the sets that are left."""
    rnd = random.Random(11)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))
    parts = [[text() for _ in range(3)] for _ in range(4)]
    texts = [" ".join(x) for x in itertools.product(*parts)]
    rows = list(enumerate(texts + [f"{x} again" for x in texts[::7]]))
    read, write = [], jaccard_skip.materialize

    def watched(df, name, *codec):
        if name == "wanted":
            read.append({f.rsplit("/", 2)[1] for f in df.inputFiles()})
        return write(df, name, *codec)
    monkeypatch.setattr(jaccard_skip, "OPEN", 0)
    monkeypatch.setattr(jaccard_skip, "SHORT", 1)
    monkeypatch.setattr(jaccard_skip, "materialize", watched)
    assert got(jaccard_components(frame(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert len(read) > 1 and "sets" in read[0] and not any("sets" in x for x in read[1:])


def test_index_entries_are_packed_by_key():
    """Ints lose their high bytes, keys go as gaps in the order of buckets, and agree with shingles that agree."""
    rnd = random.Random(6)
    values = np.array([rnd.randrange(5000) for _ in range(900)], np.int32)
    assert np.array_equal(jaccard_skip.unpacked(jaccard_skip.packed(values), np.int32), values)
    assert set(jaccard_skip.packed(values)[1800:]) == {0}
    keys = np.sort(jaccard_skip.keys_of(np.array([rnd.randrange(1 << 64) for _ in range(900)], np.uint64)))
    assert int(keys[-1]) < 1 << jaccard_skip.KEY_BITS
    full, where = jaccard_skip._by_key(keys, 7)
    assert full == list(range(7)) and [(w.start, w.stop) for w in where][0][0] == 0 and where[-1].stop == len(keys)
    assert all(int(k) * 7 >> jaccard_skip.KEY_BITS == b for b, w in zip(full, where) for k in keys[w].tolist())
    raw, gaps = keys[where[0]].tobytes(), jaccard_skip.packed_set(keys[where[0]])
    assert np.array_equal(jaccard_skip.unpacked_set(gaps), keys[where[0]]) and gaps.count(0) > raw.count(0)
