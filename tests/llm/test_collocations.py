"""Operator 12 against brute force and its SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from comparo.llm import collocations as C
from comparo.llm import queries

from .corpus import corpus

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words=3, min_count=10, top=2000, percent=50):
    """rows: (lang, text)."""
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        made = []
        for p, a in own.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in own.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            made.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(made)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def texts(seed=5, n=150):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a", "new", "york", "city", "é", "Éa", "x-y", "it's", "\u0085", "日本"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? "]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), ("fr", " .,\n"), ("xx", "ha ha ha ha ha ha ha ha ha ha ha ha ha"), ("en", "new york city " * 30)] * 2


@pytest.fixture
def table(llm):
    from pyspark.sql import functions as F

    def make(rows, extra=False):
        df = llm.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
        for name in ("word", "words", "block", "group", "left", "id", "a", "n", "phrase", "slot", "rank") if extra else ():
            df = df.withColumn(name, F.lit("x"))
        return df
    return make


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [C.BLOCK_BYTES, 300])
def test_collocations(table, block_bytes):
    rows = texts()
    assert rows_of(C.collocations(table(rows, extra=True), block_bytes=block_bytes)) == brute(rows)


def test_longer_phrases_and_a_short_report(table):
    rows = texts(6)
    got = C.collocations(table(rows), max_words=5, min_count=4, top=7, inside_percent=70)
    assert rows_of(got) == brute(rows, 5, 4, 7, 70)
    rows = [(g, t) for g, (_, t) in zip(["a", "b"] * 200, corpus())]
    assert rows_of(C.collocations(table(rows), max_words=2)) == brute(rows, 2)


def test_overlaps_and_long_texts(table):
    rows = [("e", "ha " * 400_000), ("e", "ho ha " * 9)]
    got = {r[2]: r for r in rows_of(C.collocations(table(rows), max_words=3))}
    assert got["ha ha ha"][3] == 399_998 and "ha ha" not in got
    assert rows_of(C.collocations(table([("e", "ab ab ab, ab. ab")] * 5))) == brute([("e", "ab ab ab, ab. ab")] * 5)


def test_one_language_and_one_phrase_hold_most(table):
    rows = [("en", "same old story")] * 400 + [("de", f"w{i} same old") for i in range(30)]
    assert rows_of(C.collocations(table(rows))) == brute(rows)


def test_empty(table):
    assert C.collocations(table([])).collect() == []
    assert C.collocations(table([(None, None), ("en", "one two")])).collect() == []


def test_large_counts_stay_exact(llm):
    a, wide = 3 * 10**12 + 7, 10**13 + 1
    phrases = llm.createDataFrame([("e", "x y", 2, a), ("e", "x", 1, wide), ("e", "y", 1, a + 5)], "lang string, phrase string, words int, a long")
    row = C.scored(phrases).first()
    assert (row.a, row.l, row.r, row.score) == (a, wide, a + 5, 10**6 * a * a // (wide * (a + 5)))


def test_adjacent():
    assert C.adjacent(np.array([0, 1, 3, 4, 5, 8], np.int32)).tolist() == [0, 2, 3]
    assert C.adjacent(np.zeros(0, np.int32)).tolist() == []


def test_sql(table, llm):
    rows = texts(9)
    docs = table(rows).toPandas()
    con = duckdb.connect()
    con.register("documents", docs)
    got = sorted(con.sql(queries.ORACLE["op12_collocations"]).fetchall())
    assert [tuple(r) for r in got] == brute(rows)
