"""The pipeline, stage by stage, against brute force on the smallest tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from comparo.llm import nb_toxicity
from comparo.llm.source_mix import targets
from comparo.llm.tables import materialize, table

from .test_dedup import brute_components
from .test_scores import brute_contamination

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(llm, sf_small):
    """The rows before the first stage and after each."""
    docs = table(llm, sf_small, "documents")
    extra = llm.createDataFrame([(None, None, None, None, None), (990001, "", "en", None, 0), (990002, None, "en", "src1", None),
                                 (0, "another text under a used id", "en", "src1", 1)], docs.schema)
    docs = materialize(docs.unionByName(extra), "input")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(materialize(stage(llm, out[-1], sf_small), name))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_toxicity_drops_what_the_classifier_rejects(llm, stages, sf_small):
    weights = nb_toxicity.learn(stages[0], table(llm, sf_small, "labels"))
    kept = nb_toxicity.score(stages[0], weights).where("score < 0.5")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in pairs(stages[1]))
    labels = {r.doc_id: r.toxic for r in table(llm, sf_small, "labels").collect()}
    before, after = ({d for d, _ in pairs(s)} for s in stages[:2])
    assert sum(labels.get(d) == 0 for d in before - after) <= 0.02 * len(before)


def test_one_document_of_each_group_stays(stages):
    before, after = pairs(stages[1]), pairs(stages[2])
    extra = {d for d, _, c in brute_components(before) if d is not None and d != c}
    assert Counter(map(str, after)) == Counter(str(x) for x in before if x[0] not in extra)


def test_contaminated_documents_go(llm, stages, sf_small):
    before, after = pairs(stages[2]), pairs(stages[3])
    items = [(r.item_id, r.text) for r in table(llm, sf_small, "benchmark").collect()]
    dirty = {d for d, _, hit, _ in brute_contamination(before, items) if hit}
    assert Counter(map(str, after)) == Counter(str(x) for x in before if x[0] not in dirty)


def test_sources_come_near_their_targets(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = Counter()
    for r in before:
        size[r.source] += len((r.text or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets([size[s] for s in order])))
    taken = Counter()
    for r in after:
        taken[r.source] += len(r.text.encode().split())
    smallest = {s: min(len((r.text or "").encode().split()) or 10**9 for r in before if r.source == s) for s in order}
    left = {s: goal[s] - taken[s] for s in order}          # what no document of the source fits into
    assert all(-1 <= left[s] and (left[s] < 0.1 * goal[s] or left[s] < smallest[s]) for s in order), left
    times = Counter(map(str, after))
    assert max(times.values()) <= 2 and set(times) <= set(map(str, before))


def test_every_row_gets_a_shard(stages):
    before, after = stages[4].collect(), stages[5].collect()
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    slots = {}
    for r in after:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(P.SHARDS))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_documents(llm, sf_small, tmp_path):
    for name in ("labels", "benchmark"):
        table(llm, sf_small, name).write.parquet(f"file://{tmp_path}/{name}.parquet")
    docs = table(llm, sf_small, "documents").where(F.lit(False))
    for _, stage in P.STAGES:
        docs = stage(llm, docs, f"file://{tmp_path}")
    assert docs.collect() == []


def test_one_row_of_each_group_stays(frame, llm):
    """Rows without id, repeated rows and an id with two texts, decided row by row."""
    rnd = random.Random(4)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    hot, named, lone, shared = text(80), text(60), text(50), text(70)
    rows = [(None, hot, f"s{i % 2}") for i in range(30)] + [(None, f"{hot} {i}") for i in range(10)]
    rows += [(None, named), (12, named), (11, named), (11, named), (11, named.upper()), (12, named + " x")]
    rows += [(20, shared), (21, shared), (21, text(40)), (30, lone), (30, lone), (30, text(45)), (None, text(30))]
    rows += [(None, ""), (None, ""), (40, None), (40, None)]
    group = {i: c for i, _, c in brute_components([(i, r[1]) for i, r in enumerate(rows)])}
    of = {}
    for i, r in enumerate(rows):
        of.setdefault(group[i], []).append(r)
    after = [(r.doc_id, r.text) for r in P.near_duplicates(llm, frame(rows), "").collect()]
    assert len(after) == len(of)
    for members in of.values():
        ids = [r[0] for r in members if r[0] is not None]
        texts = {r[1] for r in members if r[0] == (min(ids) if ids else None)}
        assert sum((min(ids) if ids else None, t) in after for t in texts) == 1
