"""The stages of the pipeline, one by one, against brute force."""

from collections import Counter

import numpy as np
import pytest
from test_corpus_queries import linked

import corpus_pipeline
from tablemill.llm import partenum
from tablemill.llm.common import table


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages():
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line", "n-gram", "mixing", "BPE",
    ]


def test_toxic_documents_go(spark, docs, sf):
    left = stage("toxicity")(spark, docs, sf)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    labels = table(spark, sf, "labels").collect()
    gone = {t: [x.doc_id not in ids for x in labels if x.toxic == t] for t in (0, 1)}
    assert sum(gone[1]) / len(gone[1]) > 0.8 and sum(gone[0]) / len(gone[0]) < 0.03


def test_near_copies_go(spark, docs, sf):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = stage("n-gram Jaccard join")(spark, docs.unionByName(docs.limit(3)), sf)
    assert left.columns == docs.columns
    classes = linked(rows, 5, 80, 100)
    assert Counter(r.doc_id for r in left.collect()) == Counter({c for _, c in classes.values()})


def test_boilerplate_goes(spark, docs, sf):
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in stage("line dedup")(spark, docs, sf).collect()}
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert sum(after[i].text != before[i].text for i in after) > 50
    for i, r in after.items():
        assert not Counter(r.text.split("\n")) - Counter(before[i].text.split("\n"))


def test_mix_and_run(spark, docs, sf):
    mixed = stage("mixing sources to target weights")(spark, docs, sf)
    assert mixed.columns == docs.columns
    ids = [r.doc_id for r in mixed.collect()]
    assert len(ids) == len(set(ids)) and 0.75 * docs.count() < len(ids) < docs.count()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 100 < out.count() < 200


def test_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """Nodes that sketches tell apart leave their star; linked ones of the same star stay in one."""
    passage = " ".join(f"p{j}" for j in range(120))
    rows = [(k, f"{passage} " + " ".join(f"o{k}x{j}" for j in range(280))) for k in range(60)]
    rows += [(100 + k, f"{rows[k][1]} end") for k in range(3)]
    asked, compare = [], partenum.compare

    def counting(pairs, *rest):
        asked.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(partenum, "compare", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in partenum.link(docs, corpus_pipeline.NEAR).collect()}
    assert got == {k: k % 100 for k, _ in rows}
    # Of 60 texts with a passage in common, three have a copy.
    assert 3 <= sum(asked) <= 6


def test_sketches_part_no_linked_sets(spark):
    like, draw = corpus_pipeline.NEAR, np.random.default_rng(5)
    sets = [draw.integers(0, 1 << 63, draw.integers(1, 900)).astype(np.uint64) for _ in range(40)]
    sets += [np.concatenate([s[len(s) // 8 :], s[:3] + np.uint64(1)]) for s in sets]
    sets = [np.unique(s) for s in sets]
    size = np.array([len(s) for s in sets])
    raw = partenum.sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size)
    near = partenum.may_link(size, [np.frombuffer(s, np.uint64) for s in raw], like)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if i != j and 100 * both >= 80 * (len(a) + len(b) - both):
                assert near[i, j]
    assert (near == near.T).all() and near.sum() < 0.1 * near.size
    # A star falls into its connected parts.
    node = np.arange(len(sets), dtype=np.int64) * 7
    centres, others = partenum.parted(node, near)
    for c, x in zip(centres, others, strict=True):
        assert c != x
    reach = {int(x): int(x) for x in node}
    for c, x in zip(centres, others, strict=True):
        reach[x] = c
    assert all(reach[int(node[i])] == reach[int(node[j])] for i, j in zip(*np.nonzero(near), strict=True))


def test_large_stars_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(partenum, "STAR_NODES", 2)
    stars = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (8, 9), (8, 7)], "c long, x long")
    values = np.arange(1, 301, dtype=np.uint64)
    (sketch,) = partenum.sketches(values, np.zeros(300, int), np.array([300]))
    rows = [(k, 300, sketch if k < 9 else bytes(len(sketch))) for k in range(1, 10)]
    sets = spark.createDataFrame(rows, "node long, size long, sketch binary")
    got = partenum.split_stars(stars, sets, corpus_pipeline.NEAR).collect()
    assert {(r.c, r.x) for r in got} == {(1, 2), (1, 3), (1, 4), (7, 8)}


def test_copies_and_repeats_stay_once(spark):
    long = " ".join(f"w{j}" for j in range(90))
    rows = [(1, long), (2, long), (2, long), (3, f"{long} end"), (None, long), (4, "a b"), (4, "a b")]
    rows += [(5, None), (5, None), (None, None), (None, None), (6, ""), (7, "own text"), (4, "c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = stage("n-gram Jaccard join")(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(
        {*rows} - {(2, long), (3, f"{long} end"), (1, long), (None, long)}
        | {r[:2] for r in left.where("length(text) > 100").collect()}
    )
    assert left.where("length(text) > 100").count() == 1
