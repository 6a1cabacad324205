"""Brown classes of rare words against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablemill.llm import brown
from tablemill.llm.text import pieces


def key_of(word):
    """A word's key and spelling group; None is the end."""
    piece = next(pieces(pa.array([word or ""])))
    keys, groups, _ = brown.tokens(piece)
    return int(keys[0]), int(groups[0])


@pytest.fixture(scope="module")
def texts():
    """Words of two kinds take turns; two rare ones of either kind end alike."""
    pick = random.Random(6)
    rows = []
    for k in range(500):
        words = [f"{'pq'[i % 2]}{pick.randrange(10)}" for i in range(40)]
        if k < 3:
            words[10], words[21] = "aaxyz", "bbxyz"
        words[30:30] = [f"once{k}", f"only{k}"]
        rows.append(" ".join(words))
    return [*rows, "", None]


@pytest.fixture(scope="module")
def frame(spark, texts):
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_rare_words_move_one_by_one(frame, texts, monkeypatch):
    monkeypatch.setattr(brown, "FLUSH_AT", 500)
    count = Counter(w for t in texts for w in [*(t or "").split(), None])
    n = sum(count.values())
    often = sorted(key_of(w)[0] for w, c in count.items() if c >= n * brown.UNIT_SHARE)
    units = brown.Units(np.array(often))
    only = frame.select("text")
    classes, both = brown.exchange(brown.count_unit_pairs(only, units), units.size)
    contexts = brown.count_contexts(only, units, classes)
    got = {r.key: r for r in brown.best_classes(contexts, units, classes, both).collect()}

    def first_class(word):
        key, group = key_of(word)
        return int(classes[units.of(np.array([key]), np.array([group]))[0]])

    size = both.sum(0) + both.sum(1)
    first = {w: first_class(w) for w in count}
    before, after = {}, {}
    for t in texts:
        row = [None, *(t or "").split(), None]
        for a, b in zip(row[:-1], row[1:], strict=True):
            before.setdefault(b, Counter())[first[a]] += 1
            after.setdefault(a, Counter())[first[b]] += 1
    rare = [w for w, c in count.items() if c < n * brown.UNIT_SHARE]
    assert {key_of(w)[0] for w in rare} == set(got) and len(rare) > 1000
    for w in rare:
        gain = [
            sum(k * math.log(both[b, c] + 0.1) for b, k in before[w].items())
            + sum(k * math.log(both[c, a] + 0.1) for a, k in after[w].items())
            - count[w] * math.log(size[c] + 1)
            for c in range(brown.CLASSES)
        ]
        row = got[key_of(w)[0]]
        assert row.n == count[w] and gain[row.cls] == pytest.approx(max(gain))


def test_words_that_end_alike_part(frame):
    assert key_of("aaxyz")[1] == key_of("bbxyz")[1]
    _, table = brown.fit(frame)
    cls = {r.key: r.cls for r in table.collect()}
    assert cls[key_of("aaxyz")[0]] != cls[key_of("bbxyz")[0]]


@pytest.mark.parametrize("share", [2.0**-20, 2.0**-8, 1.0])
def test_score_equals_a_plain_loop(spark, frame, texts, share, monkeypatch):
    """However many words are looked up by a join."""
    monkeypatch.setattr(brown, "TABLE_SHARE", share)
    model, table = brown.fit(frame)
    asked = [*texts[:20], "p1 unseen aaxyz bbxyz unheard q1", "unseen unseen", "", None]
    got = brown.score(
        spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, table
    ).collect()
    assert len(got) == len(asked)

    count = Counter(w for t in texts for w in [*(t or "").split(), None])
    own = {r.key: r.cls for r in table.collect()}
    assert len(own) == table.count() == len(count)
    groups = model.frequent.groups

    def class_of(word):
        key, group = key_of(word)
        return own.get(key, int(groups[group]))

    pairs, mass = Counter(), [0.5] * brown.CLASSES
    for t in texts:
        row = [class_of(w) for w in [None, *(t or "").split(), None]]
        pairs.update(zip(row[:-1], row[1:], strict=True))
    for w, c in count.items():
        mass[class_of(w)] += c + 0.5
    follows = Counter()
    for (a, _), c in pairs.items():
        follows[a] += c

    def step(a, b):
        prior = brown.PRIOR * mass[b] / sum(mass)
        return math.log10((pairs[a, b] + prior) / (follows[a] + brown.PRIOR) / mass[b])

    assert np.allclose((10.0**model.transition).sum(1), 1)
    for r in got:
        row = [None, *(asked[r.doc_id] or "").split(), None]
        known = sum(count[w] > 0 for w in row[1:])
        assert (r.n_tokens, r.n_known) == (len(row) - 1, known)
        score = sum(math.log10(count[w] + 0.5) for w in row[1:]) + sum(
            step(class_of(a), class_of(b)) for a, b in zip(row[:-1], row[1:], strict=True)
        )
        assert r.score == pytest.approx(score)
