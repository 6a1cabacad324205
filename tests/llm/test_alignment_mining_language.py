"""Token alignment, hard negatives and language profiles against brute force."""

import hashlib
import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemill.llm import hyperlang, lockstep, queries, slotmine
from tablemill.llm.text import pieces

SF_DIR = "/root/testdata/sf0.001"

BYTE_BPE, PIECES = queries._vocabulary("byte_bpe_50k.json"), queries._vocabulary("piece_bpe_32k.model")

# Null, empty and odd texts, repeated rows and ids, text that looks like special tokens.
TEXTS = [
    (None, None, None),
    (None, "no id", "en"),
    (1, "", "en"),
    (2, " \n\t 42 !", "de"),
    (3, "A b the cat", "en"),
    (3, "A b the cat", "en"),
    (4, "é😀 naïve 漢字 <|endoftext|> <s> ▁ x", None),
    (5, "<|endoftext|>a<s>b</s> <unk>\u0000z", "fr"),
    (6, "Straße, İstanbul! été  tabs\tand\r\nlines", "fr"),
    (7, "lorem ipsum dolor " * 20_000, "la"),
    (8, "x" * 5_000, "en"),
]


@pytest.fixture
def texts(spark):
    """The rows above, with further columns whose names clash with results."""
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    return frame.selectExpr("*", "1 AS Score", "2 AS n_a", "3 AS pairs", "4 AS row", "5 AS c0", "6 AS GROUPS")


# Token alignment


def aligned(text, known={}):
    """(A ids, B ids, groups, links) of a text by a plain loop over the libraries' whole encodings."""
    if not known:
        known["a"] = Tokenizer.from_file(BYTE_BPE)
        known["a"].encode_special_tokens = True
        known["b"] = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        known["bytes"] = [
            [e.tokens.body[x : x + n].tobytes() for x, n in zip(e.tokens.first, e.tokens.size, strict=True)]
            for e in (lockstep.byte_level(BYTE_BPE), lockstep.pieced(PIECES))
        ]
    a = known["a"].encode(" " + (text or ""), add_special_tokens=False).ids
    b = known["b"].encode(text or "")
    spelled_a, spelled_b = ([one[i] for i in ids] for one, ids in zip(known["bytes"], (a, b), strict=True))
    if not text or not b"".join(spelled_a) == b"".join(spelled_b) == b" " + text.encode():
        return [], [], [], []
    end_of, groups, links, held = {}, [], [], ([], [])
    place = 0
    for i, s in zip(b, spelled_b, strict=True):
        place += len(s)
        end_of[place] = i
    order = list(end_of)[::-1]
    place = 0
    for i, s in zip(a, spelled_a, strict=True):
        place += len(s)
        held[0].append(i)
        if place in end_of:
            while order and order[-1] <= place:
                held[1].append(end_of[order.pop()])
            groups.append(held)
            links.append((i, end_of[place]))
            held = ([], [])
    return a, b, groups, links


def spelled(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)


def expected_alignment(rows):
    parts = [aligned(text) for text in rows]
    counts = Counter(link for *_, links in parts for link in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, groups, links in parts:
        digest = hashlib.sha256(spelled(groups).encode()).hexdigest() if a else ""
        n_best = sum(counts[link] == best[link[1]] for link in links)
        total = sum(counts[link] for link in links)
        out.append((len(a), len(b), len(groups), len(links), n_best, total, digest))
    return out


def test_alignment_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_lockstep(spark, SF_DIR)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    expected = expected_alignment([r.text for r in docs])
    assert Counter(map(tuple, got.collect())) == Counter(
        (r.doc_id, *e) for r, e in zip(docs, expected, strict=True)
    )
    assert sum(e[3] for e in expected) > 50_000


@pytest.mark.parametrize("share", [0.0, 0.01, 2.0])
def test_alignment_of_odd_texts(spark, texts, monkeypatch, tmp_path, share):
    """Counts are the same whether pairs are sent, joined, or some of each."""
    monkeypatch.setattr(lockstep, "SENT_SHARE", share)
    path = str(tmp_path / "aligned")
    lockstep.align(texts, BYTE_BPE, PIECES).toDF(
        *"doc_id lang Score k1 k2 k3 k4 k5 n_a n_b n_groups n_links groups pairs times".split()
    ).write.parquet(path)
    frame = spark.read.parquet(path)
    scored = lockstep.score_links(frame, lockstep.id_count(PIECES))
    assert scored.columns[-2:] == ["n_best", "count_sum"] and len(scored.columns) == 15
    got = Counter(
        (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)
        for r in scored.collect()
    )
    rows = [text for _, text, _ in TEXTS]
    groups = [spelled(aligned(text)[2]) for text in rows]
    expected = Counter(
        (doc, *e[:6], g)
        for (doc, _, _), e, g in zip(TEXTS, expected_alignment(rows), groups, strict=True)
    )
    assert got == expected
    zero = {r.doc_id for r in scored.where("n_a = 0").collect()}
    # The sign that stands for a space in pieces is not in the bytes of B as itself.
    assert zero == {None, 1, 4}


def test_alignment_keeps_clashing_columns_and_empty_tables(spark, texts):
    frame = lockstep.align(texts, BYTE_BPE, PIECES)
    assert frame.columns[:8] == "doc_id lang Score n_a pairs row c0 GROUPS".split()
    own = frame.toDF(*(f"x{i}" for i in range(len(frame.columns))))
    assert {tuple(r)[2:8] for r in own.collect()} == {(1, 2, 3, 4, 5, 6)}
    none = lockstep.align(texts.where("false").select("doc_id", "text"), BYTE_BPE, PIECES)
    assert lockstep.score_links(none, 10).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sé▁漢\u00a0\u3000\t\n !1.<|>") + [" "] * 6), max_size=30)))
def test_words_encode_like_whole_texts(texts):
    piece = next(pieces(pa.array(texts), 1 << 20), None)
    for encoder in (lockstep.byte_level(BYTE_BPE), lockstep.pieced(PIECES)):
        assert encoder.by_words
        if piece:
            found = lockstep.encoded(piece, encoder)
            cuts = found.first.tolist()
            got = [found.ids[x:y].tolist() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            assert [g for g, t in zip(got, texts, strict=True) if t] == encoder.encode([t for t in texts if t])


def test_lanes_do_not_change_the_links(monkeypatch):
    rng = np.random.default_rng(5)
    a, b, first = [], [], [0]
    for size in (0, 1, 7, 3_000, 0, 40):
        base = a[-1] if a else 0
        for ends in (a, b):
            cuts = rng.choice(np.arange(1, max(2 * size, 1)), max(size - 1, 0), replace=False)
            ends += (base + np.sort(np.append(cuts, 2 * size))).tolist() if size else []
        first.append(len(a))
    ends = np.array(a), np.array(b), np.array(first)
    both = sorted(set(a) & set(b))
    for lane in (1, 2, 64, 10_000):
        monkeypatch.setattr(lockstep, "LANE", lane)
        links = lockstep.merge(*ends)
        assert ends[0][links[0]].tolist() == ends[1][links[1]].tolist() == both


# Hard negatives


def mined(rows, is_anchor, how=slotmine.Mining()):
    """Rows (id, label, vector) by plain loops over all pairs."""
    known = {}
    for i, label, vector in sorted(
        (r for r in rows if None not in r and None not in r[2]), key=lambda r: (r[0], r[1], r[2])
    ):
        known.setdefault(i, (label, vector))

    def score(x, y):
        exact = sum(p * q for p, q in zip(x, y, strict=False))
        return max(-(1 << 63), min((1 << 63) - 1, exact))

    out = []
    for i, (label, vector) in known.items():
        if not is_anchor(i):
            continue
        ranked = sorted((-score(vector, v), j, y) for j, (y, v) in known.items() if j != i)
        for s, j, _ in [r for r in ranked if r[2] == label][: how.positives]:
            fits = [
                (-t, k)
                for t, k, y in ranked
                if y != label and how.low * -s <= 100 * -t <= how.high * -s
            ]
            out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(fits[: how.negatives])]
    return Counter(out)


def mine(spark, rows, **options):
    frame = spark.createDataFrame(rows, "id long, label int, vector array<bigint>")
    extra = frame.selectExpr("*", "1 AS anchor", "2 AS score", "3 AS block", "4 AS v", "5 AS rank")
    return Counter(map(tuple, slotmine.mine(extra, F.col("id") % 5 == 0, **options).collect()))


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"ROWS": 16, "ANCHORS": 8, "TILE": 3, "CELL_BLOCKS": 2, "CELL_TASKS": 5}.items():
        monkeypatch.setattr(slotmine, name, value)


@pytest.mark.parametrize("how", [slotmine.Mining(), slotmine.Mining(7, 2, 0, 100), slotmine.Mining(1, 9, 90, 99)])
def test_hard_negatives_equal_all_pairs(spark, small_blocks, how):
    rng = np.random.default_rng(3)
    # Few directions, so that scores tie, within slots and at their limits.
    rows = [(int(i), int(rng.integers(4)), rng.integers(-2, 9, 3).tolist()) for i in range(260)]
    found = mine(spark, rows, how=how)
    assert sum(found.values()) > 100 and found == mined(rows, lambda i: i % 5 == 0, how)


def test_hard_negatives_of_odd_rows(spark, small_blocks):
    big = (1 << 62, 1 << 40, 3)
    rows = [
        *((None, 1, [1, 2]), (1, None, [1, 2]), (2, 1, None), (3, 1, [1, None])),
        # A repeated id, equal rows, vectors of other lengths, negative and huge scores.
        *((5, 1, [4, 4]), (5, 1, [4, 4]), (5, 0, [9, 9, 9]), (6, 0, [4, 4, 1]), (7, 2, [3, 3]), (8, 2, [3, 3])),
        *((10, 1, []), (11, 1, [5]), (12, 2, [2, 1]), (13, 2, [-1, -1]), (15, 3, [-4, -4]), (16, 3, [4, 4])),
        *((20, 4, list(big)), (21, 4, list(big)), (22, 5, [big[0] // 2, 0, 1]), (23, 5, [1 << 31, 1, 1])),
        *((25, 6, [1 << 30, 0, 0]), (26, 6, [1 << 30, 5, 0]), (27, 7, [(1 << 30) - (1 << 29), 7, 0])),
    ]
    # One vector that a third of the rows share.
    rows += [(100 + i, i % 3, [6, 2]) for i in range(60)]
    found = mine(spark, rows)
    assert sum(found.values()) > 20 and found == mined(rows, lambda i: i % 5 == 0)
    assert not mine(spark, [(5, 1, [1]), (6, 2, [1])]) and not mine(spark, [(6, 1, [1])])


def test_hard_negatives_of_an_empty_table(spark):
    assert not mine(spark, [(None, None, None)])
    with pytest.raises(ValueError):
        slotmine.Mining(negatives=0)


# Language profiles


def signs_of(text):
    out = " "
    for c in text or "":
        if unicodedata.category(c)[0] in "LM":
            out += c.lower() if len(c.lower()) == 1 else c
        elif out[-1] != " ":
            out += " "
    return out if out[-1] == " " else out + " "


def bundle(text):
    """The text's vector by one product of signs per letter; None without a letter."""
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return None
    signs = signs_of(text)
    bits = hyperlang.letter_bits(np.array([0 if c == " " else ord(c) for c in sorted(set(signs))]))
    letter = dict(zip(sorted(set(signs)), 1 - 2 * bits.astype(np.int64), strict=True))
    total = np.zeros(hyperlang.DIM, np.int64)
    for (a, b, c), n in Counter(zip(signs, signs[1:], signs[2:], strict=False)).items():
        if b != " ":
            total += n * np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c]
    return total


def expected_languages(learned, asked):
    profiles = {}
    for text, lang in learned:
        one = bundle(text)
        if one is not None and lang is not None:
            profiles[lang] = profiles.get(lang, 0) + one
    out = []
    for text in asked:
        one = bundle(text)
        if one is None or not profiles:
            out.append(("und", 0.0))
            continue
        near = [
            (float(one @ p) / math.sqrt(float(one @ one) * float(p @ p)), lang)
            for lang, p in sorted(profiles.items())
        ]
        best = max(near, key=lambda x: x[0])
        out.append((best[1], max(best[0], 0.0)))
    return out


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_languages_of_odd_texts(spark, texts, monkeypatch, block):
    """The same however many languages are compared at a time, and whatever else there is."""
    monkeypatch.setattr(hyperlang, "BLOCK", block)
    monkeypatch.setattr(hyperlang, "ROWS", 2)
    monkeypatch.setattr(hyperlang, "TRIGRAMS", 7)
    got = hyperlang.predict(texts, hyperlang.learn(texts))
    assert got.columns == "doc_id lang Score n_a pairs row c0 GROUPS lang_pred score".split()
    names = got.toDF(*(f"x{i}" for i in range(10))).collect()
    expected = expected_languages([(t, g) for _, t, g in TEXTS], [t for _, t, _ in TEXTS])
    assert sorted((r[0] or 0, r[8], round(r[9], 4)) for r in names) == sorted(
        (doc or 0, lang, round(s, 4)) for (doc, _, _), (lang, s) in zip(TEXTS, expected, strict=True)
    )
    assert {r[8] for r in names if r[0] in (1, 2)} == {"und"}


def test_languages_without_learning(spark, texts):
    got = hyperlang.predict(texts, hyperlang.learn(texts.where("false")))
    assert {tuple(r)[-2:] for r in got.toDF(*"abcdefghij").collect()} == {("und", 0.0)}
    none = hyperlang.predict(texts.where("false"), hyperlang.learn(texts))
    assert none.count() == 0


def test_language_sums_do_not_depend_on_tasks(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sums = [
        {(r.lang, r.run): tuple(r)[2:] for r in hyperlang.learn(frame).collect()}
        for frame in (docs.coalesce(1), docs.repartition(7))
    ]
    assert sums[0] == sums[1] and len(sums[0]) == 4 * hyperlang.DIM // hyperlang.RUN
    en = sum(bundle(r.text) for r in docs.where("lang = 'en'").collect() if bundle(r.text) is not None)
    assert [x for k in range(hyperlang.DIM // hyperlang.RUN) for x in sums[0]["en", k]] == en.tolist()


def test_languages_of_held_out_documents(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_hyperdimensional(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(lang[r.doc_id], r.lang_pred) for r in got if r.held_out]
    for one in ("en", "de", "fr", "es"):
        recall = [p == one for t, p in held if t == one]
        precision = [t == one for t, p in held if p == one]
        assert len(recall) > 15 and sum(recall) / len(recall) >= 0.97
        assert sum(precision) / len(precision) >= 0.97
