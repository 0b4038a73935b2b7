"""Importance resampling, toxicity and hard negatives against brute force and held-out labels, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import hard_negatives, importance, toxicity

R = random.Random(6)
STEMS = ["ka", "lo", "mi", "ru", "é", "ß", "x1", "Tan", "ö9"]
DOCS = "doc_id long, text string, id long, n_words long, score long, label int, key string"


def sentence(n, words=STEMS):
    return " ".join("".join(R.sample(words, 2)) for _ in range(n))


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_crc_algebra():
    whole = [bytes(R.randrange(256) for _ in range(R.choice([0, 1, 5, 60, 700]))) for _ in range(40)]
    crc, size = np.array([zlib.crc32(w) for w in whole], np.uint32), np.array([len(w) for w in whole])
    a, b = np.arange(40), np.array(R.sample(range(40), 40))
    assert importance.combined(crc[a], crc[b], size[b]).tolist() == [zlib.crc32(whole[i] + whole[j]) for i, j in zip(a, b, strict=True)]
    data = np.frombuffer(b"".join(whole), np.uint8)
    ends = np.cumsum(size)
    assert importance.word_crcs(data, ends - size, ends).tolist() == crc.tolist()


def plain_resample(docs, target, share, min_words, least, most, buckets):
    def of(text):
        w = plain_words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for b in of(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, f = of(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((k for k, r in enumerate(rows) if r[1] >= min_words), key=lambda k: (-rows[k][4], rows[k][0] is None, rows[k][0] or 0))
    drawn = order[: len(order) * share[0] // share[1]]
    return [(*r, drawn.index(k) + 1 if k in drawn else None) for k, r in enumerate(rows)]


def same_rows(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.fixture(scope="module")
def corpus():
    docs = [(i, sentence(R.choice([3, 19, 20, 25, 60]))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "long " * 3 + "é" * 300_000 + " " + sentence(40)), (204, "One " + sentence(30).upper())]
    docs += [docs[5]] * 4 + [(None, sentence(30)), (7, sentence(30))]
    return docs


@pytest.mark.parametrize("how", [{"share": (10, 100), "min_words": 20, "least": 1, "most": 1, "buckets": 10_000}, {"share": (1, 2), "min_words": 1, "least": 1, "most": 3, "buckets": 97}, {"share": (1, 1), "min_words": 5, "least": 2, "most": 2, "buckets": 50}])
def test_importance_against_brute_force(spark, corpus, how):
    target = [sentence(12) for _ in range(9)] + [None, ""]
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, "k") for i, t in corpus], DOCS).repartition(3)
    items = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    got = [tuple(r) for r in importance.resample(d, items, **how).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    want = plain_resample(corpus, target, **how)
    assert same_rows([g[:5] for g in got], [w[:5] for w in want])
    ranked = lambda rows: sorted((r[5], r[4], repr(r[0])) for r in rows if r[5] is not None)
    assert ranked(got) == ranked(want)


def test_importance_of_empty_tables(spark, corpus):
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, "k") for i, t in corpus[:9]], DOCS)
    items = spark.createDataFrame([("1", "lomi")], "item_id string, text string")
    assert importance.resample(d.limit(0), items).count() == 0
    none = importance.resample(d, items.limit(0), min_words=1, share=(1, 1)).collect()
    assert len(none) == 9 and sorted(r["rank"] for r in none) == list(range(1, 10))


def insulting(n):
    words = sentence(n).split()
    for _ in range(R.randint(2, 4)):
        words.insert(R.randrange(len(words) + 1), R.choice(["zornak", "blöfix", "Zornak"]))
    return " ".join(words)


def test_toxicity_on_held_out_labels(spark):
    rows = [(i, insulting(R.randint(20, 80)) if i % 6 == 0 else sentence(R.randint(20, 80))) for i in range(900)]
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, "k") for i, t in rows], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(900)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, score int")
    train = F.col("doc_id") < 600
    model = toxicity.fit_toxicity(d.where(train), labels.where(train | F.col("doc_id").isNull()))
    odd = [(1000, None), (1001, ""), (1002, "zo*rn@k " * 3 + sentence(20)), (1003, "w " * 200_000 + "zornak blöfix zornak"), (None, insulting(30)), (5, sentence(30))]
    more = d.unionByName(spark.createDataFrame([(i, t, 1, 2, 3, 4, "k") for i, t in [*odd, *rows[:3]]], DOCS))
    got = [(r["doc_id"], r["score"]) for r in toxicity.toxicity_scores(more, model).collect()]
    assert len(got) == 909 and all(0 <= s <= 1 for _, s in got)
    held = [(i % 6 == 0, s >= 0.3) for i, s in got if i is not None and 600 <= i < 900]
    assert sum(p for t, p in held if t) >= 0.98 * sum(t for t, _ in held) and sum(p for t, p in held if not t) <= 2
    score = dict(got)
    assert score[1000] == score[1001] and score[1001] < 0.3
    assert score[1002] >= 0.3  # read through its disguise
    assert toxicity.toxicity_scores(d.limit(0), model).count() == 0


def test_toxicity_without_what_it_needs(spark):
    d = spark.createDataFrame([(i, sentence(9), 1, 2, 3, 4, "k") for i in range(8)], DOCS)
    for labels, share in (([], 0.5), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 0)], 0.5)):
        model = toxicity.fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["score"] for r in toxicity.toxicity_scores(d, model).collect()} == {share}
    empty = toxicity.text_features(np.zeros(0, np.uint8), np.zeros(2, np.int64), toxicity.Lexicon())
    assert empty.shape == (1, len(toxicity.FEATURES)) and not empty.any()


def test_toxicity_features():
    lexicon = toxicity.Lexicon(toxicity._hashes(["zornak"]), np.zeros(0, np.uint64))
    texts = ["You ZORNAK!! really", "z*0rn@k ok", "aaab zornak"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    x = {n: toxicity.text_features(data, offs, lexicon)[:, k] for k, n in enumerate(toxicity.FEATURES)}
    assert np.allclose(np.expm1(x["log_hits"]), [1, 1, 1]) and np.allclose(np.expm1(x["log_unmasked"]), [0, 1, 0])
    assert np.allclose(x["addressed_share"], [1, 0, 0]) and np.allclose(x["shouted_words"], [1 / 3, 0, 0])
    assert np.allclose(x["exclamations"], [2 / 19, 0, 0]) and np.allclose(x["long_runs"], [0, 0, 1 / 11]) and np.allclose(x["repeated_marks"], [1 / 19, 0, 0])


def plain_negatives(rows, anchor, positives=5, k=3):
    good = {}
    size = max((len(v) for _, v, _ in rows if v), key=lambda n: (sum(len(v) == n for _, v, _ in rows if v), n), default=0)
    for i, v, label in rows:
        if i is not None and label is not None and v and len(v) == size and all(c is not None and math.isfinite(c) for c in v):
            x = [math.floor(256 * c) for c in v]
            good[i] = min(good.get(i, (label, x)), (label, x))
    out = []
    for a in (i for i in good if anchor(i)):
        score = {i: sum(p * q for p, q in zip(x, good[a][1], strict=True)) for i, (_, x) in good.items()}
        near = sorted((i for i in good if i != a and good[i][0] == good[a][0]), key=lambda i: (-score[i], i))[:positives]
        for p in near:
            fit = sorted((i for i in good if good[i][0] != good[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]), key=lambda i: (-score[i], i))[:k]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(fit)]
    return out


@pytest.mark.parametrize("leaf,sample,kind", [(4096, 16_384, "even"), (16, 400, "even"), (8, 300, "grouped"), (8, 200, "copies")])
def test_negatives_against_brute_force(spark, monkeypatch, leaf, sample, kind):
    rng = np.random.default_rng(len(kind) + leaf)
    centres = rng.normal(size=(6, 12))
    v = rng.normal(size=(420, 12)) if kind == "even" else centres[rng.integers(0, 6, 420)] + 0.1 * rng.normal(size=(420, 12))
    if kind == "copies":
        v[rng.random(420) < 0.4] = v[0]
    rows = [(int(i), [float(np.float32(c)) for c in v[i]], int(rng.integers(0, 4))) for i in range(420)]
    rows += [(500, None, 1), (501, [1.0] * 12, None), (502, [float("nan")] * 12, 1), (503, [float("inf")] * 12, 1), (504, [1.0] * 5, 1), (505, [], 1), (None, [1.0] * 12, 1), (506, [None, *[1.0] * 11], 1)]
    rows += [rows[3], (rows[4][0], rows[5][1], 9)]
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    d = spark.createDataFrame([(i, x, label, 1, 2, "v") for i, x, label in rows], "vec_id long, embedding array<float>, label int, id long, score long, v string").repartition(3)
    got = hard_negatives.hard_negatives(d, F.col("id") % 20 == 0, leaf=leaf, sample=sample).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_negatives_of_empty_tables(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [0.9, 1.8], 2)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.hard_negatives(d.limit(0), F.col("id") == 1).count() == 0
    assert hard_negatives.hard_negatives(d, F.col("id") == 9).count() == 0
    assert [tuple(r) for r in hard_negatives.hard_negatives(d, F.col("id") == 1).select("positive_id", "negative_id").collect()] == [(2, 3)]


def test_tree_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(500, 6)))
    tree = hard_negatives.grown(x[:200], float((x * x).sum(axis=1).max()), 16)
    leaf = hard_negatives.leaf_of(tree, x)
    y = hard_negatives._augmented(x, tree.norm2)
    low, high = np.zeros((len(tree.paths), len(tree.points))), np.full((len(tree.paths), len(tree.points)), np.inf)
    for k in set(leaf.tolist()):
        for node in tree.paths[k]:
            d = hard_negatives._distances(y[leaf == k], tree.points[node])
            low[k, node], high[k, node] = d.min(), d.max()
    q = np.floor(256 * rng.normal(size=(40, 6)))
    worst, best = hard_negatives.reach(hard_negatives.Bounds(tree, low, high, np.arange(len(tree.paths) + 1)), q)
    scores = q @ x.T
    assert len(tree.paths) == 16 and (scores <= best[:, leaf]).all() and (scores >= worst[:, leaf]).all()
    assert (best[:, np.unique(leaf)].min() < scores.max())  # some leaves are out of some reach
