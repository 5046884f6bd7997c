"""Quality: n-grams and ratios against plain Python, the descent against its optimum, held-out accuracy, defined cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphaudit.llm import quality as ql
from glyphaudit.llm.words import mix


def bucket(gram):
    key = (int.from_bytes(gram, "big") + (len(gram) << 40)) & (1 << 64) - 1
    return int(mix(np.array([key], np.uint64))[0]) >> (64 - ql.BITS)


def plain_grams(text):
    return sorted({bucket(text[i:i + n]) for n in range(1, ql.ORDER + 1) for i in range(len(text) - n + 1)})


@pytest.mark.parametrize("chunk", [1 << 19, 5])
def test_grams(monkeypatch, chunk):
    monkeypatch.setattr(ql, "CHUNK", chunk)
    r = random.Random(1)
    texts = [b"", b"a", b"abc", "né".encode(), b"", bytes(r.randrange(97, 100) for _ in range(60)), b"xy"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    row, found = ql.grams(data, offsets)
    assert [found[row == i].tolist() for i in range(len(texts))] == [plain_grams(t) for t in texts]


def test_ratios():
    texts = [np.array(t) for t in ([1, 2, 3], [2, 3], [3, 9], [9])]
    r = ql.ratios(texts, np.array([True, True, False, False]))
    p, q = {1: 1, 2: 2, 3: 2}, {3: 1, 9: 2}
    for g in (1, 2, 3, 9):
        want = math.log((1 + p.get(g, 0)) / (4 + 5)) - math.log((1 + q.get(g, 0)) / (4 + 3))
        assert r[g] == pytest.approx(want)
    assert r[5] == 0


def test_descent_reaches_the_optimum():
    """The duality gap closes: primal and dual objective meet."""
    chance = np.random.default_rng(2)
    good = chance.random(80) < 0.5
    rows = []
    for g in good:
        v = chance.standard_normal(6) + (0.7 if g else -0.7)
        rows.append((np.arange(6), v / np.linalg.norm(v)))
    w, alpha = ql.descend(rows, good, rounds=2000)
    y = np.where(good, 1, -1)
    margins = np.array([w[at] @ v for at, v in rows]) * y
    primal = w @ w / 2 + np.maximum(0, 1 - margins).sum()
    dual = alpha.sum() - w @ w / 2
    assert primal - dual < 0.02 * primal and (alpha >= 0).all() and (alpha <= ql.COST).all()
    assert np.allclose(w[:6], sum(a * s * v for a, s, (_, v) in zip(alpha, y, rows)))


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    rows = ql.op11_nb_support_vectors(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([[a > b for b in bad] for a in good])
    assert auc > 0.93
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0


def test_held_out_labels_do_not_matter(spark, sf):
    documents, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(ql.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ql.train(documents, labels), ql.train(documents, turned)
    assert (one.weights == two.weights).all() and (one.slope, one.bias) == (two.slope, two.bias)


def test_defined_cases(spark, documents):
    rows = [(i, ("clear words here " if i % 2 else "### !! $$ ") * 5 + str(i), "en") for i in range(60)]
    rows += [(100, None, None), (101, "", None), (101, "", "en"), (None, "clear words", "en"), (102, "long " * 300_000, "en")]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 1), (4, None, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    model = ql.train(docs, labels, fold=False)
    got = {r.doc_id: r for r in ql.score(docs, model, 0.3).collect()}
    assert len(got) == 64 and got[100].score == got[101].score
    assert all(got[i].predicted == i % 2 for i in range(60))
    assert got[None].predicted == 1
    assert ql.score(documents([]), model, 0.3).count() == 0
    for some, score in ((labels.where("false"), 0), (labels.where("quality = 1"), 1)):   # no labels; one class
        flat = {r.score for r in ql.score(docs, ql.train(docs, some, fold=False), 0.3).collect()}
        assert len(flat) == 1 and flat.pop() == pytest.approx(score, abs=1e-9)


def test_long_texts_in_chunks(monkeypatch):
    chance = np.random.default_rng(4)
    model = ql.Model(chance.standard_normal(ql.BUCKETS), chance.random(ql.BUCKETS), 1.0, 0.1)
    data = chance.integers(97, 123, 3 << 20, dtype=np.uint8)
    whole = model.scores(data, np.array([0, 10, len(data)]))
    monkeypatch.setattr(ql, "CHUNK", 1 << 16)
    assert np.allclose(whole, model.scores(data, np.array([0, 10, len(data)])))
