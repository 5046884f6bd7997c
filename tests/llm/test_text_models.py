"""Language identification and toxicity."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from glyphaudit.llm import language_id as li, toxicity as tox

EN = "the quick brown fox jumps over the lazy dog and then it runs away from the house with the others"
DE = "der schnelle braune Fuchs springt über den faulen Hund und läuft dann mit den anderen vom Haus weg"


def sentences(base, n, seed):
    r, words = random.Random(seed), base.split()
    return [" ".join(r.choice(words) for _ in range(r.randint(3, 40))) for _ in range(n)]


def code_length(train, text, order):
    """PPM by dictionaries: trained on texts, no exclusions, escape D / (T + D)."""
    counts = defaultdict(Counter)
    for t in train:
        for i in range(len(t)):
            for k in range(min(i, order) + 1):
                counts[t[i - k:i]][t[i]] += 1
    bits = 0.0
    for i, b in enumerate(text):
        for k in range(min(i, order), -1, -1):
            c = counts.get(text[i - k:i])
            if not c:
                continue
            total, kinds = sum(c.values()), len(c)
            if b in c:
                bits -= math.log2(c[b] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    train = {"en": sentences(EN, 12, 1), "de": sentences(DE, 12, 2)}
    rows = spark.createDataFrame([(t, k) for k, ts in train.items() for t in ts], "text string, label string")
    model = li.train(rows, order=3)
    texts = [x.encode() for x in [*sentences(EN, 5, 3), *sentences(DE, 5, 4), "", "zz\x00ü", "a", "日本語", "x" * 70]]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for limit in (7, 64, 1 << 18):
        got = li.code_lengths(model, data, offsets, limit)
        want = [[code_length([t.encode() for t in train[k]], x, 3) for k in model.languages] for x in texts]
        assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_language_defined_cases(spark, documents):
    rows = [(i, t, "en") for i, t in enumerate(sentences(EN, 30, 5))] + [(100 + i, t, "de") for i, t in enumerate(sentences(DE, 30, 6))]
    odd = [(200, None, "en"), (201, "", None), (202, "123 !?", "en"), (203, EN * 3000, None), (3, rows[3][1], "en"), (None, DE, "de"), (204, "\x00\x01", None)]
    model = li.train_on_fold(documents(rows + odd))
    found = {r.doc_id: r for r in li.predict(documents(rows + odd), model).collect()}
    assert li.predict(documents(rows + odd), model).count() == len(rows) + len(odd)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (200, 201, 202, 204))
    assert found[203].lang_pred == "en" and found[None].lang_pred == "de"
    assert sum(found[i].lang_pred == k for i, _, k in rows) >= 58
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = li.keep_identified(documents(rows + odd), model)
    assert kept.columns == documents(rows).columns
    assert {r.doc_id for r in kept.collect()} == set(found) - {200, 201, 202, 204}
    nothing = li.train_on_fold(documents([]))
    assert [r.lang_pred for r in li.predict(documents(rows[:2]), nothing).collect()] == ["und"] * 2
    assert li.predict(documents([]), model).count() == 0


def test_nnpu_finds_marked_texts():
    r = random.Random(3)

    def text(bad):
        found = {r.randrange(2000) for _ in range(40)}
        if bad:
            found |= {2000 + r.randrange(5) for _ in range(2)}
        return np.array(sorted(found))

    positive, unlabelled = [text(True) for _ in range(300)], [text(r.random() < 0.1) for _ in range(2000)]
    model = tox.fit(positive, unlabelled, 0.1)
    assert set(model.hashes.tolist()) >= set(range(2000, 2005)) and (model.weights[model.hashes >= 2000] > 0).all()

    def score(t):
        at = model.slots[t]
        return model.bias + model.weights[at[at >= 0]].sum()

    assert np.mean([score(text(True)) > 0 for _ in range(300)]) > 0.8
    assert np.mean([score(text(False)) > 0 for _ in range(300)]) < 0.05


def test_toxicity_defined_cases(spark, documents):
    r = random.Random(5)
    rows = [(i, t + (" scumbag moronic" if i % 8 == 0 else ""), "en") for i, t in enumerate(sentences(EN, 400, 8))]
    odd = [(1000, None, None), (1001, "", None), (1002, "Scumbag MORONIC " * 5, None), (8, rows[8][1], "en"), (None, "moronic", None)]
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400) if r.random() < 0.8] + [(8, 0, 1), (None, 1, 1), (3, 0, None)],
                                   "doc_id long, quality int, toxic int")
    docs = documents(rows + odd)
    model = tox.train(docs, labels)
    found = tox.score(docs, model).collect()
    assert len(found) == 405 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in found)
    by = {x.doc_id: x.predicted for x in found}
    assert by[1000] == by[1001] == 0 and by[1002] == 1
    assert all(by[i] == (i % 8 == 0) for i in range(400))
    kept = tox.keep_clean(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, p in by.items() if not p}
    none = tox.train(docs, labels.where("false"))
    assert [x.predicted for x in tox.score(docs, none).collect()] == [0] * 405
    assert tox.score(documents([]), model).count() == 0
