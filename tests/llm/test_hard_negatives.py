"""Hard negatives: packed products, and the whole search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphaudit.llm import hard_negatives as hn

VECTORS = "vec_id long, label int, embedding array<double>, q int, score int"


@pytest.mark.parametrize("low,high,width", [(-300, 300, 64), (0, 0, 5), (-1, 1, 3), (-5, 9, 1), (-(2 ** 20), 2 ** 20, 16), (-(2 ** 60), 2 ** 60, 4), (3, 7, 0)])
def test_packed_products_are_exact(low, high, width):
    r = random.Random(width)
    v = np.array([[float(r.randint(low, high)) for _ in range(width)] for _ in range(37)]).reshape(37, width)
    a = np.array([[float(r.randint(-400, 400)) for _ in range(width)] for _ in range(11)]).reshape(11, width)
    most = max(int(np.abs(a).sum(axis=1).max(initial=0)), 1)
    packed = hn.pack(v, most)
    words, fields, bits, bias = packed
    assert (hn.unpacked(*packed, 37) == v).all()
    want = [[sum(int(x) * int(y) for x, y in zip(one, two)) for two in v.tolist()] for one in a.tolist()]
    assert hn.products(a, *packed, 37).tolist() == want
    if fields:   # several candidates share a word
        assert words.shape == (width, -(-37 // fields)) and fields * bits <= 53
    # anchors beyond what the fields were made for
    big = a * 2.0 ** 30
    assert hn.products(big, *packed, 37).tolist() == [[x << 30 for x in row] for row in want]


def test_usual_vectors_share_words():
    v = np.floor(256 * np.random.default_rng(1).standard_normal((100, 64)) / 8)
    _, fields, bits, _ = hn.pack(v, 64 * 256)
    assert fields >= 2


def brute(rows, is_anchor):
    rows = list(dict.fromkeys((i, label, tuple(e)) for i, label, e in rows
                              if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)))
    whole = [(i, label, [math.floor(256 * x) for x in e]) for i, label, e in rows]
    out = []
    for i, label, e in whole:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f)), j, m) for j, m, f in whole if j != i and len(f) == len(e))
        hold = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
        for minus, j, _ in [s for s in scored if s[2] == label][:5]:
            p = hold(-minus)
            near = [(-s, n) for s, n, m in scored if m != label and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(i, j, k, n, p, hold(s)) for k, (s, n) in enumerate(near, 1)]
    return sorted(out)


def found(spark, given, is_anchor, **sizes):
    df = spark.createDataFrame([(*r, 1, 2) for r in given], VECTORS).repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(df, is_anchor, **sizes).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST", 1)
    r = random.Random(4)
    rows = []
    for i in range(400):
        centre = r.randrange(4)
        rows.append((i, centre if r.random() < 0.8 else r.randrange(5), [r.gauss(0.2 * (k % 4 == centre), 0.1) for k in range(12)]))
    rows += [rows[0], rows[7], (1000, 1, rows[20][2]), (1001, 2, rows[20][2]), (20, 3, rows[21][2]),     # repeats, ties, an id of two rows
             (2000, None, rows[1][2]), (None, 1, rows[1][2]), (2010, 1, None), (2020, 1, [None] * 12), (2030, 1, [float("nan")] * 12),
             (2040, 1, [float("inf")] + [0.0] * 11), (2050, 1, [0.0] * 12), (2060, 2, []), (2070, 2, []), (2080, 1, [1.0, 2.0]), (2081, 1, [1.0, 1.5]), (2082, 2, [1.0, 1.0])]
    want = brute(rows, lambda i: i % 10 == 0)
    assert found(spark, rows, F.col("vec_id") % 10 == 0, rows=50, anchors=7) == want
    assert found(spark, rows, F.col("vec_id") % 10 == 0) == want
    assert len(want) > 300 and any(x[0] == 2080 for x in want)


def test_large_components(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST", 1)
    r = random.Random(5)
    rows = [(i, i % 3, [r.choice([1.0, 1e3, 1e7, 1e15]) * r.uniform(0.5, 1) for _ in range(4)]) for i in range(60)]
    assert found(spark, rows, F.col("vec_id") % 10 == 0, rows=20, anchors=3) == brute(rows, lambda i: i % 10 == 0)


def test_no_rows(spark):
    assert found(spark, [], F.lit(True)) == []
    assert found(spark, [(0, 1, [0.5, 0.5])], F.lit(True)) == []
    assert found(spark, [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4])], F.lit(True)) == []


def test_blocks_meet_by_number(spark):
    """Block pairs are dealt out by both numbers, whatever their size."""
    rows = [(i, i % 3, [0.1 * (i % 7), 0.2, 0.3]) for i in range(50)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)
    base = df.select("vec_id", F.col("label").cast("long"), "embedding", F.lit(3).alias("width"), F.lit(False).alias("wide"), F.xxhash64("vec_id").alias("key"))
    packed = hn.packed_rows(base, {3: 1000})
    asking = hn.asking_rows(base.withColumn("scores", F.array().cast("array<bigint>")), 20)
    plan = hn.met(packed, asking, False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
