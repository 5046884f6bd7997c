"""Nearest neighbours and near-duplicate embeddings."""

import numpy as np
import pyspark.sql.functions as F

from glyphaudit.llm import ann, embedding_dup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def vectors(seed, n=300, width=12):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, width))
    base[50:90] = base[50] + 0.08 * r.standard_normal((40, width))   # close ones, some at the threshold
    base[100:105] = base[100]                                      # copies
    base[110] = 3 * base[111]
    return base.astype(np.float32)


BAD = [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [float("nan")] + [1.0] * 11), (9004, [None] + [1.0] * 11), (9005, [float("inf")] + [1.0] * 11),
       (9006, [1.0, 2.0]), (9100, None)]


def test_near_duplicate_vectors_equal_brute_force(spark):
    x = vectors(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD + [(3, x[3].tolist())]
    u = x.astype(np.float64)
    u = np.concatenate([u, u[3:4]])
    ids = [*range(len(x)), 3]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    same = np.arange(len(u))
    for _ in range(30):
        same = np.array([same[link[i]].min() for i in range(len(u))])
    for cells, block in ((64, 8192), (8, 20), (1, 7)):
        got = ed.near_duplicate_vectors(table(spark, rows), cells=cells, block=block).collect()
        assert len(got) == len(rows)
        want = sorted((ids[i], int(link[i].sum()) - 1, ids[same[i]], ids[same[i]] == ids[i]) for i in range(len(u)))
        assert sorted(tuple(r) for r in got if r.vec_id < 9000) == want
        assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id >= 9000)
    assert ed.near_duplicate_vectors(table(spark, [])).count() == 0


def test_cells_lose_no_pair():
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = ed.spherical_k_means(x, 20)
    home, may = ed.visits(x, centres, 0.95)
    i, j = np.nonzero(x @ x.T >= 0.95)
    assert may[i, home[j]].all() and may.mean() < 0.6


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    best = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), d[j]) for j in best]


def test_search_recall(spark):
    x = vectors(2, 1200, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD + [(5, x[5].tolist())]
    for size, queries in ((32_768, 2048), (150, 4)):
        got = ann.search(table(spark, rows), F.col("vec_id") % 50 == 0, rows=size, queries=queries).collect()
        wide, ids, hits = x.astype(np.float64), np.arange(len(x)), 0
        for q in range(0, 1200, 50):
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            want = brute(wide, ids, q, 10)
            assert [m[0] for m in mine] == list(range(1, 11)) and q not in [m[1] for m in mine]
            assert all(abs(m[2] - np.sqrt(((wide[m[1]] - wide[q]) ** 2).sum())) < 1e-12 for m in mine)
            assert [m[2] for m in mine] == sorted(m[2] for m in mine)
            hits += len({m[1] for m in mine} & {w[0] for w in want})
        assert hits >= 0.9 * 240
        assert {r.query_id for r in got} == set(range(0, 1200, 50))


def test_search_small_tables(spark):
    few = table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (100, [0.0, 0.0]), (200, [1.0, 1.0, 1.0])])
    got = sorted(tuple(r) for r in ann.search(few, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 2, 0.0), (0, 2, 1, float(np.sqrt(2)))]
    assert ann.search(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_search_counts_repeated_rows_once(spark):
    """A row near the query is stored 30 times; the other neighbours stay."""
    x = vectors(6, 200, 12)
    x[7] = x[0] + np.float32(0.001)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    alone = sorted(tuple(r) for r in ann.search(table(spark, rows), F.col("vec_id") == 0).collect())
    assert len(alone) == 10 and alone[0][2] == 7
    for size in (32_768, 60):
        assert sorted(tuple(r) for r in ann.search(table(spark, rows + 30 * [rows[7]]), F.col("vec_id") == 0, rows=size).collect()) == alone


def test_index_finds_the_whole_radius():
    r = np.random.default_rng(4)
    codes = r.integers(0, 256, (500, 4)).astype(np.uint8)
    index = ann.Index(codes)
    for radius, s in ((3, 0), (7, 1), (11, 2), (6, 1)):
        want = np.flatnonzero(ann._BITS[codes ^ codes[0]].sum(axis=1) <= radius)
        assert np.array_equal(index.within(codes[0], s, radius), want)
