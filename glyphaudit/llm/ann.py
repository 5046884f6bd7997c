"""Nearest neighbours by multi-index hashing.

Codes: vectors are centred, turned by rotations learned on a bounded sample (iterative quantisation after principal components) and cut to their
signs. A code is split into bytes, and each byte position has an index of the rows by value. Two codes within Hamming distance
m * (s + 1) - 1 differ by at most s bits in one of the m bytes (pigeonhole), so probing every byte's values within s bits finds all codes
of that radius. A query starts with s = 0. What lies in the radius is ranked by exact distance in double precision; the
distance of the k-th tells by its angle in which radius anything nearer would lie (expected bits plus ``MARGIN`` standard deviations). The radius grows
until it covers that.

Every row is in the index. Rows are dealt into blocks of about ``ROWS`` and queries into blocks of ``QUERIES``; each pair of blocks is a task that
builds its index, and gives out k rows per query at most.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part; only vectors of equal length are compared; with
fewer than k candidates all are returned; equal distances go to the smaller id; rows with the query's id are no candidates; repeated queries are one; repeated
candidate rows count once; ``label`` and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Shared, stored, table
from .vectors import matrix_of, usable

SAMPLE, COMPONENTS, TURNS, LEARN = 20_000, 64, 2, 25
ROWS, QUERIES, NEAREST, MARGIN = 32_768, 2048, 10, 2.5
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_APART = _BITS[np.arange(256)[:, None] ^ np.arange(256)[None]]  # bits between two bytes


class Codes:
    """Learned binary codes: mean, and the turned principal components."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        k = min(COMPONENTS, sample.shape[1])
        values, vectors = np.linalg.eigh(centred.T @ centred)
        axes = vectors[:, np.argsort(-values, kind="stable")[:k]]
        flat, chance = centred @ axes, np.random.default_rng(seed)
        self.axes = np.concatenate([axes @ self._turn(flat, chance) for _ in range(TURNS)], axis=1)
        self.bits = self.axes.shape[1]

    @staticmethod
    def _turn(flat: np.ndarray, chance: np.random.Generator) -> np.ndarray:
        """A rotation that brings the sample near the corners of the cube."""
        turn = np.linalg.qr(chance.standard_normal((flat.shape[1], flat.shape[1])))[0]
        for _ in range(LEARN):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        return turn

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.axes > 0, axis=1)


class Index:
    """Rows by the value of each byte of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.by = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(codes.shape[1])]
        self.at = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.by)]

    def within(self, code: np.ndarray, s: int, radius: int) -> np.ndarray:
        """Rows within ``radius`` (below m * (s + 1)), found by probing bytes within ``s`` bits."""
        found = np.zeros(len(self.codes), bool)
        for j, (order, at) in enumerate(zip(self.by, self.at)):
            for value in np.flatnonzero(_APART[code[j]] <= s).tolist():
                found[order[at[value]:at[value + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[_BITS[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def nearest(codes: Codes | None, index: Index | None, x: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest rows found, nearest first."""
    def ranked(rows):
        rows = rows[ids[rows] != own]
        d = np.sqrt(((x[rows] - query) ** 2).sum(axis=1))
        best = np.lexsort((ids[rows], d))[:k]
        return rows[best], d[best]

    if index is None:
        return ranked(np.arange(len(x)))
    code, bytes_ = codes(query[None])[0], index.codes.shape[1]
    s, radius = 0, bytes_ - 1
    while True:
        rows, distances = ranked(np.arange(len(x)) if radius >= codes.bits else index.within(code, s, radius))
        if radius >= codes.bits:
            return rows, distances
        if len(rows) < k:
            need = radius + 1
        else:
            a, b = query - codes.mean, x[rows[-1]] - codes.mean
            size = np.linalg.norm(a) * np.linalg.norm(b)
            p = np.arccos(np.clip(a @ b / size, -1, 1)) / np.pi if size else 1.0
            need = int(np.ceil(codes.bits * p + MARGIN * np.sqrt(codes.bits * p * (1 - p))))
        if need <= radius:
            return rows, distances
        s = max(s + 1, -(-(need + 1) // bytes_) - 1)
        if len(rows) < k:
            radius = bytes_ * (s + 1) - 1
        else:
            radius = min(need, bytes_ * (s + 1) - 1)


def learn(rows: DataFrame, sample: int) -> dict[int, Codes]:
    """Codes by vector length, of a bounded sample in hash order."""
    by_width: dict[int, list] = {}
    for r in rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect():
        by_width.setdefault(len(r[0]), []).append(r[0])
    return {n: Codes(np.array(v, np.float64)) for n, v in by_width.items()}


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, id_column: str = "vec_id", sample: int = SAMPLE,
           rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every query, score being the Euclidean distance."""
    base = vectors.where(usable()).select(F.col(id_column).cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("width"),
                                          F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null")
    base = stored(base.groupBy("vec_id", "embedding", "width").agg(F.bool_or("asks").alias("asks")), "vectors")  # repeated rows count once
    n, asked = base.agg(F.count("*"), F.count_if("asks")).first()
    row_blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-asked // queries))
    shared = Shared(vectors.sparkSession, learn(base, sample))
    deal = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = base.where("asks").select("width", deal(query_blocks, 1).alias("q"), every(row_blocks).alias("r"), F.lit(True).alias("asks"), "vec_id", "embedding")
    right = base.select("width", every(query_blocks).alias("q"), deal(row_blocks, 2).alias("r"), F.lit(False).alias("asks"), "vec_id", "embedding")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(part: pa.Table) -> pa.Table:
        asks, ids, width = part.column("asks").to_numpy(), part.column("vec_id").to_numpy(), part.column("width")[0].as_py()
        x = matrix_of(part.column("embedding"), width)
        who, near, score = [], [], []
        if asks.any() and not asks.all():
            codes = shared.get().get(width)
            ours, ours_ids = x[~asks], ids[~asks]
            index = Index(codes(ours)) if codes else None
            for i in np.flatnonzero(asks).tolist():
                found, distances = nearest(codes, index, ours, ours_ids, x[i], ids[i], k)
                who.append(np.full(len(found), ids[i]))
                near.append(ours_ids[found])
                score.append(distances)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table([join(who, np.int64), join(near, np.int64), join(score, np.float64)], schema=schema)

    found = left.union(right).groupBy("width", "q", "r").applyInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
