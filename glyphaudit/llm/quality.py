"""Text quality by naive Bayes support vectors.

Features are the n-grams of one to ``ORDER`` bytes a text holds, as indicators, hashed to ``BUCKETS`` numbers. Over the texts of the fit, an n-gram has the
log-count ratio

    r = log((a + p) / (a P + P')) - log((a + q) / (a Q + Q'))

where p and q count the texts of either class that hold it, P' and Q' are the sums of p and q, and a is ``SMOOTH``. A text is the vector of r over
its n-grams, brought to length 1. A linear hinge-loss model on these is fitted by dual coordinate descent: each step solves the dual exactly
in one text's multiplier, bounded by ``COST``. Its margins become probabilities by a logistic fit on texts kept out of the descent, weighted back
to the true share of the classes.

The fit is bounded by ``ROWS`` labelled texts of each class, whole and in hash order; scoring is a scan that reads every whole text.

Defined cases: null and empty texts have no n-gram and score by the bias alone; without texts of both classes every score is the share of class 1
(0 without labels); repeated label rows count once (good if any says so); texts of any length are read in chunks that overlap; invalid UTF-8 is bytes
like others; only the text enters a score; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Shared, held_out, slices, table, text_column
from .words import U, mix

ORDER, BITS = 4, 16
BUCKETS = 1 << BITS
ROWS = 2500              # labelled texts of each class
SMOOTH, COST, ROUNDS = 1.0, 1.0, 30
ASIDE = 5                # every so many-th text is kept for the logistic fit
CHUNK, SCRATCH = 1 << 19, 256   # bytes hashed at once; texts looked at together


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct n-grams of many texts, in order."""
    n = len(offsets) - 1
    there = np.zeros(n << BITS, bool)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    for lo in range(0, len(data), CHUNK):
        part, own = data[lo:lo + CHUNK + ORDER - 1].astype(U), row[lo:lo + CHUNK + ORDER - 1]
        key = np.zeros(len(part), U)
        for size in range(1, ORDER + 1):
            m = len(part) - size + 1
            if m <= 0:
                break
            key = (key[:m] << U(8)) | part[size - 1:]
            bucket = (mix(key + (U(size) << U(40))) >> U(64 - BITS)).astype(np.int64)
            whole = own[:m] == own[size - 1:]
            there[(own[:m][whole] << BITS) | bucket[whole]] = True
    hit = np.flatnonzero(there)
    return hit >> BITS, hit & (BUCKETS - 1)


@dataclass
class Model:
    """``weights`` and ``squares`` by n-gram; a margin is (sum of weights) / sqrt(sum of squares); the score is logistic in it."""
    weights: np.ndarray
    squares: np.ndarray
    slope: float
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(offsets) - 1)
        for a, b in slices(offsets):
            for lo in range(a, b, SCRATCH):
                hi = min(lo + SCRATCH, b)
                row, bucket = grams(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                up, down = (np.bincount(row, w[bucket], hi - lo) for w in (self.weights, self.squares))
                margin[lo:hi] = up / np.sqrt(np.maximum(down, 1e-12))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.bias, -500, 500)))


def ratios(texts: list[np.ndarray], good: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Log-count ratio of every n-gram; 0 for those no text holds."""
    p, q = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, g in zip(texts, good) if g == side)]).astype(np.int64), minlength=BUCKETS)
            for side in (True, False))
    seen = p + q > 0
    kinds = seen.sum()
    r = np.log((smooth + p) / (smooth * kinds + p.sum())) - np.log((smooth + q) / (smooth * kinds + q.sum()))
    return np.where(seen, r, 0.0)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(w, multipliers) of min |w|^2 / 2 + cost * sum of max(0, 1 - y w.x), by dual coordinate descent. A row is (places, values)."""
    w, y = np.zeros(BUCKETS), np.where(good, 1.0, -1.0)
    alpha, size = np.zeros(len(rows)), np.array([v @ v for _, v in rows])
    chance = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in chance.permutation(len(rows)).tolist():
            if not size[i]:
                continue
            at, v = rows[i]
            slope = y[i] * (w[at] @ v) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), cost)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                worst = max(worst, abs(new - alpha[i]) * size[i])
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, alpha


def logistic(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and bias of the weighted logistic regression of the class on the margin, by Newton steps on smoothed targets."""
    plus, minus = weight[good].sum(), weight[~good].sum()
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, float(np.log(plus / minus))
    x = np.stack([margin, np.ones(len(margin))])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        gradient = x @ (weight * (s - target)) + 1e-6 * np.array([a, 0])
        curve = (x * (weight * s * (1 - s))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def fit(texts: list[np.ndarray], good: np.ndarray, share: float) -> Model:
    """Each text is given as its distinct n-grams. ``share`` is that of class 1 among all labelled rows."""
    if not good.any() or good.all():
        flat = np.log(share / (1 - share)) if 0 < share < 1 else (500.0 if share >= 1 else -500.0)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, float(flat))
    place = np.zeros(len(texts), np.int64)
    for side in (True, False):
        place[good == side] = np.arange((good == side).sum())
    aside = place % ASIDE == ASIDE - 1 if min(good.sum(), (~good).sum()) >= ASIDE else np.zeros(len(texts), bool)
    r = ratios([t for t, out in zip(texts, aside) if not out], good[~aside])
    rows = []
    for t in texts:
        v = r[t]
        rows.append((t, v / np.sqrt(max(v @ v, 1e-12))))
    w, _ = descend([x for x, out in zip(rows, aside) if not out], good[~aside])
    margin = np.array([w[t] @ v for t, v in rows])
    check = aside if aside.any() else np.ones(len(texts), bool)
    weight = np.where(good, share / good[check].sum(), (1 - share) / (~good[check]).sum()) * check.sum()
    slope, bias = logistic(margin[check], good[check], weight[check])
    return Model(w * r, r * r, slope, bias)


def labelled(documents: DataFrame, labels: DataFrame, fold: bool, rows: int) -> tuple[DataFrame, float]:
    """(good, text) of the first ``rows`` labelled documents of each class in hash order, and the share of class 1 among all labelled ids."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    if fold:
        known = known.where(~held_out())
    counts = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    total = sum(counts.values())

    def some(side):
        low = known.where(F.col("good") == side).select("doc_id", "good", F.xxhash64("doc_id").alias("h"))
        if counts.get(side, 0) > 2 * rows:   # hashes are even: what can be among the first
            low = low.where(F.col("h") <= -(1 << 63) + (2 * rows << 64) // counts[side])
        return low.orderBy("h", "doc_id").limit(rows).select("doc_id", "good")

    ids = some(True).union(some(False))
    sample = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.first("good").alias("good"), F.min("text").alias("text"))
    return sample.select("good", "text"), counts.get(True, 0) / total if total else 0.0


def train(documents: DataFrame, labels: DataFrame, fold: bool = True, rows: int = ROWS) -> Model:
    """A model of the labelled rows; ``fold`` leaves out the held-out rows."""
    sample, share = labelled(documents, labels, fold, rows)

    def numbers(batches):
        for batch in batches:
            data, offsets = text_column(batch, "text")
            found = []
            for a, b in slices(offsets):
                for lo in range(a, b, SCRATCH):
                    hi = min(lo + SCRATCH, b)
                    row, bucket = grams(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                    cut, small = np.searchsorted(row, np.arange(hi - lo + 1)).tolist(), bucket.astype("<u2")
                    found += [small[i:j].tobytes() for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["good", "grams"])

    texts, good = [], []
    for r in sample.mapInArrow(numbers, "good boolean, grams binary").toLocalIterator():   # bounded by the sample: 2 bytes for each of at most BUCKETS n-grams
        texts.append(np.frombuffer(bytes(r.grams), "<u2"))
        good.append(r.good)
    order = sorted(range(len(texts)), key=lambda i: (good[i], texts[i].tobytes()))   # the same fit however rows arrive
    return fit([texts[i] for i in order], np.array([good[i] for i in order], bool), share)


def score(docs: DataFrame, model: Model, threshold: float, id_column: str = "doc_id") -> DataFrame:
    """(id, score, predicted) of every row."""
    shared = Shared(docs.sparkSession, model)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        model = shared.get()
        for batch in batches:
            s = model.scores(*text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_column, "score", "predicted"])

    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")


def op11_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model, 0.3).select("doc_id", held_out().alias("held_out"), "score", "predicted")
