"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Positives are rows confirmed toxic; the unlabelled set is a sample of all training rows whatever their label. With the class prior p
(the share of toxic rows among the labelled ones), the risk of a linear classifier g is estimated as

    p * R_P+(g) + max(0, R_U-(g) - p * R_P-(g))

and minimised with the non-negative gradient rule: where the corrected negative part falls below zero, the step goes against it.

Features are the presence of hashed words and of their first 3 to 7 bytes (A-Z lower-cased). Kept are those whose
rows are toxic for a large part by the prior-corrected estimate, at most ``FEATURES``; a text's score is the logistic of the sum of
its weights. The fit is bounded by ``POSITIVES`` and ``UNLABELLED`` rows; scoring reads every whole text.

Defined cases: null and empty texts score as a text without features; without positives or without unlabelled rows every score is the
prior (0 without labels), predicted 0; repeated label rows count once (toxic if any says so); only the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Shared, held_out, slices, table, text_column, trimmed
from .words import U, word_hashes

PREFIXES = (3, 4, 5, 6, 7)
POSITIVES, UNLABELLED = 3000, 9000   # rows of the fit
FEATURES = 4000
PURITY, SUPPORT = 0.6, 0.01            # least estimated share of toxic rows among those with a feature; least share of positives
FEATURE_BITS = 22                    # hashed feature space of the fit
EPOCHS, RATE, DECAY = 150, 0.3, 3e-4


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of the words and word heads of many texts, with repeats."""
    first, words, heads = word_hashes(data, offsets, PREFIXES)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, hashes = [row], [words]
    for head in heads:
        there = head != 0
        rows.append(row[there])
        hashes.append(head[there])
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Model:
    """Weights by feature: ``slots`` is a lookup from the low bits of a hash to a place in ``hashes``, -1 where none."""
    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    slots: np.ndarray

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        if not len(self.hashes):
            return total
        for lo, hi in slices(offsets):
            row, hashes = features_of(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            at = self.slots[(hashes & U((1 << FEATURE_BITS) - 1)).astype(np.int64)]
            hit = np.flatnonzero(at >= 0)
            pairs = np.unique(row[hit].astype(np.int64) * len(self.hashes) + at[hit])
            np.add.at(total, lo + pairs // len(self.hashes), self.weights[pairs % len(self.hashes)])
        return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def frequent(positive: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of enough positives, and of how many."""
    numbers, count = np.unique(np.concatenate(positive), return_counts=True)
    kept = count >= max(3, SUPPORT * len(positive))
    return numbers[kept], count[kept].astype(float)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS) -> Model:
    """Each text is given as its sorted distinct feature numbers (below 2**FEATURE_BITS)."""
    slots = np.full(1 << FEATURE_BITS, -1, np.int32)
    base = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (-30.0 if prior <= 0 else 30.0)
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), base if base < 0 else -1e-9, slots)
    numbers, kp = frequent(positive)
    every, count = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(every, numbers), max(len(every) - 1, 0))
    ku = np.where(every[at] == numbers, count[at], 0) if len(every) else np.zeros(len(numbers))
    # Bayes: of the rows with a feature, prior * P(feature | toxic) / P(feature) are toxic; both rates at the cautious end
    rate = np.maximum(kp - np.sqrt(kp), 0) / len(positive)
    strong = np.flatnonzero(prior * rate / ((ku + 1 + np.sqrt(ku)) / len(unlabelled)) > PURITY)
    chosen = np.sort(numbers[strong[np.lexsort((strong, -rate[strong]))][:FEATURES]]).astype(np.int64)
    slots[chosen] = np.arange(len(chosen))

    def matrix(texts):
        out = np.zeros((len(texts), len(chosen)), np.float32)
        for i, t in enumerate(texts):
            at = slots[t]
            out[i, at[at >= 0]] = 1
        return out

    xp, xu = matrix(positive), matrix(unlabelled)
    w, bias = np.zeros(len(chosen), np.float32), base
    moment, variance = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, epochs + 1):
        gp, gu = xp @ w + bias, xu @ w + bias
        # logistic loss: l(g, +1) = log(1 + exp(-g)), l(g, -1) = log(1 + exp(g)); derivatives sigmoid(g) - 1 and sigmoid(g)
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp_plus, dp_minus, du_minus = (sp - 1) / len(sp), sp / len(sp), su / len(su)
        if negative >= 0:
            dp, du = prior * dp_plus - prior * dp_minus, du_minus
        else:
            dp, du = prior * dp_minus, -du_minus
        gradient = np.append(xp.T @ dp.astype(np.float32) + xu.T @ du.astype(np.float32) + DECAY * w, dp.sum() + du.sum())
        moment, variance = 0.9 * moment + 0.1 * gradient, 0.99 * variance + 0.01 * gradient ** 2
        move = RATE * (moment / (1 - 0.9 ** step)) / (np.sqrt(variance / (1 - 0.99 ** step)) + 1e-8) / np.sqrt(step)
        w -= move[:-1].astype(np.float32)
        bias -= float(move[-1])
    return Model(chosen, w.astype(np.float64), bias, slots)


def training_sample(documents: DataFrame, labels: DataFrame, fold: bool) -> tuple[DataFrame, float]:
    """(text, positive) rows for the fit and the class prior; ``fold`` leaves out the held-out rows."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    light = documents.where("doc_id is not null").select("doc_id")
    if fold:
        known, light = known.where(~held_out()), light.where(~held_out())
    rate = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    h = F.xxhash64("doc_id")

    def some(df, n, positive):
        """The first n in hash order. Hashes are even, so all but the lowest 2n or so are left out before anything is sorted."""
        rows = df.count()
        low = df.select("doc_id", h.alias("h"))
        if rows > 2 * n:
            low = low.where(F.col("h") <= -(1 << 63) + (2 * n << 64) // rows)
        return low.orderBy("h", "doc_id").limit(n).select("doc_id", F.lit(positive).alias("positive"))

    ids = some(known.where("toxic > 0"), POSITIVES, True).union(some(light, UNLABELLED, False))
    return documents.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id").select("positive", "text"), rate


def train(documents: DataFrame, labels: DataFrame, fold: bool = True) -> Model:
    sample, prior = training_sample(documents, labels, fold)
    wanted = None

    def numbers(batches):
        only = wanted.get() if wanted else None
        for batch in batches:
            data, offsets = text_column(batch, "text")
            found = []
            for lo, hi in slices(offsets):
                row, hashes = features_of(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                key = np.unique(row.astype(np.int64) << FEATURE_BITS | (hashes & U((1 << FEATURE_BITS) - 1)).astype(np.int64))
                cut = np.searchsorted(key >> FEATURE_BITS, np.arange(hi - lo + 1))
                small = (key & ((1 << FEATURE_BITS) - 1)).astype("<i4")
                if only is not None:
                    there = np.isin(small, only)
                    cut, small = np.concatenate([[0], np.cumsum(there)])[cut], small[there]
                found += [small[cut[i]:cut[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["positive", "features"])

    def texts(rows):  # bounded by the sample
        return [np.frombuffer(bytes(r[0]), "<i4") for r in rows.mapInArrow(numbers, "positive boolean, features binary").select("features").toLocalIterator()]

    positive = texts(sample.where("positive"))
    if positive:
        wanted = Shared(documents.sparkSession, frequent(positive)[0])  # of the others no more than these is sent
    return fit(positive, texts(sample.where("not positive")), prior)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """(id, score, predicted) of every row."""
    shared = Shared(docs.sparkSession, model)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        model = shared.get()
        for batch in batches:
            s = sigmoid(model.sums(*text_column(batch, "text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_column, "score", "predicted"])

    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")


def op4_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows scored below one half, all columns as they are."""
    shared = Shared(docs.sparkSession, model)

    def keep(batches):
        model = shared.get()
        for batch in batches:
            yield batch.filter(pa.array(model.sums(*text_column(batch, "text")) < 0))

    return docs.mapInArrow(trimmed(keep), docs.schema)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop documents predicted toxic by a model of the tables in ``sf_dir``."""
    return keep_clean(docs, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
