"""Language identification by prediction by partial matching (PPM).

For every language a variable-order tree of byte contexts is counted on a bounded sample of labelled rows and then frozen.
A text's code length under a language is exact: at each byte the longest known context codes the byte with
n / (T + D), or escapes with D / (T + D) to the context one byte shorter (T occurrences, D different bytes, no
exclusions), down to the uniform order -1. The language with the shortest code wins.

The trees of all languages are laid into one open-addressing table per order: key = context and byte, value = the code length in
every language. A key that some language knows at the top order is thus one lookup per byte; only the others descend.

Defined cases: null text, or text without a letter, is ``und`` with score 0; ties go to the smaller language name; with no labelled
rows everything is ``und``; null languages are not learned; only ``id_column``, ``text`` and ``label`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Shared, emit, held_out, slices, table, text_column, trimmed

ORDER = 4
TRAIN_ROWS = 500         # labelled rows per language
TRAIN_BYTES = 1_500_000  # and their bytes together (the first row is always taken)
SPARE = 4                # times the rows wanted that are ranked, for the sake of repeated texts
U = np.uint64


def training_rows(labelled: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """A bounded sample of (text, label): per label the first rows in hash order, whole texts, up to ``size`` bytes."""
    light = labelled.where("label is not null and text is not null and octet_length(text) > 0").select(
        "label", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    w = Window.partitionBy("label").orderBy("h")
    # hashes are even: of a language of any size only about ``SPARE`` times the rows wanted can be among the first
    sizes = light.groupBy("label").agg(F.count("*").alias("all"))
    light = light.join(sizes, "label").where(F.col("h") <= F.lit(2.0 ** 64) * (F.least(F.lit(1.0), SPARE * rows / F.col("all")) - 0.5)).drop("all")
    ranked = light.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows)
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    chosen = ranked.withColumn("t", total).where((F.col("t") <= size) | (F.col("r") == 1)).select("label", "h").distinct()
    return (labelled.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["label", "h"])
            .dropDuplicates(["label", "h"]).select("label", "text"))


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """Key of the ``order`` bytes up to each position and the byte itself; the length is part of the key."""
    key = np.full(len(data), 1, U)
    for back in range(order, 0, -1):
        shifted = np.zeros(len(data), U)
        shifted[back:] = data[:-back] if back < len(data) else 0
        key = (key << U(8)) | shifted
    return (key << U(8)) | data.astype(U)


def count_contexts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(label, order, key, n): how often each byte follows each context."""
    out = pa.schema([("label", pa.string()), ("order", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            data, offsets = text_column(batch, "text")
            names = np.array(batch.column(batch.schema.get_field_index("label")).to_pylist(), dtype=object)
            for name in sorted(set(names)):
                kept = [data[offsets[i]:offsets[i + 1]] for i in np.flatnonzero(names == name)]
                for k in range(order + 1):
                    keys = np.concatenate([_codes(d, k)[k:] for d in kept])
                    keys, n = np.unique(keys, return_counts=True)
                    yield emit(out, [[name] * len(keys), np.full(len(keys), k, np.int32), keys.view(np.int64), n])

    return rows.mapInArrow(count, "label string, order int, key long, n long").groupBy("label", "order", "key").agg(F.sum("n").alias("n"))


class Table:
    """Open addressing over numpy arrays: integer keys to rows of values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, 3 * len(keys))))))
        self.keys = np.zeros(1 << self.bits, U)  # 0 is no key
        self.values = np.zeros((1 << self.bits, values.shape[1]), np.float32)
        left, at, step = keys.astype(U), self._home(keys.astype(U)), np.arange(len(keys))
        mask = U((1 << self.bits) - 1)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at] == 0
            self.keys[at[free]] = left[free]  # of several for one place the last stays
            placed = self.keys[at] == left
            self.values[at[placed]] = values[step[placed]]
            left, at, step = left[~placed], (at[~placed] + U(1)) & mask, step[~placed]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where unknown."""
        at = self._home(keys).astype(np.int64)
        got = self.keys[at]
        found = np.where(got == keys, at, -1)
        open_ = np.flatnonzero((got != keys) & (got != 0))
        mask = (1 << self.bits) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (got != 0)]
        return found


@dataclass
class Model:
    """Frozen statistics: per order the code lengths of known bytes and the escapes of known contexts, in bits."""
    languages: list[str]
    coded: list[Table]     # (context, byte) -> bits in every language, escapes above included
    escapes: list[Table]   # context -> bits of an escape in every language, 0 where the context is unknown


def build_model(counts: pa.Table, order: int = ORDER) -> Model:
    """Trees from a table (label, order, key, n), whose size is bounded by the training sample."""
    found = counts.column("label").combine_chunks().dictionary_encode()
    names = found.dictionary.to_pylist()
    languages = sorted(names)
    if not languages:
        return Model([], [], [])
    lang = np.array([languages.index(n) for n in names])[found.indices.to_numpy()]
    level, key, n = (counts.column(c).to_numpy() for c in ("order", "key", "n"))
    key = key.view(U)
    coded: list[Table] = []
    escapes: list[Table] = []
    width = len(languages)
    for k in range(order + 1):
        here = level == k
        keys, inverse = np.unique(key[here], return_inverse=True)
        counted = np.zeros((len(keys), width))
        counted[inverse, lang[here]] = n[here]
        contexts, where = np.unique(keys >> U(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(total, where, counted)
        np.add.at(kinds, where, counted > 0)
        escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
        if k:  # the same byte one order down: drop the oldest byte of the context
            low = (keys & U((1 << (8 * k)) - 1)) | U(1 << (8 * k))
            fallback = _look(Model(languages, coded, escapes), low, k - 1)
        else:
            fallback = np.full((len(keys), width), 8.0)
        with np.errstate(divide="ignore"):
            bits = np.where(counted > 0, -np.log2(counted / np.maximum(total + kinds, 1)[where]), escape[where] + fallback)
        coded.append(Table(keys, bits))
        escapes.append(Table(contexts, escape))
    return Model(languages, coded, escapes)


def _look(model: Model, keys: np.ndarray, k: int) -> np.ndarray:
    """Bits of keys of order ``k`` in every language."""
    at = model.coded[k].find(keys)
    bits = model.coded[k].values[np.maximum(at, 0)]
    lost = np.flatnonzero(at < 0)
    if len(lost):
        missed = keys[lost]
        context = model.escapes[k].find(missed >> U(8))
        escape = np.where((context >= 0)[:, None], model.escapes[k].values[np.maximum(context, 0)], 0)
        if k:
            escape = escape + _look(model, (missed & U((1 << (8 * k)) - 1)) | U(1 << (8 * k)), k - 1)
        else:
            escape = escape + np.float32(8.0)
        bits[lost] = escape
    return bits


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 18) -> np.ndarray:
    """Bits of every row in every language. Rows may be of any length: the bytes are taken in blocks."""
    order, out = len(model.coded) - 1, np.zeros((len(offsets) - 1, len(model.languages)))
    begins = np.unique(offsets[offsets < len(data)])
    for lo in range(0, len(data), limit):
        hi = min(lo + limit, len(data))
        back = min(order, lo)
        bits = _look(model, _codes(data[lo - back:hi], order)[back:], order)
        near = begins[np.searchsorted(begins, lo - order):np.searchsorted(begins, hi)]
        early = np.unique((near[:, None] + np.arange(order)).ravel())
        early = early[(early >= lo) & (early < hi)]
        depth = early - begins[np.searchsorted(begins, early, "right") - 1]
        for k in range(order):  # the first bytes of a row have shorter contexts
            at = early[depth == k]
            if len(at):
                key = np.full(len(at), 1, U)
                for b in range(k, -1, -1):
                    key = (key << U(8)) | data[at - b].astype(U)
                bits[at - lo] = _look(model, key, k)
        bounds = np.unique(np.concatenate([[lo], near[near >= lo]]))
        sums = np.add.reduceat(bits.astype(np.float64), bounds - lo, axis=0)
        np.add.at(out, np.searchsorted(offsets, bounds, "right") - 1, sums)
    return out


def train(labelled: DataFrame, order: int = ORDER, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """A model from (text, label) rows; sample and tables are bounded by ``rows`` and ``size`` per label."""
    counts = count_contexts(training_rows(labelled, rows, size), order)
    return build_model(counts.toArrow(), order)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) of every row; score is the winner's share of the coding probability."""
    shared = Shared(docs.sparkSession, model)
    kind = docs.schema[id_column].dataType.simpleString()
    prepared = docs.select(F.col(id_column), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def score(batches):
        model = shared.get()
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            data, offsets = text_column(batch, "text")
            best = np.full(len(offsets) - 1, len(names) - 1)
            share, rate = np.zeros(len(best)), np.full(len(best), 8.0)
            if model.languages:
                bits = np.zeros((len(best), len(names) - 1))
                for lo, hi in slices(offsets):
                    bits[lo:hi] = code_lengths(model, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                letters = np.asarray(batch.column(2))
                least = bits.min(axis=1)
                odds = np.exp2(-np.minimum(bits - least[:, None], 1000.0))
                best = np.where(letters, bits.argmin(axis=1), best)
                share = np.where(letters, 1.0 / odds.sum(axis=1), 0.0)
                rate = np.where(letters, least / np.maximum(np.diff(offsets), 1), 8.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(share), pa.array(rate)],
                names=[id_column, "lang_pred", "score", "bits_per_byte"])

    return prepared.mapInArrow(trimmed(score), f"`{id_column}` {kind}, lang_pred string, score double, bits_per_byte double")


def train_on_fold(documents: DataFrame) -> Model:
    return train(documents.where(~held_out()).select("text", F.col("lang").alias("label")))


def op1_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, train_on_fold(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop documents without a letter, and those no learned language codes below the 8 bits a byte of noise.

    The model is learned from the documents of ``sf_dir``. All columns of ``docs`` stay; rows are neither joined nor shuffled.
    """
    model = train_on_fold(table(spark, sf_dir, "documents"))
    return keep_identified(docs, model)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    shared = Shared(docs.sparkSession, model)
    names = docs.columns
    marked = docs.withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def keep(batches):
        model = shared.get()
        for batch in batches:
            data, offsets = text_column(batch, "text")
            stays = np.zeros(len(offsets) - 1, bool)
            if model.languages:
                bits = np.zeros((len(stays), len(model.languages)))
                for lo, hi in slices(offsets):
                    bits[lo:hi] = code_lengths(model, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                stays = np.asarray(batch.column(batch.num_columns - 1)) & (bits.min(axis=1) < 8.0 * np.diff(offsets))
            yield batch.select(names).filter(pa.array(stays))

    return marked.mapInArrow(trimmed(keep), docs.schema)
