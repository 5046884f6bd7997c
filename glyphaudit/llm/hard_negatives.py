"""Hard-negative mining with Kronecker-packed inner products.

Components are integers, floor(256 x). Candidates come in blocks. A block adds a bias to its components, so that all are non-negative,
and puts those of several candidates into separated fields of one wide integer. Such an integer is multiplied once per anchor component and summed
over the components; each field of the sum then holds one candidate's product with the anchor, which is unpacked exactly and relieved of the
bias. Wide integers are kept in doubles, exact up to 2^53, because a matrix product of doubles is the fastest exact product there is. A
field is as wide as the largest product the block can have with any anchor; where not even one fits (components beyond ``LIMIT`` or very long
vectors), the same sums are made with unbounded integers.

Blocks are stored once and met twice by the anchors, which come in blocks too: first for each anchor's positives, its best rows of the
same label, then, for every positive, for the best rows of other labels whose score lies in the wanted share of the positive's. A task keeps
the best k for each anchor (and score) over the blocks it takes, which are ranked at last.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; zero and empty vectors do (their
products are 0); only vectors of equal length meet; repeated rows count once; rows that share an id are rows of their own, but none is a candidate
of an anchor of its id; ties go to the smaller id; anchors without positives, and positives without negatives, give no rows; scores beyond 64 bits are
held at its ends; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored, table

SCALE, LIMIT, EXACT = 256, 4096.0, 53
ROWS, ANCHORS, AT_ONCE = 16_384, 8192, 256   # most rows and anchors of a block; anchors multiplied at once
LEAST, PARTS = 1024, 64          # smaller tables are cut into so many blocks, of so many rows at least
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90               # percent of the positive's score
LONG = (-(1 << 63), (1 << 63) - 1)


def pack(v: np.ndarray, most: int) -> tuple[np.ndarray, int, int, int]:
    """(words, fields, bits, bias) of the rows of an integer matrix held in doubles; ``most`` bounds the sum of an anchor's absolute components.

    ``words`` has a row per component and a column per ``fields`` candidates; with no fields it is the plain matrix, transposed.
    """
    n, d = v.shape
    low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
    bits = (most * (high - low)).bit_length() + 1
    fields = EXACT // bits
    if not fields or max(abs(low), abs(high)) >= 1 << EXACT:
        return np.ascontiguousarray(v.T), 0, 0, 0
    filled = np.zeros((d, -(-n // fields) * fields))
    filled[:, :n] = v.T - low
    return filled.reshape(d, -(-n // fields), fields) @ (2.0 ** (bits * np.arange(fields))), fields, bits, -low


def unpacked(words: np.ndarray, fields: int, bits: int, bias: int, n: int) -> np.ndarray:
    """The matrix that was packed."""
    if not fields:
        return words.T
    rest, out = words.astype(np.int64), []
    for _ in range(fields):
        out.append(rest & ((1 << bits) - 1))
        rest >>= bits
    return (np.stack(out, axis=2).reshape(len(words), words.shape[1] * fields)[:, :n] - bias).astype(np.float64).T


def products(anchors: np.ndarray, words: np.ndarray, fields: int, bits: int, bias: int, n: int) -> np.ndarray:
    """Exact inner products (anchors x candidates): 64-bit integers, or unbounded ones where the fields cannot hold them."""
    if not fields or not _fits(float(np.abs(anchors).sum(axis=1).max(initial=0)), words, fields, bits):
        left, right = (np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
                       for m in (anchors, unpacked(words, fields, bits, bias, n).T))
        return left @ right if anchors.shape[1] else np.zeros((len(anchors), n), object)
    rest, half = (anchors @ words).astype(np.int64), np.int64(1) << np.int64(bits - 1)
    out = np.empty((len(anchors), rest.shape[1], fields), np.int64)
    for f in range(fields):
        out[:, :, f] = ((rest + half) & ((half << np.int64(1)) - 1)) - half   # the signed value of the lowest field
        rest = (rest - out[:, :, f]) >> np.int64(bits)
    return out.reshape(len(anchors), -1)[:, :n] - bias * anchors.sum(axis=1).astype(np.int64)[:, None]


def _fits(size: float, words: np.ndarray, fields: int, bits: int) -> bool:
    """Whether no field of a sum can run over: the largest field times the anchor's absolute components stays below half of a field's range."""
    if size >= 1 << EXACT:
        return False
    rest, top = words.astype(np.int64), 0
    for _ in range(fields):
        top = max(top, int((rest & ((1 << bits) - 1)).max(initial=0)))
        rest >>= bits
    return int(size) * top < 1 << (bits - 1)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def eligible(column: str = "embedding") -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _whole(column: pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(SCALE * values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width))


PACKED = "width int, wide boolean, r int, n int, fields int, bits int, bias long, ids binary, labels binary, words binary"
ASKING = "width int, wide boolean, q int, ids binary, labels binary, keys binary, wanted binary, rows binary"


def packed_rows(rows: DataFrame, most: dict[int, int], size: int = ROWS) -> DataFrame:
    """The candidates in packed blocks of about ``size``. ``most``: largest sum of absolute components of an anchor, by vector length."""
    n = rows.count()
    blocks = max(1, -(-n // min(size, max(LEAST, n // PARTS))))
    schema = pa.schema([("width", pa.int32()), ("wide", pa.bool_()), ("r", pa.int32()), ("n", pa.int32()), ("fields", pa.int32()), ("bits", pa.int32()),
                        ("bias", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("words", pa.binary())])

    def run(part: pa.Table) -> pa.Table:
        width = part.column("width")[0].as_py()
        v = _whole(part.column("embedding"), width)
        words, fields, bits, bias = pack(v, max(most.get(width, 1), 1))
        binary = [np.ascontiguousarray(x).tobytes() for x in (part.column("vec_id").to_numpy(), part.column("label").to_numpy(), words)]
        return pa.table([[x] for x in (width, part.column("wide")[0].as_py(), part.column("r")[0].as_py(), len(v), fields, bits, bias, *binary)], schema=schema)

    dealt = rows.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).select("width", "wide", "r", "vec_id", "label", "embedding")
    return dealt.groupBy("width", "wide", "r").applyInArrow(run, PACKED)


def asking_rows(anchors: DataFrame, size: int) -> DataFrame:
    """The anchors in blocks of about ``size``, each with the scores it has (``wanted``, at most ``POSITIVES``)."""
    blocks = max(1, -(-anchors.count() // size))
    schema = pa.schema([("width", pa.int32()), ("wide", pa.bool_()), ("q", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("keys", pa.binary()),
                        ("wanted", pa.binary()), ("rows", pa.binary())])

    def run(part: pa.Table) -> pa.Table:
        width = part.column("width")[0].as_py()
        wanted = np.full((part.num_rows, POSITIVES + 1), LONG[0], np.int64)   # the number of scores, and the scores
        for i, scores in enumerate(part.column("scores").to_pylist()):
            wanted[i, 0] = len(scores)
            wanted[i, 1:len(scores) + 1] = scores
        binary = [np.ascontiguousarray(x).tobytes() for x in (*(part.column(c).to_numpy() for c in ("vec_id", "label", "key")), wanted,
                                                              _whole(part.column("embedding"), width))]
        return pa.table([[x] for x in (width, part.column("wide")[0].as_py(), part.column("q")[0].as_py(), *binary)], schema=schema)

    dealt = anchors.withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int")).select(
        "width", "wide", "q", "vec_id", "label", "key", "scores", "embedding")
    return dealt.groupBy("width", "wide", "q").applyInArrow(run, ASKING)


def met(packed: DataFrame, asking: DataFrame, negatives: bool) -> DataFrame:
    """Every anchor block meets every block of candidates: the best of a block of the anchor's own label, or of others near each wanted score.

    (anchor_id, key, wanted, vec_id, score); ``wanted`` is null for the anchor's own label.
    """
    # numbers of the blocks by vector length: few rows, each a block
    right = packed.select("width", "r", "n", "fields", "bits", "bias", F.col("ids").alias("row_ids"), F.col("labels").alias("row_labels"), "words",
                          F.col("wide").alias("row_wide"))
    left = asking.select("width", "q", "wide", "ids", "labels", "keys", "wanted", "rows")
    asks = left.groupBy("width").agg(F.collect_set(F.struct("wide", "q")).alias("blocks"))
    holds = right.groupBy("width").agg(F.collect_set(F.struct("row_wide", "r")).alias("blocks"))
    right = right.join(asks, "width").withColumn("b", F.explode("blocks")).select("*", F.col("b.wide").alias("wide"), F.col("b.q").alias("q")).drop("blocks", "b")
    left = left.join(holds, "width").withColumn("b", F.explode("blocks")).select("*", F.col("b.row_wide").alias("row_wide"), F.col("b.r").alias("r")).drop("blocks", "b")
    # every row is a block of megabytes: dealt out by both numbers, never broadcast
    pairs = left.join(right.hint("merge"), ["width", "wide", "q", "row_wide", "r"]).select(
        "width", "wide", "q", "n", "fields", "bits", "bias", "row_ids", "row_labels", "words", "ids", "labels", "keys", "wanted", "rows")
    schema = pa.schema([("anchor_id", pa.int64()), ("key", pa.int64()), ("wanted", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    most = NEGATIVES if negatives else POSITIVES

    def run(batches):
        block, best = None, {}    # of the anchor block at hand: (anchor, key, wanted) -> best scores and ids of the blocks met so far
        for batch in batches:
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for i in range(batch.num_rows):
                now = tuple(columns[c][i].as_py() for c in ("width", "wide", "q"))
                if now != block:   # the join has sorted the rows by anchor block
                    yield given(best)
                    block, best = now, {}
                meet(best, *(columns[c][i] for c in ("width", "n", "fields", "bits", "bias", "row_ids", "row_labels", "words", "ids", "labels", "keys", "wanted", "rows")))
        yield given(best)

    def given(best):
        size = [len(ids) for _, ids in best.values()]
        names = [np.repeat(np.array([k[c] for k in best], np.int64), size) for c in (0, 1)]
        wanted = pa.array([k[2] for k, n in zip(best, size) for _ in range(n)], pa.int64())
        scores, ids = ([x for pair in best.values() for x in pair[c].tolist()] for c in (0, 1))
        return pa.RecordBatch.from_arrays([*map(pa.array, names), wanted, pa.array(ids, pa.int64()),
                                           pa.array([min(max(int(x), LONG[0]), LONG[1]) for x in scores], pa.int64())], schema=schema)

    def meet(best, width, n, fields, bits, bias, row_ids, row_labels, words, ids, labels, keys, wanted, rows):
        width, n, fields, bits, bias = (x.as_py() for x in (width, n, fields, bits, bias))
        longs = lambda x: np.frombuffer(x.as_buffer(), np.int64)
        row_ids, row_labels, ids, labels, keys = map(longs, (row_ids, row_labels, ids, labels, keys))
        wanted = longs(wanted).reshape(len(ids), -1)
        columns = -(-n // fields) if fields else n
        asked = np.frombuffer(rows.as_buffer(), np.float64).reshape(len(ids), width)
        words = np.frombuffer(words.as_buffer(), np.float64).reshape(width, columns)

        def give(i, want, at, scores):
            if not len(at):
                return
            key, found = (int(ids[i]), int(keys[i]), want), (scores[at], row_ids[at])
            if key in best:
                found = tuple(np.concatenate(pair) for pair in zip(best[key], found))
            at = first(*found, most)
            best[key] = found[0][at], found[1][at]

        for lo in range(0, len(ids), AT_ONCE):
            for i, scores in enumerate(products(asked[lo:lo + AT_ONCE], words, fields, bits, bias, n), lo):
                own = row_labels == labels[i]
                if not negatives:
                    at = np.flatnonzero(own & (row_ids != ids[i]))
                    give(i, None, at[first(scores[at], row_ids[at], most)], scores)
                    continue
                other = np.flatnonzero(~own & (row_ids != ids[i]))
                hundred = 100 * scores[other]
                for want in sorted(set(wanted[i, 1:1 + wanted[i, 0]].tolist())):
                    at = other[(hundred >= LOW * want) & (hundred <= HIGH * want)]
                    give(i, want, at[first(scores[at], row_ids[at], most)], scores)

    return pairs.mapInArrow(run, "anchor_id long, key long, wanted long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``vectors``: vec_id, label, embedding."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding",
                          F.coalesce(is_anchor, F.lit(False)).alias("asks")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & eligible())
    wide = F.exists("embedding", lambda x: F.abs(x) > LIMIT)
    base = stored(base.groupBy("vec_id", "label", "embedding").agg(F.bool_or("asks").alias("asks")).select(   # repeated rows count once
        "*", F.size("embedding").alias("width"), wide.alias("wide"), F.xxhash64("label", "embedding").alias("key")), "vectors")
    chosen = base.where("asks")
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(F.floor(F.lit(float(SCALE)) * x.cast("double"))))
    most = {r[0]: int(r[1]) for r in chosen.where("not wide").groupBy("width").agg(F.max(size)).collect()}   # a row per vector length
    packed = stored(packed_rows(base, most, rows), "packed")
    own = met(packed, stored(asking_rows(chosen.withColumn("scores", F.array().cast("array<bigint>")), anchors), "anchors"), False)
    best = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    positives = stored(own.withColumn("r", F.row_number().over(best)).where(F.col("r") <= POSITIVES).select(
        "anchor_id", "key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = positives.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(F.collect_list("positive_score").alias("scores"))
    others = met(packed, stored(asking_rows(chosen.join(wanted, ["vec_id", "key"]), anchors), "anchors"), True)
    near = Window.partitionBy("anchor_id", "key", "wanted").orderBy(F.desc("score"), "vec_id")
    found = others.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= NEGATIVES)
    return positives.join(found.withColumn("positive_score", F.col("wanted")), ["anchor_id", "key", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)
