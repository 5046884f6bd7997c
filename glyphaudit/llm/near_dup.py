"""Near duplicates by an LSH forest over MinHash signatures.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words between ASCII white space; with fewer words the whole
sequence). Documents of equal sets are one class, so copies cost nothing further. A class has ``HASHES`` min-hashes; each of ``TREES``
trees sorts the classes by its own rotation of the signature. In a tree, classes that share the first ``depth`` values are a region. Inside it, each
class meets its ``NEIGHBOURS`` successors in sorted order, those of the longest common prefix: few classes in a region meet all, in
crowded regions the depth adapts. With likeness 0.85 and depth 4 a pair misses a region in all trees
with probability (1 - 0.85^4)^16 < 1e-5, with 0.8 and depth 3 of (1 - 0.8^3)^16, about 1e-5.

Candidates whose signatures agree too little are dropped, the rest confirmed on the full sets, which are computed from the texts of the two
documents. First each class's best candidate is confirmed; then only those candidates between different components of the confirmed
links. So a group of n near copies costs about n confirmations. Last, in regions larger than the sorted order has met all of, every class outside
the region's largest component meets all other components, so that no candidate of a region is left out. There the sets travel with the classes, in
blocks bounded in classes and bytes; a block confirms its own candidates and gives out no more than a spanning forest of what it tied.

Defined cases: texts without a word (null, empty, white space) have size 0 and are linked with nothing; rows of one id and text are
one document; a null id is never a representative, its component is that of its class, or null; a text of any length is one set (a set larger than a
block is a block of its own); other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import emit, fixed_binary, kept_in_worker, slices, stored, table, text_column, trimmed
from .components import components
from .embedding_dup import merge
from .words import U, mix, word_hashes

SHINGLE = 5
HASHES, TREES, NEIGHBOURS = 128, 16, 4
BLOCK, BLOCK_BYTES = 8192, 16 << 20   # classes of a crowded region that meet in one task, and bytes of their sets


class Bounds(NamedTuple):
    """Linked if ``bottom`` * intersection >= ``top`` * union; the others follow from that likeness."""
    top: int = 85
    bottom: int = 100
    agreement: int = 88     # least number of equal signature values: five standard deviations below likeness * HASHES
    depth: int = 4          # shared values that make a region, 1 to 4: a pair is missed with probability (1 - likeness^depth)^TREES


FROM_85, FROM_80 = Bounds(), Bounds(80, 100, 80, 3)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    first, words, _ = word_hashes(data, offsets)
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        if len(words) >= SHINGLE:
            run = words[:len(words) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                run = run * U(0x9E3779B97F4A7C15) + words[k:len(words) - SHINGLE + 1 + k]
            run = mix(run)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(run[a:b - SHINGLE + 1]))
            elif b > a:
                h = U(b - a)
                for w in words[a:b]:
                    h = h * U(0x9E3779B97F4A7C15) + w
                out.append(mix(np.array([h, 0], U))[:1])
            else:
                out.append(np.zeros(0, U))
    return out


def class_of(found: np.ndarray) -> int:
    """A set as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(found ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(found))], U)).view(np.int64)[0])


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Fixed pseudo-random parameters of the min-hashes."""
    seed = mix(np.arange(1, 2 * HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return (seed[:HASHES] >> U(32)).astype(np.uint32)[:, None], (seed[HASHES:] >> U(32)).astype(np.uint32)[:, None] | np.uint32(1)


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each of ``HASHES`` min-hashes."""
    flip, times = kept_in_worker("minhash", _multipliers)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (found >> U(32)).astype(np.uint32)
    for lo in range(0, len(short), 2048):
        values = short[None, lo:lo + 2048] ^ flip
        values *= times
        np.minimum(least, values.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def described(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, cls, sig) of every row; cls is null without words."""
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("sig", pa.binary())])
        for batch in batches:
            data, offsets = text_column(batch, "text")
            for lo, hi in slices(offsets):
                sets = shingles(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                yield emit(schema, [batch.column(0).slice(lo, hi - lo), [len(s) for s in sets],
                                    [class_of(s) if len(s) else None for s in sets],
                                    [signature(s).tobytes() if len(s) else None for s in sets]])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), "text").mapInArrow(
        trimmed(run), "doc_id long, n_shingles long, cls long, sig binary")


def ordered(classes: DataFrame, depth: int) -> DataFrame:
    """(tree, region, rest, cls): the place of every class in every tree."""
    def order(batches):
        schema = pa.schema([("tree", pa.int32()), ("region", pa.int64()), ("rest", pa.binary()), ("cls", pa.int64())])
        for batch in batches:
            raw, offsets = text_column(batch, "sig")
            n = len(offsets) - 1
            if not n:
                continue
            sig = raw.view("<u2").reshape(n, HASHES)
            step = HASHES // TREES
            for t in range(TREES):
                turned = np.roll(sig[:, :], -t * step, axis=1)
                region = np.zeros((n, 4), "<u2")
                region[:, :depth] = turned[:, :depth]
                region = region.view("<i8").ravel()
                rest = np.ascontiguousarray(turned[:, depth:depth + 16])
                yield emit(schema, [np.full(n, t, np.int32), region, fixed_binary(rest), batch.column(0)])

    return classes.select("cls", "sig").mapInArrow(order, "tree int, region long, rest binary, cls long")


def forest(classes: DataFrame, depth: int) -> DataFrame:
    """(a, b) candidate classes, a < b: successors in the sorted orders that share a region."""
    def meet(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        tree = region = cls = np.zeros(0, np.int64)
        for batch in batches:
            fresh = len(tree)
            tree, region, cls = (np.concatenate([old, batch.column(i).to_numpy()]) for old, i in ((tree, 0), (region, 1), (cls, 3)))
            found = []
            for d in range(1, NEIGHBOURS + 1):
                lo = max(0, fresh - d)  # pairs whose second is new
                same = (tree[lo:-d] == tree[lo + d:]) & (region[lo:-d] == region[lo + d:])
                at = lo + np.flatnonzero(same)
                found.append(np.stack([cls[at], cls[at + d]]))
            pairs = np.concatenate(found, axis=1)
            if pairs.shape[1]:
                yield emit(schema, [pairs.min(axis=0), pairs.max(axis=0)])
            tree, region, cls = tree[-NEIGHBOURS:], region[-NEIGHBOURS:], cls[-NEIGHBOURS:]

    dealt = ordered(classes, depth).repartition("tree", "region").sortWithinPartitions("tree", "region", "rest", "cls")
    return dealt.mapInArrow(meet, "a long, b long").where("a <> b").distinct()


def promising(pairs: DataFrame, classes: DataFrame, agreement: int) -> DataFrame:
    """(a, b, agreement) of the candidates whose signatures agree enough."""
    def agree(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agreement", pa.int32())])
        for batch in batches:
            n = batch.num_rows
            if n:
                left, right = (text_column(batch, c)[0].view("<u2").reshape(n, HASHES) for c in ("left", "right"))
                same = (left == right).sum(axis=1)
                keep = same >= agreement
                yield emit(schema, [batch.column(0).to_numpy()[keep], batch.column(1).to_numpy()[keep], same[keep].astype(np.int32)])

    sigs = classes.select("cls", "sig")
    joined = pairs.join(sigs.withColumnsRenamed({"cls": "a", "sig": "left"}), "a").join(
        sigs.withColumnsRenamed({"cls": "b", "sig": "right"}), "b").select("a", "b", "left", "right")
    return joined.mapInArrow(agree, "a long, b long, agreement int")


def sets_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(cls, shingles): the sorted set of each wanted class as binary, from the text of its representative."""
    def run(batches):
        schema = pa.schema([("cls", pa.int64()), ("shingles", pa.binary())])
        for batch in batches:
            data, offsets = text_column(batch, "text")
            cls = batch.column(0).to_pylist()
            for lo, hi in slices(offsets):
                sets = shingles(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                own = [(c, s.tobytes()) for c, s in zip(cls[lo:hi], sets) if len(s) and class_of(s) == c]
                yield emit(schema, [[c for c, _ in own], [s for _, s in own]])

    rows = wanted.join(classes.select("cls", "rep"), "cls").join(
        texts.where("doc_id is not null and text is not null"), F.col("rep") == F.col("doc_id")).select("cls", "text")
    return rows.mapInArrow(run, "cls long, shingles binary").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def ties(sig: np.ndarray, sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, bounds: Bounds) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and ``right`` that tie different components together, at most one less than there are components."""
    sizes = np.array([len(s) for s in sets])
    names, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.split(numbers, np.cumsum(sizes)[:-1])
    kind = np.unique(component, return_inverse=True)[1]
    root = np.arange(kind.max() + 1)
    there = np.zeros(len(names), bool)
    found = []
    for i in left.tolist():
        apart = right[root[kind[right]] != root[kind[i]]]
        agree = np.concatenate([[0], *((sig[apart[lo:lo + 1024]] == sig[i]).sum(axis=1) for lo in range(0, len(apart), 1024))])[1:]
        hit = apart[agree >= bounds.agreement]
        if not len(hit):
            continue
        there[member[i]] = True
        common = np.add.reduceat(there[np.concatenate([member[h] for h in hit.tolist()])].astype(np.int64), np.cumsum(sizes[hit]) - sizes[hit])
        there[member[i]] = False
        linked = hit[bounds.bottom * common >= bounds.top * (sizes[i] + sizes[hit] - common)]
        linked = linked[np.unique(root[kind[linked]], return_index=True)[1]]
        if len(linked):
            found += [(i, h) for h in linked.tolist()]
            merge(root, np.full(len(linked), kind[i]), kind[linked])
            merge(root, root, root)
    return found


def crowded(classes: DataFrame, groups: DataFrame, texts: DataFrame, bounds: Bounds) -> DataFrame:
    """(a, b) links between different components in regions too large for the sorted order to have met all.

    A region's largest component is connected already; every other class of the region meets all classes of other components, in blocks
    of bounded size that hold the sets. A block gives out only links that tie components, so its output is linear in its classes.
    """
    most, most_bytes = BLOCK, BLOCK_BYTES
    place = ordered(classes, bounds.depth).select("tree", "region", "cls").join(groups.withColumnsRenamed({"id": "cls"}), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")).join(classes.select("cls", (F.col("size") * 8 + 512).alias("bytes")), "cls")
    parts = place.groupBy("tree", "region", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    mixed = parts.groupBy("tree", "region").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("kinds"), F.max(F.struct("n", "component", "bytes")).alias("top")).where(
        (F.col("kinds") > 1) & (F.col("n") > NEIGHBOURS + 1))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / most), F.ceil(size / most_bytes)).cast("int")
    mixed = mixed.select("tree", "region", F.col("top.component").alias("main"),
                         blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("i_parts"), blocks(F.col("n"), F.col("bytes")).alias("j_parts"))
    rows = stored(place.drop("bytes").join(mixed, ["tree", "region"]), "mixed")
    sets = stored(sets_of(rows.select("cls").distinct(), classes, texts), "sets")
    rows = rows.join(classes.select("cls", "sig"), "cls").join(sets, "cls")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(n)).cast("int")
    columns = ["tree", "region", "i", "j", "minor", "cls", "component", "sig", "shingles"]
    minor = rows.where("component <> main").withColumns({"minor": F.lit(True), "i": mine("i_parts", 1), "j": every("j_parts")}).select(columns)
    whole = rows.withColumns({"minor": F.lit(False), "j": mine("j_parts", 2), "i": every("i_parts")}).select(columns)

    def meet(part: pa.Table) -> pa.Table:
        minor, cls, component = (part.column(c).to_numpy() for c in ("minor", "cls", "component"))
        sig = np.stack([np.frombuffer(x, "<u2") for x in part.column("sig").to_pylist()])
        sets = [np.frombuffer(x, "<u8") for x in part.column("shingles").to_pylist()]
        found = ties(sig, sets, component, np.flatnonzero(minor), np.flatnonzero(~minor), bounds)
        ends = np.array(found, np.int64).reshape(-1, 2)
        a, b = cls[ends[:, 0]], cls[ends[:, 1]]
        return pa.table([np.minimum(a, b), np.maximum(a, b)], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    dealt = minor.union(whole).repartition("tree", "region", "i", "j")
    return dealt.groupBy("tree", "region", "i", "j").applyInArrow(meet, "a long, b long").where("a <> b").distinct()


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, bounds: Bounds) -> DataFrame:
    """(a, b) of the pairs that are links on their full sets. ``texts``: (doc_id, text)."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("cls")).join(classes.select("cls", "rep"), "cls")
    rows = ends.join(texts.where("doc_id is not null and text is not null"), ends.rep == texts.doc_id).select("a", "b", "cls", "text")

    def check(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        pair, sets = None, {}
        top, bottom = bounds.top, bounds.bottom

        def verdict():
            if pair is None or len(sets) < 2:
                return False
            left, right = sets[pair[0]], sets[pair[1]]
            common = len(np.intersect1d(left, right, assume_unique=True))
            return bottom * common >= top * (len(left) + len(right) - common)

        for batch in batches:
            out = []
            data, offsets = text_column(batch, "text")
            first, second, cls = (batch.column(i).to_pylist() for i in range(3))
            for lo, hi in slices(offsets):
                for i, found in enumerate(shingles(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]), lo):
                    if pair != (first[i], second[i]):
                        if verdict():
                            out.append(pair)
                        pair, sets = (first[i], second[i]), {}
                    if cls[i] not in sets and class_of(found) == cls[i]:
                        sets[cls[i]] = found
            yield emit(schema, [[p[0] for p in out], [p[1] for p in out]])
        if verdict():
            yield emit(schema, [[pair[0]], [pair[1]]])

    return rows.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(trimmed(check), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", bounds: Bounds = FROM_85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id, group_id) of every row; group_id tells components of one component_id apart."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    rows = stored(described(docs, id_column), "shingled")
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
                     .where("rep is not null"), "classes")
    pairs = stored(promising(forest(classes, bounds.depth), classes, bounds.agreement), "candidates")
    ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "agreement").union(
        pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "agreement"))
    best = ends.groupBy("u").agg(F.max(F.struct("agreement", "v")).alias("best")).select(
        F.least("u", "best.v").alias("a"), F.greatest("u", "best.v").alias("b")).distinct()
    links = stored(confirmed(best, classes, texts, bounds), "links")
    groups = stored(components(links), "groups")
    left, right = groups.withColumnsRenamed({"id": "a", "component": "ca"}), groups.withColumnsRenamed({"id": "b", "component": "cb"})
    open_ = pairs.join(best, ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left").where(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = stored(confirmed(open_, classes, texts, bounds), "links")
    links = links.union(more)
    groups = stored(components(links), "groups")
    rest = stored(crowded(classes, groups, texts, bounds), "crowded")
    groups = stored(components(links.union(rest)), "groups")
    least = groups.join(classes.select(F.col("cls").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = groups.join(least, "component").select(F.col("id").alias("cls"), "component_id", F.col("component").alias("group_id"))
    final = classes.select("cls", "rep").join(of_class, "cls", "left").select(
        "cls", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("group_id", "cls").alias("group_id"))
    return rows.drop("sig").join(final, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class_id"), "group_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op3_near_dup_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def with_class(docs: DataFrame) -> DataFrame:
    """``docs`` and the class of each row's set, null without words."""
    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch, "text")
            cls = [class_of(s) if len(s) else None for lo, hi in slices(offsets)
                   for s in shingles(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls, pa.int64())], names=[*batch.schema.names, "__cls"])

    return docs.mapInArrow(trimmed(run), StructType([*docs.schema.fields, StructField("__cls", LongType())]))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, bounds: Bounds = FROM_85) -> DataFrame:
    """Pipeline stage: one row of each group stays, that of the smallest id. Rows without a word stay.

    It is decided by row: texts that share an id are told apart by their class, repeated rows stay once. Rows without an id take part under
    the hash of their text, behind all ids below 2^62.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    keyed = docs.withColumn("__key", key)
    stay = near_duplicates(keyed, "__key", bounds).where("kept and class_id is not null").groupBy("group_id").agg(
        F.min(F.struct("class_id", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("__key"), F.col("first.class_id").alias("__cls"), F.lit(True).alias("__stays"))
    rows = with_class(keyed).join(stay, ["__key", "__cls"], "left").where("__stays or __cls is null")
    once = Window.partitionBy("__key", "__cls").orderBy(F.xxhash64("text"))
    return rows.withColumn("__n", F.row_number().over(once)).where("__n = 1 or __cls is null").select(docs.columns)
