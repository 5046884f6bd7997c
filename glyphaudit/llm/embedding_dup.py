"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Equal vectors are one class. Classes are assigned to the nearest of at most ``CELLS`` unit centres, learned on a bounded sample; fewer are
made where more would not keep vectors apart. A partner y of x lies in
another cell c' only across the plane between the two centres, so if x is farther from that plane than the angle allows,

    (x.c - x.c') / |c - c'| > sin(arccos THRESHOLD),

no partner of x can be there; else x visits c' too. Each cell compares its visitors and own vectors with its own vectors, so every ordered pair
is seen once and no pair is missed. Cells of any size are cut into blocks of about ``BLOCK`` by ``BLOCK`` vectors; a block gives out counts
and a spanning forest, never its pairs. Products are in single precision; those near the threshold are decided in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, link with nothing; vectors of different length neither;
equal vectors link with each other; repeated rows count as vectors of their own; ``label`` and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Shared, emit, stored, table
from .components import components
from .vectors import matrix_of, unit, usable

THRESHOLD = 0.95
CELLS, SAMPLE, ROUNDS = 64, 20_000, 12
BLOCK = 8192
DOUBT = 1e-5


def spherical_k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centres of unit rows, at most ``k``, started far apart."""
    chance = np.random.default_rng(seed)
    centres = rows[chance.integers(len(rows))][None]
    near = rows @ centres[0]
    while len(centres) < min(k, len(rows)):
        weight = np.maximum(1 - near, 0)
        if weight.sum() <= 1e-9:
            break
        pick = rows[chance.choice(len(rows), p=weight / weight.sum())]
        centres = np.vstack([centres, pick])
        near = np.maximum(near, rows @ pick)
    for _ in range(rounds):
        home = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def visits(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row, and the cells its partners may be in (home among them)."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[home]
    reach = float(np.sqrt(1 - threshold ** 2)) + 1e-9
    return home, near[np.arange(len(x)), home][:, None] - near <= reach * apart


def parting_centres(rows: np.ndarray, cells: int, threshold: float) -> np.ndarray:
    """The most centres, halving from ``cells``, that keep a vector out of half of the cells on the average; else one."""
    while cells > 1:
        centres = spherical_k_means(rows, cells)
        if visits(rows, centres, threshold)[1].mean() <= 0.5:
            return centres
        cells //= 2
    return spherical_k_means(rows, 1)


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a[i] with b[i] in a forest where every node points to a smaller or equal one."""
    while len(a):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def learn_centres(classes: DataFrame, cells: int, sample: int, threshold: float = THRESHOLD) -> dict[int, np.ndarray]:
    """Centres by vector length, of a bounded sample in hash order."""
    rows = classes.select("embedding").orderBy(F.xxhash64("cls"), "cls").limit(sample).collect()
    by_width: dict[int, list] = {}
    for r in rows:
        by_width.setdefault(len(r[0]), []).append(r[0])
    return {n: parting_centres(unit(np.array(v, np.float64)), cells, threshold) for n, v in by_width.items()}


def assigned(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(width, cell, own, cls, copies, embedding): each class in its own cell and in those where partners may be."""
    shared = Shared(classes.sparkSession, centres)

    def run(batches):
        centres, schema = shared.get(), None
        for batch in batches:
            lists = batch.column(0)
            widths = np.diff(lists.offsets.to_numpy())
            schema = schema or pa.schema([("width", pa.int32()), ("cell", pa.int32()), ("own", pa.bool_()), ("cls", pa.int64()),
                                          ("copies", pa.int64()), ("embedding", lists.type)])
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                x = unit(matrix_of(lists.take(pa.array(at)), width))
                c = centres.get(width)
                if c is None:
                    row, cell, own = np.arange(len(at)), np.zeros(len(at), np.int32), np.ones(len(at), bool)
                else:
                    home, may = visits(x, c, threshold)
                    row, cell = np.nonzero(may)
                    own = cell == home[row]
                yield emit(schema, [np.full(len(row), width, np.int32), cell.astype(np.int32), own,
                                    *(batch.column(i).take(pa.array(at[row])) for i in (1, 2)), lists.take(pa.array(at[row]))])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("embedding", "cls", "copies").mapInArrow(
        run, f"width int, cell int, own boolean, cls long, copies long, embedding {kind}")


def compared(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, links): partial numbers of links of class a where b is null, else an edge of a spanning forest."""
    sizes = rows.groupBy("width", "cell").agg(F.sum(F.col("own").cast("long")).alias("n_own"), F.count("*").alias("n_all"))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    sized = rows.join(sizes, ["width", "cell"]).withColumns({"own_parts": F.greatest(parts("n_own"), F.lit(1)), "parts": parts("n_all")})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(n)).cast("int")
    fixed = sized.where("own").withColumns({"right": F.lit(True), "h": mine("own_parts", 1), "l": F.explode(every("parts"))})
    moving = sized.withColumns({"right": F.lit(False), "l": mine("parts", 2), "h": F.explode(every("own_parts"))})
    columns = ["width", "cell", "h", "l", "right", "cls", "copies", "embedding"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        right = part.column("right").to_numpy()
        cls, copies = part.column("cls").to_numpy(), part.column("copies").to_numpy()
        x = unit(matrix_of(part.column("embedding"), part.column("width")[0].as_py()))
        order = np.argsort(cls, kind="stable")  # the forest's smallest node is the smallest class
        right, cls, copies, x = right[order], cls[order], copies[order], x[order]
        left_at, right_at = np.flatnonzero(~right), np.flatnonzero(right)
        node = np.unique(cls, return_inverse=True)[1]
        parent, links = np.arange(node.max() + 1), np.zeros(len(left_at), np.int64)
        small, other = x.astype(np.float32), x[right_at].astype(np.float32)
        for lo in range(0, len(left_at), 1024):
            at = left_at[lo:lo + 1024]
            products = small[at] @ other.T
            i, j = np.nonzero(products >= threshold - DOUBT)
            close = np.flatnonzero(products[i, j] < threshold + DOUBT)
            exact = np.einsum("ij,ij->i", x[at[i[close]]], x[right_at[j[close]]])
            keep = np.ones(len(i), bool)
            keep[close] = exact >= threshold
            keep &= cls[at[i]] != cls[right_at[j]]
            i, j = i[keep], j[keep]
            links[lo:lo + len(at)] = np.bincount(i, weights=copies[right_at[j]], minlength=len(at))
            merge(parent, node[at[i]], node[right_at[j]])
        names = np.unique(cls)
        merge(parent, parent, parent)
        tied = np.flatnonzero(parent != np.arange(len(parent)))
        some = np.flatnonzero(links)
        a = np.concatenate([cls[left_at[some]], names[tied]])
        b = pa.array(np.concatenate([np.zeros(len(some), np.int64), names[parent[tied]]]), mask=np.arange(len(a)) < len(some))
        return pa.table([pa.array(a), b, pa.array(np.concatenate([links[some], np.zeros(len(tied), np.int64)]))], schema=schema)

    dealt = fixed.select(columns).union(moving.select(columns)).repartition("width", "cell", "h", "l")  # else a whole cell is one task after a sort-merge join
    return dealt.groupBy("width", "cell", "h", "l").applyInArrow(run, "a long, b long, links long")


def near_duplicate_vectors(vectors: DataFrame, id_column: str = "vec_id", threshold: float = THRESHOLD, cells: int = CELLS,
                           sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. ``threshold`` must be above 0."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("cls", F.when(usable(), F.xxhash64("embedding")))
    classes = stored(rows.where("cls is not null").groupBy("cls", "embedding").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("rep")), "vectors")
    centres = learn_centres(classes, cells, sample, threshold)
    found = stored(compared(stored(assigned(classes, centres, threshold), "cells"), threshold, block), "compared")
    links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    groups = stored(components(found.where("b is not null").select("a", "b")), "groups")
    least = groups.join(classes.select(F.col("cls").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    of_class = groups.join(least, "component").select(F.col("id").alias("cls"), "least")
    facts = classes.join(links, "cls", "left").join(of_class, "cls", "left").select(
        "cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.join(facts, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
