"""Ranked lexical search with per-term geometric blocking.

Documents become sparse vectors: for every term asked for, its share of the score, an integer that depends on how often the document holds it and on
the document's length. Vectors are indexed by segments of at most ``SEGMENT`` documents. In a segment each term has a posting list; a long list is
clustered by the similarity of its documents (nearest of evenly spaced pivots under random projections of their vectors) and cut into blocks of at
most ``BLOCK``. A block keeps a summary: the coordinatewise maximum of its documents' vectors. The product of a query with a summary is an
exact upper bound of every score in the block.

A list is blocked when a query first needs it; lists whose own greatest shares together stay below the score a query needs are left out, as no
document found in them alone can reach it. A query goes through the blocks of its other terms in falling order of their bounds. It stops at the first bound below the score it needs to enter the
k best found so far; equal bounds are still looked at, as ties go to smaller ids. Documents of blocks not skipped are scored exactly.
What a query needs is known beforehand from a first scan that scores all documents holding one of the query's ``SEEDS`` rarest terms: its
k-th best is a lower bound everywhere.

Queries are taken in batches of about ``BATCH`` bytes, so that vocabulary, weights and bounds held by a task are bounded whatever their number. For
each batch the documents are read once; vectors of its terms are stored and scanned twice. Segments are made of the rows as they
lie: nothing is shuffled but each task's k best per query. Terms are found by a hash and confirmed byte by byte.

Defined cases: null texts and texts without a term are no documents of the statistics and are never found; rows are documents of their own, also
if repeated; ids may be null and rank last among ties; items without a term or with terms that no document holds give no rows; repeated rows of an
item count once, different texts of one item are ranked apart; texts of any length are read in slices of whole texts; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Shared, emit, kept_in_worker, slices, stored, table, text_column
from .words import BYTE_VALUE, CHUNK, U, mix, prefix_sums

NEAREST, SEEDS = 10, 3
SEGMENT, ENTRIES, BLOCK, SKETCH = 2048, 1 << 19, 128, 32
BATCH = 4 << 20          # bytes of query texts taken at once
SIEVE = 22               # bits of the table that most foreign words fail
PARTS = 32               # parts of a query's results that are ranked apart first
NO_ID = (1 << 63) - 1    # stands for a null id in the order of ties
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of all terms, A-Z as a-z. No term crosses a row."""
    solid = IN_TERM[data]
    first = offsets[:-1][offsets[:-1] < len(data)]
    last = offsets[1:][offsets[1:] > 0] - 1
    before, after = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
    before[first], after[last] = False, False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    hashes, lo = np.empty(len(starts), U), 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            base = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            sums, inverse = prefix_sums(data[base:ends[hi - 1]], BYTE_VALUE)
            a, b = starts[lo:hi] - base, ends[lo:hi] - base
            hashes[lo:hi] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U))
            lo = hi
    return np.searchsorted(offsets, starts, "right") - 1, hashes, starts, ends


class Vocabulary:
    """Terms by number, found by hash and confirmed by their bytes."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.stops = np.cumsum([len(t) for t in terms]).astype(np.int64)
        self.lengths = np.diff(self.stops, prepend=0)
        hashes = terms_of(np.frombuffer(b" ".join(terms), np.uint8), np.array([0, len(self.data) + max(len(terms) - 1, 0)]))[1]
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(hashes & U((1 << SIEVE) - 1)).astype(np.int64)] = True

    def find(self, data, hashes, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(places among the words, term numbers) of the words that are terms."""
        at = np.flatnonzero(self.sieve[(hashes & U((1 << SIEVE) - 1)).astype(np.int64)])
        if not len(at):
            return at, at
        where = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[where] == hashes[at]
        at, number = at[same], self.order[where[same]]
        ok = self.lengths[number] == ends[at] - starts[at]
        live, k = np.flatnonzero(ok), 0
        while len(live := live[self.lengths[number[live]] > k]):
            term = number[live]
            wrong = _LOWER[data[starts[at[live]] + k]] != self.data[self.stops[term] - self.lengths[term] + k]
            ok[live[wrong]] = False
            live, k = live[~wrong], k + 1
        return at[ok], number[ok]


@dataclass
class Queries:
    """A batch: ids, and for each its distinct term numbers and how often it holds them."""
    ids: list
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    vocabulary: Vocabulary
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))   # by term, 0 where no document holds it
    documents: int = 0
    length: int = 1            # terms of all documents
    needed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))    # least score to enter the k best

    def factors(self, q: int) -> np.ndarray:
        return self.weights[self.terms[q]] * self.counts[q]


def queries_of(rows: list) -> Queries:
    """From (id, text) rows."""
    ids, found = [], []
    for name, text in rows:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        _, _, starts, ends = terms_of(data, np.array([0, len(data)]))
        lower = _LOWER[data].tobytes()
        if words := [lower[a:b] for a, b in zip(starts.tolist(), ends.tolist())]:
            ids.append(name)
            found.append(words)
    number = {t: i for i, t in enumerate(dict.fromkeys(w for words in found for w in words))}
    each = [np.unique([number[w] for w in words], return_counts=True) for words in found]
    return Queries(ids, [t for t, _ in each], [c for _, c in each], Vocabulary(list(number)))


def vectors_of(docs: DataFrame, queries: Shared, id_column: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every row with a term: n of all terms, the others of those in the vocabulary."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches):
        vocabulary = queries.get().vocabulary
        size = max(len(vocabulary.terms), 1)
        for batch in batches:
            data, offsets = text_column(batch, "text")
            for lo, hi in slices(offsets):
                part = data[offsets[lo]:offsets[hi]]
                row, hashes, starts, ends = terms_of(part, offsets[lo:hi + 1] - offsets[lo])
                n = np.bincount(row, minlength=hi - lo)
                at, number = vocabulary.find(part, hashes, starts, ends)
                key, count = np.unique(row[at] * size + number, return_counts=True)
                keep = np.flatnonzero(n)
                cut = pa.array(np.append(np.searchsorted(key, keep * size), len(key)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (key % size, count)]
                yield emit(schema, [batch.column(0).slice(lo, hi - lo).take(pa.array(keep)), n[keep], *lists])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def with_statistics(queries: Queries, vectors: DataFrame) -> Queries:
    """The weights, from counts over all documents. A row per term of the batch comes to the driver."""
    n, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    size = len(queries.vocabulary.terms)

    def count(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for term, many in vectors.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = many
    queries.documents, queries.length = n, length
    queries.weights = np.array([floor(1000 * log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    return queries


@dataclass
class Rows:
    """Document vectors of a batch: entries of row i are ``at[i]`` to ``at[i + 1]``; ``share`` is the part of the score before the term's weight."""
    ids: np.ndarray
    null: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    share: np.ndarray

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the entries of some rows, where each row's begin)."""
        size = self.at[docs + 1] - self.at[docs]
        begin = np.cumsum(size) - size
        return np.repeat(self.at[docs] - begin, size) + np.arange(size.sum()), begin

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of rows that have an entry each."""
        places, begin = self.entries(docs)
        return np.add.reduceat(weight[self.terms[places]] * self.share[places], begin)


def rows_of(batch: pa.RecordBatch, queries: Queries):
    """The rows of a batch that have an entry, by segments."""
    lists = [batch.column(i) for i in (2, 3)]
    at = lists[0].offsets.to_numpy().astype(np.int64)
    at -= at[0]
    terms, counts = (x.flatten().to_numpy() for x in lists)
    n, back = np.unique(batch.column(1).to_numpy(), return_inverse=True)
    m = np.array([25 + (75 * x * queries.documents) // queries.length for x in n.tolist()], np.int64)[back]
    counts = counts.astype(np.int64)
    share = (1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, np.diff(at)))
    null = ~batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    ids = batch.column(0).fill_null(NO_ID).to_numpy()
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, min(lo + SEGMENT, int(np.searchsorted(at, at[lo] + ENTRIES, "right")) - 1))
        own = lo + np.flatnonzero(at[lo + 1:hi + 1] > at[lo:hi])
        if len(own):
            part = slice(at[lo], at[hi])
            yield Rows(ids[own], null[own], np.append(at[own], at[hi]) - at[lo], terms[part], share[part])
        lo = hi


class Blocks:
    """The posting lists of a segment; a list's blocks and their summaries are made when it is first asked for."""

    def __init__(self, rows: Rows, size: int):
        self.rows = rows
        doc = np.repeat(np.arange(len(rows.ids)), np.diff(rows.at))
        self.lists = doc[np.argsort(rows.terms, kind="stable")]
        self.ends = np.cumsum(np.bincount(rows.terms, minlength=size))
        self.most = np.zeros(size, np.int64)      # the summary of a whole list in its own term
        np.maximum.at(self.most, rows.terms, rows.share)
        self.top = np.zeros(size, np.int64)
        self.made: dict[int, tuple] = {}
        self.sketch = None

    def _sketch(self) -> np.ndarray:
        """Random projections of the rows' vectors, of length 1."""
        if self.sketch is None:
            rows = self.rows
            doc = np.repeat(np.arange(len(rows.ids)), np.diff(rows.at))
            signs = kept_in_worker("lexical sketch", lambda: np.random.default_rng(17).choice(np.array([-1, 1], np.int8), (1 << 12, SKETCH)))
            place = rows.terms & 0xFFF
            sketch = np.stack([np.bincount(doc, signs[place, k] * rows.share, len(rows.ids)) for k in range(SKETCH)], axis=1)
            self.sketch = (sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        return self.sketch

    def of(self, t: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(documents of each block, where its summary begins, terms and maxima of the summaries) of a term's list."""
        if t not in self.made:
            rows, top, terms, tops = self.rows, self.top, [], []
            docs = self.lists[self.ends[t - 1] if t else 0:self.ends[t]]
            blocks = [docs] if len(docs) <= BLOCK else self._clusters(docs, self._sketch())
            for members in blocks:
                if len(members) == 1:
                    entries = slice(rows.at[members[0]], rows.at[members[0] + 1])
                    at, most = rows.terms[entries], rows.share[entries]
                else:
                    places, _ = rows.entries(members)
                    np.maximum.at(top, rows.terms[places], rows.share[places])
                    at = np.flatnonzero(top)
                    most = top[at]
                    top[at] = 0
                terms.append(at)
                tops.append(most)
            size = np.array([len(x) for x in terms])
            self.made[t] = blocks, np.cumsum(size) - size, np.concatenate(terms), np.concatenate(tops).astype(np.int32)   # shares are at most a million
        return self.made[t]

    @staticmethod
    def _clusters(docs: np.ndarray, sketch: np.ndarray) -> list[np.ndarray]:
        """A posting list in blocks of similar documents."""
        n = len(docs)
        pivots = docs[np.linspace(0, n - 1, -(-n // BLOCK)).astype(np.int64)]
        home = (sketch[docs] @ sketch[pivots].T).argmax(axis=1)
        docs, home = docs[np.argsort(home, kind="stable")], np.sort(home)
        out = []
        for part in np.split(docs, np.flatnonzero(np.diff(home)) + 1):
            out += [part[i:i + BLOCK] for i in range(0, len(part), BLOCK)]
        return out

    def bounds(self, terms: np.ndarray, weight: np.ndarray, needed: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(documents, upper bound of their scores) of the blocks in which a score of ``needed`` may be.

        The lists of terms whose own summaries together stay below it are left out: a document in none of the other lists cannot reach it.
        """
        most = weight[terms] * self.most[terms]
        order = np.argsort(most, kind="stable")
        hope = terms[order[(np.cumsum(most[order]) >= needed) & (most[order] > 0)]]
        blocks, bounds = [], []
        for t in hope.tolist():
            docs, at, own, tops = self.of(t)
            blocks += docs
            bounds.append(np.add.reduceat(weight[own] * tops, at))
        return blocks, np.concatenate(bounds) if blocks else np.zeros(0, np.int64)


class Best:
    """The k best of every query; ties to smaller ids."""

    def __init__(self, queries: Queries, k: int):
        self.k, self.needed = k, np.maximum(queries.needed, 1) if len(queries.needed) else np.ones(len(queries.ids), np.int64)
        self.held = [None] * len(queries.ids)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        keep = scores >= self.needed[q]
        if not keep.any():
            return
        new = [scores[keep], ids[keep], null[keep]]
        if self.held[q] is not None:
            new = [np.concatenate(pair) for pair in zip(self.held[q], new)]
        order = np.lexsort((new[1], -new[0]))[:self.k]
        self.held[q] = [x[order] for x in new]
        if len(order) == self.k:
            self.needed[q] = max(self.needed[q], int(self.held[q][0][-1]))

    def rows(self, queries: Queries, id_type: pa.DataType | None = None):
        """(q, item_id, doc_id, score), or (q, score) without a type."""
        there = [q for q, h in enumerate(self.held) if h is not None]
        if there:
            scores, ids, null = (np.concatenate([self.held[q][i] for q in there]) for i in range(3))
            q = np.repeat(there, [len(self.held[x][0]) for x in there])
            names = [] if id_type is None else [pa.array([queries.ids[i] for i in q.tolist()], id_type), pa.array(ids, mask=null)]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), *names, pa.array(scores)], names=["q", *["item_id", "doc_id"][:len(names)], "score"])


def look(blocks: Blocks, queries: Queries, best: Best, weight: np.ndarray) -> int:
    """Take the queries through a segment; the number of blocks looked into. ``weight`` is zero and is left so."""
    looked = 0
    for q, terms in enumerate(queries.terms):
        weight[terms] = queries.factors(q)
        docs, bounds = blocks.bounds(terms, weight, int(best.needed[q]))
        hope = np.flatnonzero(bounds >= best.needed[q])
        hope = hope[np.argsort(-bounds[hope], kind="stable")]
        seen, lo, step = np.zeros(len(blocks.rows.ids), bool), 0, 1
        while lo < len(hope) and bounds[hope[lo]] >= best.needed[q]:
            some = hope[lo:lo + step]
            some = some[bounds[some] >= best.needed[q]]
            new = np.zeros(len(seen), bool)
            for b in some.tolist():
                new[docs[b]] = True
            new &= ~seen
            seen |= new
            rows = np.flatnonzero(new)
            if len(rows):
                best.add(q, blocks.rows.scores(rows, weight), blocks.rows.ids[rows], blocks.rows.null[rows])
            lo, step = lo + len(some), min(2 * step, 64)
        looked += lo
        weight[terms] = 0
    return looked


def seeded(queries: Queries, vectors: DataFrame, k: int, seeds: int = SEEDS) -> Queries:
    """``needed``: the k-th best score among the documents that hold one of a query's rarest terms."""
    shared, size = Shared(vectors.sparkSession, queries), len(queries.vocabulary.terms)

    def run(batches):
        queries = shared.get()
        best, weight = Best(queries, k), np.zeros(size, np.int64)
        asked: dict[int, list[int]] = {}
        for q, terms in enumerate(queries.terms):
            known = terms[queries.weights[terms] > 0]
            for t in known[np.argsort(-queries.weights[known], kind="stable")][:seeds].tolist():
                asked.setdefault(t, []).append(q)
        rare = np.zeros(size, bool)
        rare[list(asked)] = True
        for batch in batches:
            for rows in rows_of(batch, queries):
                hit = np.flatnonzero(rare[rows.terms])
                doc = np.searchsorted(rows.at, hit, "right") - 1
                wanted: dict[int, set] = {}
                for t, d in zip(rows.terms[hit].tolist(), doc.tolist()):
                    for q in asked[t]:
                        wanted.setdefault(q, set()).add(d)
                for q, docs in wanted.items():
                    docs = np.array(sorted(docs))
                    weight[queries.terms[q]] = queries.factors(q)
                    best.add(q, rows.scores(docs, weight), rows.ids[docs], rows.null[docs])
                    weight[queries.terms[q]] = 0
        yield from best.rows(queries)

    found = _ranked(vectors.select("doc_id", "n", "terms", "counts").mapInArrow(run, "q int, score long"), k, [F.desc("score")])
    needed = np.ones(len(queries.ids), np.int64)
    for q, score in found.where(F.col("rank") == k).select("q", "score").collect():   # a row per query of the batch
        needed[q] = max(score, 1)
    queries.needed = needed
    return queries


def _ranked(found: DataFrame, k: int, order: list) -> DataFrame:
    """The first k of every query; first within parts, so that a query's rows of all tasks are not one task's."""
    part = Window.partitionBy("q", "part").orderBy(*order)
    few = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return few.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = NEAREST, id_column: str = "doc_id", batch: int = BATCH) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item (item_id, text) with a score above 0."""
    asked = items.select("item_id", "text").where("text is not null").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // batch))
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == b).orderBy("item_id", "text").collect()   # bounded by ``batch``
        found = _searched(docs, queries_of([tuple(r) for r in rows]), k, id_column, kind)
        out = found if out is None else out.union(found)
    return out


def _searched(docs: DataFrame, queries: Queries, k: int, id_column: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    vectors = stored(vectors_of(docs, Shared(spark, queries), id_column), "vectors")
    queries = seeded(with_statistics(queries, vectors), vectors, k)
    shared, size = Shared(spark, queries), len(queries.vocabulary.terms)
    id_type = pa.string() if kind == "string" else pa.int64()

    def run(batches):
        queries = shared.get()
        best, weight = Best(queries, k), np.zeros(size, np.int64)
        for batch in batches:
            for rows in rows_of(batch, queries):
                look(Blocks(rows, size), queries, best, weight)
        yield from best.rows(queries, id_type)

    found = vectors.select("doc_id", "n", "terms", "counts").mapInArrow(run, f"q int, item_id {'string' if kind == 'string' else 'long'}, doc_id long, score long")
    ranked = _ranked(found, k, [F.desc("score"), F.asc_nulls_last("doc_id")])
    return ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op12_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
