"""Packing documents into training sequences, in order, by dynamic programming.

The documents of a partition are one stream of tokens. Windows of at most ``LENGTH`` tokens cut it; a cut may lie at the end of a document
(free), at the end of a sentence or line (small penalty) or, inside stretches of over ``STRETCH`` tokens without either, at every
``STEP``-th token (larger penalty). The cost of a window is its padding (none at a power of two), its cut's penalty and a
constant. The cheapest cutting of the stream is found exactly: with f(j) the least cost up to cut j,

    f(j) = penalty(j) + min over i of f(i) + LENGTH - (p(j) - p(i)),     p(j) - LENGTH <= p(i) < p(j)

whose minimum over f(i) + p(i) is kept in a monotone queue as both ends of the range only move forward; power-of-two windows are looked up
beside it. The stream is taken in blocks of ``BLOCK`` tokens; a block's last window is carried into the next block.

No shuffle: each partition packs what it reads, and only its last sequence can be short. Sequence numbers hold the partition.

Defined cases: null and empty texts are the single end id; repeated rows are packed as often as they occur; an empty table has no
sequences; ``doc_id`` may be null; other columns are ignored. Text that spells an added token of the tokenizer is that token, as in the
library; what stands around it is encoded as texts of its own.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe_fst import PieceCache, encode_texts, read_ranks, text_slices
from .common import emit, kept_in_worker, table, trimmed, without_collection

VOCABULARY = "byte_bpe_50k.tiktoken"   # the ranks of byte_bpe_50k.json
TOKENIZER = "byte_bpe_50k.json"        # names the added tokens
LENGTH, END_ID = 2048, 1
SENTENCE, INSIDE, WINDOW = 4, 24, 32   # penalties in tokens of padding: sentence cut, cut inside a sentence, each window
STRETCH, STEP, LEAST_POWER = 96, 32, 512
BLOCK = 1 << 20
KEPT_PIECES = 150_000                  # encoded pieces a worker keeps, twice at most


def tokenizer(path: str) -> tuple[PieceCache, np.ndarray]:
    """Cached encoder of pieces, and which ids end a sentence or a line."""
    import tiktoken

    ranks = read_ranks(path)
    core = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ends = np.zeros(max(ranks.values()) + 2, bool)
    ends[[i for t, i in ranks.items() if t.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b"\n")]] = True
    return PieceCache(core.encode_ordinary, KEPT_PIECES), ends


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that a tokenizer file adds to its vocabulary, by their text. Read on the driver: the file is part of the library."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encode_documents(texts: list[str], cache: PieceCache, pattern: str, added: dict[str, int]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit bytes. Added tokens are found first, the leftmost and of those the longest."""
    if not added:
        return encode_texts(texts, cache, pattern)
    mark = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))
    marked = [i for i, t in enumerate(texts) if mark.search(t)]
    if not marked:
        return encode_texts(texts, cache, pattern)
    ids = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
    out = encode_texts(["" if i in set(marked) else t for i, t in enumerate(texts)], cache, pattern)
    for i in marked:
        parts = encode_texts(mark.split(texts[i]), cache, pattern)
        found = mark.findall(texts[i])
        out[i] = b"".join([parts[0], *(ids[t] + part for t, part in zip(found, parts[1:]))])
    return out


def cut_stream(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH, window: int = WINDOW, least_power: int = LEAST_POWER) -> list[int]:
    """Indexes into ``places`` (ascending, first 0, gaps of at most ``length``) of the cheapest cuts, first and last included."""
    n = len(places)
    exact: dict[int, list[int]] = {}
    power = least_power
    while power < length:
        at = np.searchsorted(places, places - power)
        for j in np.flatnonzero((places >= power) & (places[np.minimum(at, n - 1)] == places - power)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        power *= 2
    where, penalty = places.tolist(), penalties.tolist()
    cost, back, queue = [0.0] * n, [0] * n, deque([0])
    value = [0.0] * n  # f(i) + p(i)
    for j in range(1, n):
        p = where[j]
        while where[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        best = value[i] + length - p
        for e in exact.get(j, ()):
            if cost[e] < best:
                best, i = cost[e], e
        cost[j], back[j] = best + penalty[j] + window, i
        value[j] = v = cost[j] + p
        while queue and value[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def places_of(ids: np.ndarray, document_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a block may be cut and at which penalty; 0 and the end are included."""
    penalty = np.full(len(ids) + 1, INSIDE, np.int32)
    allowed = np.zeros(len(ids) + 1, bool)
    sentence = np.flatnonzero(sentence_ends[ids]) + 1
    allowed[sentence], penalty[sentence] = True, SENTENCE
    allowed[document_ends], penalty[document_ends] = True, 0
    allowed[[0, len(ids)]] = True
    known = np.flatnonzero(allowed)
    for a in known[:-1][np.diff(known) > STRETCH].tolist():
        b = int(known[np.searchsorted(known, a) + 1])
        allowed[a + STEP:b:STEP] = True
    places = np.flatnonzero(allowed)
    return places, penalty[places]


PIECES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Packer:
    """Collects documents and gives out the pieces of finished sequences."""

    def __init__(self, first_sequence: int, sentence_ends: np.ndarray, block: int = BLOCK):
        self.next, self.sentence_ends, self.block = first_sequence, sentence_ends, block
        self.docs: list[tuple[object, bytes, int, int]] = []  # id, ids left, their start, ids of the document
        self.waiting = 0

    def add(self, doc_id, ids: bytes) -> bool:
        """True if a block is full."""
        self.docs.append((doc_id, ids, 0, len(ids) // 4))
        self.waiting += len(ids) // 4
        return self.waiting >= self.block

    def pack(self, last: bool) -> tuple[list, list[np.ndarray]]:
        """Document ids and the columns of ``PIECES``."""
        if not self.docs:
            return [], [np.zeros(0, np.int64)] * len(PIECES)
        raw = b"".join(d[1] for d in self.docs)
        ids = np.frombuffer(raw, "<u4")
        ends = np.cumsum([len(d[1]) // 4 for d in self.docs])
        begins = np.concatenate([[0], ends[:-1]])
        places, penalties = places_of(ids, ends, self.sentence_ends)
        windows = places[cut_stream(places, penalties)]
        if not last:
            windows = windows[:-1]
        done = int(windows[-1])
        cuts = np.unique(np.concatenate([windows[:-1], begins[begins < done]]))
        stops = np.append(cuts[1:], done) if len(cuts) else cuts
        doc = np.searchsorted(begins, cuts, "right") - 1
        window = np.searchsorted(windows, cuts, "right") - 1
        base = np.array([d[2] for d in self.docs], np.int64)
        view = memoryview(raw)
        crc = np.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(cuts.tolist(), stops.tolist())], np.int64)
        columns = [cuts - begins[doc] + base[doc], stops - cuts, crc, np.array([d[3] for d in self.docs], np.int64)[doc],
                   self.next + window, cuts - windows[window]]
        names = [self.docs[i][0] for i in doc.tolist()]
        self.next += len(windows) - 1
        rest = int(np.searchsorted(ends, done, "right"))
        kept = self.docs[rest:]
        if kept and begins[rest] < done:
            used = done - int(begins[rest])
            doc_id, left, start, total = kept[0]
            kept[0] = (doc_id, left[4 * used:], start + used, total)
        self.docs, self.waiting = kept, len(ids) - done
        return names, columns


def packed(docs: DataFrame, path: str, id_column: str = "doc_id", end_id: int = END_ID, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of a document in a sequence. ``added``: tokens that are found in the text before it is split."""
    field = docs.schema[id_column]
    kind, pattern, end = field.dataType.simpleString(), public_tokenizers.PATTERN, np.array([end_id], "<u4").tobytes()

    def run(batches):
        with without_collection():
            yield from pack(batches)

    def pack(batches):
        cache, sentence_ends = kept_in_worker(f"packing {path}", lambda: tokenizer(path))
        packer, schema = Packer(TaskContext.get().partitionId() << 33, sentence_ends), None

        def out(last):
            names, columns = packer.pack(last)
            return emit(schema, [names, *columns])

        for batch in batches:
            schema = schema or pa.schema([pa.field(id_column, batch.schema.field(0).type), *PIECES])
            for lo, hi, texts in text_slices(batch):
                names = batch.column(0).slice(lo, hi - lo).to_pylist()
                for name, ids in zip(names, encode_documents(texts, cache, pattern, added or {})):
                    if packer.add(name, ids + end):
                        yield out(False)
        if schema is not None:
            yield out(True)

    return docs.select(id_column, "text").mapInArrow(
        trimmed(run), f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), added=added_tokens(public_tokenizers.path(TOKENIZER)))


def packed_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents."""
    return packed(docs, public_tokenizers.path(VOCABULARY), added=added_tokens(public_tokenizers.path(TOKENIZER)))
