"""Token-id matrices by best-fit-decreasing packing.

Documents are encoded, closed with an end id, and split without loss into full rows and a rest shorter than a row. The rests of a block are
sorted by falling length and each goes to the open row with the least room that still holds it. Rooms are leaves of a segment tree whose nodes
count open rows, so the search takes a step per level. A row carries its padded ids, the cumulative lengths of its segments and where
positions restart.

Blocks of ``BLOCK`` tokens bound the memory; there is no shuffle. Rows are numbered by partition.

Defined cases: null and empty texts are a single end id; equal lengths keep their input order; repeated rows are packed as often as they occur; an
empty table has no rows; other columns than the id and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe_fst import text_slices
from .common import emit, kept_in_worker, table, without_collection
from .packing import TOKENIZER, VOCABULARY, added_tokens, encode_documents, tokenizer

LENGTH, END_ID, BLOCK = 2048, 50256, 1 << 21


class Rooms:
    """Open rows by free room, with best-fit search in a segment tree."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        at = self.base + room
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, row: int, room: int) -> None:
        if room:
            self.rows[room].append(row)
            self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The fullest row with at least ``need`` room, and its room."""
        at, count = self.base + need, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.base
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Row of each item, taken by falling length; number of rows."""
    rooms, row_of, rows = Rooms(capacity), np.zeros(len(lengths), np.int64), 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = rooms.take(need)
        if found is None:
            found, rows = (rows, capacity), rows + 1
        row_of[item] = found[0]
        rooms.add(found[0], found[1] - need)
    return row_of, rows


ROWS = pa.schema([
    ("row_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])
SCHEMA = ("row_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, "
          "doc_starts array<long>")


def rows_of_block(docs: list[tuple[object, bytes]], first: int, length: int, pad: int) -> list[list]:
    """Columns of ``ROWS`` for (doc id, 32-bit ids) items. Ids are stored as unsigned 16-bit numbers, little-endian."""
    names, starts, parts = [], [], []
    for name, raw in docs:
        ids = np.frombuffer(raw, "<u4").astype("<u2")
        for at in range(0, len(ids), length):
            names.append(name)
            starts.append(at)
            parts.append(ids[at:at + length])
    row_of, rows = best_fit(np.array([len(p) for p in parts], np.int64), length)
    inside: list[list[int]] = [[] for _ in range(rows)]
    for item, row in enumerate(row_of.tolist()):
        inside[row].append(item)
    columns: list[list] = [[] for _ in ROWS]
    for row, items in enumerate(inside):
        ids = np.concatenate([parts[i] for i in items])
        cumulative = np.cumsum([0, *(len(parts[i]) for i in items)]).tolist()
        full = np.full(length, pad, "<u2")
        full[:len(ids)] = ids
        for column, value in zip(columns, (first + row, len(ids), full.tobytes(), cumulative, cumulative[:-1],
                                           [names[i] for i in items], [starts[i] for i in items])):
            column.append(value)
    return columns


def matrix(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_column: str = "doc_id",
           added: dict[str, int] | None = None) -> DataFrame:
    """One row per packed sequence. ``added``: tokens that are found in the text before it is split. Positions restart at each segment, padding is ``end_id`` and is outside ``cu_seqlens``."""
    pattern, end = public_tokenizers.PATTERN, np.array([end_id], "<u4").tobytes()

    def run(batches):
        with without_collection():
            yield from pack(batches)

    def pack(batches):
        cache, _ = kept_in_worker(f"packing {path}", lambda: tokenizer(path))
        row, held, waiting = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                names = batch.column(0).slice(lo, hi - lo).to_pylist()
                for name, ids in zip(names, encode_documents(texts, cache, pattern, added or {})):
                    held.append((name, ids + end))
                    waiting += len(ids) // 4 + 1
                if waiting >= BLOCK:
                    columns = rows_of_block(held, row, length, end_id)
                    row, held, waiting = row + len(columns[0]), [], 0
                    yield emit(ROWS, columns)
        if held:
            yield emit(ROWS, rows_of_block(held, row, length, end_id))

    return docs.select(id_column, "text").mapInArrow(run, SCHEMA)


def write_matrix(docs: DataFrame, path: str, out: str, mode: str = "errorifexists") -> None:
    """Write the packed rows as Parquet."""
    matrix(docs, path).write.mode(mode).parquet(out)


def op7_matrix_bfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), added=added_tokens(public_tokenizers.path(TOKENIZER)))
