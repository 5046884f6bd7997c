"""Files of any size as rows of chunks: lossless conversion, verification and UTF-8 validity.

A file is several rows (key, no, bytes), cut anywhere. What a chunk needs of its surroundings is small: where it starts, the four bytes before it and the
first four of the file (``placed``; ``sources.tree.read_chunks`` reads them along). From these the decoder's state at its start follows for charsets
that synchronise themselves (Unicode and single-byte pages), so every chunk is decoded, encoded and verified where it lies, and one file is
many tasks. Other charsets (multi-byte pages, escapes) carry a state that only the bytes before tell: their files are streamed, chunk after
chunk in order, and only one chunk is in memory at a time.

Outcomes are those of ``operators.convert`` for the whole content: codes, messages, counts, offsets within 256 KiB read chunks. The digest is SHA-256 over the
whole text, which is serial by nature: it streams a file's chunks in order and can be left out.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrow import _decode_errors, _encode_errors, give_back
from ..functions.charsets import BOM_OF, CODEC_OF, canonical, resolve
from ..functions.constants import CONVERT_CHUNK_BYTES, CONVERTED, ERROR, SKIPPED, UNCHANGED, UNKNOWN
from ..functions.labels import split_label
from ..sources.scratch import shared_folder
from .convert import _code_of_facts, _from_facts, diagnostic, needs_conversion

# Charsets whose decoder state is not told by the bytes just before, and those whose encoder has a state.
STREAMED = ["euc-jp", "euc-kr", "iso-2022-kr", "iso-2022-jp", "big5", "GB18030", "gb2312", "hz-gb-2312", "shift_jis", "ks_c_5601-1987"]
# Bytes of output and facts sent back to the JVM at once, and what the facts of a piece count for.
EMIT_BYTES, FACT_BYTES = 4 << 20, 256
SHIFTING = ["iso-2022-kr", "iso-2022-jp", "hz-gb-2312"]

FACTS = [
    ("begin", pa.int64()), ("end", pa.int64()), ("decode_error_at", pa.int64()), ("cut_tail", pa.bool_()), ("encode_error_cp", pa.int32()),
    ("written", pa.int64()), ("scalars", pa.int64()), ("units", pa.int64()), ("target_scalars", pa.int64()), ("target_units", pa.int64()),
    ("same", pa.bool_()), ("target_error_at", pa.int64()), ("first", pa.int32()), ("output", pa.binary()),
]
_FACTS_SQL = ("begin long, end long, decode_error_at long, cut_tail boolean, encode_error_cp int, written long, scalars long, units long, "
              "target_scalars long, target_units long, same boolean, target_error_at long, first int, output binary")


def _last_four(content: Column) -> Column:
    return F.when(F.length(content) > 4, F.substring(content, -4, 4)).otherwise(content)


def placed(chunks: DataFrame, key: str = "path", no: str = "no", content: str = "content") -> DataFrame:
    """Add ``start``, ``before``, ``head`` and ``last`` to chunk rows. Only numbers and a few bytes of each chunk are brought in order.

    Chunks hold a byte at least, but for the only chunk of an empty file.
    """
    order = Window.partitionBy(key).orderBy(no)
    edge = chunks.select(key, no, F.length(content).cast("long").alias("_n"), F.substring(content, 1, 4).alias("_first"), _last_four(F.col(content)).alias("_tail"))
    none = F.lit(b"")
    back = [F.coalesce(F.lag("_tail", k).over(order), none) for k in (4, 3, 2, 1)]
    near = edge.withColumns({
        "start": F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
        "_back": F.concat(*back), "last": F.lead(no).over(order).isNull(), "_r": F.row_number().over(order),
    })
    heads = near.where("_r <= 4").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_r", "_first"))).alias("_h")).select(
        key, F.substring(F.aggregate("_h", none, lambda a, h: F.concat(a, h["_first"])), 1, 4).alias("head"))
    near = near.join(heads, key).select(key, no, "start", _last_four(F.col("_back")).alias("before"), "head", "last")
    return chunks.join(near, [key, no])


def unfinished(before: bytes, charset: str, at: int) -> bytes:
    """The bytes just before offset ``at`` of the text that belong to a character not yet complete there."""
    before = before[-min(len(before), at):] if at else b""
    if charset == "utf-8":
        for k in range(1, min(3, len(before)) + 1):
            lead = before[-k]
            if lead >= 0xC0:
                part = before[-k:]
                try:
                    codecs.getincrementaldecoder("utf-8")("strict").decode(part, False)
                except UnicodeError:
                    return b""
                return part if _needs_more(part) else b""
            if lead < 0x80:
                return b""
        return b""
    if charset in ("utf-16", "utf-16BE"):
        odd = at % 2
        unit = before[-2 - odd:len(before) - odd]
        high = len(unit) == 2 and 0xD8 <= unit[1 if charset == "utf-16" else 0] <= 0xDB
        n = odd + (2 if high else 0)
        return before[-n:] if n else b""
    if charset in ("utf-32", "utf-32BE"):
        return before[-(at % 4):] if at % 4 else b""
    return b""


def _needs_more(part: bytes) -> bool:
    return len(part) < (2 if part[0] < 0xE0 else 3 if part[0] < 0xF0 else 4)


class Transcoder:
    """Decode, encode and decode again piece by piece; faults are noted as facts."""

    def __init__(self, source: str, target: str, at: int = 0, pending: bytes = b""):
        self.source, self.target, self.at = source, target, at
        self.decoder = codecs.getincrementaldecoder(CODEC_OF[source])(_decode_errors(source))
        if pending:
            self.decoder.decode(pending, False)
        shifts = target in SHIFTING
        self.encoder = codecs.getincrementalencoder(CODEC_OF[target])(_encode_errors(target)) if shifts else None
        self.again = codecs.getincrementaldecoder(CODEC_OF[target])(_decode_errors(target)) if shifts else None
        self.failed, self.owed = False, ""   # owed: text a decoder with a state has yet to give back

    def _text(self, data: bytes, final: bool) -> tuple[str, int | None, bool]:
        """(text, offset of the first fault, whether it is a sequence cut off by the end)."""
        held = len(self.decoder.getstate()[0])
        try:
            text = self.decoder.decode(data, False)
        except UnicodeDecodeError as e:
            return "", self.at - held + e.start, False
        held = self.decoder.getstate()[0]
        if final:
            try:
                text += self.decoder.decode(b"", True)
            except UnicodeDecodeError:
                surrogate = self.source == "utf-8" and len(held) > 1 and held[0] == 0xED and held[1] >= 0xA0
                return text, self.at + len(data) - len(held), not surrogate
        return text, None, False

    def piece(self, data: bytes, final: bool) -> dict:
        row = {"begin": self.at, "end": self.at + len(data), "written": 0, "scalars": 0, "units": 0, "target_scalars": 0, "target_units": 0, "same": True}
        if self.failed:
            self.at += len(data)
            return row
        text, fault, cut = self._text(data, final)
        self.at += len(data)
        if fault is not None:
            row |= {"decode_error_at": fault, "cut_tail": cut}
            self.failed = True
        row |= {"scalars": len(text), "units": len(text.encode("utf-16-le")) // 2, "first": ord(text[0]) if text else None}
        try:
            output = self.encoder.encode(text, final) if self.encoder else text.encode(CODEC_OF[self.target], _encode_errors(self.target))
        except UnicodeEncodeError as e:
            row["encode_error_cp"] = ord(e.object[e.start])
            return row
        row |= {"output": output, "written": len(output)}
        again = self.again or codecs.getincrementaldecoder(CODEC_OF[self.target])(_decode_errors(self.target))
        try:
            back = again.decode(output, final or not self.again)
        except UnicodeDecodeError as e:
            row["target_error_at"] = e.start
            return row
        if self.again:
            owed, same = self.owed + text, (self.owed + text).startswith(back)
            self.owed = owed[len(back):]
            same = same and not (final and self.owed)
        else:
            same = back == text
        row |= {"same": same, "target_scalars": len(back), "target_units": len(back.encode("utf-16-le")) // 2}
        return row


def _cuts(at: int, size: int) -> Iterator[tuple[int, int]]:
    """Parts of a chunk that do not cross the borders of 256 KiB read chunks of the file's text."""
    lo = 0
    while lo < size or not size:
        hi = min(size, ((at + lo) // CONVERT_CHUNK_BYTES + 1) * CONVERT_CHUNK_BYTES - at)
        yield lo, hi
        lo = hi
        if not size:
            return


def _mark_of(head: bytes, source: str) -> int:
    mark = BOM_OF.get(source, b"")
    return len(mark) if mark and head.startswith(mark) else 0


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    names = ("start", "last", "source", "before", "head")
    small = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
    content = batch.column(batch.schema.get_field_index("content"))
    for i, values in enumerate(zip(*small)):
        yield i, *values, content[i].as_buffer()


def _schema(key_type: pa.DataType, no_type: pa.DataType) -> pa.Schema:
    return pa.schema([("key", key_type), ("no", no_type), ("part", pa.int32()), *FACTS])


class _Facts:
    """Rows of facts gathered to record batches: a batch for each chunk costs more than the chunk, one for all would hold every output."""

    def __init__(self, batch: pa.RecordBatch):
        self.schema = _schema(batch.schema.field("key").type, batch.schema.field("no").type)
        self.keys, self.numbers = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("key", "no"))
        self.rows, self.held = [], 0

    def add(self, i: int, facts: list[dict]) -> None:
        key, no = self.keys[i], self.numbers[i]
        for k, row in enumerate(facts):
            self.rows.append({"key": key, "no": no, "part": k, **row})
            self.held += len(row.get("output") or b"") + FACT_BYTES

    def full(self) -> bool:
        return self.held >= EMIT_BYTES

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array([r.get(f.name) for r in self.rows], f.type) for f in self.schema]
            self.rows, self.held = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _apart(target: str):
    """Facts of chunks each by itself."""
    def run(batches):
        for batch in batches:
            out = _Facts(batch)
            for i, start, last, source, before, head, content in _rows(batch):
                mark = _mark_of(head or b"", source)
                data = memoryview(content)[max(0, mark - start):] if content is not None else memoryview(b"")
                at = max(0, start - mark)
                work = Transcoder(source, target, at, unfinished(before or b"", source, at))
                parts = list(_cuts(at, len(data)))
                out.add(i, [work.piece(bytes(data[a:b]), last and b == len(data)) for a, b in parts])
                if out.full():
                    yield from out.taken()
            yield from out.taken()
            give_back()

    return run


def _in_order(target: str):
    """Facts of chunks that come sorted by file and number."""
    def run(batches):
        file, work = None, None
        for batch in batches:
            out = _Facts(batch)
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            for i, start, last, source, before, head, content in _rows(batch):
                if file != (keys[i],):
                    file, work = (keys[i],), Transcoder(source, target)
                data = memoryview(content)[max(0, _mark_of(head or b"", source) - start):] if content is not None else memoryview(b"")
                parts = list(_cuts(work.at, len(data)))
                out.add(i, [work.piece(bytes(data[a:b]), last and b == len(data)) for a, b in parts])
                if out.full():
                    yield from out.taken()
            yield from out.taken()
            give_back()

    return run


def _digests(batches):
    """SHA-256 over the UTF-16LE units of each file whose chunks come in order; null where the text cannot be decoded."""
    schema, file, work, sha, fine, found = None, None, None, None, True, []

    def done():
        rows = pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], schema.field(0).type), pa.array([d for _, d in found], pa.string())], schema=schema)
        found.clear()
        return rows

    for batch in batches:
        schema = schema or pa.schema([("key", batch.schema.field("key").type), ("sha256", pa.string())])
        keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
        for i, start, last, source, before, head, content in _rows(batch):
            if file != (keys[i],):
                if file:
                    found.append((file[0], sha.hexdigest() if fine else None))
                file, work, sha, fine = (keys[i],), Transcoder(source, "utf-8"), hashlib.sha256(), True
            data = bytes(memoryview(content)[max(0, _mark_of(head or b"", source) - start):]) if content is not None else b""
            if fine:
                text, fault, _ = work._text(data, last)
                work.at += len(data)
                fine = fault is None and content is not None
                sha.update(text.encode("utf-16-le"))
        if found:
            yield done()
    if file:
        found.append((file[0], sha.hexdigest() if fine else None))
        yield done()


def transcode_chunks(chunks: DataFrame, target_label: str, key: str = "path", no: str = "no", content: str = "content", digest: bool = True,
                     stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pieces, results) of placed chunk rows that have ``charset``, the canonical source charset.

    ``pieces`` (key, no, part, output) are the converted bytes, in order of no and part, without the target's mark; ``results`` (key and the result struct
    ``conversion`` of ``operators.convert`` without its output) has a row per file. With ``stored`` the pieces are written once to the shared folder, so files
are not converted again for their results.
    """
    base, want_bom = split_label(target_label)
    target = resolve(base)
    bom = len(BOM_OF.get(target, b"")) if want_bom else 0
    if want_bom and not bom:
        raise ValueError(f"{target} has no byte-order mark")
    kind, number = (chunks.schema[c].dataType.simpleString() for c in (key, no))
    rows = chunks.select(F.col(key).alias("key"), F.col(no).alias("no"), "start", "before", "head", "last", F.col("charset").alias("source"), F.col(content).alias("content"))
    out = f"key {kind}, no {number}, part int, {_FACTS_SQL}"
    known = rows.where(F.col("source").isin(list(CODEC_OF)))
    serial = F.col("source").isin(STREAMED) | F.lit(target in SHIFTING)
    sorted_ = lambda df: df.repartition("key").sortWithinPartitions("key", "no")
    pieces = known.where(~serial).mapInArrow(_apart(target), out).union(sorted_(known.where(serial)).mapInArrow(_in_order(target), out))
    if stored:
        pieces = _stored(pieces, "pieces")
    return pieces, _results(pieces, rows, target, want_bom, bom, sorted_(known).mapInArrow(_digests, f"key {kind}, sha256 string") if digest else None).withColumnRenamed("key", key)


def _results(pieces: DataFrame, rows: DataFrame, target: str, want_bom: bool, bom: int, digests: DataFrame | None) -> DataFrame:
    files = rows.groupBy("key").agg(
        F.sum(F.length("content")).alias("size"), F.first("source").alias("source"), F.first("head").alias("head"),
        F.bool_or(F.col("content").isNull()).alias("missing")).withColumn("size", F.when(~F.col("missing"), F.col("size")))
    marks = F.create_map(*[F.lit(x) for pair in BOM_OF.items() for x in pair])
    mark = F.when(F.startswith("head", marks[F.col("source")]), F.length(marks[F.col("source")])).otherwise(0)
    facts = pieces.drop("output")
    first = facts.groupBy("key").agg(F.min(F.when(F.col("decode_error_at").isNotNull(), F.struct("decode_error_at", "cut_tail"))).alias("fault"))
    # what lies before the read chunk of the fault has been written by then
    limit = F.when(F.col("fault.cut_tail"), F.lit((1 << 62))).otherwise(
        F.floor(F.col("fault.decode_error_at") / CONVERT_CHUNK_BYTES) * CONVERT_CHUNK_BYTES)
    facts = facts.join(first, "key").withColumn("early", F.col("fault").isNotNull() & (F.col("end") <= limit))
    at = F.struct("no", "part")
    total = facts.groupBy("key").agg(
        F.first("fault").alias("fault"), F.sum("scalars").alias("scalars"), F.sum("units").alias("units"), F.sum("target_scalars").alias("target_scalars"),
        F.sum("target_units").alias("target_units"), F.bool_and("same").alias("same"), F.sum("written").alias("written"),
        F.sum(F.when(F.col("early"), F.col("written"))).alias("early"), F.bool_or(F.col("early") & F.col("encode_error_cp").isNotNull()).alias("early_fault"),
        F.min_by("encode_error_cp", F.when(F.col("encode_error_cp").isNotNull(), at)).alias("encode_error_cp"),
        F.min_by("first", F.when(F.col("first").isNotNull(), at)).alias("first"),
        F.min(F.when(F.col("target_error_at").isNotNull(), at)).alias("target_fault"))
    wrong = facts.join(total.where("target_fault is not null").select("key", "target_fault"), "key").groupBy("key").agg(
        (F.sum(F.when(at < F.col("target_fault"), F.col("written")).otherwise(0)) + F.max(F.when(at == F.col("target_fault"), F.col("target_error_at")))).alias("target_decode_error_at"))
    joined = files.join(total, "key", "left").join(wrong, "key", "left")
    joined = joined.join(digests, "key", "left") if digests is not None else joined.withColumn("sha256", F.lit(None).cast("string"))
    decoded, encoded = F.col("fault").isNull(), F.col("encode_error_cp").isNull()
    f = F.when(F.col("written").isNotNull(), F.struct(
        mark.alias("source_mark"), F.col("fault.decode_error_at").alias("decode_error_at"), F.coalesce("fault.cut_tail", F.lit(False)).alias("cut_tail"),
        "encode_error_cp", (F.lit(bom) + F.when(F.col("early_fault"), 0).otherwise(F.coalesce("early", F.lit(0)))).alias("partial_bytes"),
        F.when(decoded, F.col("sha256")).alias("sha256"), "scalars", "units",
        (F.lit(want_bom) | F.coalesce(F.lit(target in BOM_OF) & (F.col("first") == 0xFEFF), F.lit(False))).alias("target_mark"),
        "target_decode_error_at", "target_scalars", "target_units"))
    staged = joined.withColumn("_f", f)
    f = F.col("_f")
    code = _code_of_facts(f, F.col("size"), target, want_bom, F.col("same"))
    staged = staged.withColumn("_code", code)
    written = F.when(decoded & encoded, F.col("written") + bom)
    result = _from_facts(f, F.col("_code"), F.col("size"), F.col("source"), target, want_bom, written, F.lit(None))
    return staged.select("key", result.dropFields("output").alias("conversion"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def convert_chunks(chunks: DataFrame, target_label: str, key: str = "path", no: str = "no", content: str = "content", digest: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pieces, outcomes) of placed chunk rows with ``source_encoding`` and ``source_has_bom``; the rules are those of ``operators.convert.convert``.

    ``outcomes`` has a row per file: key, the source and target columns, ``result``, ``diagnostic`` and ``conversion``. ``pieces`` holds the bytes of the files
    whose conversion succeeded, the target's mark in front of the first, as rows (key, no, part, output). The chunks are stored once with their places: pieces,
    digests and outcomes each read them, and finding the places anew costs as much as the conversion.
    """
    base, want_bom = split_label(target_label)
    target = resolve(base)
    rows = _stored(chunks.select(key, no, content, "start", "before", "head", "last", "source_encoding", "source_has_bom").withColumn(
        "charset", canonical(F.col("source_encoding"))), "placed")
    unknown = F.col("source_encoding") == UNKNOWN
    untried = F.coalesce(unknown | F.col("charset").isNull(), F.lit(True))
    needs = F.coalesce(~untried & needs_conversion(F.col("source_encoding"), F.col("source_has_bom"), base, want_bom), F.lit(False))
    pieces, results = transcode_chunks(rows.where(needs), target_label, key, no, content, digest, stored=True)
    files = rows.groupBy(key).agg(F.first("source_encoding").alias("source_encoding"), F.first("source_has_bom").alias("source_has_bom"),
                                  F.first(untried).alias("_untried"), F.first(needs).alias("_needs"))
    c = F.col("conversion")
    outcomes = files.join(results, key, "left").withColumns({
        "target_encoding": F.when(F.col("_untried"), F.col("source_encoding")).otherwise(F.lit(base)),
        "target_has_bom": F.when(F.col("_untried"), F.col("source_has_bom")).otherwise(F.lit(want_bom)),
        "result": F.when(unknown, SKIPPED).when(F.col("_untried"), ERROR).when(
            F.col("_needs"), F.when(c["success"], CONVERTED).otherwise(ERROR)).otherwise(UNCHANGED),
        "diagnostic": F.when(F.col("_needs") & ~c["success"], diagnostic(c["error_code"], c["error_message"])),
    }).drop("_untried", "_needs")
    good = outcomes.where(F.col("result") == CONVERTED).select(F.col(key).alias("key"))
    bytes_ = pieces.join(good, "key", "left_semi").select("key", "no", "part", "output")
    if want_bom:
        low = pieces.groupBy("key").agg(F.min(F.struct("no", "part")).alias("_low"))
        lead = F.when(F.struct("no", "part") == F.col("_low"), F.lit(BOM_OF[target])).otherwise(F.lit(b""))
        bytes_ = bytes_.join(low, "key").withColumn("output", F.concat(lead, "output"))
    return bytes_.select(F.col("key").alias(key), "no", "part", "output"), outcomes


# --- UTF-8 validity of whole contents ---------------------------------------------------------------

# States of the UTF-8 automaton: a character is complete; 1, 2 or 3 free continuation bytes to come; the second byte after E0, ED, F0, F4; refused.
DONE, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, REFUSED = range(9)


def _moves() -> np.ndarray:
    """Next state by state and byte."""
    t = np.full((9, 256), REFUSED, np.uint8)
    t[DONE, :0x80] = DONE
    for lo, hi, state in ((0xC2, 0xE0, ONE), (0xE0, 0xE1, AFTER_E0), (0xE1, 0xF0, TWO), (0xED, 0xEE, AFTER_ED), (0xF0, 0xF1, AFTER_F0), (0xF1, 0xF4, THREE),
                          (0xF4, 0xF5, AFTER_F4)):
        t[DONE, lo:hi] = state
    for state, lo, hi, to in ((ONE, 0x80, 0xC0, DONE), (TWO, 0x80, 0xC0, ONE), (THREE, 0x80, 0xC0, TWO), (AFTER_E0, 0xA0, 0xC0, ONE),
                              (AFTER_ED, 0x80, 0xA0, ONE), (AFTER_F0, 0x90, 0xC0, TWO), (AFTER_F4, 0x80, 0x90, TWO)):
        t[state, lo:hi] = to
    return t


def transition(data: bytes, moves: np.ndarray) -> list[int]:
    """The automaton's state after ``data`` for each state before it.

    Within three bytes every start has completed its character or is refused, so the rest is the codec's work and common to all.
    """
    states = list(range(9))
    for k, b in enumerate(data):
        states = [int(moves[s, b]) for s in states]
        if all(s in (DONE, REFUSED) for s in states):
            return [_after(data[k + 1:], moves) if s == DONE else REFUSED for s in states]
    return states


def _after(data: bytes, moves: np.ndarray) -> int:
    decoder = codecs.getincrementaldecoder("utf-8")("strict")
    try:
        decoder.decode(data, False)
    except UnicodeDecodeError:
        return REFUSED
    state = DONE
    for b in decoder.getstate()[0]:
        state = int(moves[state, b])
    return state


def _vectors(batches):
    moves = _moves()
    for batch in batches:
        content = batch.column(batch.num_columns - 1)
        out = [transition(bytes(c.as_buffer()), moves) if c.is_valid else [REFUSED] * 9 for c in content]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "vector"])


FOLD = 1024


def _composed(vectors: Column) -> Column:
    """One vector of a list in order: where each state is taken by one after the other."""
    same = F.array(*[F.lit(i) for i in range(9)])
    return F.aggregate(vectors, same, lambda a, v: F.transform(a, lambda s: F.get(v["vector"], s)))


def utf8_states(chunks: DataFrame, key: str = "path", no: str = "no", content: str = "content") -> DataFrame:
    """(key, valid, accepted): whether the whole content of each file is UTF-8, and whether it is but for a sequence cut off by its end.

    A chunk is a vector of nine small numbers; vectors are composed in groups of ``FOLD`` neighbours, so no task holds all chunks of a file. Composition is
    associative: any cutting and any grouping of neighbours give the same. ``no`` numbers the chunks from 0.
    """
    kind, number = (chunks.schema[c].dataType.simpleString() for c in (key, no))
    vectors = chunks.select(F.col(key).alias("key"), F.col(no).alias("no"), F.col(content).alias("content")).mapInArrow(
        _vectors, f"key {kind}, no {number}, vector array<int>")
    for level in range(3):   # 1024^3 chunks
        group = (F.floor(F.col("no") / FOLD) if level < 2 else F.lit(0)).alias("no")
        vectors = vectors.groupBy("key", group).agg(F.sort_array(F.collect_list(F.struct("no", "vector"))).alias("v")).select("key", "no", _composed(F.col("v")).alias("vector"))
    end = F.get("vector", F.lit(DONE))
    return vectors.select(F.col("key").alias(key), (end == DONE).alias("valid"), (end != REFUSED).alias("accepted"))
