"""Arrow-batched column helpers for what Catalyst cannot express: byte statistics and codecs.

Each returns plain facts; the decisions made from them are Catalyst expressions in ``operators``.
A NULL input row costs nothing, so callers pass NULL for rows already decided in the JVM.

``once(f)`` is the form for use inside long expressions: Catalyst takes a deterministic Python UDF for cheap
and copies it, arguments and all, to every place that refers to it, which makes chained calls grow without
bound in the optimizer. The marked form stays one column.
"""

from __future__ import annotations

import codecs
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .charsets import BOM_OF, CODEC_OF, STRICT_ENCODERS
from .constants import CONVERT_CHUNK_BYTES, TEXT_SCALARS

_FEATURES_ARROW = pa.struct([
    ("size", pa.int32()), ("entropy", pa.float64()), ("even_nul", pa.int32()), ("odd_nul", pa.int32()),
    ("even_chi2", pa.float64()), ("odd_chi2", pa.float64()),
    ("first_lane_clear", pa.bool_()), ("last_lane_clear", pa.bool_()),
])
FEATURES = from_arrow_type(_FEATURES_ARROW)
COUNTS = ArrayType(IntegerType())


def once(f):
    """The same helper, kept by Catalyst as a single column."""
    return arrow_udf(f.func, f.returnType).asNondeterministic()


def give_back() -> None:
    """What a worker has freed goes back to the system: workers live on beside the JVM, one for each helper of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def _rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Zero-copy byte view of each value."""
    for value in column:
        buf = value.as_buffer()
        yield None if buf is None else np.frombuffer(buf, dtype=np.uint8)


def _channels(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histograms of the even and odd positions over whole 2-byte units."""
    n = len(v) & ~1
    return np.bincount(v[0:n:2], minlength=256), np.bincount(v[1:n:2], minlength=256)


def _chi2(counts: np.ndarray, expected: float) -> float:
    """Summed in byte order: the two channels are compared strictly, so the last bit can decide a near tie."""
    off = counts - expected
    return float(np.cumsum(off * off / expected)[-1])


def _facts(v: np.ndarray) -> dict:
    n = len(v)
    even, odd = _channels(v)
    hist = even + odd
    if n & 1:
        hist[v[-1]] += 1
    p = hist[hist > 0] / max(n, 1)
    units = n // 2
    expected = units / 256
    quads = n & ~3
    return {
        "size": n,
        "entropy": float(-(p * np.log2(p)).sum()) + 0.0,
        "even_nul": int(even[0]),
        "odd_nul": int(odd[0]),
        "even_chi2": _chi2(even, expected) if units else 0.0,
        "odd_chi2": _chi2(odd, expected) if units else 0.0,
        # a lane can only be clear when its channel holds a NUL for every unit of the lane
        "first_lane_clear": bool(even[0] >= quads // 4 and not v[0:quads:4].any()),
        "last_lane_clear": bool(odd[0] >= quads // 4 and not v[3:quads:4].any()),
    }


@arrow_udf(FEATURES)
def byte_features(sample: pa.Array) -> pa.Array:
    """Entropy, NUL counts, channel chi-square and lane flags of a byte sample."""
    out = pa.array([None if v is None else _facts(v) for v in _rows(sample)], type=_FEATURES_ARROW)
    give_back()
    return out


def _counts(sample: pa.Array, width: int, count) -> pa.Array:
    """``width`` counts per sample, written into one flat buffer."""
    flat = np.zeros((len(sample) - sample.null_count, width), np.int32)
    held = np.array([v is not None for v in _rows(sample)], bool)
    for row, v in zip(flat, (v for v in _rows(sample) if v is not None)):
        row[:] = count(v)
    ends = np.concatenate([[0], np.cumsum(held) * width]).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.ravel()), mask=pa.array(~held) if sample.null_count else None)
    give_back()
    return out


@arrow_udf(COUNTS)
def byte_histogram(sample: pa.Array) -> pa.Array:
    """256 counts per sample."""
    return _counts(sample, 256, lambda v: np.bincount(v, minlength=256))


@arrow_udf(COUNTS)
def lane_histogram(sample: pa.Array) -> pa.Array:
    """1024 counts per sample: index lane * 256 + byte, lane = position mod 4."""
    return _counts(sample, 1024, lambda v: np.concatenate([np.bincount(v[k::4], minlength=256) for k in range(4)]))


def _windows_gaps(error: UnicodeError):
    """Code points 80-9F that a windows-125x page leaves open stand for the C1 control of the same value."""
    if isinstance(error, UnicodeDecodeError):
        part = error.object[error.start:error.end]
        if all(0x80 <= b <= 0x9F for b in part):
            return "".join(map(chr, part)), error.end
    elif isinstance(error, UnicodeEncodeError):
        part = error.object[error.start:error.end]
        if all(0x80 <= ord(c) <= 0x9F for c in part):
            return bytes(map(ord, part)), error.end
    raise error


def _windows_gaps_or_replace(error: UnicodeEncodeError):
    out = bytearray()
    for c in error.object[error.start:error.end]:
        out.append(ord(c) if 0x80 <= ord(c) <= 0x9F else 0x3F)
    return bytes(out), error.end


def _decode_errors(charset: str) -> str:
    if not charset.startswith("windows-125"):
        return "strict"
    codecs.register_error("glyphaudit-gaps", _windows_gaps)
    return "glyphaudit-gaps"


def _encode_errors(charset: str) -> str:
    if charset in STRICT_ENCODERS:
        return "strict"
    if not charset.startswith("windows-125"):
        return "replace"
    codecs.register_error("glyphaudit-gaps-replace", _windows_gaps_or_replace)
    return "glyphaudit-gaps-replace"


def _decode(data: bytes, charset: str, final: bool) -> str:
    """Strict decode; without ``final`` an unfinished tail is left out instead of refused."""
    if charset == "utf-8" and not final and len(data) > 1 and data[-2] == 0xED and 0xA0 <= data[-1] <= 0xBF:
        # the codec waits for more, but no third byte can make a surrogate valid
        raise UnicodeDecodeError(charset, data, len(data) - 2, len(data), "surrogate")
    return codecs.getincrementaldecoder(CODEC_OF[charset])(_decode_errors(charset)).decode(data, final)


def _strict_head(data: bytes, charset: str) -> str | None:
    try:
        return _decode(data, charset, False)[:TEXT_SCALARS]
    except UnicodeError:
        return None


@arrow_udf(StringType())
def strict_head(sample: pa.Array, charset: pa.Array) -> pa.Array:
    """First 500 scalars when the whole sample decodes in the charset, NULL when it does not."""
    out = pa.array(
        [
            None if v is None or c not in CODEC_OF else _strict_head(v.tobytes(), c)
            for v, c in zip(_rows(sample), charset.to_pylist())
        ],
        type=pa.string(),
    )
    give_back()
    return out


_HEADS_ARROW = pa.list_(pa.struct([("charset", pa.string()), ("head", pa.string())]))
HEADS = from_arrow_type(_HEADS_ARROW)


@arrow_udf(HEADS)
def strict_heads(sample: pa.Array, charsets: pa.Array) -> pa.Array:
    """``strict_head`` for each charset of a per-row list, keeping the order, dropping failures."""
    out = []
    for v, names in zip(_rows(sample), charsets.to_pylist()):
        if v is None or names is None:
            out.append(None)
            continue
        heads = [(c, _strict_head(v.tobytes(), c)) for c in names]
        out.append([{"charset": c, "head": h} for c, h in heads if h is not None])
    heads = pa.array(out, type=_HEADS_ARROW)
    give_back()
    return heads


_TRANSCODED_ARROW = pa.struct([
    ("output", pa.binary()), ("source_mark", pa.int32()), ("decode_error_at", pa.int64()),
    ("cut_tail", pa.bool_()), ("encode_error_cp", pa.int32()), ("partial_bytes", pa.int64()),
    ("sha256", pa.string()), ("scalars", pa.int64()), ("units", pa.int64()),
    ("target_mark", pa.bool_()), ("target_decode_error_at", pa.int64()),
    ("target_sha256", pa.string()), ("target_scalars", pa.int64()), ("target_units", pa.int64()),
])
TRANSCODED = from_arrow_type(_TRANSCODED_ARROW)


def _digest(text: str) -> tuple[str, int, int]:
    units = text.encode("utf-16-le")
    return hashlib.sha256(units).hexdigest(), len(text), len(units) // 2


def _transcode(data: bytes, source: str, target: str, want_bom: bool) -> dict:
    """Decode, encode, decode again; stop at the first failure and say where it happened."""
    mark = BOM_OF.get(source, b"")
    mark = mark if mark and data.startswith(mark) else b""
    body = data[len(mark):]
    bom = BOM_OF.get(target, b"") if want_bom else b""
    row = {"source_mark": len(mark), "partial_bytes": len(bom)}

    def written(prefix: bytes) -> int:
        try:
            return len(bom) + len(_decode(prefix, source, False).encode(CODEC_OF[target], _encode_errors(target)))
        except UnicodeError:
            return len(bom)

    try:
        text = _decode(body, source, True)
    except UnicodeDecodeError as e:
        # buffered decoders report offsets relative to what they were given: here the whole body
        row["decode_error_at"] = e.start
        row["cut_tail"] = _is_unfinished(body, source)
        done = len(body) if row["cut_tail"] else e.start // CONVERT_CHUNK_BYTES * CONVERT_CHUNK_BYTES
        row["partial_bytes"] = written(body[:done])
        return row
    row["sha256"], row["scalars"], row["units"] = _digest(text)
    try:
        encoded = text.encode(CODEC_OF[target], _encode_errors(target))
    except UnicodeEncodeError as e:
        row["encode_error_cp"] = ord(text[e.start])
        return row
    output = bom + encoded
    row["output"] = output
    target_bom = BOM_OF.get(target, b"")
    row["target_mark"] = bool(target_bom) and output.startswith(target_bom)
    try:
        again = _decode(output[len(target_bom):] if row["target_mark"] else output, target, True)
        # equal text has an equal digest; only a mismatch is worth a second one
        same = again == text
        row["target_sha256"], row["target_scalars"], row["target_units"] = (
            (row["sha256"], row["scalars"], row["units"]) if same else _digest(again)
        )
    except UnicodeDecodeError as e:
        row["target_decode_error_at"] = e.start
    return row


def _is_unfinished(body: bytes, source: str) -> bool:
    """Whether the only fault is a sequence cut off by the end of the data."""
    try:
        _decode(body, source, False)
        return True
    except UnicodeError:
        return False


@arrow_udf(TRANSCODED)
def transcode_facts(content: pa.Array, source: pa.Array, target: pa.Array, want_bom: pa.Array) -> pa.Array:
    rows = zip(_rows(content), source.to_pylist(), target.to_pylist(), want_bom.to_pylist())
    out = pa.array(
        [
            None if v is None or s not in CODEC_OF or t not in CODEC_OF
            else _transcode(v.tobytes(), s, t, bool(b))
            for v, s, t, b in rows
        ],
        type=_TRANSCODED_ARROW,
    )
    give_back()
    return out
