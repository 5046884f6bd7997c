"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. BPE has a left-to-right form: a row of tokens is the encoding of its bytes exactly if every token is the encoding of its own
bytes and every two neighbours are the encoding of theirs. So for each prefix of the input one last token follows from the last
tokens of shorter prefixes. A state of the transducer is (last emitted token, bytes read but not yet emitted); reading a byte leads
to the next state and emits the tokens that all continuations share. A continuation can only start where the unread rest may still be the
beginning of a vocabulary entry, which bounds the lookahead by the longest entry. States and arcs are made when first met and kept.
As in rank-file tokenizers, a piece that is itself an entry is that entry.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8 automaton that keeps an unfinished character back.

Defined cases: null and empty texts have no tokens; every byte must be an entry (else ``ValueError``); ids outside the vocabulary raise
``KeyError``. ``id_column`` and ``text`` are read, other columns ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import kept_in_worker, slices, table, text_column, without_collection
from .pieces import split

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
KEPT_PIECES = 300_000   # memory bounds of a worker: encoded pieces, arcs, token pairs
KEPT_ARCS = 250_000
KEPT_PAIRS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """Plain BPE: join the neighbours of lowest rank, leftmost first, until none can be joined or ``stop`` are left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class State:
    """``last``: the token emitted last; ``pending``: bytes read since; ``open``: (bytes of ``pending``, tokens that encode them) of
    every place where a further token may start."""
    __slots__ = ("arcs", "last", "open", "pending")

    def __init__(self, last: bytes, pending: bytes, places: list[tuple[int, tuple[bytes, ...]]]):
        self.last, self.pending, self.open = last, pending, places
        self.arcs: dict[int, tuple[State, tuple[bytes, ...]]] = {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be an entry of the vocabulary")
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.beginnings = {t[:n] for t in ranks for n in range(1, len(t))}
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.start = State(b"", b"", [(0, ())])
        self.states: dict[tuple[bytes, bytes], State] = {(b"", b""): self.start}
        self.made = 0

    def last_merge(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for a byte, or if merging never makes it."""
        if token not in self.parts:
            parts = merge_by_rank(token, self.ranks, stop=2)
            self.parts[token] = (parts[0], parts[1]) if len(parts) == 2 and parts[0] + parts[1] in self.ranks else None
        return self.parts[token]

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Do two tokens stay two when their bytes are encoded together? Their merges are undone from the last one on; at
        no time may the two tokens that meet at the seam have been the next to merge."""
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, bound = self.ranks.get, 1 << 62
        while True:
            seam = rank(left + right)
            if seam is not None and seam < bound:
                good = False
                break
            age_left = rank(left) if len(left) > 1 else -1
            age_right = rank(right) if len(right) > 1 else -1
            if age_left < 0 and age_right < 0:
                good = True
                break
            if age_left > age_right:
                left, bound = self.last_merge(left)[1], age_left
            else:  # of merges of one rank the left one is first, so the right one is undone first
                right, bound = self.last_merge(right)[0], age_right + 1
        if len(self.fits) < KEPT_PAIRS:
            self.fits[key] = good
        return good

    def _arc(self, state: State, byte: int) -> tuple[State, tuple[bytes, ...]]:
        """Next state and the tokens it emits; kept until there are ``KEPT_ARCS``, then made for this use only."""
        read, ranks, beginnings = state.pending + bytes((byte,)), self.ranks, self.beginnings
        places, here = [], None
        for start, path in state.open:
            token = read[start:] if start else read
            if here is None and token in ranks and (len(token) == 1 or self.last_merge(token)):
                before = path[-1] if path else state.last
                if not before or self._fits(before, token):
                    here = (len(read), (*path, token))
            if token in beginnings:
                places.append((start, path))
        shared, first = 0, here[1]
        if places:
            least = min([len(p) for _, p in places])
            while shared < least and all([p[shared] == first[shared] for _, p in places]):
                shared += 1
        else:
            shared = len(first)
        places.append(here)
        if shared:
            sure = first[:shared]
            cut, last = sum([len(t) for t in sure]), sure[-1]
            places = [(n - cut, p[shared:]) for n, p in places]
            read = read[cut:]
        else:
            sure, last = (), state.last
        after = self.states.get((last, read)) or State(last, read, places)
        if self.made < KEPT_ARCS:
            self.made += 1
            self.states[last, read] = after
            state.arcs[byte] = (after, sure)
        return after, sure

    def _rest(self, state: State, piece: bytes) -> tuple[bytes, ...]:
        """The tokens of a short rest, followed without making states (when no more are kept)."""
        done, read, places = len(state.pending), state.pending + piece, state.open
        ranks, beginnings, parts, fits, last = self.ranks, self.beginnings, self.parts, self.fits, state.last
        for end in range(done + 1, len(read) + 1):
            here, kept = None, []
            for place in places:
                token = read[place[0]:end]
                if here is None and token in ranks and (parts.get(token) or len(token) == 1 or self.last_merge(token)):
                    path = place[1]
                    before = path[-1] if path else last
                    good = fits.get((before, token))
                    if good or not before or (good is None and self._fits(before, token)):
                        here = (end, (*path, token))
                if token in beginnings:
                    kept.append(place)
            kept.append(here)
            places = kept
        return places[-1][1]

    def encode(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, full = self.start, [], self.made >= KEPT_ARCS
        for at, byte in enumerate(piece):
            arc = state.arcs.get(byte)
            if arc is None:
                if full and len(piece) - at <= 64:
                    out += self._rest(state, piece[at:])
                    break
                arc = self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        else:
            out += state.open[-1][1]
        return [ranks[t] for t in out]


class PieceCache(dict):
    """Piece to its ids as little-endian 32-bit bytes, filled by an encoder. When full, the entries become the old generation, from
    which those still in use are taken over: at most twice ``bound`` entries."""

    def __init__(self, encode, bound: int = KEPT_PIECES):
        super().__init__()
        self.encode, self.bound, self.old = encode, bound, {}

    def __missing__(self, piece: str) -> bytes:
        made = self.old.get(piece)
        if made is None:
            made = np.array(self.encode(piece), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[piece] = made
        return made


class Utf8Stream:
    """Incremental UTF-8: complete characters pass, an unfinished one waits for its next bytes."""

    # bytes still to come after a lead byte
    AFTER = np.array([0] * 0xC2 + [1] * 0x1E + [2] * 0x10 + [3] * 5 + [0] * 11, np.uint8)

    def __init__(self):
        self.waiting = b""

    def feed(self, chunk: bytes) -> bytes:
        """Bytes of the characters that are complete now."""
        held = self.waiting + chunk
        cut = len(held)
        for back in range(1, min(3, len(held)) + 1):
            byte = held[-back]
            if byte >= 0xC0:
                if self.AFTER[byte] >= back:
                    cut -= back
                break
            if byte < 0x80:
                break
        self.waiting = held[cut:]
        return held[:cut]

    def close(self) -> bytes:
        """What stays unfinished at the end."""
        rest, self.waiting = self.waiting, b""
        return rest


def decode(ids: np.ndarray, bytes_of: dict[int, bytes], block: int = 1 << 16):
    """Decoded bytes in blocks of whole characters, then an unfinished rest if there is one."""
    stream = Utf8Stream()
    for lo in range(0, len(ids), block):
        yield stream.feed(b"".join(map(bytes_of.__getitem__, ids[lo:lo + block].tolist())))
    if rest := stream.close():
        yield rest


LONG_TEXT = 1 << 20
_BETWEEN_WORDS = re.compile(r"(?<=\w) (?=\w)")


def _blocks(text: str):
    """A long text in blocks; a blank between two word characters always starts a piece, so none is cut."""
    lo = 0
    while len(text) - lo > LONG_TEXT and (found := _BETWEEN_WORDS.search(text, lo + LONG_TEXT)):
        yield text[lo:found.start()]
        lo = found.start()
    yield text[lo:]


def encode_texts(texts: list[str], cache: PieceCache, pattern: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit bytes."""
    if any(len(t) > LONG_TEXT for t in texts):
        return [b"".join(b"".join(map(cache.__getitem__, split([part], pattern)[0])) for part in _blocks(t)) for t in texts]
    return [b"".join(map(cache.__getitem__, found)) for found in split(texts, pattern)]


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_column: str = "doc_id") -> DataFrame:
    """(id, ids binary): whole texts as little-endian 32-bit token ids. ``path`` must be readable on every executor."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        with without_collection():
            yield from encode(batches)

    def encode(batches):
        _, cache = kept_in_worker(f"fst {path}", lambda: _machine(path))
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(encode_texts(texts, cache, pattern), pa.binary())],
                                                 names=[id_column, "ids"])

    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, ids binary")


def _machine(path: str) -> tuple[Transducer, PieceCache]:
    transducer = Transducer(read_ranks(path))
    return transducer, PieceCache(lambda piece: transducer.encode(piece.encode("utf-8")))


def text_slices(batch: pa.RecordBatch):
    """(from row, to row, texts) in slices of about a megabyte; nulls are empty."""
    data, offsets = text_column(batch, "text")
    for lo, hi in slices(offsets):
        part = data[offsets[lo]:offsets[hi]].tobytes()
        cut = (offsets[lo:hi + 1] - offsets[lo]).tolist()
        yield lo, hi, [part[a:b].decode("utf-8") for a, b in zip(cut, cut[1:])]


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_column: str = "doc_id") -> DataFrame:
    """Encode and decode every text: (id, n_tokens, ids_sha256, decoded_sha256)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        with without_collection():
            yield from digest(batches)

    def digest(batches):
        transducer, cache = kept_in_worker(f"fst {path}", lambda: _machine(path))
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                n, first, second = [], [], []
                for ids in encode_texts(texts, cache, pattern):
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    sha = hashlib.sha256()
                    for part in decode(np.frombuffer(ids, "<u4"), transducer.bytes_of):
                        sha.update(part)
                    second.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_column, "text").mapInArrow(
        run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
