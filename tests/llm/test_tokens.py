"""Byte-level BPE, matrix packing and order-preserving packing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from glyphaudit.llm import bpe_fst as fst, matrix as mx, packing as pk
from glyphaudit.llm.pieces import split

MULTI = public.path("byte_bpe_multi_50k.tiktoken")
ENGLISH = public.path("byte_bpe_50k.tiktoken")


def awkward(n, seed):
    r = random.Random(seed)
    narrow = "ab'ts rvelmd  \n\t.,!0 1²½\xa0\x85éÀ_-'"
    out = ["", " ", "'", "'s", "x's 'll''ve", "a  b", "  ", "\n \n", "<|endoftext|>", "e" * 300, "日本語 текст 😀👍🏽 ​"]
    for _ in range(n):
        wide = r.random() < 0.3
        out.append("".join(chr(r.choice([r.randint(32, 126), r.randint(0x400, 0x4FF), r.randint(0x4E00, 0x9FFF), 0x1F600 + r.randint(0, 50)]))
                           if wide else r.choice(narrow) for _ in range(r.randint(0, 30))))
    return out


def test_pieces_are_the_patterns_matches():
    texts = awkward(4000, 1)
    assert split(texts, public.PATTERN) == [regex.findall(public.PATTERN, t) for t in texts]


@pytest.mark.parametrize("arcs", [0, 500, 250_000])
def test_transducer_equals_the_library(monkeypatch, arcs):
    monkeypatch.setattr(fst, "KEPT_ARCS", arcs)
    machine, cache = fst._machine(MULTI)
    cache.bound = 100
    library = tiktoken.Encoding("test", pat_str=public.PATTERN, mergeable_ranks=machine.ranks, special_tokens={})
    for text in [*awkward(1500, 2), "supercalifragilistic unbelievably " * 3, "x" * 500]:
        ids = np.frombuffer(fst.encode_texts([text], cache, public.PATTERN)[0], "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        for block in (1, 3, 1 << 16):
            parts = list(fst.decode(ids, machine.bytes_of, block))
            assert b"".join(parts) == text.encode()
            assert all(p.decode() is not None for p in parts)


def test_streaming_decode_keeps_unfinished_characters():
    stream, out = fst.Utf8Stream(), []
    raw = "aé日😀".encode()
    for i in range(len(raw)):
        out.append(stream.feed(raw[i:i + 1]))
    assert [o.decode() for o in out if o] == ["a", "é", "日", "😀"] and stream.close() == b""
    assert stream.feed(b"ok\xf0\x9f") == b"ok" and stream.close() == b"\xf0\x9f"
    assert stream.feed(b"\xff\x80") == b"\xff\x80"


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(fst, "LONG_TEXT", 50)
    _, cache = fst._machine(MULTI)
    text = " ".join(awkward(60, 3)) + " plain words follow here " * 20
    whole = b"".join(map(cache.__getitem__, split([text], public.PATTERN)[0]))
    assert fst.encode_texts([text], cache, public.PATTERN)[0] == whole
    assert "".join(fst._blocks(text)) == text and len(list(fst._blocks(text))) > 3


ROWS = [(1, "hello there. And again! " * 20, "en"), (2, None, None), (3, "", "en"), (None, "no id", None), (1, "hello there. And again! " * 20, "en"),
        (5, "word " * 3000, "en"), (6, "日本語" * 40, None)]


def test_digests_defined_cases(documents):
    machine, _ = fst._machine(MULTI)
    library = tiktoken.Encoding("test", pat_str=public.PATTERN, mergeable_ranks=machine.ranks, special_tokens={})
    got = sorted(map(tuple, fst.digests(documents(ROWS), MULTI).collect()), key=str)
    want = []
    for i, text, _ in ROWS:
        raw = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        want.append((i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert fst.digests(documents([]), MULTI).count() == 0


def reference_ids(text):
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_packing_keeps_every_id(documents, monkeypatch):
    docs = documents(ROWS + [(10 + i, t, "en") for i, t in enumerate(awkward(300, 4))], 2)
    rows = pk.packed(docs, ENGLISH).collect()
    texts = {i: t for i, t, _ in ROWS} | {10 + i: t for i, t in enumerate(awkward(300, 4))}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, found in pieces.items():
        ids = reference_ids(texts[i])
        copies = 2 if i == 1 else 1
        assert sum(p.length for p in found) == copies * len(ids)
        for p in found:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= pk.LENGTH
    assert pk.packed(documents([]), ENGLISH).count() == 0


def test_blocks_carry_their_last_window():
    _, ends = pk.tokenizer(ENGLISH)
    r = np.random.default_rng(1)
    docs = [(i, r.integers(0, 50000, r.integers(1, 4000)).astype("<u4").tobytes()) for i in range(60)]
    packer, got = pk.Packer(0, ends, block=9000), []
    for name, raw in docs:
        if packer.add(name, raw):
            names, columns = packer.pack(False)
            got += zip(names, *columns)
    names, columns = packer.pack(True)
    got += zip(names, *columns)
    for name, raw in docs:
        mine, at = [g for g in got if g[0] == name], 0
        for g in mine:  # in order
            assert g[1] == at and g[3] == zlib.crc32(raw[4 * at:4 * (at + g[2])])
            at += g[2]
        assert at == len(raw) // 4
    sequences = [g[5] for g in got]
    assert sequences == sorted(sequences) and set(sequences) == set(range(max(sequences) + 1))


def test_cuts_are_the_cheapest():
    r = random.Random(6)
    for _ in range(60):
        places = np.array([0, *sorted(r.sample(range(1, 90), r.randint(3, 14)))])
        places = np.array(sorted({*places.tolist(), *range(0, 91, 30), 90}))
        penalties = np.array([r.choice([0, 2, 9]) for _ in places])

        def cost(a, b):
            n = places[b] - places[a]
            return (0 if n >= 8 and n & (n - 1) == 0 else 32 - n) + penalties[b] + 3

        best = [0.0] + [float("inf")] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min(best[i] + cost(i, j) for i in range(j) if places[j] - places[i] <= 32)
        cuts = pk.cut_stream(places, penalties, 32, 3, 8)
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1
        assert sum(cost(a, b) for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_best_fit_equals_a_plain_search():
    r = np.random.default_rng(2)
    for _ in range(30):
        lengths = r.integers(1, 65, 80)
        got, rows = mx.best_fit(lengths, 64)
        room, want = [], np.zeros(80, np.int64)
        for item in np.argsort(-lengths, kind="stable"):
            fits = [i for i, x in enumerate(room) if x >= lengths[item]]
            if not fits:
                room.append(64)
                fits = [len(room) - 1]
            least = min(room[i] for i in fits)
            want[item] = next(i for i in reversed(fits) if room[i] == least)
            room[want[item]] -= lengths[item]
        assert rows == len(room)
        fill = lambda rows_: sorted(np.bincount(rows_, weights=lengths).tolist())
        assert fill(got) == fill(want) and max(fill(got)) <= 64


def test_matrix_is_lossless(documents):
    rows = mx.matrix(documents(ROWS), ENGLISH, length=256).collect()
    found = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert (ids[r.n_tokens:] == mx.END_ID).all()
        for a, b, name, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts):
            found.setdefault(name, []).append((start, ids[a:b]))
    for i, text in {i: t for i, t, _ in ROWS}.items():
        want = np.append(reference_ids(text)[:-1], mx.END_ID).astype("<u2")
        parts = [p for s, p in sorted(found[i], key=lambda x: x[0])]
        if i == 1:
            assert sum(map(len, parts)) == 2 * len(want)
        else:
            assert np.array_equal(np.concatenate(parts), want)
    assert mx.matrix(documents([]), ENGLISH).count() == 0


def test_added_tokens_as_the_library(documents):
    """Texts that spell the tokenizer's added token, by the library's own setting."""
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "it's <|endoftext|>'s  <|endof", "<|endoftext|", " é <|endoftext|>\n\n日本", "plain", None]
    library, added = Tokenizer.from_file(public.path("byte_bpe_50k.json")), pk.added_tokens(public.path(pk.TOKENIZER))
    assert added == {"<|endoftext|>": 50256}
    docs = documents([(i, t, "en") for i, t in enumerate(texts)])
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    pieces = {}
    for r in sorted(pk.packed(docs, ENGLISH, added=added).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == {i: len(x) for i, x in want.items()}
    for r in mx.matrix(docs, ENGLISH, added=added).collect():
        ids = np.frombuffer(bytes(r.ids), "<u2")
        for i, a, b, start in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], r.doc_starts):
            assert ids[a:b].tolist() == [*want[i][:-1], mx.END_ID][start:start + b - a]
