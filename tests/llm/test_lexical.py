"""Lexical search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from glyphaudit.llm import lexical as lx

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    vectors = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    vectors = [v for v in vectors if v[2]]
    n_docs, words = len(vectors), sum(v[2] for v in vectors)
    df = Counter(t for _, c, _ in vectors for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        asked = Counter(terms(text))
        scored = []
        for i, c, n in vectors:
            m = 100 - 75 + (75 * n * n_docs) // words
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i if i is not None else 1 << 63, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本語", "x1", "ÀB"]
    passages = [[r.choice(words) for _ in range(25)] for _ in range(5)]
    docs = []
    for i in range(700):
        text = [r.choice(words[:r.choice([5, 20, 65])]) for _ in range(r.choice([1, 3, 30, 120]))]
        if r.random() < 0.05:
            text += r.choice(passages)
        docs.append((i, r.choice([" ", ", ", "\n", "-"]).join(text) if r.random() < 0.9 else " ".join(text).upper()))
    docs += [(5000, None), (5001, ""), (5002, " ... \x00"), (5003, "w1"), (5004, "W1"), (5004, "W1"), (None, "w1 w2 w3"), (5005, "w1 w2 w3"), (5006, "a" * 5000 + " w7")]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)]
    items += [(10, "w1 w1 w2"), (11, None), (12, ""), (13, "unheard of"), (14, "Été日本語 naïve!"), (10, "w1 w1 w2"), (15, "w3"), (15, "w4 w5"), (16, "été"), (17, "a" * 5000)]
    return docs, items


def searched(spark, documents, docs, items, **limits):
    table = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, q int")
    return sorted((tuple(r) for r in lx.search(documents([(i, t, "en") for i, t in docs]), table, **limits).collect()), key=str)


@pytest.mark.parametrize("segment,block,batch", [(2048, 128, 4 << 20), (90, 4, 120)])
def test_equals_plain_ranking(spark, documents, monkeypatch, segment, block, batch):
    monkeypatch.setattr(lx, "SEGMENT", segment)
    monkeypatch.setattr(lx, "BLOCK", block)
    docs, items = made(1)
    want = brute(docs, items)
    assert len(want) > 60
    assert searched(spark, documents, docs, items, batch=batch) == want


def test_no_rows(spark, documents):
    docs, items = made(2)
    assert searched(spark, documents, [], items) == []
    assert searched(spark, documents, docs, []) == []
    assert searched(spark, documents, [(1, None), (2, "")], items) == []


def test_terms_do_not_cross_rows():
    texts = [b"ab", b"cd", b"", b" ", b"Ab-9\xc3\xa9", b"x"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    row, hashes, starts, ends = lx.terms_of(data, offsets)
    found = [(int(i), data[a:b].tobytes()) for i, a, b in zip(row, starts, ends)]
    assert found == [(0, b"ab"), (1, b"cd"), (4, b"Ab"), (4, b"9\xc3\xa9"), (5, b"x")]
    assert hashes[0] == hashes[2]   # A-Z as a-z


def test_words_are_confirmed_by_bytes():
    vocabulary = lx.Vocabulary([b"ab", b"abc"])
    data = np.frombuffer(b"ab Abc ad", np.uint8)
    _, hashes, starts, ends = lx.terms_of(data, np.array([0, len(data)]))
    hashes[2] = hashes[0]   # a collision
    at, number = vocabulary.find(data, hashes, starts, ends)
    assert at.tolist() == [0, 1] and number.tolist() == [0, 1]


def test_bounds_hold_and_skip():
    """No document exceeds the bound of a block it is in; documents left out stay below the score asked for; far blocks are skipped."""
    r = np.random.default_rng(3)
    n, size = 600, 40
    rows = []
    for i in range(n):
        kind = i % 4
        at = np.unique(np.concatenate([r.integers(10 * kind, 10 * kind + 10, 5), r.integers(0, size, 1)]))
        rows.append((at, r.integers(1, 1000, len(at))))
    at = np.cumsum([0, *(len(x) for x, _ in rows)])
    table = lx.Rows(np.arange(n), np.zeros(n, bool), at, np.concatenate([x for x, _ in rows]), np.concatenate([s for _, s in rows]))
    blocks = lx.Blocks(table, size)
    weight = np.zeros(size, np.int64)
    terms = np.arange(0, 10)
    weight[terms] = r.integers(1, 50, 10)
    exact = table.scores(np.arange(n), weight)
    for t in terms:
        docs, first, own, tops = blocks.of(int(t))
        assert sorted(np.concatenate(docs).tolist()) == [i for i in range(n) if t in rows[i][0]] and max(map(len, docs)) <= lx.BLOCK
    everything, bounds = blocks.bounds(terms, weight, 1)
    for members, bound in zip(everything, bounds):
        assert exact[members].max() <= bound
    needed = int(np.sort(exact)[-10])
    some, _ = blocks.bounds(terms, weight, needed)
    inside = np.unique(np.concatenate(some))
    assert set(np.flatnonzero(exact >= needed)) <= set(inside.tolist()) and len(some) < len(everything)
    queries = lx.Queries([7], [terms], [np.ones(10, np.int64)], None, weight.copy())
    best, scratch = lx.Best(queries, 10), np.zeros(size, np.int64)
    lx.look(blocks, queries, best, scratch)
    order = np.lexsort((np.arange(n), -exact))[:10]
    assert best.held[0][1].tolist() == order.tolist() and not scratch.any()
    best.needed[0] = needed
    assert lx.look(blocks, queries, best, scratch) < len(everything)
