"""Near duplicates, repeated passages, components and sorting."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from glyphaudit.llm import near_dup as nd, repeats as rp, suffix_sort as ss
from glyphaudit.llm.components import components


def grouped(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    loose = [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(150)]
    edges = chain + star + loose + [(5, 5)]
    want = grouped({x for e in edges for x in e}, edges)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got}
    assert {k for k, v in want.items() if list(want.values()).count(v) > 1} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_duplicates_equal_brute_force(documents):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 40, 120, 400]))]
        for _ in range(r.choice([1, 1, 2, 5, 30])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((i, " ".join(words) if r.random() < 0.8 else "\n".join(words).upper(), "en"))
            i += 1
    r.shuffle(rows)
    rows += [(5000, None, None), (5001, "", "en"), (5002, " \t\n", None), (5003, "one two", "en"), (5004, "ONE  two", "en"), (5005, "one  TWO", "en"), rows[0]]
    sets = {i: shingle_set(t) for i, t, _ in rows}
    names = sorted(sets)
    edges = [(a, b) for k, a in enumerate(names) for b in names[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = grouped(names, edges)
    got = nd.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)
    assert nd.near_duplicates(documents([])).count() == 0
    kept = nd.without_near_duplicates(documents(rows).sparkSession, documents(rows + [(None, "a b c", "en")]), "")
    assert kept.columns == documents([]).columns
    assert {x.doc_id for x in kept.collect()} == {i for i in names if want[i] == i} | {None}


def test_stage_decides_by_row(spark, documents):
    """Repeated rows, exact and near copies without an id, and texts that share an id."""
    r = random.Random(12)
    text = lambda: [f"w{r.randrange(5000)}" for _ in range(100)]
    one, two, three, four, five, six = (text() for _ in range(6))
    near = lambda words: " ".join([*words[:-1], "changed"])
    one, two, three, four, five, six, near_one, near_four, near_six = *map(" ".join, (one, two, three, four, five, six)), near(one), near(four), near(six)
    rows = [(1, one), (1, one), (1, one.upper()), (None, one), (None, near_one),      # stored again, also without an id
            (2, near_one), (2, two), (2, two),                                        # an id of two texts, one a near copy
            (3, three), (3, five),                                                    # an id of two texts, both alone
            (4, four), (4, near_four), (4, four),                                     # an id of two texts that are near copies
            (None, six), (None, six), (None, near_six),                               # no row has an id
            (9, ""), (9, None), (None, " ")]
    out = nd.without_near_duplicates(spark, documents([(i, t, "en") for i, t in rows]), "").collect()
    got = Counter((x.doc_id, None if x.text is None else nd_group(x.text, {"one": (one, one.upper()), "four": (four, near_four), "six": (six, near_six)})) for x in out)
    assert got == Counter([(1, "one"), (2, two), (3, three), (3, five), (4, "four"), (None, "six"), (9, ""), (9, None), (None, " ")])


def nd_group(text, groups):
    return next((name for name, texts in groups.items() if text in texts), text)


def test_crowded_regions_lose_no_link(documents, monkeypatch):
    """Near copies of one text, many barely linked, while the sorted order meets next to none."""
    monkeypatch.setattr(nd, "NEIGHBOURS", 1)
    monkeypatch.setattr(nd, "BLOCK", 50)
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(r.choice([1, 1, 2, 2, 3, 4])):
            words[r.randrange(120)] = r.choice(vocabulary)
        rows.append((i, " ".join(words), "en"))
    sets = [shingle_set(t) for _, t, _ in rows]
    edges = [(a, b) for a in range(250) for b in range(a + 1, 250) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = grouped(range(250), edges)
    assert {x.doc_id: x.component_id for x in nd.near_duplicates(documents(rows)).collect()} == want


def test_other_thresholds_equal_brute_force(spark, documents):
    """Near copies between 0.80 and 0.85 are links from 0.8 up, and only there."""
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        words = [r.choice(vocabulary) for _ in range(150)]
        other = list(words)
        for at in r.sample(range(5, 140, 6), r.choice([2, 3, 3, 3, 4])):
            other[at] = "changed"
        rows += [(2 * g, " ".join(words), "en"), (2 * g + 1, " ".join(other), "en")]
    sets = [shingle_set(t) for _, t, _ in rows]
    kept = {}
    for bounds in (nd.FROM_85, nd.FROM_80):
        edges = [(a, a + 1) for a in range(0, 120, 2) if 100 * len(sets[a] & sets[a + 1]) >= bounds.top * len(sets[a] | sets[a + 1])]
        kept[bounds] = {i for i, c in grouped(range(120), edges).items() if i == c}
        assert {x.doc_id for x in nd.without_near_duplicates(spark, documents(rows), "", bounds).collect()} == kept[bounds]
    assert len(kept[nd.FROM_80]) < len(kept[nd.FROM_85])


@pytest.mark.parametrize("depth", [1, 3])
def test_deep_shallow_sort(depth):
    r = random.Random(3)
    base = bytes(r.randrange(2) for _ in range(60))
    strings = [base[:r.randrange(61)] + bytes(r.randrange(2) for _ in range(r.randrange(5))) for _ in range(400)]
    group = np.array([r.randrange(3) for _ in strings])
    lengths = np.array([len(s) for s in strings])
    rows = np.frombuffer(b"".join(s.ljust(64, b"\0") for s in strings), np.uint8).reshape(-1, 64)
    order, same = ss.deep_shallow(rows, lengths, group, depth)
    keys = [(group[i], strings[i].ljust(64, b"\0")) for i in order]
    assert keys == sorted(keys)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        n = next((i for i, (x, y) in enumerate(zip(strings[a], strings[b])) if x != y), min(lengths[a], lengths[b]))
        assert same[k] == (n if group[a] == group[b] else -1)


def test_blind_trie_orders_prefixes_first():
    strings = [b"abc", b"ab", b"abcd", b"ab", b"abd\0", b"abd"]
    assert [strings[i] for i in ss.blind_trie(strings, 2)] == sorted(strings)


def brute_repeats(rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(t[p:p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for (i, _, _), t in zip(rows, texts):
        cover = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p:p + 200]] > 1:
                cover[p:p + 200] = b"\1" * 200
        kept = bytes(c for c, x in zip(t, cover) if not x)
        out.append((i, len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest(), kept))
    return out


def repeat_rows(seed):
    r = random.Random(seed)

    def noise(n):
        return "".join(r.choice("abcdeé ") for _ in range(n))

    passages = [noise(r.choice([150, 190, 200, 201, 260, 500])) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [r.choice([noise(r.randint(0, 150)), r.choice(passages), r.choice(passages)[r.randint(0, 60):], "x" * r.randint(0, 400)])
                 for _ in range(r.randint(0, 5))]
        rows.append((i, "".join(parts), "en"))
    return rows + [(200, None, None), (201, "", "en"), (7, rows[7][1], "en"), (300, "ab" * 2000, None), (301, "ab" * 300 + "c", None),
                   (None, rows[9][1], "en"), (None, "zz", None)]


@pytest.mark.parametrize("seed,chunk,block", [(4, 20_000, 1 << 20), (5, 10, 500)])
def test_repeats_equal_brute_force(documents, monkeypatch, seed, chunk, block):
    monkeypatch.setattr(rp, "CHUNK", chunk)
    monkeypatch.setattr(rp, "BLOCK", block)
    rows = repeat_rows(seed)
    got = sorted(map(tuple, rp.digests(documents(rows)).collect()), key=str)
    assert got == sorted((b[:5] for b in brute_repeats(rows)), key=str)
    assert rp.digests(documents([])).count() == 0


def test_repeats_stage_cuts_texts(documents):
    rows = repeat_rows(6)
    docs = documents(rows)
    out = rp.without_repeats(docs.sparkSession, docs, "")
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    got = sorted(((x.doc_id, x.text, x.n_chars) for x in out.collect()), key=str)
    want = []
    for (i, t, _), b in zip(rows, brute_repeats(rows)):
        text = None if t is None else b[5].decode("utf-8", "ignore")
        want.append((i, text, None if t is None else len(text)))
    assert got == sorted(want, key=str)


def test_long_texts_at_the_real_block_size():
    """Texts a little longer than two blocks: the last block may be empty or hold no anchor. Blocks find what one pass finds."""
    r = np.random.default_rng(5)
    text = r.integers(97, 123, 2 * rp.BLOCK + 200, dtype=np.uint8)
    for tail in range(1, 200):
        data = text[:2 * rp.BLOCK + tail]
        sizes = np.array([len(data)])
        if tail % 40 == 1:
            whole = np.sort(np.concatenate([place for _, place, _, _ in [rp.anchors(data, np.array([0, len(data)]))]]))
            parts = list(rp.all_anchors(data, np.array([0, len(data)])))
            assert np.array_equal(np.sort(np.concatenate([p for _, p, _, _ in parts])), whole)
            for part in parts:
                on, known = rp._known(*part, sizes)
                assert len(on) == len(part[0]) and not len(known[0])
        else:   # only the last block
            begin = 2 * rp.BLOCK
            a = begin - rp.REACH
            row, place, gram, context = rp.anchors(data[a:], np.array([0, len(data) - a]))
            mine = place + a >= begin
            rp._known(row[mine], place[mine] + a, gram[mine], context[mine], sizes)


def test_crowded_output_is_linear():
    """Near copies that agree but hardly link: a block gives out fewer links than it has classes."""
    for n in (500, 2000):
        r = np.random.default_rng(n)
        base = np.arange(100, dtype=np.uint64)
        sets = []
        for i in range(n):
            own = base.copy()
            own[r.choice(100, 3 + i % 3, replace=False)] = r.integers(1000, 1 << 60, 3 + i % 3, dtype=np.uint64)
            sets.append(np.unique(own))
        sig = np.zeros((n, nd.HASHES), "<u2")   # all signatures agree: every pair is confirmed on its sets
        found = nd.ties(sig, sets, np.arange(n), np.arange(n), np.arange(n), nd.FROM_85)
        assert len(found) < n
        linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
        assert all(linked(a, b) for a, b in found)
        if n == 500:
            edges = [(a, b) for a in range(n) for b in range(a + 1, n) if linked(a, b)]
            assert grouped(range(n), edges) == grouped(range(n), found) and len(edges) > n
