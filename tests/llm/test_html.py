"""Block reading and labelling of pages."""

import time

import numpy as np
import pytest

from glyphaudit.llm import html_text as ht


def test_leaves():
    page = ("<html><head><title>no</title><style>p{}</style></head><body><nav class='top menu-bar'><a href='x>y'>Home</a></nav><!-- <p>gone</p> -->"
            "<div id=main><h1>A &amp; B</h1><p>One<br>two <b>bold</b>\n three<p>next &lt;p&gt;<script>var a='</p>';</script></div> tail < 5 <textarea>t</textarea>")
    got = [(p[-1], t) for p, t, _ in ht.leaves(page)]
    assert [t for _, t in got] == ["Home", "A & B", "One two bold three", "next <p>", "tail < 5", "t"]
    assert ".menu" in ht.leaves(page)[0][0] and ht.leaves(page)[0][2] == 1.0
    assert ht.leaves("") == [] and ht.leaves("<p>open <b>text") == [(("p",), "open text", 0.0)]
    assert ht.leaves("<!-- never closed <p>x</p>") == [] and ht.leaves("<script>x") == []


@pytest.mark.parametrize("page,texts", [
    ("<html><head><title>x</title><body><article><p>Main", ["Main"]),
    ("<head><meta charset=utf-8><title>x</title><link rel=a><article><p>Main", ["Main"]),
    ("<head><title>x</title>Plain text", ["Plain text"]),
    ("<head>junk<title>x</title>junk</head><p>Main", ["Main"]),
    ("<head><noscript><p>no</p></noscript><style>p{}</style></head><body><noscript>yes</noscript>", ["yes"]),
    ("<head><title>x<body><p>Main</p><svg><title>icon</title></svg>", ["Main"]),
    ("<title>x<p>Main</p><svg><title>icon</title></svg>", ["Main"]),
    ("<title>a <b> c</title><p>Main", ["Main"]),
    ("<p>One<svg class=a /> two<iframe src='x'/> three<math/> four<object data=x />five</p>", ["One two three fourfive"]),
    ("<p>One<svg><svg/><svg>no</svg>no</svg> two<template>no<script>'</template>'</script>no</template>", ["One two"]),
    ("<p>One<svg><path> two<template> three<object data=x> four<iframe src=x> five", ["One two three four five"]),
    ("<head-line>One</head-line><svg-icon>two</svg-icon><title-bar>three", ["Onetwothree"]),
    ("<style-guide>One</style-guide><p>two<script-x>three<object_y>four", ["One", "twothreefour"]),
    ("<p>One<script>x</script foo>two<iframe><!-- x</iframe>three<style>y", ["Onetwothree"]),
    ("<header>One</header><p>two<!-- rest", ["One", "two"]),
])
def test_only_scripts_styles_and_comments_run_to_the_end(page, texts):
    assert [t for _, t, _ in ht.leaves(page)] == texts


def test_many_unclosed_tags_take_linear_time():
    began = time.process_time()
    assert ht.leaves("<p>Main" + "<svg><iframe><title>" * 30_000)[0][1] == "Main"
    assert time.process_time() - began < 20


def test_gradients():
    r = np.random.default_rng(1)
    model = ht.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = ht.padded([r.random((5, ht.WIDTH)).astype(np.float32), r.random((3, ht.WIDTH)).astype(np.float32)])
    y = (r.random((5, 2)) < 0.5).astype(np.float32)

    def loss():
        z = model.forward(x, mask)[0]
        return ((np.logaddexp(0, z) - y * z) * mask[:, :, 0]).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for name in ("wf", "ub", "bf", "o", "c", "wb"):
        flat = model.p[name].reshape(-1)
        for at in r.integers(0, flat.size, 4):
            kept, e = flat[at], 1e-2
            flat[at] = kept + e
            up = loss()
            flat[at] = kept - e
            down = loss()
            flat[at] = kept
            assert abs((up - down) / (2 * e) - g[name].reshape(-1)[at]) < 2e-3


def page(i, words):
    text = lambda a, n: " ".join(words[(a + k) % len(words)] for k in range(n))
    return (f"<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>{text(i, 1)}</a></li></ul></nav><div class='ad'>{text(i + 3, 6)}</div>"
            f"<article><h1>{text(i + 5, 4)}</h1><p>{text(i, 40)}.</p><p>{text(i + 9, 25)} &amp; more.</p></article><footer>&copy; {text(i, 2)}</footer></body></html>",
            "\n".join([text(i + 5, 4), text(i, 40) + ".", text(i + 9, 25) + " & more."]))


def test_pages(spark):
    words = [f"word{i}" for i in range(50)]
    made = {i: page(i, words) for i in range(80)}
    rows = [(i, f"http://x/{i}", h, "z") for i, (h, _) in made.items()] + [(900, None, None, "z"), (901, "u", "", None), (902, "u", "<script>x</script>", "z"),
                                                                          (3, "http://x/3", made[3][0], "z"), (None, "u", made[4][0], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    model = ht.train(pages)
    got = ht.main_text(pages, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[900] == by[901] == by[902] == "" and by[None] == made[4][1]
    assert all(by[i] == t for i, (_, t) in made.items())
    assert ht.main_text(pages.where("false"), model).count() == 0
    assert [r.text for r in ht.main_text(pages.limit(1), ht.train(pages.where("false"))).collect()] == [""]


def test_other_layouts():
    words = [f"term{i}" for i in range(60)]
    read = [ht.leaves(page(i, words)[0]) for i in range(80)]
    chance, known = np.random.default_rng(3), {}
    pages = [(b, np.array([not ht.outside(p) for p, _, _ in b], np.float32)) for b in read] + [ht.composed(read, chance) for _ in range(500)]
    model = ht.Labeller().fit([(ht.features(b, known), y) for b, y in pages])
    fresh = [ht.composed(read, np.random.default_rng(77)) for _ in range(1)] + [ht.composed(read, chance) for _ in range(200)]
    right = total = 0
    for b, y in fresh:
        right += int((model.label(ht.features(b, known), np.array([len(b)])) == (y > 0)).sum())
        total += len(y)
    assert right / total > 0.96
