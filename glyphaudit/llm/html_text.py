"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with the path of open tags (names, classes, ids). A
bidirectional LSTM in numpy reads the sequence of blocks, each given as hashed path tokens, hashed words and a few proportions, and says of
every block whether it belongs to the article; so each decision sees the whole page. Kept blocks are joined in page order.

The labeller is trained on a bounded sample of the table's own pages, labelled by the meaning of their tags and names, and on pages composed
from those pages' sentences in other common layouts, labelled by construction. At most ``SAMPLE`` pages of at most ``SAMPLE_BYTES`` enter the
fit; every page is labelled whole.

Defined cases: null or empty html, or pages without an article, give an empty text of 0 code points; scripts, styles, comments of
the markup, the head and other invisible content are no blocks; only scripts, styles and comments without an end run to the end of the page;
the head ends at its end tag, the body or the first tag of body content; other unclosed and stray tags are tolerated; repeated rows are labelled
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Shared, emit, slices, table, text_column
from .words import U, word_hashes

SAMPLE, SAMPLE_BYTES = 300, 1 << 18
PATH_BITS, LEAF_BITS, WORD_BITS, PLAIN = 7, 5, 5, 5
WIDTH = (1 << PATH_BITS) + (1 << LEAF_BITS) + (1 << WORD_BITS) + PLAIN
HIDDEN, EPOCHS, RATE, BATCH = 16, 14, 0.02, 32

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - frozenset("body html button option optgroup select".split())
# Names that mark a part of a page as no article, whole or as a part between hyphens.
OUTSIDE = frozenset(
    "nav header footer aside form button select textarea label fieldset dialog menu menus navbar navigation topbar sidebar rail masthead ad ads advert "
    "adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay "
    "comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup login search breadcrumb "
    "breadcrumbs pagination pager widget widgets copyright toolbar".split())

# Parts that are no blocks where they have an end; those in CLOSED_BY_SLASH may also be empty tags.
SKIPPED = frozenset("template svg math object iframe noframes title noscript".split())
CLOSED_BY_SLASH = frozenset("svg math object iframe".split())
RAW = frozenset("iframe noframes title noscript".split())   # do not nest; comments and scripts inside are plain text
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())

_ATTRIBUTES = r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
_WHOLE = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
_TOKEN = re.compile(_WHOLE + r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)" + _ATTRIBUTES, re.S | re.I)
_ENDS = {n: re.compile(("()" if n in RAW else _WHOLE + "|") + rf"<(/?)({n})(?=[\s/>])" + _ATTRIBUTES, re.S | re.I) for n in SKIPPED}
_HEAD_OVER = re.compile(r"</head(?=[\s/>])|<body(?=[\s/>])", re.I)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[^a-z0-9]+")


def _names(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for found in _NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            parts = [p for p in _PART.split(name) if p]
            out += ["." + p for p in dict.fromkeys([name, *parts])]
    return tuple(out)


def _empty(tag: str, attributes: str) -> bool:
    return tag in CLOSED_BY_SLASH and attributes.rstrip().endswith("/")


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the parts of this name that have an end tag stop, by the end of their start tag. Start tags without one are left out."""
    out, open_ = {}, []
    for found in _ENDS[name].finditer(page):
        if found.group(3) is None:
            continue
        if not found.group(2):
            if not _empty(name, found.group(4)):
                open_.append(found.end())
        elif open_:
            out[open_.pop()] = found.end()
            if name in RAW:
                open_.clear()
    return out


def leaves(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path tokens, text, share of characters in links) of every leaf block with text."""
    out, stack, path = [], [], ()
    parts: list[str] = []
    linked = at = 0
    in_link = False

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((path, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    ends: dict[str, dict[int, int]] = {}
    in_head = untitled = False
    while found := _TOKEN.search(page, at):
        if found.start() > at and not untitled:
            parts.append(page[at:found.start()])
            if in_link:
                linked += found.start() - at
        at, untitled = found.end(), False
        tag = found.group(3)
        if tag is None:
            if found.group(1) is None and found.group(0).startswith("<![CDATA["):
                parts.append(found.group(0)[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if (tag in SKIPPED or tag == "head") and found.group(4)[:1].strip(" \t\n\r\f/"):
            tag = ""  # a longer name, such as head_line
        if tag == "head" and not found.group(2):
            flush()
            in_head = True
            continue
        if in_head:
            if tag == "body" or tag == "head":  # text before belongs to the head
                parts.clear()
                linked = 0
            in_head = tag not in ("head", "body") and (tag in IN_HEAD or bool(found.group(2)))
        if tag in SKIPPED and not found.group(2) and (tag != "noscript" or in_head) and not _empty(tag, found.group(4)):
            if tag not in ends:
                ends[tag] = _ends(page, tag)
            end = ends[tag].get(at)
            if end is not None and tag in ("title", "noscript") and _HEAD_OVER.search(page, at, end):
                end = None
            untitled = tag == "title" and end is None  # what runs up to the next tag is the title
            if end is not None:
                at = end
                continue
        if tag not in BLOCK_TAGS:
            if tag == "a":
                in_link = not found.group(2)
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if found.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID_TAGS:
            if stack and (stack[-1][0] == "p" and tag in CLOSES_P or stack[-1][0] == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option")):
                stack.pop()
            if not found.group(4).rstrip().endswith("/"):
                stack.append((tag, (tag, *_names(found.group(4)))))
        path = tuple(name for _, names in stack for name in names)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def outside(path: tuple[str, ...]) -> bool:
    """Do a block's tags or names say that it is no article text?"""
    header = "article" in path or "main" in path  # an article may have its own header
    return any(n.lstrip(".") in OUTSIDE and not (n == "header" and header) for n in path)


def _slots(path: tuple[str, ...]) -> list[int]:
    found = [zlib.crc32(n.encode()) >> (32 - PATH_BITS) for n in set(path)]
    last = max((i for i, n in enumerate(path) if not n.startswith(".")), default=0)
    return found + [(1 << PATH_BITS) + (zlib.crc32(b"leaf " + n.encode()) >> (32 - LEAF_BITS)) for n in set(path[last:])]


def features(blocks: list[tuple[tuple[str, ...], str, float]], known: dict) -> np.ndarray:
    """A row per block."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return x
    for i, (path, _, _) in enumerate(blocks):
        slots = known.get(path)
        if slots is None:
            slots = known[path] = _slots(path)
        x[i, slots] = 1
    texts = [b[1].encode("utf-8") for b in blocks]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, words, _ = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(blocks)), n_words)
    slot = (words >> U(64 - WORD_BITS)).astype(np.int64)
    base, width = (1 << PATH_BITS) + (1 << LEAF_BITS), 1 << WORD_BITS
    counted = np.bincount(row * width + slot, minlength=len(blocks) * width).reshape(len(blocks), width)
    x[:, base:base + width] = counted / np.maximum(n_words, 1)[:, None]
    length = np.diff(offsets)
    marks = np.array([b[1].count(".") + b[1].count(",") for b in blocks])
    x[:, base + width:] = np.stack([np.log1p(length) / 8, np.log1p(n_words) / 6, [b[2] for b in blocks], marks / np.maximum(n_words, 1), n_words < 4], axis=1)
    return x


class Labeller:
    """Two LSTMs over the blocks of a page, forwards and backwards, and a logistic output on their joined states."""

    def __init__(self, seed: int = 5):
        chance = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for side in "fb":
            self.p["w" + side] = (chance.standard_normal((WIDTH, 4 * h)) / np.sqrt(20)).astype(np.float32)
            self.p["u" + side] = (chance.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            self.p["b" + side] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["o"] = (chance.standard_normal(2 * h) / np.sqrt(2 * h)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x, mask, side, keep):
        """States of every step; x is (steps, pages, width), mask (steps, pages, 1). The backward side is given reversed input."""
        steps, pages, _ = x.shape
        w, u, b, h = self.p["w" + side], self.p["u" + side], self.p["b" + side], HIDDEN
        fed = (x.reshape(-1, WIDTH) @ w + b).reshape(steps, pages, 4 * h)
        state = cell = np.zeros((pages, h), np.float32)
        out, trace = np.empty((steps, pages, h), np.float32), []
        for t in range(steps):
            z = fed[t] + state @ u
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * h], -30, 30)))
            fresh = np.tanh(z[:, 3 * h:])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            new = f * cell + i * fresh
            squashed = np.tanh(new)
            if keep:
                trace.append((state, cell, i, f, o, fresh, squashed))
            cell = np.where(mask[t], new, cell)
            state = np.where(mask[t], o * squashed, state)
            out[t] = state
        return out, trace

    def forward(self, x, mask, keep=False):
        forwards, ft = self._run(x, mask, "f", keep)
        backwards, bt = self._run(x[::-1], mask[::-1], "b", keep)
        joined = np.concatenate([forwards, backwards[::-1]], axis=2)
        return joined @ self.p["o"] + self.p["c"], joined, ft, bt

    def gradients(self, x, mask, y):
        """Of the mean cross entropy over the blocks that the mask has."""
        logit, joined, ft, bt = self.forward(x, mask, True)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * mask[:, :, 0] / mask.sum()
        g = {"o": np.tensordot(d, joined, 2), "c": np.array([d.sum()], np.float32)}
        back = d[:, :, None] * self.p["o"]
        h = HIDDEN
        for side, trace, flow, xs, ms in (("f", ft, back[:, :, :h], x, mask), ("b", bt, back[::-1, :, h:], x[::-1], mask[::-1])):
            dz_all = np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
            gu, ds, dc = np.zeros_like(self.p["u" + side]), np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t in range(x.shape[0] - 1, -1, -1):
                state, cell, i, f, o, fresh, squashed = trace[t]
                total = ds + flow[t]
                inner = np.where(ms[t], total, 0)
                dcell = np.where(ms[t], dc, 0) + inner * o * (1 - squashed ** 2)
                dz = np.concatenate([dcell * fresh * i * (1 - i), dcell * cell * f * (1 - f), inner * squashed * o * (1 - o), dcell * i * (1 - fresh ** 2)], axis=1)
                dz_all[t] = dz
                gu += state.T @ dz
                ds = dz @ self.p["u" + side].T + np.where(ms[t], 0, total)
                dc = dcell * f + np.where(ms[t], 0, dc)
            g["u" + side] = gu
            g["w" + side] = xs.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * h)
            g["b" + side] = dz_all.sum(axis=(0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 9) -> "Labeller":
        """Adam over batches of pages of like length."""
        chance = np.random.default_rng(seed)
        pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
        batches = [pages[i:i + BATCH] for i in range(0, len(pages), BATCH)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            for at in chance.permutation(len(batches)):
                x, mask = padded([p[0] for p in batches[at]])
                y = np.zeros(x.shape[:2], np.float32)
                for j, (_, labels) in enumerate(batches[at]):
                    y[:len(labels), j] = labels
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    rate = RATE * (1 - 0.9 * epoch / epochs)
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Article or not, for the rows of pages with ``counts`` blocks each."""
        out, starts = np.zeros(len(x), bool), np.concatenate([[0], np.cumsum(counts)])
        order = [i for i in np.argsort(counts, kind="stable").tolist() if counts[i]]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and int(counts[order[hi]]) * (hi - lo + 1) <= 20_000:
                hi += 1
            group = order[lo:hi]
            data, mask = padded([x[starts[i]:starts[i + 1]] for i in group])
            logit = self.forward(data, mask)[0]
            for j, i in enumerate(group):
                out[starts[i]:starts[i + 1]] = logit[:counts[i], j] >= 0
            lo = hi
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((steps, len(rows), WIDTH), np.float32), np.zeros((steps, len(rows), 1), bool)
    for j, r in enumerate(rows):
        x[:len(r), j], mask[:len(r), j] = r, True
    return x, mask


BODIES = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main"), ("div", ".post", "div", ".entry", ".content"),
          ("section", ".article"), ("div", ".container", "article", ".post"), ("div",), ("div", ".page", "main", ".content"), ())
PARTS = (("p",), ("p",), ("p",), ("p",), ("h1",), ("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("div",), ("pre",),
         ("table", "tbody", "tr", "td"), ("figure", "figcaption"), ("section", "p"), ("header", "h1"), ("div", ".text", "p"))
AROUND = (("nav", "ul", "li"), ("header",), ("header", "div", ".logo"), ("footer",), ("footer", "p"), ("aside",), ("aside", "h3"), ("aside", "ul", "li"),
          ("form",), ("form", "label"), ("form", "button"), ("form", "p"), ("ul", ".menu", "li"), ("div", "p"))


def composed(pages: list[list], chance: np.random.Generator) -> tuple[list, np.ndarray]:
    """A page in some layout, from the blocks of other pages; its labels by construction."""
    pool = [b for page in pages for b in page]

    def text(short: bool) -> str:
        words = pool[chance.integers(len(pool))][1].split()
        n = int(chance.integers(1, 8) if short else chance.integers(2, 120))
        return " ".join(words[:n])

    names = sorted(n for n in OUTSIDE if n not in BLOCK_TAGS)
    root, body, out, labels = ("html", "body"), BODIES[chance.integers(len(BODIES))], [], []

    def around(inside: bool):
        if chance.random() < 0.5:
            kind = AROUND[chance.integers(len(AROUND))]
            if kind == ("div", "p") or inside and kind[0] in ("header", "footer"):
                kind = ("aside",)
        else:
            name = names[chance.integers(len(names))]
            kind = (("div", "section", "ul", "p")[chance.integers(4)], "." + name)
            if chance.random() < 0.4:
                other = ("box", "wrapper", "top", "left", "right", "list", "block", "inner")[chance.integers(8)]
                kind = (kind[0], f".{name}-{other}", "." + name, "." + other)
            kind += ((), ("p",), ("div", "p"), ("ul", "li"), ("h3",))[chance.integers(5)]
        link = float(chance.random() < 0.5)
        for _ in range(int(chance.integers(1, 6))):
            out.append((root + (body if inside else ()) + kind, text(chance.random() < 0.6), link))
            labels.append(0)

    for _ in range(int(chance.integers(0, 4))):
        around(False)
    for _ in range(int(chance.integers(1, 14))):
        out.append((root + body + PARTS[chance.integers(len(PARTS))], text(chance.random() < 0.25), float(chance.random() < 0.05)))
        labels.append(1)
        if chance.random() < 0.12:
            around(True)
    for _ in range(int(chance.integers(0, 4))):
        around(False)
    return out, np.array(labels, np.float32)


def train(pages: DataFrame, id_column: str = "page_id", sample: int = SAMPLE) -> Labeller | None:
    """A labeller of a bounded sample; None if no page has text."""
    light = pages.where(f"html is not null and octet_length(html) between 1 and {SAMPLE_BYTES}").select(F.xxhash64(id_column, F.octet_length("html")).alias("h"))
    chosen = light.orderBy("h").limit(sample).distinct()
    taken = pages.where("html is not null").withColumn("h", F.xxhash64(id_column, F.octet_length("html"))).join(F.broadcast(chosen), "h").where(
        f"octet_length(html) <= {SAMPLE_BYTES}").dropDuplicates(["h"]).select("h", "html").collect()
    read = [b for b in (leaves(r[1]) for r in sorted(taken)) if b]
    if not read:
        return None
    chance, known = np.random.default_rng(3), {}
    labelled = [(b, np.array([not outside(path) for path, _, _ in b], np.float32)) for b in read]
    labelled += [composed(read, chance) for _ in range(2 * len(read) + 400)]
    return Labeller().fit([(features(b, known), y) for b, y in labelled])


def main_text(pages: DataFrame, labeller: Labeller | None, id_column: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = Shared(pages.sparkSession, labeller)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_column, "url")}

    def run(batches):
        labeller, known = shared.get(), {}
        for batch in batches:
            data, offsets = text_column(batch, "html")
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), ("text", pa.string()), ("n_chars", pa.int64())])
            for lo, hi in slices(offsets):
                read = [leaves(data[a:b].tobytes().decode("utf-8")) for a, b in zip(offsets[lo:hi], offsets[lo + 1:hi + 1])]
                if len(known) > 20_000:
                    known.clear()
                blocks = [b for page in read for b in page]
                kept = labeller.label(features(blocks, known), np.array([len(p) for p in read])) if labeller else np.zeros(len(blocks), bool)
                texts, at = [], 0
                for page in read:
                    texts.append("\n".join(b[1] for b, k in zip(page, kept[at:at + len(page)].tolist()) if k))
                    at += len(page)
                yield emit(schema, [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), texts, [len(t) for t in texts]])

    return pages.select(id_column, "url", "html").mapInArrow(
        run, f"`{id_column}` {kinds[id_column]}, url {kinds['url']}, text string, n_chars long")


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train(pages))
