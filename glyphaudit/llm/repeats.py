"""Removal of repeated passages: every byte covered by a ``WINDOW``-byte string that also starts elsewhere.

Positions are sampled by content: in every window the places where the hash of the next ``GRAM`` bytes is least are anchors, so two equal
windows have an anchor at the same place in them. Anchors meet by that hash. An anchor's context is all that a window over it can hold
(``REACH`` bytes to each side of the gram, less at the ends of a text). Equal contexts are repeats as a whole and are collapsed by their hash; of
each different context of a gram one copy is sent with its bytes. There a window is a pair of o bytes to the left of the gram and REACH - o to
the right. Left parts (read backwards) and right parts are sorted by ``suffix_sort``; with the common prefixes of neighbours, windows at each o are
equal exactly if both parts lie in one run. This gives the covered stretch around every anchor, and their union the bytes to remove.

Texts are classes of equal content. A text with copies is removed whole if it is long enough; it still meets others once.

Defined cases: null texts are empty; texts shorter than a window are kept; repeated rows are copies of each other; matches never cross texts;
an empty table gives no rows; texts above two ``BLOCK`` are taken in blocks that see their surroundings, so their length changes nothing; other
columns are ignored. In the pipeline a character cut by a removal is dropped with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import emit, slices, stored, table, text_column, trimmed
from .suffix_sort import deep_shallow
from .words import RAW_VALUE, U, mix, prefix_sums

WINDOW, GRAM = 200, 32
REACH = WINDOW - GRAM
BLOCK = 1 << 20
CHUNK = 20_000       # contexts sorted at once, whole grams
NO_TEXT = hashlib.sha256(b"").hexdigest()


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` successive values."""
    f = np.minimum if least else np.maximum
    n = -(-len(x) // width) * width
    filled = np.full(n, 0xFFFFFFFF if least else 0, x.dtype)
    filled[:len(x)] = x
    table_ = filled.reshape(-1, width)
    ahead = f.accumulate(table_, axis=1).ravel()
    behind = f.accumulate(table_[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:len(x) - width + 1], ahead[width - 1:len(x)])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, gram hash, context hash) of all anchors of texts of at least ``WINDOW`` bytes."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < WINDOW:
        return none
    sums, inverse = prefix_sums(data, RAW_VALUE)
    with np.errstate(over="ignore"):
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:len(sums) - GRAM])
    short = (gram >> U(32)).astype(np.uint32)
    short[short == 0xFFFFFFFF] -= np.uint32(1)
    # no gram may cross texts, and texts without a window have none
    sizes = np.diff(offsets)
    edge = np.zeros(len(data) + 1, np.int32)
    begins, ends = offsets[:-1], offsets[1:]
    np.add.at(edge, np.where(sizes >= WINDOW, np.maximum(ends - GRAM + 1, begins), begins), 1)
    np.add.at(edge, ends, -1)
    barred = np.cumsum(edge)[:len(short)] > 0
    short[barred] = 0xFFFFFFFF
    width = REACH + 1
    if len(short) < width:
        return none
    least = _slide(short, width, True)
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    # the window minima may be taken from windows that cross texts: such anchors are superfluous, not wrong
    most = _slide(padded, width, False)[:len(short)]
    at = np.flatnonzero((short == most) & ~barred)
    row = np.searchsorted(offsets, at, "right") - 1
    lo, hi = np.maximum(at - REACH, offsets[row]), np.minimum(at + WINDOW, offsets[row + 1])
    with np.errstate(over="ignore"):
        context = mix((sums[hi] - sums[lo]) * inverse[lo] + mix(((at - lo) * 1000 + (hi - at)).astype(U)))
    return row, at - offsets[row], gram[at].view(np.int64), context.view(np.int64)


def all_anchors(data: np.ndarray, offsets: np.ndarray):
    """``anchors`` of any texts; a long one is taken in blocks that see their surroundings."""
    for lo, hi in slices(offsets, BLOCK):
        size = int(offsets[hi] - offsets[lo])
        if size <= 2 * BLOCK:
            row, place, gram, context = anchors(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            yield row + lo, place, gram, context
            continue
        text = data[offsets[lo]:offsets[hi]]
        for begin in range(0, size, BLOCK):
            a, b = max(0, begin - REACH), min(size, begin + BLOCK + WINDOW)
            _, place, gram, context = anchors(text[a:b], np.array([0, b - a]))
            mine = (place + a >= begin) & (place + a < begin + BLOCK)
            yield np.full(int(mine.sum()), lo), place[mine] + a, gram[mine], context[mine]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sha", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).withColumn("cls", F.xxhash64("sha"))


ANCHORS = pa.schema([(n, pa.int64()) for n in ("gram", "cls", "place", "context", "stop")])


def _known(row: np.ndarray, place: np.ndarray, gram: np.ndarray, context: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list]:
    """Anchors to go on with, and (row, start, stop) that are repeats already: of equal contexts seen together one goes on."""
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, [none, none, none]
    order = np.lexsort((context, gram))
    same = (gram[order][1:] == gram[order][:-1]) & (context[order][1:] == context[order][:-1])
    again, several = np.concatenate([[False], same]), np.concatenate([[False], same]) | np.concatenate([same, [False]])
    members = np.sort(order[several])
    start, stop = np.maximum(place[members] - REACH, 0), np.minimum(place[members] + WINDOW, sizes[row[members]])
    wide = stop - start >= WINDOW
    r, start, stop = row[members][wide], start[wide], stop[wide]
    # in order of place; neighbours that touch are one stretch
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (start[1:] > stop[:-1])]) if len(r) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(r)) - 1 if len(r) else first
    return np.sort(order[~again]), [r[first], start[first], stop[last]]


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """(gram, cls, place, context, stop): where stop is 0, an anchor whose gram occurs twice at least, else a stretch from place to stop that
    is known to repeat. Equal contexts are collapsed before the shuffle, so a passage or line however frequent sends a row per slice."""
    def find(batches):
        done: set[int] = set()
        for batch in batches:
            cls = batch.column(0).to_numpy()
            if len(done) > 200_000:
                done = set()
            fresh = [i for i, c in enumerate(cls.tolist()) if not (c in done or done.add(c))]  # copies seen just now
            data, offsets = text_column(batch.take(pa.array(fresh, pa.int64())), "text")
            own, sizes = cls[fresh], np.diff(offsets)
            for row, place, gram, context in all_anchors(data, offsets):
                on, (r, start, stop) = _known(row, place, gram, context, sizes)
                yield emit(ANCHORS, [gram[on], own[row[on]], place[on], context[on], np.zeros(len(on), np.int64)])
                if len(r):
                    key = mix(own[r].view(U) ^ mix(start.astype(U))).view(np.int64)  # only deals the rows out
                    yield emit(ANCHORS, [key, own[r], start, np.zeros(len(r), np.int64), stop])

    found = texts.where(f"octet_length(text) >= {WINDOW}").select("cls", "text").mapInArrow(
        trimmed(find), "gram long, cls long, place long, context long, stop long")

    def pick(batches):
        held, repeated = None, False   # the last anchor waits for its successor; is its gram known to repeat?
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy() for i in range(5)])
            stretch = now[4] > 0
            if stretch.any():
                yield emit(ANCHORS, list(now[:, stretch]))
                now = now[:, ~stretch]
            if held is not None:
                now = np.concatenate([held, now], axis=1)
            if not now.shape[1]:
                continue
            now = now[:, np.concatenate([[True], (now[:, 1:] != now[:, :-1]).any(axis=0)])]
            same = now[0, 1:] == now[0, :-1]
            before = np.concatenate([[repeated], same])
            keep = (before | np.concatenate([same, [False]]))[:-1]
            yield emit(ANCHORS, list(now[:, :-1][:, keep]))
            held, repeated = now[:, -1:], bool(before[-1])
        if held is not None and repeated:
            yield emit(ANCHORS, list(held))

    dealt = found.repartition("gram").sortWithinPartitions("gram", "context", "cls", "place")
    return dealt.mapInArrow(pick, "gram long, cls long, place long, context long, stop long")


def contexts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, cls, place, left, right) for the wanted (cls, gram, place). ``left`` is read backwards from the gram."""
    lists = wanted.groupBy("cls").agg(F.collect_list(F.struct("place", "gram")).alias("places"))
    joined = texts.join(lists, "cls").select("cls", "text", F.col("places.place").alias("place"), F.col("places.gram").alias("gram"))

    def cut(batches):
        schema = pa.schema([("gram", pa.int64()), ("cls", pa.int64()), ("place", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
        for batch in batches:
            data, offsets = text_column(batch, "text")
            cls = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                places, grams = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values
                at = places.tolist()
                yield emit(schema, [grams, np.full(len(at), cls[i]), places, [text[max(0, p - REACH):p][::-1] for p in at],
                                    [text[p + GRAM:p + WINDOW] for p in at]])

    return joined.mapInArrow(trimmed(cut), "gram long, cls long, place long, left binary, right binary")


def covered(gram: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of equal grams: bytes left of the gram's start and from it on that repeated windows cover; -1, -1 if none."""
    n = len(gram)
    group = np.unique(gram, return_inverse=True)[1]
    sides = []
    for parts in (left, right):
        lengths = np.array([len(p) for p in parts], np.int64)
        rows = np.frombuffer(b"".join(p.ljust(REACH, b"\0") for p in parts), np.uint8).reshape(n, REACH)
        sides.append(deep_shallow(rows, lengths, group))
    (l_order, l_same), (r_order, r_same) = sides
    most, least = np.full(n, -1), np.full(n, -1)
    l_class, r_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(REACH + 1):
        l_class[l_order] = np.cumsum(l_same < o)
        r_class[r_order] = np.cumsum(r_same < REACH - o)
        key = l_class * (n + 1) + r_class
        by = np.argsort(key, kind="stable")
        twin = key[by][1:] == key[by][:-1]
        hit = by[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return most, np.where(most < 0, -1, WINDOW - least)


def stretches(contexts: DataFrame) -> DataFrame:
    """(cls, start, stop) that repeated windows cover around anchors."""
    out_schema = pa.schema([("cls", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches):
        def solve(gram, cls, place, left, right):
            before, after = covered(gram, left, right)
            hit = before >= 0
            return emit(out_schema, [cls[hit], (place - before)[hit], (place + after)[hit]])

        held = None
        for batch in batches:
            now = [*(batch.column(i).to_numpy() for i in range(3)), *(batch.column(i).to_pylist() for i in (3, 4))]
            if held is not None:
                now = [np.concatenate([h, n]) if isinstance(h, np.ndarray) else h + n for h, n in zip(held, now)]
            if not len(now[0]):
                continue
            gram, cls, place = now[:3]
            new = np.concatenate([[True], gram[1:] != gram[:-1]])
            fresh = new | np.concatenate([[True], (cls[1:] != cls[:-1]) | (place[1:] != place[:-1])])  # repeated rows
            if not fresh.all():
                keep = np.flatnonzero(fresh)
                now = [n[keep] if isinstance(n, np.ndarray) else [n[i] for i in keep.tolist()] for n in now]
                new = new[keep]
            starts = np.flatnonzero(new)
            lo, last = 0, int(starts[-1])   # the last gram may go on
            while lo < last:
                hi = int(starts[min(np.searchsorted(starts, lo + CHUNK), len(starts) - 1)])
                yield solve(*(n[lo:hi] for n in now))
                lo = hi
            held = [n[last:] for n in now]
        if held is not None:
            yield solve(*held)

    return contexts.repartition("gram").sortWithinPartitions("gram", "cls", "place").mapInArrow(trimmed(run), "cls long, start long, stop long")


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, spans, texts): rows (doc_id, cls, sha, n_bytes, copies), spans (cls, spans array<start, stop>) of texts without copies, and the
    texts (cls, text) that share anchors with others."""
    keyed = _keyed(docs.select("doc_id", "text"))
    rows = stored(keyed.select("doc_id", "cls", "sha", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "texts")
    classes = rows.groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    both = stored(repeated_anchors(keyed), "anchors")
    found, known = both.where("stop = 0").drop("stop"), both.where("stop > 0").select("cls", F.col("place").alias("start"), "stop")
    per_context = found.groupBy("gram", "context").agg(F.count("*").alias("alike"), F.min(F.struct("cls", "place")).alias("first"))
    per_gram = per_context.groupBy("gram").agg(F.count("*").alias("kinds"))
    several = stored(per_context.join(per_gram.where("kinds > 1"), "gram").select(
        "gram", F.col("first.cls").alias("cls"), F.col("first.place").alias("place")), "contexts")
    alike = found.join(per_context.where("alike > 1").select("gram", "context"), ["gram", "context"]).select("cls", "place")
    needed = both.select("cls").distinct().join(classes, "cls")
    by_id = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    texts = stored(keyed.select("cls", "text", by_id.alias("k")).join(
        needed.select("cls", F.coalesce("rep", F.lit(-(1 << 63))).alias("k")), ["cls", "k"]).select("cls", "text"), "needed")
    near = stored(stretches(contexts_of(texts, several)), "stretches")
    sizes = rows.select("cls", "n_bytes").distinct()
    whole = alike.join(sizes, "cls").select(
        "cls", F.greatest(F.lit(0), F.col("place") - REACH).alias("start"), F.least(F.col("n_bytes"), F.col("place") + WINDOW).alias("stop")).where(
        f"stop - start >= {WINDOW}")
    single = classes.where("copies = 1").select("cls")
    spans = near.union(whole).union(known).join(single, "cls").groupBy("cls").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(classes.select("cls", "copies"), "cls"), spans, texts


def joined_spans(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Union of stretches as maximal runs."""
    out: list[tuple[int, int]] = []
    for i in np.lexsort((stop, start)).tolist():
        a, b = int(start[i]), int(stop[i])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _spans_of(batch: pa.RecordBatch, column: int, i: int) -> list[tuple[int, int]]:
    value = batch.column(column)[i]
    if not value.is_valid:
        return []
    return joined_spans(value.values.field("start").to_numpy(), value.values.field("stop").to_numpy())


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row. ``docs`` has doc_id and text."""
    rows, spans, texts = removed(docs)

    def run(batches):
        schema = pa.schema([("cls", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])
        for batch in batches:
            data, offsets = text_column(batch, "text")
            out = []
            for i in range(batch.num_rows):
                found = _spans_of(batch, 2, i)
                kept = _kept(data[offsets[i]:offsets[i + 1]].tobytes(), found)
                out.append((sum(b - a for a, b in found), len(found), hashlib.sha256(kept).hexdigest()))
            yield emit(schema, [batch.column(0), *([o[k] for o in out] for k in range(3))])

    cut = stored(texts.join(spans, "cls").select("cls", "text", "spans").mapInArrow(
        run, "cls long, n_removed long, n_spans long, kept string").dropDuplicates(["cls"]), "cut")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    return rows.join(cut, "cls", "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(NO_TEXT)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut out of ``text``, ``n_chars`` follows. All rows stay, also those left empty."""
    rows, spans, _ = removed(docs)
    whole = rows.where(f"copies > 1 and n_bytes >= {WINDOW}").select(
        "cls", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans")).distinct()
    cuts = spans.union(whole)
    names, has_count = docs.columns, "n_chars" in docs.columns
    tagged = docs.withColumn("__cls", F.xxhash64(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    joined = tagged.join(cuts.withColumnsRenamed({"cls": "__key", "spans": "__spans"}), F.col("__cls") == F.col("__key"), "left").drop("__cls", "__key")

    def run(batches):
        for batch in batches:
            at, last = batch.schema.get_field_index("text"), batch.num_columns - 1
            data, offsets = text_column(batch, "text")
            texts, counts = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("n_chars")).to_pylist() if has_count else None
            for i in range(batch.num_rows):
                if found := _spans_of(batch, last, i):
                    texts[i] = _kept(data[offsets[i]:offsets[i + 1]].tobytes(), found).decode("utf-8", "ignore")
                    if has_count:
                        counts[i] = len(texts[i])
            columns = {"text": texts} | ({"n_chars": counts} if has_count else {})
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], batch.schema.field(n).type) if n in columns else batch.column(i)
                                              for i, n in enumerate(names)], names=names)

    return joined.mapInArrow(trimmed(run), docs.schema)
