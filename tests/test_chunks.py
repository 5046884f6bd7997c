"""Conversion and UTF-8 validity of files in chunks against the same for whole contents."""

import random

import pytest
from pyspark.sql import functions as F

from glyphaudit.functions.text import is_utf8
from glyphaudit.operators import chunks as ck
from glyphaudit.operators.convert import RESULT_FIELDS, convert

FIELDS = [f for f in RESULT_FIELDS if f != "output"]


def cut(data, r, longest):
    at, out = 0, []
    while at < len(data):
        n = r.randint(1, longest)
        out.append(data[at:at + n])
        at += n
    return out or [b""]


def contents(seed):
    """(content, charset): sound and broken ones, marks, ends inside a character."""
    r = random.Random(seed)
    texts = ["", "a", "plain ascii only", "é", "Grüße, naïve café – 10 €", "日本語テキスト、かな", "한국어 문장", "a😀b𝄞", "﻿marked", "mixed é 日本 ﻿ z" * 5, "ÀÉ" * 300]
    out = []
    for charset, codec, mark in (("utf-8", "utf-8", b"\xef\xbb\xbf"), ("utf-16", "utf-16-le", b"\xff\xfe"), ("utf-16BE", "utf-16-be", b"\xfe\xff"),
                                 ("utf-32", "utf-32-le", b"\xff\xfe\0\0"), ("utf-32BE", "utf-32-be", b"\0\0\xfe\xff"), ("windows-1252", "cp1252", b""),
                                 ("iso-8859-1", "latin-1", b""), ("us-ascii", "ascii", b""), ("shift_jis", "cp932", b""), ("euc-kr", "euc_kr", b""),
                                 ("iso-2022-jp", "iso2022_jp", b""), ("GB18030", "gb18030", b"")):
        for text in texts:
            try:
                data = text.encode(codec)
            except UnicodeEncodeError:
                continue
            out += [(data, charset), (mark + data, charset)]
            if len(data) > 3:
                out += [(data[:-1], charset), (data[:-2], charset), (data[:-3], charset)]
                broken = bytearray(data)
                broken[r.randrange(len(broken))] = r.choice([0xFF, 0x80, 0xD8, 0xDC, 0xED, 0x1B])
                out.append((bytes(broken), charset))
        out += [(bytes(r.randrange(256) for _ in range(r.randint(1, 12))), charset) for _ in range(6)]
    out += [(b"ab\xed\xa0", "utf-8"), (b"ab\xed", "utf-8"), (b"x\xf0\x90", "utf-8"), (b"\x81\x90ok", "windows-1252"), (b"\x00\xd8\x00", "utf-16"), (b"abc", "no-such")]
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("target,longest", [("utf-8", 3), ("utf-16-bom", 7), ("us-ascii", 3), ("windows-1250", 5), ("shift_jis", 3), ("iso-2022-jp", 3),
                                            ("utf-8", 100_000), ("us-ascii", 100_000)])
def test_chunks_equal_whole_contents(spark, target, longest):
    r = random.Random(longest)
    given = contents(longest)
    if longest == 100_000:   # texts beyond a read chunk
        given = [("é".encode() * 140_000 + b"\xff" + b"a" * 300_000, "utf-8"), (b"a" * 262_143 + b"\xc3\xa9" * 3 + b"\xc3", "utf-8"),
                 ("é".encode("utf-16-le") * 131_072 + b"\0\xd8", "utf-16"), (b"\xef\xbb\xbf" + "日".encode() * 100_000, "utf-8"),
                 (b"a" * 300_000 + b"\xff" + b"b" * 300_000, "utf-8"), ("é".encode() + b"a" * 600_000 + b"\xff", "utf-8")]
    whole = spark.createDataFrame([(i, bytearray(c), e, False) for i, (c, e) in enumerate(given)], "id int, content binary, source_encoding string, source_has_bom boolean")
    want = {x.id: x for x in convert(whole, target).collect()}
    rows = [(i, k, bytearray(part), e, False) for i, (c, e) in enumerate(given) for k, part in enumerate(cut(c, r, longest))]
    r.shuffle(rows)
    parts = spark.createDataFrame(rows, "id int, no int, content binary, source_encoding string, source_has_bom boolean").repartition(5)
    pieces, outcomes = ck.convert_chunks(ck.placed(parts, "id"), target, "id")
    output = {}
    for x in sorted(pieces.collect(), key=lambda x: (x.id, x.no, x.part)):
        output[x.id] = output.get(x.id, b"") + bytes(x.output)
    got = outcomes.collect()
    assert len(got) == len(given)
    for x in got:
        w = want[x.id]
        assert (x.result, x.diagnostic, x.target_encoding, x.target_has_bom) == (w.result, w.diagnostic, w.target_encoding, w.target_has_bom), given[x.id]
        if w.conversion is None:
            assert x.conversion is None
            continue
        assert [x.conversion[f] for f in FIELDS] == [w.conversion[f] for f in FIELDS], given[x.id]
        assert output.get(x.id) == (None if w.conversion.output is None else bytes(w.conversion.output)), given[x.id]


def test_validity_is_associative(spark, monkeypatch):
    """Equal to the test of whole contents for any cutting and any size of the groups that are folded."""
    r = random.Random(9)
    given = [c for c, _ in contents(1)] + [bytes(r.choice(b"a\xc3\xa9\xe0\xa0\x80\xed\x9f\xf0\x90\xf4\x8f\xbf") for _ in range(r.randint(1, 9))) for _ in range(400)]
    whole = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(given)], "id int, content binary").select(
        "id", is_utf8(F.col("content")).alias("accepted"), is_utf8(F.col("content"), cut_tail=False).alias("valid"))
    want = {x.id: (x.accepted, x.valid) for x in whole.collect()}
    for longest, fold in ((1, 2), (3, 3), (50, 1024)):
        monkeypatch.setattr(ck, "FOLD", fold)
        rows = [(i, k, bytearray(part)) for i, c in enumerate(given) for k, part in enumerate(cut(c, r, longest))]
        r.shuffle(rows)
        got = ck.utf8_states(spark.createDataFrame(rows, "id int, no int, content binary").repartition(4), "id").collect()
        assert {x.id: (x.accepted, x.valid) for x in got} == want


def test_one_file_is_many_tasks(spark):
    """Self-synchronising sources are not brought together by file for anything but the digest. Contents too large to broadcast, that is."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        many_tasks(spark)
    finally:
        for name in settings:
            spark.conf.unset(name)


def many_tasks(spark):
    rows = ck.placed(spark.createDataFrame([(1, i, bytearray(b"ab")) for i in range(50)], "id int, no int, content binary").repartition(5), "id")
    pieces, _ = ck.transcode_chunks(rows.withColumn("charset", F.lit("utf-8")), "utf-16", "id", digest=False)
    tasks = pieces.where("written > 0").withColumn("t", F.spark_partition_id()).select("t").distinct().count()
    assert tasks > 1


def test_allow_list_of_any_size(spark):
    """Beyond the bound a list is joined: same rows as by a short one."""
    from glyphaudit.operators import validate as vd

    rows = spark.createDataFrame([(i, e, b) for i, (e, b) in enumerate([("utf-8", False), ("UTF-8", True), ("x42", False), ("(Unknown)", False), (None, False), ("x-none", False)] * 5)],
                                 "id int, source_encoding string, source_has_bom boolean")
    many = spark.range(vd.MOST_LABELS + 1).selectExpr("concat('X', id) as label", "1 as source_encoding").union(
        spark.createDataFrame([("utf-8-bom", 2), (None, 3), ("(unknown)", 4)], "label string, source_encoding int"))
    got = vd.validate(rows, many)
    assert got.columns == vd.validate(rows, ["utf-8"]).columns
    assert {x.id: x.result for x in got.collect()} == {i: "Unchanged" if i % 6 in (1, 2) else "Invalid" for i in range(30)}
    assert {x.id for x in vd.accepted(rows, many).collect()} == {i for i in range(30) if i % 6 in (1, 2)}
    assert vd.rejected(rows, many).count() == 20


def test_facts_of_many_chunks_travel_together():
    """A record batch for each chunk cost more than the chunk; one for all would hold every output at once."""
    import pyarrow as pa

    from glyphaudit.operators.chunks import EMIT_BYTES, _apart

    def facts(size, n):
        batch = pa.RecordBatch.from_pydict({
            "key": list(range(n)), "no": [0] * n, "start": [0] * n, "before": [b""] * n, "head": [b"aaaa"] * n, "last": [True] * n,
            "source": ["us-ascii"] * n, "content": [b"a" * size] * n})
        return list(_apart("utf-16")(iter([batch])))

    small, large = facts(10, 500), facts(EMIT_BYTES // 2, 4)
    assert len(small) == 1 and small[0].num_rows == 500 and small[0].column("output")[499].as_py() == b"a\x00" * 10
    assert [b.num_rows for b in large] == [8, 8, 8, 8]   # read chunks of 256 KiB
