import random

import pytest
from pyspark.sql import functions as F

import brute
from glyphaudit.functions.sql import register_functions
from glyphaudit.operators.detect import detect

ASCII = "A plain note: 42 boxes, 7 crates.\r\nNothing else in store.\r\n"
MULTI = "Ship 船 باخرة корабль πλοίο אונייה 배 🚢⚓\r\nAll of it arrived: 全部 всё όλα.\r\n"
CODECS = {"utf-8": "utf-8", "utf-16": "utf-16-le", "utf-16BE": "utf-16-be", "utf-32": "utf-32-le", "utf-32BE": "utf-32-be"}


def found(df, **options):
    return {r.id: (r.charset, r.has_bom) for r in detect(df, **options).select("id", "charset", "has_bom").collect()}


def awkward():
    """Buffers on both sides of every rule, then seeded noise of several shapes."""
    r = random.Random(7)
    out = [b"", b"a", b"\x00" * 64, b"\x00" * 3, ASCII.encode(), b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff", b"\xff\xfe\x00\x00",
           b"\x00\x00\xfe\xff", b"\xff\xfe\x00", b"caf\xc3\xa9", b"caf\xc3", b"caf\xe2\x82", b"caf\xe0\x80", b"caf\xed\xa0\x80",
           b"\xf0\x9f\x8c", b"ab\xf0\x9f\x8c", b"\xc3", b"\xf4\x90\x80\x80 text text", b"\xc0\x80 text", b"\x1b" * 3 + b"x" * 30,
           b"\x1b" * 4 + b"x" * 30, "xyz".encode(), ("x" * 500 + "").encode(), ("x" * 499 + "").encode(),
           "\U000f0000 plane 15".encode(), b"x" * 511 + b"\x85", bytes(range(256)) * 2, bytes(range(256)) * 2 + b"a",
           b"\xff\xfe" + bytes(range(256)) * 2, bytes(range(256))[:255] * 2 + b"\x00"]
    for text in (ASCII, MULTI, "ab", "abcd", "abcde", "世界世界世", "я" * 20, "中" * 300 + "\n", "a" * 40 + "\ud83c", "\ud800a" * 10, "\udc00" * 8):
        for name, codec in CODECS.items():
            data = text.encode(codec, "surrogatepass")
            out += [data, data[:-1], data + b"\x00", bytes.fromhex({"utf-8": "EFBBBF", "utf-16": "FFFE", "utf-16BE": "FEFF",
                    "utf-32": "FFFE0000", "utf-32BE": "0000FEFF"}[name]) + data, data[:9], data[:10], data[:15], data[:16]]
    han = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(900))
    mixed = "".join(chr(r.choice([32, 10, r.randrange(0x4E00, 0x9FFF)])) for _ in range(900))
    out += [x.encode(c) for x in (han, mixed) for c in ("utf-16-le", "utf-16-be", "utf-8")]
    alphabets = [bytes(range(256)), bytes(range(0x20, 0x7F)) + b"\r\n\t", b"\x00\x00\x00ab ", b"\xc3\xa9\xe2\x82\xac ab", b"\x00\xd8\xdc\xdf\x41",
                 b"\x00\x04\x10\x30\x41\x4e", b"\xe9\xe8 abc", bytes(range(0x80, 0x100)) + b" abc"]
    for _ in range(900):
        a = r.choice(alphabets)
        n = r.choice([3, 8, 10, 15, 16, 17, 40, 200, 511, 512, 513, 1500])
        out.append(bytes(r.choice(a) for _ in range(n)))
    for _ in range(150):
        n = r.choice([12, 64, 700])
        out.append(bytes(b for _ in range(n) for b in (0 if r.random() < 0.6 else r.randrange(256), r.choice(b"abc\x00"))))
        out.append("".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x2FFF), r.randrange(0x1F300, 0x1F600)])) for _ in range(n)).encode())
    return out


def test_cascade_equals_brute_force(buffers):
    values = awkward()
    got = found(buffers(values), legacy=False)
    want = {i: brute.detect(v) for i, v in enumerate(values)}
    assert {i: (got[i], want[i], values[i][:40]) for i in want if got[i] != want[i]} == {}
    assert len({v[0] for v in want.values()}) == 7


def test_sql_function_equals_operator(spark, buffers):
    register_functions(spark)
    df = buffers(awkward())
    df.createOrReplaceTempView("awkward")
    via_sql = spark.sql("select id, d.charset, d.has_bom from (select id, detect_charset(content) d from awkward)")
    whole = detect(df).select("id", "charset", "has_bom")
    assert via_sql.exceptAll(whole).count() == 0 and whole.exceptAll(via_sql).count() == 0


def test_long_sample_is_cut_at_64_kib(buffers):
    a = b"x" * 65535
    values = [a + "é".encode() + b"y" * 100, a + b"y" + b"\xff" * 100, "é".encode() * 40000, b"x" + "é".encode() * 40000]
    assert [found(buffers(values))[i][0] for i in range(4)] == ["utf-8", "us-ascii", "utf-8", "utf-8"]


def test_null_and_empty_content(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray())], "id int, content binary")
    assert found(df) == {1: ("(Unknown)", False), 2: ("(Unknown)", False)}


def test_sample_size_must_be_positive(buffers):
    with pytest.raises(ValueError):
        detect(buffers([b"x"]), sample_bytes=0)


@pytest.mark.parametrize("charset,codec,text", [
    ("koi8-r", "koi8-r", "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства."),
    ("windows-1251", "cp1251", "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства."),
    ("cp866", "cp866", "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства."),
    ("iso-8859-5", "iso8859-5", "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства."),
    ("windows-1253", "cp1253", "Η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και μετά κοιμάται."),
    ("windows-1255", "cp1255", "דג סקרן שט בים מאוכזב ולפתע מצא לו חברה נחמדה"),
    ("windows-1252", "cp1252", "Le cœur déçu mais l'âme plutôt naïve, Louÿs rêva de crapaüter à l'été."),
    ("windows-1252", "cp1252", "El niño pequeño comió jamón, ¿qué más podría pedir la señora?"),
    ("windows-1252", "cp1252", "Die Bäckerin grüßte höflich über den Zaun, während der Hund müde gähnte."),
    ("windows-1252", "cp1252", "O coração não conhece razões; amanhã virão os irmãos."),
    ("windows-1250", "cp1250", "Zażółć gęślą jaźń, mówiła żona do męża nad rzeką."),
    ("iso-8859-9", "iso8859-9", "Işık hızıyla koşan çocuğun şapkası düştü, güneş doğdu."),
    ("windows-1250", "cp1250", "Příliš žluťoučký kůň úpěl ďábelské ódy, řekl starý šnek."),
    ("shift_jis", "cp932", "いろはにほへとちりぬるを。日本語の文章です。カタカナも少し。"),
    ("euc-jp", "euc_jp", "いろはにほへとちりぬるを。日本語の文章です。カタカナも少し。"),
    ("GB18030", "gb18030", "我能吞下玻璃而不伤身体。今天的天气很好，我们一起去公园散步。"),
    ("big5", "cp950", "我能吞下玻璃而不傷身體。今天的天氣很好，我們一起去公園散步。"),
    ("euc-kr", "euc_kr", "나는 유리를 먹을 수 있어요. 그래도 아프지 않아요. 오늘은 날씨가 좋습니다."),
    ("windows-874", "cp874", "ฉันกินกระจกได้ แต่มันไม่ทำให้ฉันเจ็บ วันนี้อากาศดีมาก"),
])
def test_legacy_pick_on_plain_text(buffers, charset, codec, text):
    assert found(buffers([text.encode(codec)]))[0] == (charset, False)


def test_nothing_but_high_bytes_is_not_taken_for_another_script(buffers):
    assert found(buffers([("é" * 50).encode("latin-1")]))[0][0] == "windows-1252"


def test_result_does_not_depend_on_partitioning(buffers):
    values = awkward()[:300]
    from glyphaudit.operators.validate import report_detected
    from glyphaudit.operators.verify import compare_runs

    def run(n):
        df = detect(buffers(values, n)).withColumnsRenamed({"charset": "source_encoding", "has_bom": "source_has_bom"})
        return report_detected(df.withColumn("path", F.col("id").cast("string")))

    assert compare_runs(run(1), run(7)).isEmpty()
