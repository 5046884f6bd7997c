"""The SQL of detection over texts too short to be told apart, and over files longer than a read chunk."""

import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from glyphaudit.operators import legacy
from glyphaudit.plans.page_oracles import ranked

TEXTS = ["A.", "Re.", "Erö.", "Éaux.", "Ärzte", "Äautz.", "Éçellement.", "Ííñ.", "Çmentque,", "È", "Çéé.", "Éééai", "Chäßä.", "Yñóómi,",
         "un été", "a.b\u0001\u0002é", "Äa" * 70000, "x" * 65536 + "É é"]
NAMES = ["cnv1_convert_detected", "det7_label_counts", "err1_codes", "leg1_pick", "snk6_conversion_job", "src5_empty_and_hidden", "src6_unreadable", "str1_changed_files",
         "str1_incremental_report", "str2_counts_after_rewrites", "str2_running_counts", "udf1_detect_charset", "val2_detect_bytes"]


@pytest.fixture(scope="module")
def short(tmp_path_factory):
    folder = tmp_path_factory.mktemp("short")
    c = duckdb.connect()
    c.execute("create table t(i int, text varchar)")
    c.executemany("insert into t values (?, ?)", list(enumerate(TEXTS)))
    c.execute(f"copy (select i * 13 + k as doc_id, text, 'fr' as lang, 's' as source, length(text) as n_chars from t, range(13) r(k)) to '{folder}/documents.parquet'")
    c.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", NAMES)
def test_short_texts(spark, short, name):
    folder, duck = short
    df = entry.queries()[name](spark, folder)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted(repr(tuple(r)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


def test_ranking_in_sql_equals_the_operator():
    r = random.Random(3)
    alphabets = ["aeiou .éèÄßüÉçñ", "中文字书写、。你好 abc", "かなカナ日本語、。 x", "한글나다라 힣 a", "Привет мир ё", "żółćęab \x01", "世界\U00020000\U000f0000a€"]
    values = []
    while len(values) < 400:
        text = "".join(r.choice(r.choice(alphabets)) for _ in range(r.choice([2, 5, 9, 600])))
        data = text.encode(r.choice(["cp932", "euc_jp", "gb18030", "cp950", "euc_kr", "cp949", "latin-1", "cp1251", "koi8-r"]), "ignore")
        data = data[:-1] if r.random() < 0.2 else data
        if any(b > 127 for b in data):
            values.append(data)
    tables, known, want = legacy._single_byte_tables(), {}, {}
    for i, v in enumerate(values):
        best = max(legacy._rank(np.frombuffer(v, np.uint8), tables, known), key=lambda x: (round(x["score"], 9), -x["priority"]))
        n = best["head_scalars"]
        if n and not best["head_private"] and (n - best["head_controls"]) / n >= 0.9:
            want[i] = (best["charset"], best["priority"])
    c = duckdb.connect()
    c.execute("create table rest(doc_id int, s varchar)")
    c.executemany("insert into rest values (?, ?)", [(i, v.hex().upper()) for i, v in enumerate(values)])
    assert {i: (page, p) for i, page, p in c.execute(f"with {ranked(9)} select doc_id, page, priority from picked").fetchall()} == want
