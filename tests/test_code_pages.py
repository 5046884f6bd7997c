"""The learned code-page model against planted pages, a plain-Python count and its defined cases."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphaudit.operators.code_pages import (
    PRIOR, UNIT, code_page_model, count_pairs, fit_code_pages, training_texts,
)
from glyphaudit.operators.detect import detect
from glyphaudit.plans import fixtures as fx
from glyphaudit.plans.audit import audit

SCHEMA = "text string, language string"
HUNGARIAN = ["Árvíztűrő tükörfúrógép és öt hűtőház.", "Őszi szőlő, kései bor, hűvös este.", "Nyúlcipőt húz a vízöntő, őz ül a fűben."]
FRENCH = ["Où êtes-vous allés cet été, à la forêt?", "Les élèves ont reçu leurs prix à Noël.", "Ça ira, même après la tempête."]
PAGES = ["windows-1252", "windows-1250", "koi8-r"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t, "hu") for t in HUNGARIAN] + [(t, "fr") for t in FRENCH], SCHEMA)


def test_counts_and_likelihoods_equal_plain_python(spark, texts):
    counts = count_pairs(texts, PAGES)
    seen = Counter()
    for t in HUNGARIAN:
        data = b" " + t.encode("cp1250")
        seen.update(a * 256 + b for a, b in zip(data, data[1:]))
    got = {r.pair: r.n for r in counts.where("page = 'windows-1250' and language = 'hu' and pair >= 0").collect()}
    assert got == dict(seen)
    model = code_page_model(counts, PAGES)
    row = model.table[model.models.index(("windows-1250", "hu"))]
    after, before, total = Counter(), Counter(), sum(seen.values())
    for pair, n in seen.items():
        before[pair // 256] += n
        after[pair % 256] += n
    for pair in [0xF5 * 256 + 0x7A, 0x20 * 256 + 0xC1, 0x41 * 256 + 0x42]:
        own = (after[pair % 256] + 0.5) / (total + 128)
        expected = math.log2((seen[pair] + PRIOR * own) / (before[pair // 256] + PRIOR))
        assert row[pair] == round(UNIT * expected)


def test_a_page_is_learned_only_for_languages_it_holds(texts):
    model = fit_code_pages(texts, PAGES)
    assert ("windows-1250", "hu") in model.models and ("windows-1252", "fr") in model.models
    assert ("windows-1252", "hu") not in model.models and not any(p == "koi8-r" for p, _ in model.models)


def test_hungarian_is_told_from_french(spark, texts, buffers):
    model = fit_code_pages(texts, PAGES)
    values = ["A hőség elől a hűs erdőbe menekült.".encode("cp1250"), "Après la fête, où êtes-vous?".encode("cp1252")]
    rows = {r.id: r.charset for r in detect(buffers(values), legacy=model).collect()}
    assert rows == {0: "windows-1250", 1: "windows-1252"}


def test_same_text_in_two_pages_goes_by_their_order(texts, buffers):
    german = "Grüße aus Köln".encode("cp1252")
    for pages in (["windows-1252", "windows-1250"], ["windows-1250", "windows-1252"]):
        model = fit_code_pages(texts, pages)
        assert detect(buffers([german]), legacy=model).first().charset == pages[0]


def test_defined_cases(spark, texts, buffers):
    model = fit_code_pages(texts, PAGES)
    values = [b"", b"plain", "é".encode("cp1252"), ("é" * 200_000).encode("cp1252"), "schön".encode()]
    rows = {r.id: r.charset for r in detect(buffers(values), legacy=model).collect()}
    assert rows[0] == "(Unknown)" and rows[1] == "us-ascii" and rows[4] == "utf-8"
    assert rows[2] == rows[3] == "windows-1252"
    empty = spark.createDataFrame([], "id int, content binary")
    assert detect(empty, legacy=model).count() == 0
    nulls = spark.createDataFrame([(1, None)], "id int, content binary")
    assert detect(nulls, legacy=model).first().charset == "(Unknown)"


def test_labels_that_teach_nothing(spark):
    rows = [(None, "fr"), ("été", None), ("plain", "en"), ("", "en")]
    with pytest.raises(ValueError, match="no labelled text"):
        fit_code_pages(spark.createDataFrame(rows, SCHEMA), PAGES)


def test_sample_is_bounded_and_counts_repeated_texts_once(spark):
    rows = [("é même", "fr")] * 500 + [(f"é {i}", "fr") for i in range(200)] + [("ő", "hu")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    counts = {r.language: r["count"] for r in training_texts(df, 50).groupBy("language").count().collect()}
    assert counts == {"fr": 50, "hu": 1}
    every = training_texts(df, 1000)
    assert every.where("language = 'fr'").count() == 201 and every.where("text = 'é même'").count() == 1
    first = sorted(r.h for r in df.distinct().where("language = 'fr'").select(F.xxhash64("text").alias("h")).collect())[:50]
    assert sorted(r.h for r in training_texts(df, 50).where("language = 'fr'").select(F.xxhash64("text").alias("h")).collect()) == first


def test_counts_can_be_stored(spark, texts, tmp_path):
    count_pairs(texts, PAGES).write.parquet(str(tmp_path / "counts"))
    stored = code_page_model(spark.read.parquet(str(tmp_path / "counts")), PAGES)
    fresh = fit_code_pages(texts, PAGES)
    assert stored.models == fresh.models and (stored.table == fresh.table).all()


def test_held_out_documents(spark, sf):
    model = fit_code_pages(fx.labelled(spark, sf), fx.PAGES)
    held = fx.planted(spark, sf).where("crc32(cast(doc_id as string)) % 5 = 0").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    found = detect(held, legacy=model).selectExpr("avg(cast(charset = page as double)) as share", "count(*) as n").first()
    assert found.n >= 30 and found.share >= 0.98


def test_scoring_does_not_shuffle_and_scores_once(spark, texts, buffers):
    model = fit_code_pages(texts, PAGES)
    df = spark.createDataFrame([(bytearray(b"x"),)], "content binary")
    plan = detect(df, legacy=model)._jdf.queryExecution().toString()
    executed = plan[plan.index("== Physical Plan =="):]
    assert "Exchange" not in executed and executed.count("rank_code_pages(") == 1
    assert audit(df, legacy=model).count() == 1
