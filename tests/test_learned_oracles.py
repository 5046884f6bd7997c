"""The SQL of the learned code pages: texts too short to be told apart, pages in which a sample is the same text, samples beyond the bound."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphaudit.operators.code_pages import training_texts
from glyphaudit.plans import fixtures as fx
from glyphaudit.plans.learned_oracles import hashed

TEXTS = ["A.", "Re.", "De.", "Erö.", "Éaux.", "Ärzte", "a", "é", "Aé", "È", "§¶×÷", " ", "a b", "ÿþabc é", "ï»¿abc é", "Ã©t é", "\x01\x02é", "\x7fé", "plain text",
         "plain\x01\x02", "", "Grüße aus Köln", "日本語 x", "ÁÂ", "y", "Äa" * 40000, "".join(map(chr, range(0xA0, 0x100))) * 7, None]


def test_short_texts_in_every_page(spark, tmp_path):
    c = duckdb.connect()
    c.execute("create table t(i int, text varchar)")
    c.executemany("insert into t values (?, ?)", list(enumerate(TEXTS)))
    c.execute(f"copy (select i * 11 + k as doc_id, text, case when i % 9 = 8 then null else ['fr','de','en'][i % 3 + 1] end as lang, 's' as source, length(text) as n_chars "
              f"from t, range(11) r(k)) to '{tmp_path}/documents.parquet'")
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    result = c.execute(entry.oracle_sql()["leg1_learned_pages"])
    columns = [d[0] for d in result.description]
    got = entry.queries()["leg1_learned_pages"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall()) and len(got) == 11 * len(TEXTS)


def test_the_sample_in_sql_is_the_sample_of_the_model(spark):
    rows = [(f"é{'x€' * (i % 90)}{i}", f"l{i % 2}") for i in range(1500)]
    kept = training_texts(spark.createDataFrame(rows, "text string, language string"), 400).select("text").collect()
    c = duckdb.connect()
    c.execute("create table t(text varchar, lang varchar)")
    c.executemany("insert into t values (?, ?)", rows)
    want = c.execute(f"with {hashed('t', 'keyed')} select text from keyed qualify row_number() over (partition by lang order by h) <= 400").fetchall()
    assert len(want) == 800 and sorted(r.text for r in kept) == sorted(r[0] for r in want)
    h = spark.createDataFrame(rows, "text string, language string").select("text", F.xxhash64("text").alias("h")).collect()
    assert {r.text: r.h + 2**63 for r in h} == dict(c.execute(f"with {hashed('t', 'keyed')} select text, h from keyed").fetchall())


def test_documents_are_planted_once(spark, sf):
    df = fx.planted(spark, sf).filter(F.col("content").isNotNull()).filter(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "content")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and df.count() > 0
