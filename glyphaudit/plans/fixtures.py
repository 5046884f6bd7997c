"""Byte forms, paths and known encodings derived from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrow import once, transcode_facts
from ..operators.code_pages import training_texts
from .session import CHAINED, tune

ENC_SPARK = """case doc_id % 13
 when 0 then encode(text,'UTF-8')
 when 1 then concat(x'EFBBBF', encode(text,'UTF-8'))
 when 2 then encode(text,'UTF-16LE')
 when 3 then concat(x'FFFE', encode(text,'UTF-16LE'))
 when 4 then encode(text,'UTF-16BE')
 when 5 then concat(x'FEFF', encode(text,'UTF-16BE'))
 when 6 then unhex(regexp_replace(hex(encode(text,'UTF-32')),'(..)(..)(..)(..)','$4$3$2$1'))
 when 7 then concat(x'FFFE0000', unhex(regexp_replace(hex(encode(text,'UTF-32')),'(..)(..)(..)(..)','$4$3$2$1')))
 when 8 then encode(text,'UTF-32')
 when 9 then concat(x'0000FEFF', encode(text,'UTF-32'))
 when 10 then encode(text,'ISO-8859-1')
 when 11 then unhex(concat_ws('', transform(sequence(0,63), i -> sha2(concat(doc_id,'-',i),256))))
 else x'' end"""

PATHS = """case doc_id % 9 when 0 then 'bin/' when 1 then 'Node_Modules/x/' when 2 then 'src/' when 3 then 'src/nested/'
   when 4 then '.git/' when 5 then 'other/' else '' end
 || case doc_id % 5 when 0 then 'na,me' when 1 then 'say "hi"' when 2 then '_under' when 3 then 'Doc' else '.dot' end
 || cast(doc_id as varchar(20))
 || case doc_id % 7 when 0 then '.cs' when 1 then '.CS' when 2 then '.txt' when 3 then '.cs.BAK'
   when 4 then '.txt.0a1b.unicodechecker.tmp' when 5 then '.txt.unicodechecker.tmpx' else '.designer.cs' end"""

TRUTH_ENCODING = """case when doc_id % 13 in (0,1) then 'utf-8' when doc_id % 13 in (2,3) then 'utf-16'
   when doc_id % 13 in (4,5) then 'utf-16BE' when doc_id % 13 in (6,7) then 'utf-32'
   when doc_id % 13 in (8,9) then 'utf-32BE' when doc_id % 13 = 10 then 'iso-8859-1' else '(Unknown)' end"""
TRUTH_BOM = "doc_id % 13 in (1,3,5,7,9)"

# A finished report with all five outcomes, the same in both engines.
REPORT = f"""select doc_id, {PATHS} as path, {TRUTH_ENCODING} as source_encoding, {TRUTH_BOM} as source_has_bom,
 case when doc_id % 13 > 10 then '(Unknown)' when doc_id % 19 = 0 then {TRUTH_ENCODING} else 'utf-8' end as target_encoding,
 case when doc_id % 13 > 10 then false when doc_id % 19 = 0 then {TRUTH_BOM} else doc_id % 2 = 0 end as target_has_bom,
 case when doc_id % 13 > 10 then 'Skipped' when doc_id % 19 = 0 then 'Invalid' when doc_id % 17 = 0 then 'Error'
  when doc_id % 13 < 2 and (doc_id % 13 = 1) = (doc_id % 2 = 0) then 'Unchanged' else 'Converted' end as result,
 case when doc_id % 13 <= 10 and doc_id % 19 <> 0 and doc_id % 17 = 0 and doc_id % 3 <> 0
  then 'SourceDecodeError: document ' || cast(doc_id as varchar(20)) end as diagnostic
from documents"""

# Letters that stand for a to z, so that the documents become texts of other scripts. Fixed values of the test data.
ALPHABETS = {
    "central": "ábčďěfghíjkľmňópqřšťůvwxýž", "cyrillic": "абцдефгхийклмнопщрстувшжыз", "greek": "αβψδεφγηιξκλμνοπθρστυωςχζύ",
    "kana": "あいうえおかきくけこさしすせそたちつてとなにぬねのは", "hangul": "가나다라마바사아자차카타파하고노도로모보소오조코토포",
    "thai": "กขคงจชซญดตถทธนบปผพฟภมยรลวส",
}
# The page each document is planted in, by doc_id % 11, and its script.
PLANTED = [
    ("windows-1252", "western"), ("windows-1250", "central"), ("windows-1251", "cyrillic"), ("koi8-r", "cyrillic"),
    ("cp866", "cyrillic"), ("iso-8859-5", "cyrillic"), ("windows-1253", "greek"), ("windows-874", "thai"),
    ("shift_jis", "kana"), ("euc-jp", "kana"), ("euc-kr", "hangul"),
]
PAGES = [page for page, _ in PLANTED]
# What stays of a Western text; everything else becomes a question mark, as it does in every script.
KEPT = {"western": "\u00a0-\u00ff"} | ALPHABETS
PLANTED_PAGE = "case doc_id % 11 " + " ".join(f"when {i} then '{page}'" for i, page in enumerate(PAGES)) + " end"


def scripted(script: str) -> str:
    """SQL for the text in a script; the same in both engines but for the flag of a global replacement."""
    text = "text" if script == "western" else f"translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{ALPHABETS[script]}')"
    return f"regexp_replace({text}, '[^\u0001-\u007f{KEPT[script]}]', '?'FLAG)"


PLANTED_TEXT = "case doc_id % 11 " + " ".join(f"when {i} then {scripted(s)}" for i, (_, s) in enumerate(PLANTED)) + " end"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, script, planted text, content): each document in one of eleven code pages."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    script = "case doc_id % 11 " + " ".join(f"when {i} then '{s}'" for i, (_, s) in enumerate(PLANTED)) + " end"
    texts = docs.selectExpr(
        "doc_id", f"lang || '-' || {script} as language", f"{PLANTED_PAGE} as page", f"{PLANTED_TEXT.replace('FLAG', '')} as text")
    # one column: a filter above must not plant the texts again
    coded = once(transcode_facts)(F.encode("text", "UTF-8"), F.lit("utf-8"), F.col("page"), F.lit(False))
    return texts.withColumn("content", coded["output"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, language) a model may learn from: a sample of the documents whose crc32(doc_id) mod 5 is not 0, in every script.

    The sample is drawn before the texts are rewritten, so the rewriting does not grow with the table.
    """
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]).where("crc32(cast(doc_id as string)) % 5 <> 0")
    some = training_texts(docs.select("text", F.col("lang").alias("language")), beyond_ascii=False)
    scripts = ", ".join(f"struct('{s}' as script, {scripted(s).replace('FLAG', '')} as text)" for s in KEPT)
    return some.selectExpr("language", f"explode(array({scripts})) as s").selectExpr("s.text as text", "language || '-' || s.script as language")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a table has fewer splits than there are task slots; large tables stay as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = tune(spark, **CHAINED).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def enc(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """(doc_id, content, extra...) with each document in one of 13 byte forms."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.selectExpr("doc_id", f"{ENC_SPARK} as content", *extra)


def paths(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr("doc_id", f"{PATHS} as rel", *extra)


def truth(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr(
        "doc_id", f"{TRUTH_ENCODING} as source_encoding", f"{TRUTH_BOM} as source_has_bom", *extra
    )


def enc_truth(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return enc(
        spark, sf_dir, f"{TRUTH_ENCODING} as source_encoding", f"{TRUTH_BOM} as source_has_bom", *extra
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    select = REPORT[len("select "):REPORT.rindex("from documents")]
    return spark.sql(f"select {select} from {{docs}}", docs=docs)
