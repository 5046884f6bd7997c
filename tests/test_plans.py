"""What the plans must and must not contain."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphaudit.operators import profile as prof
from glyphaudit.operators.convert import convert
from glyphaudit.operators.detect import detect, sample_of
from glyphaudit.operators.joins import merge_outcomes
from glyphaudit.operators.report import report_order, sort_rows, with_position
from glyphaudit.plans.audit import audit, with_source


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def stored(spark, sf, tmp_path):
    path = str(tmp_path / "corpus")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.selectExpr("cast(doc_id as string) as path", "encode(text,'UTF-8') as content", "lang", "source").write.parquet(path)
    return spark.read.parquet(path)


def test_detection_does_not_shuffle_and_reads_two_columns(stored):
    p = plan(detect(stored).select("path", "charset", "has_bom"))
    assert "Exchange" not in p and p.count("(unknown)") >= 0
    assert "ReadSchema: struct<path:string,content:binary>" in p
    # three helpers, each evaluated once
    assert sum(line.strip().startswith("Arguments: [byte_features") for line in p.splitlines()) == 1
    assert sum(line.strip().startswith("Arguments: [strict_heads") for line in p.splitlines()) == 1
    assert sum(line.strip().startswith("Arguments: [rank_legacy") for line in p.splitlines()) == 1


def test_conversion_does_not_shuffle(stored):
    p = plan(audit(stored, action="convert", target="utf-16-bom"))
    assert "Exchange" not in p
    assert len(p) < 60000  # the chained helpers must not be copied into each other


def test_validation_does_not_shuffle(spark, stored):
    listed = spark.createDataFrame([("utf-8",), ("US-ASCII",)], "label string")
    for labels in (["utf-8", "us-ascii"], listed):
        p = plan(audit(stored, action="validate", accepted=labels))
        assert "Exchange" not in p and "Join" not in p
    # a list of any length is taken; past the filter's bound the distinct labels are joined
    long = spark.range(10_001).selectExpr("cast(id as string) as label").union(listed)
    same = [audit(stored, action="validate", accepted=a).groupBy("result").count().collect() for a in (listed, long)]
    assert sorted(same[0]) == sorted(same[1]) and {r.result for r in same[0]} >= {"Unchanged"}


def test_paths_that_differ_by_case_are_not_mixed_up(spark):
    listed = spark.createDataFrame([("a.txt",), ("A.txt",), ("b.txt",), ("c.txt",), ("C.TXT",)], "path string")
    outcomes = spark.createDataFrame([("a.txt", 1), ("A.txt", 2), ("B.TXT", 3), ("C.txt", 4), ("gone", 5)], "path string, result int")
    got = sorted(tuple(r) for r in merge_outcomes(listed, outcomes).collect())
    assert got == [("A.txt", 2), ("a.txt", 1), ("b.txt", 3)]


def test_dry_run_leaves_content_in_the_file(stored):
    known = stored.withColumns({"source_encoding": F.lit("utf-8"), "source_has_bom": F.lit(False)})
    p = plan(convert(known, "utf-16", what_if=True).select("path", "result"))
    assert "ArrowEvalPython" not in p and "ReadSchema: struct<path:string>" in p


def test_built_in_targets_need_python_only_for_the_rest(stored):
    known = stored.withColumns({"source_encoding": F.lit("utf-8"), "source_has_bom": F.lit(False)})
    assert "ArrowEvalPython" in plan(convert(known, "utf-16"))
    infeasible = plan(convert(known, "us-ascii-bom").select("path", "result", "diagnostic"))
    assert "ArrowEvalPython" not in infeasible and "content" not in infeasible.split("ReadSchema")[1].split("\n")[0]


def test_path_filter_reaches_the_scan(stored):
    p = plan(with_source(stored.filter(F.col("lang") == "de")).select("path", "source_encoding"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in p


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n[:3] in ("agg", "det", "val", "cnv", "joi", "txt", "ver", "lbl")))
def test_no_cross_joins(spark, sf, name):
    p = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_position_equals_sorted_rank(spark):
    rows = [(f"{'AbC_z'[i % 5]}{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "path string, id int").repartition(5)
    got = [(r.path, r.id) for r in with_position(df, report_order() + [F.col("id")]).orderBy("position").collect()]
    assert got == sorted(rows, key=lambda r: (r[0].upper(), r[0], r[1]))
    assert sorted(r.position for r in with_position(df, report_order()).collect()) == list(range(1, 501))


def test_column_sort_breaks_ties_by_the_other_columns(spark):
    df = spark.createDataFrame([("Apple", "zzz"), ("apple", "aaa"), ("banana", "a")], "a string, b string")
    up = [tuple(r) for r in df.orderBy(*sort_rows(df, "a", df.columns)).collect()]
    down = [tuple(r) for r in df.orderBy(*sort_rows(df, "a", df.columns, True)).collect()]
    assert up == [("apple", "aaa"), ("Apple", "zzz"), ("banana", "a")] and down == up[::-1]


def test_relational_profile_equals_arrow_profile(buffers):
    from test_detect import awkward

    df = buffers([v for v in awkward()[:250] if v])
    sample = sample_of("content")
    arrow = prof.unfold_histogram(prof.with_byte_histogram(df, sample), ["id"]).select("id", "byte", F.col("n").cast("bigint"))
    relational = prof.relational_histogram(df, sample, ["id"])
    assert arrow.exceptAll(relational).isEmpty() and relational.exceptAll(arrow).isEmpty()


def test_one_worker_decodes_in_all_charsets(spark, sf):
    """Each call of its own is a Python worker more for every task, with a batch and its results in memory."""
    from glyphaudit.plans import catalog

    plan = catalog.txt3_valid_text(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("strict_heads(") == 1


def test_small_batches_for_chained_helpers():
    from glyphaudit.plans.session import CHAINED, tune

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf()

    tune(Session, **CHAINED)
    tune(Session)
    assert int(Session.conf["spark.sql.execution.arrow.maxBytesPerBatch"]) == 8 << 20


def test_counts_of_null_and_empty_samples(spark):
    from glyphaudit.functions.arrow import byte_histogram, lane_histogram

    df = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"aab"))], "id int, content binary").coalesce(1)
    rows = {r.id: r for r in df.select("id", byte_histogram("content").alias("h"), lane_histogram("content").alias("l")).collect()}
    assert rows[1].h is None and rows[1].l is None and sum(rows[2].h) == 0 and len(rows[2].l) == 1024
    assert rows[3].h[97] == 2 and rows[3].h[98] == 1 and [rows[3].l[97], rows[3].l[256 + 97], rows[3].l[512 + 98]] == [1, 1, 1]
