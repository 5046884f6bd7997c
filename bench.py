"""Headline timings as one JSON line. Each query runs once to warm up and is then timed, best of two."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from glyphaudit.operators import profile as prof  # noqa: E402
from glyphaudit.operators.convert import convert  # noqa: E402
from glyphaudit.operators.detect import detect, sample_of  # noqa: E402
from glyphaudit.plans.audit import audit  # noqa: E402
from glyphaudit.plans import catalog, fixtures as fx  # noqa: E402
from glyphaudit.plans.session import tune  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = tune(
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # byte forms are made once: the timings are those of the operators, not of the fixture
    store = os.path.join(catalog.shared_folder(spark, "bench"), "enc")
    fx.enc_truth(spark, SF, "text").write.parquet(store)
    enc = spark.read.parquet(store)
    docs = enc.count()
    total = enc.agg(F.sum(F.length("content"))).first()[0]
    utf8 = enc.select("doc_id", F.encode("text", "UTF-8").alias("content"),
                      F.lit("utf-8").alias("source_encoding"), F.lit(False).alias("source_has_bom"))
    sample = sample_of("content")
    cases = {
        "detect_cascade": lambda: detect(enc).select("doc_id", "charset", "has_bom"),
        "detect_utf8_corpus": lambda: detect(utf8).select("doc_id", "charset", "has_bom"),
        "convert_utf8": lambda: convert(enc.drop("text"), "utf-8"),
        "convert_utf8_arrow": lambda: convert(enc.drop("text"), "utf-8", built_in=False),
        "convert_utf8_to_utf16": lambda: convert(utf8, "utf-16-bom"),
        "convert_utf8_to_utf16_arrow": lambda: convert(utf8, "utf-16-bom", built_in=False),
        "byte_histogram_arrow": lambda: prof.unfold_histogram(prof.with_byte_histogram(enc, sample), ["doc_id"]),
        "byte_histogram_relational": lambda: prof.relational_histogram(enc, sample, ["doc_id"]),
        "validate_contents": lambda: audit(utf8.drop("source_encoding", "source_has_bom"), "validate", accepted=["utf-8", "us-ascii"]),
        "validate": lambda: catalog.val1_validate(spark, SF),
        "report_order": lambda: catalog.sort1_report_order(spark, SF),
        "label_counts": lambda: catalog.det7_label_counts(spark, SF),
    }
    seconds = {}
    for name, make in cases.items():
        drain(make())
        best = None
        for _ in range(2):
            start = time.time()
            drain(make())
            took = time.time() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": SF, "cpus": int(CPUS), "documents": docs, "bytes": total,
        "documents_per_second": {n: round(docs / s) for n, s in seconds.items()},
    }))


if __name__ == "__main__":
    main()
