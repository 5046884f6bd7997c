"""Spark's own file sources against the listing that does not pass through the driver."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glyphaudit.sources.tree import list_binary_files, scan_binary_files
from glyphaudit.streaming.incremental import deliver_report, running_counts, watch_tree

FILES = {
    "Top.py": b"1", "bin/kept.py": b"22", "lib/Node_Modules/kept.py": b"333", "lib/odd name,\"q\" 100%41.txt": b"\xff\xfe\x00", "empty": b"",
    ".dot": b"x", "_under": b"x", "_a=b": b"yes", "copy._COPYING_": b"x", ".git/no": b"x", "_dir/no": b"x", "_metadata/kept": b"m", "_metadata/_no": b"x", "_metadata.x": b"x",
}


@pytest.fixture
def base(tmp_path):
    for rel, data in FILES.items():
        p = tmp_path / "base" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / "else").mkdir()
    (tmp_path / "else/far.txt").write_bytes(b"far")
    os.symlink(tmp_path / "else", tmp_path / "base/link")
    os.symlink(tmp_path / "else/far.txt", tmp_path / "base/link.txt")
    os.symlink(tmp_path / "nowhere", tmp_path / "base/broken")
    return str(tmp_path / "base")


@pytest.mark.parametrize("recursive", [True, False])
@pytest.mark.parametrize("prefix", ["", "file://"])
def test_rows_of_sparks_reader_without_its_listing(spark, base, recursive, prefix):
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(prefix + base)
    ours = scan_binary_files(spark, prefix + base, recursive)
    assert ours.dtypes == theirs.dtypes and ours.count() == (8 if recursive else 3)
    assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()
    plan = ours._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "Relation" in plan


def test_what_cannot_be_read_ends_the_job(spark, base):
    rows = scan_binary_files(spark, base)
    os.remove(base + "/Top.py")
    with pytest.raises(PySparkException, match="Top.py"):
        rows.collect()
    with pytest.raises(OSError):
        scan_binary_files(spark, base + "/nowhere")


def test_directory_gone_during_the_listing_is_left_out(spark, base):
    from glyphaudit.sources.tree import list_directories

    gone = spark.createDataFrame([(base + "/gone", "gone")], "path string, rel string")
    assert list_directories(gone, as_spark=True).isEmpty() and list_directories(gone).first().kind == "error"


def test_store_that_only_spark_reaches(spark, base):
    from glyphaudit.sources.tree import reachable

    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.binary.link./in", f"file://{base}")
    assert not reachable("viewfs://binary/in")
    rows = scan_binary_files(spark, "viewfs://binary/in")
    assert rows.count() == list_binary_files(spark, base).count() == 8
    assert rows.where(F.col("path").endswith("/bin/kept.py")).first().content == b"22"


def delivered(spark, base, folder, **options):
    deliver_report(watch_tree(spark, base, **options), folder + "/out", folder + "/state").awaitTermination()
    return sorted(r.path.split("/base/")[1] for r in spark.read.parquet(folder + "/out").collect())


VISIBLE = ["Top.py", "_a=b", "_metadata/kept", "bin/kept.py", "lib/Node_Modules/kept.py", "lib/odd name,\"q\" 100%41.txt", "link.txt", "link/far.txt"]


def test_stream_remembers_paths_over_restarts(spark, base, tmp_path):
    place = {"arrived": str(tmp_path / "arrived")}
    assert delivered(spark, base, str(tmp_path), **place) == VISIBLE
    with open(base + "/Top.py", "wb") as f:
        f.write(b"rewritten")
    with open(base + "/bin/new.py", "wb") as f:
        f.write(b"new")
    for _ in range(2):
        assert delivered(spark, base, str(tmp_path), **place) == sorted([*VISIBLE, "bin/new.py"])
    # a second query of the same tree gets all of it
    assert delivered(spark, base, str(tmp_path / "second"), **place) == sorted([*VISIBLE, "bin/new.py"])


def test_stream_finds_its_table_again_by_the_tree(spark, base, tmp_path):
    for _ in range(2):
        assert delivered(spark, base, str(tmp_path)) == VISIBLE


def test_driver_remembers_part_files_not_paths(spark, base, tmp_path):
    (tmp_path / "base/many").mkdir()
    for i in range(300):
        (tmp_path / f"base/many/{i}.txt").write_bytes(b"x")
    assert len(delivered(spark, base, str(tmp_path))) == 308
    log = "".join(p.read_text() for p in (tmp_path / "state/sources/0").iterdir() if not p.name.startswith("."))
    assert "many" not in log and 0 < log.count('"path"') < 20


def test_batches_are_bounded_by_files(spark, base, tmp_path):
    query = deliver_report(watch_tree(spark, base, 3), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    sizes = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert sum(sizes) == 8 and max(sizes) <= 3


def test_counts_of_a_watched_tree(spark, base, tmp_path):
    running_counts(watch_tree(spark, base), "counts_of_a_watched_tree", str(tmp_path / "state"), action="validate", accepted=["us-ascii"]).awaitTermination()
    assert {r.result: r.n for r in spark.table("counts_of_a_watched_tree").collect()} == {"Unchanged": 7, "Invalid": 1}
