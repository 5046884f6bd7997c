import os

import pytest
from pyspark.sql import functions as F

from glyphaudit.operators.convert import convert
from glyphaudit.operators.paths import included, mask_regex, split_masks
from glyphaudit.plans.audit import audit, audit_report, check_options
from glyphaudit.sources.sinks import read_csv_report, write_backup, write_csv_report, write_tree
from glyphaudit.sources.tree import list_tree, listed_files, listing_warnings, read_files, scan_files, scan_prefixes
from glyphaudit.streaming.incremental import deliver_report, watch_tree


@pytest.fixture
def tree(tmp_path):
    def write(rel, data=b"x"):
        p = tmp_path / "base" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    for rel in ("Top.py", "lib/one.py", "lib/deep/two.py", "misc/three.py", "bin/gone.py", "lib/Node_Modules/gone.py", "lib/.git/gone.py",
                "a.bak", "b.txt.1.unicodechecker.tmp", "B.BAK", "keep.tmp", "keep.unicodechecker.tmpx", ".hidden", "_under", "odd name,\"q\".txt"):
        write(rel)
    write("empty", b"")
    write("big.txt", b"y" * 100000)
    os.symlink(tmp_path / "base" / "lib", tmp_path / "base" / "link")
    os.symlink(tmp_path / "base" / "Top.py", tmp_path / "base" / "link.py")
    return str(tmp_path / "base")


def rels(df):
    return sorted(r.rel for r in df.select("rel").collect())


def test_listing_rules(spark, tree):
    want = sorted([".hidden", "_under", "big.txt", "empty", "keep.tmp", "keep.unicodechecker.tmpx", 'odd name,"q".txt', "misc/three.py",
                   "Top.py", "lib/one.py", "lib/deep/two.py"])
    assert rels(scan_prefixes(spark, tree)) == want
    assert rels(scan_prefixes(spark, tree, recursive=False)) == [w for w in want if "/" not in w]
    assert rels(scan_prefixes(spark, tree, include=["*.py"], exclude=["two.py"])) == ["Top.py", "lib/one.py", "misc/three.py"]
    assert rels(scan_prefixes(spark, tree, include=[r"LIB\*.py"])) == ["lib/deep/two.py", "lib/one.py"]
    report = tree.upper().replace(tree.upper(), tree) + "/TOP.py"
    assert "Top.py" not in rels(scan_prefixes(spark, tree, excluded_path=report))
    assert rels(scan_files(spark, tree + "/bin")) == ["gone.py"]  # the base itself is never excluded


def test_prefix_is_all_that_is_read(spark, tree):
    row = scan_prefixes(spark, tree, include=["big.txt"], sample_bytes=1000).first()
    assert (row.length, len(row.sample), row.read_error) == (100000, 1000, None)
    assert len(scan_files(spark, tree, include=["big.txt"]).first().content) == 100000


def test_samples_are_never_converted_or_backed_up(spark, tree, tmp_path):
    samples = scan_prefixes(spark, tree, include=["big.txt"])
    assert audit(samples).first().source_encoding == "us-ascii"
    planned = audit(samples, action="convert", target="utf-16", what_if=True)
    assert planned.first().result == "Converted"
    for refused in (lambda: audit(samples, action="convert", target="utf-16"), lambda: write_backup(planned, str(tmp_path / "bak")),
                    lambda: convert(planned, "utf-16", content="sample")):
        with pytest.raises(ValueError):
            refused()
    cut = samples.withColumnRenamed("sample", "content")  # passed off as whole
    row = audit(cut, action="convert", target="utf-16").first()
    assert (row.result, row.conversion.error_code, row.conversion.output) == ("Error", "SourceReadError", None)
    with pytest.raises(Exception, match="not the whole file"):
        write_backup(audit(cut, action="convert", target="utf-16", what_if=True), str(tmp_path / "bak"))
    whole = audit(scan_files(spark, tree, include=["big.txt"]), action="convert", target="utf-16").first()
    assert (whole.result, whole.conversion.scalars_verified) == ("Converted", 100000)


def test_length_and_time_are_those_at_opening(spark, tree):
    files = listed_files(list_tree(spark, tree), include=["big.txt"]).withColumns({
        "length": F.lit(5).cast("bigint"), "modificationTime": F.lit("2001-01-01").cast("timestamp")})
    row = read_files(files).first()
    assert row.length == len(row.content) == 100000 and row.modificationTime.year > 2001


def test_a_file_that_changes_while_it_is_read(tree, monkeypatch):
    import pyarrow as pa

    from glyphaudit.sources import tree as module

    path, stats = tree + "/big.txt", []

    class Growing:
        def __init__(self, system):
            self.system = system

        def get_file_info(self, inner):
            stats.append(self.system.get_file_info(inner))
            if len(stats) == 1:
                with open(path, "ab") as f:
                    f.write(b"more")
            return stats[-1]

        def open_input_file(self, inner):
            return self.system.open_input_file(inner)

    opened = module._open
    monkeypatch.setattr(module, "_open", lambda p, known=None: (Growing(opened(p)[0]), opened(p)[1]))
    listed = pa.RecordBatch.from_pylist([{"path": path, "rel": "big.txt", "length": 1, "modificationTime": None}])
    rows = [r for b in module._reader(None, "content")(iter([listed])) for r in b.to_pylist()]
    assert rows[0]["content"] is None and rows[0]["read_error"] == module.CHANGED


def test_lost_file_and_lost_directory_do_not_fail_the_job(spark, tree):
    listing = list_tree(spark, tree)
    files = listed_files(listing, include=["*.py"]).persist()
    files.count()
    os.remove(tree + "/lib/one.py")
    rows = {r.rel: r for r in audit(read_files(files, 65536)).collect()}
    bad = rows["lib/one.py"]
    assert (bad.source_encoding, bad.target_encoding, bad.result) == ("(Error)", "(Error)", "Error") and bad.diagnostic
    assert rows["Top.py"].result == "Unchanged" and len(rows) == 4
    gone = list_tree(spark, tree + "/nowhere")
    assert listing_warnings(gone).count() == 1 and listed_files(gone).count() == 0


def test_base_must_be_a_real_directory(tree):
    check_options("detect", base=tree)
    for bad in (tree + "/link", tree + "/absent", tree + "/Top.py"):
        with pytest.raises(ValueError):
            check_options("detect", base=bad)


def test_files_round_trip_and_stream_equals_batch(spark, buffers, tmp_path):
    values = [b"plain", "é".encode(), b"\xff\xfea\x00", b"\x00" * 40, "x".encode("utf-32-le") * 20]
    df = buffers(values).withColumn("rel", F.concat(F.lit("d/"), "id", F.lit(".txt")))
    base = str(tmp_path / "out")
    write_tree(df, base).write.format("noop").mode("overwrite").save()
    batch = scan_files(spark, base)
    assert {r.rel: bytes(r.content) for r in batch.collect()} == {f"d/{i}.txt": v for i, v in enumerate(values)}
    assert sorted(os.listdir(base + "/d")) == [f"{i}.txt" for i in range(5)]
    query = deliver_report(watch_tree(spark, base, 2), str(tmp_path / "rep"), str(tmp_path / "state"))
    query.awaitTermination()
    name = F.element_at(F.split("path", "/"), -1)
    streamed = spark.read.parquet(str(tmp_path / "rep")).withColumn("path", name)
    assert streamed.exceptAll(audit_report(batch).withColumn("path", name)).isEmpty() and streamed.count() == 5


def test_csv_report_round_trip(spark, tmp_path):
    odd = ["a,b", 'say "hi"', "line\nbreak", "cr\rhere", "", " lead and trail ", "plain", "_x", "Zed", "abc"]
    rows = [(p, "utf-8", True, "utf-16", False, "Converted", "secret") for p in odd]
    report = spark.createDataFrame(rows, "path string, source_encoding string, source_has_bom boolean, target_encoding string, "
                                         "target_has_bom boolean, result string, diagnostic string").coalesce(1)
    out = str(tmp_path / "csv")
    write_csv_report(report, out)
    back = read_csv_report(spark, out).collect()
    assert sorted(r.path for r in back) == sorted(odd)
    assert all((r.source_has_bom, r.target_has_bom, r.result) == (True, False, "Converted") for r in back)
    text = "".join(open(f"{out}/{f}", newline="").read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert "secret" not in text and "File,Encoding,BOM,Target,BOM,Result\n" in text
    assert '"a,b",utf-8,Yes,utf-16,No,Converted\n' in text and '"say ""hi""",' in text and "\n,utf-8" in "\n" + text
    plain = [line.split(",")[0] for line in text.split("\n") if line.split(",")[0] in ("plain", "_x", "Zed", "abc")]
    assert plain == ["abc", "plain", "Zed", "_x"]


def test_backup_holds_only_what_would_change(spark, buffers, tmp_path):
    df = buffers([b"a", b"b", b"c"]).withColumns({
        "path": F.col("id").cast("string"), "source_has_bom": F.lit(False),
        "source_encoding": F.expr("element_at(array('utf-8','utf-16','(Unknown)'), id + 1)")})
    write_backup(convert(df, "utf-8", what_if=True), str(tmp_path / "bak"))
    assert [(r.path, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "bak")).collect()] == [("1", b"b")]


@pytest.mark.parametrize("mask,hits", [
    ("*", "a.cs src/b.cs"), ("*.cs", "a.cs src/b.cs"), ("src/*", "src/b.cs"), ("?.cs", "a.cs src/b.cs"), ("B.CS", "src/b.cs"),
    ("src\\b.cs", "src/b.cs"), ("a+cs", ""), ("[ab].cs", ""), ("*/b.cs", "src/b.cs"), ("", "a.cs src/b.cs")])
def test_masks(spark, mask, hits):
    df = spark.createDataFrame([("a.cs",), ("src/b.cs",)], "rel string")
    assert rels(df.filter(included(F.col("rel"), [mask]))) == hits.split()


def test_mask_lists():
    assert split_masks(" *.a , ,b*,") == ["*.a", "b*"] and split_masks("x\n\n y ", "\n") == ["x", "y"]
    assert mask_regex("*.cs").endswith(r"^(?:.*/)?.*\.cs$")


def test_stream_reads_samples_only(spark, tmp_path):
    base = tmp_path / "in"
    base.mkdir()
    (base / "odd name.txt").write_bytes(b"z" * 5000)
    stream = watch_tree(spark, str(base), sample_bytes=100)
    assert "content" not in stream.columns
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.length, bytes(row.sample), row.read_error) == (5000, b"z" * 100, None)
