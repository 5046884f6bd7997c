"""Incremental delivery by a ledger: what changed, what is taken off, restarts, repeated batches."""

import os
import time
from datetime import datetime

import pytest

from glyphaudit.plans.audit import audit_report
from glyphaudit.sources.tree import scan_prefixes
from glyphaudit.streaming.ledger import (
    CHANGE, RESULT, changes_between, count_changes, current_counts, deliver_changes, newest, poll_tree, retractions, watch_ledger,
)


def put(base, files: dict) -> None:
    for rel, data in files.items():
        (base / rel).parent.mkdir(parents=True, exist_ok=True)
        (base / rel).write_bytes(data)


FIRST = {"a.txt": b"plain", "empty.txt": b"", "_under/.dot": "é".encode() * 9, "d/x.txt": b"\xff\xfea\x00", "d/gone.txt": b"x"}


def events(spark, ledger):
    return sorted((r.rel, r.version, r.event) for r in spark.read.schema(CHANGE).parquet(ledger).collect())


@pytest.fixture
def place(tmp_path):
    base = tmp_path / "tree"
    base.mkdir()
    return base, *(str(tmp_path / n) for n in ("ledger", "out", "state"))


def test_polls_note_what_is_new_changed_and_gone(spark, place):
    base, ledger, _, _ = place
    poll_tree(spark, str(base), ledger)
    assert events(spark, ledger) == []
    put(base, FIRST)
    poll_tree(spark, str(base), ledger)
    poll_tree(spark, str(base), ledger)
    first = [(rel, 1, "added") for rel in FIRST]
    assert events(spark, ledger) == sorted(first)
    put(base, {"a.txt": b"longer than before", "new.txt": b"n"})
    os.utime(base / "empty.txt", (1, 1))
    os.remove(base / "d/gone.txt")
    poll_tree(spark, str(base), ledger)
    second = [("a.txt", 2, "changed"), ("new.txt", 1, "added"), ("empty.txt", 2, "changed"), ("d/gone.txt", 2, "removed")]
    assert events(spark, ledger) == sorted(first + second)
    put(base, {"d/gone.txt": b"back"})
    poll_tree(spark, str(base), ledger)
    assert events(spark, ledger) == sorted(first + second + [("d/gone.txt", 3, "added")])


def test_path_rules_hold_and_files_that_leave_them_are_removed(spark, place):
    base, ledger, _, _ = place
    put(base, {"a.txt": b"1", "b.cs": b"2"})
    poll_tree(spark, str(base), ledger)
    poll_tree(spark, str(base), ledger, include=["*.cs"])
    assert events(spark, ledger) == [("a.txt", 1, "added"), ("a.txt", 2, "removed"), ("b.cs", 1, "added")]


def test_nothing_is_removed_while_a_directory_cannot_be_listed(spark):
    at = datetime(2020, 1, 1)
    known = spark.createDataFrame([("/a", "a", 1, at, 1, "added"), ("/b", "b", 1, at, 4, "removed")], CHANGE)
    listed = spark.createDataFrame([], "path string, rel string, length bigint, modificationTime timestamp")
    assert changes_between(listed, known, complete=False).isEmpty()
    assert [tuple(r) for r in changes_between(listed, known).collect()] == [("/a", "a", None, None, 2, "removed")]


def test_stream_equals_batch_and_delivers_rewritten_files_again(spark, place):
    base, ledger, out, state = place
    put(base, FIRST)
    poll_tree(spark, str(base), ledger)
    deliver_changes(watch_ledger(spark, ledger), out, state).awaitTermination()
    deliver_changes(watch_ledger(spark, ledger), out, state).awaitTermination()
    report = spark.read.parquet(out)
    batch = audit_report(scan_prefixes(spark, str(base)))
    assert report.count() == len(FIRST) and report.drop("version").exceptAll(batch).isEmpty()
    put(base, {"a.txt": "ä".encode() * 3, "empty.txt": b"no longer"})
    poll_tree(spark, str(base), ledger)
    deliver_changes(watch_ledger(spark, ledger), out, state).awaitTermination()
    report = spark.read.parquet(out)
    again = sorted((os.path.basename(r.path), r.source_encoding) for r in report.where("version = 2").collect())
    assert again == [("a.txt", "utf-8"), ("empty.txt", "us-ascii")] and report.count() == len(FIRST) + 2
    batch = audit_report(scan_prefixes(spark, str(base)))
    assert newest(report).drop("version").select(batch.columns).exceptAll(batch).isEmpty()


def test_file_gone_between_poll_and_read_is_an_error_row(spark, place):
    base, ledger, out, state = place
    put(base, FIRST)
    poll_tree(spark, str(base), ledger)
    os.remove(base / "d/gone.txt")
    deliver_changes(watch_ledger(spark, ledger), out, state).awaitTermination()
    rows = spark.read.parquet(out).where("result = 'Error'").collect()
    assert [os.path.basename(r.path) for r in rows] == ["gone.txt"] and rows[0].diagnostic


def counts(spark, out):
    return {r.result: r.n for r in current_counts(spark, out).collect()}


def test_counts_follow_rewritten_and_removed_files_over_restarts(spark, place):
    base, ledger, out, state = place

    def run():
        poll_tree(spark, str(base), ledger)
        count_changes(watch_ledger(spark, ledger), out, state, action="validate", accepted=["us-ascii"]).awaitTermination()
        expected = audit_report(scan_prefixes(spark, str(base)), action="validate", accepted=["us-ascii"])
        assert counts(spark, out) == {r.result: r["count"] for r in expected.groupBy("result").count().collect()}

    run()
    assert counts(spark, out) == {}
    put(base, FIRST)
    run()
    assert counts(spark, out) == {"Unchanged": 2, "Invalid": 3}
    time.sleep(0.01)
    put(base, {"a.txt": "ä".encode() * 4, "empty.txt": b"now ascii", "d/x.txt": b"\xff\xfeb\x00"})
    os.remove(base / "d/gone.txt")
    run()
    assert counts(spark, out) == {"Unchanged": 1, "Invalid": 3}
    for rel in [*FIRST][:4]:
        os.remove(base / rel)
    run()
    assert counts(spark, out) == {}


@pytest.mark.parametrize("before,now,expected", [
    ([], [("p", 1, "Invalid"), ("q", 1, None)], {"Invalid": 1}),
    ([("p", 1, "Invalid")], [("p", 2, "Unchanged")], {"Invalid": -1, "Unchanged": 1}),
    ([("p", 1, "Invalid")], [("p", 2, "Invalid")], {"Invalid": 0}),
    ([("p", 1, "Invalid"), ("p", 2, "Error"), ("r", 1, "Error")], [("p", 4, None), ("p", 3, "Unchanged")], {"Error": -1}),
    ([("p", 3, "Invalid")], [("p", 2, "Unchanged"), ("p", 3, "Invalid")], {}),
    ([("p", 2, None)], [("p", 3, "Unchanged")], {"Unchanged": 1}),
    ([("p", 1, "Error")], [], {}),
])
def test_old_results_are_taken_off(spark, before, now, expected):
    given = (spark.createDataFrame(rows, RESULT) for rows in (now, before))
    assert {r.result: r.n for r in retractions(*given).collect()} == expected


def test_repeated_batch_replaces_its_own_rows(spark, place):
    base, ledger, out, state = place
    put(base, FIRST)
    poll_tree(spark, str(base), ledger)
    for checkpoint in (state, state + "-lost"):
        # with its checkpoint lost, the query gives the same batch number once more
        count_changes(watch_ledger(spark, ledger), out, checkpoint, action="validate", accepted=["us-ascii"]).awaitTermination()
        assert counts(spark, out) == {"Unchanged": 2, "Invalid": 3}


def test_plan_of_changes_moves_no_contents(spark, place):
    base, ledger, _, _ = place
    put(base, FIRST)
    poll_tree(spark, str(base), ledger)
    changes = watch_ledger(spark, ledger)
    assert changes.isStreaming and not set(changes.columns) & {"content", "sample"}
