"""Incremental delivery by a ledger of changes: empty, hidden, rewritten and removed files count.

Spark's file source remembers paths and skips empty and hidden files. Here ``poll_tree`` lists the tree as a batch job does and
appends to a Parquet table, the ledger, one row for each file that is new, has another length or time than before, or is gone;
versions number the changes of a path. The streams read the ledger, whose part files are never rewritten, so offsets and exactly-once
delivery are Spark's own, and no list of paths ever comes to the driver.

- A poll is a distributed listing and one join on the path with the newest row of each path; no file is opened. A poll that dies
  halfway is made up for by the next one, which compares with what the ledger holds. Polls of one ledger follow each other.
- While a directory cannot be listed, nothing is taken for removed; the next complete poll notes it.
- A file rewritten with its old length and time is not noticed. One that changes between poll and read is reported as it is read, or as
  an error row, and delivered again by the next poll. One removed meanwhile is an error row.
- An empty tree, ledger or poll without changes gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.constants import SAMPLE_BYTES
from ..operators.report import as_report
from ..plans.audit import audit
from ..sources.tree import SLICE_FILES, list_tree, listed_files, listing_warnings, read_samples

CHANGE = "path string, rel string, length bigint, modificationTime timestamp, version bigint, event string"
ADDED, CHANGED, REMOVED = "added", "changed", "removed"
DELTA = "result string, n bigint"
RESULT = "path string, version bigint, result string"


def newest(rows: DataFrame) -> DataFrame:
    """The row of the highest version of each path: of a ledger, or of a delivered report."""
    others = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*others), "version").alias("_row")).select("path", *[f"_row.{c}" for c in others])


def changes_between(listed: DataFrame, known: DataFrame, complete: bool = True) -> DataFrame:
    """Ledger rows that lead from ``known``, the newest ones, to the listed files; without ``complete`` nothing is taken for removed."""
    was = known.select("path", F.struct("rel", "length", "modificationTime", "version", "event").alias("_was"))
    both = listed.select("path", "rel", "length", "modificationTime").join(was, "path", "full_outer")
    here, before = F.col("rel").isNotNull(), F.coalesce(F.col("_was.event") != REMOVED, F.lit(False))
    same = (F.col("length") == F.col("_was.length")) & F.col("modificationTime").eqNullSafe(F.col("_was.modificationTime"))
    event = F.when(here & ~before, F.lit(ADDED)).when(here & ~same, F.lit(CHANGED))
    if complete:
        event = event.when(~here & before, F.lit(REMOVED))
    return both.select(
        "path", F.coalesce("rel", "_was.rel").alias("rel"), "length", "modificationTime",
        (F.coalesce("_was.version", F.lit(0)) + 1).cast("bigint").alias("version"), event.alias("event"),
    ).where("event is not null")


def poll_tree(
    spark: SparkSession, base: str, ledger: str, recursive: bool = True, include: list[str] | None = None,
    exclude: list[str] | None = None, excluded_path: str | None = None,
) -> None:
    """Append to the ledger what has changed below ``base`` since its last poll."""
    spark.createDataFrame([], CHANGE).write.mode("ignore").parquet(ledger)
    listing = list_tree(spark, base, recursive)
    known = newest(spark.read.schema(CHANGE).parquet(ledger))
    changes = changes_between(
        listed_files(listing, include, exclude, excluded_path), known, listing_warnings(listing).isEmpty())
    # part files of a bounded number of rows, so that a stream can take them by the file
    changes.write.mode("append").option("maxRecordsPerFile", SLICE_FILES).parquet(ledger)


def watch_ledger(spark: SparkSession, ledger: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of changes; a batch takes so many part files of at most 20,000 rows."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).parquet(ledger)


def samples_of_changes(changes: DataFrame, sample_bytes: int = SAMPLE_BYTES, tasks: int | None = None) -> DataFrame:
    """Samples of the files that were added or changed, with their ``version``.

    Rows of a ledger are tiny and reading a file is not, so they are dealt out first, by default over the cluster's slots.
    """
    slots = tasks or changes.sparkSession.sparkContext.defaultParallelism
    return read_samples(changes.where(F.col("event") != REMOVED).repartition(slots), sample_bytes, ("version",))


def deliver_changes(changes: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append a report row, with its ``version``, for each added or changed file, then stop when the backlog is empty."""
    rows = as_report(audit(samples_of_changes(changes), **options), "version")
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def retractions(now: DataFrame, before: DataFrame) -> DataFrame:
    """(result, n): what the rows of one batch add to the counts and, by the newest earlier row of their paths, take off them.

    Both are (path, version, result), the result NULL for a removed file. Rows older than the counted one change nothing.
    """
    now = newest(now)
    was = newest(before.join(now.select("path"), "path", "left_semi"))
    moved = now.join(was.select("path", F.struct("version", "result").alias("_was")), "path", "left")
    moved = moved.where("_was is null or _was.version < version")
    steps = F.array(
        F.struct(F.col("_was.result").alias("result"), F.lit(-1).alias("n")), F.struct(F.col("result"), F.lit(1).alias("n")))
    return moved.select(F.explode(steps).alias("_s")).select("_s.*").where("result is not null").groupBy("result").agg(F.sum("n").alias("n"))


def count_changes(changes: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Keep counts by result that follow rewritten and removed files; ``current_counts`` reads them.

    A batch stores its results, then the difference they make: at most one row a result. Both lie under the batch's number and see
    earlier numbers only, so a batch repeated after a failure replaces its own rows. Earlier results are joined on the path, a small
    row for each version; nothing is held in the memory of executors between batches.
    """
    changes.sparkSession.createDataFrame([], DELTA).write.mode("ignore").parquet(f"{path}/deltas/batch=-1")
    counted = audit(samples_of_changes(changes), **options).select("path", "version", "result")
    gone = changes.where(F.col("event") == REMOVED).select("path", "version", F.lit(None).cast("string").alias("result"))

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        results = batch.sparkSession.read.schema(f"{RESULT}, batch bigint").parquet(f"{path}/results")
        now, before = (results.where(rows).drop("batch") for rows in (F.col("batch") == number, F.col("batch") < number))
        retractions(now, before).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")

    return (
        counted.unionByName(gone).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """(result, n) of the files as they were last delivered; results without files are left out."""
    deltas = spark.read.schema(DELTA).parquet(f"{path}/deltas")
    return deltas.groupBy("result").agg(F.sum("n").alias("n")).where("n <> 0")
