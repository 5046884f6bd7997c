"""File trees: distributed listing, prefix-sampled and whole-file reads.

Spark's ``binaryFile`` reader always reads whole files, drops empty and hidden ones, follows links and keeps all paths on the
driver. These readers keep them apart: the listing walks the tree one level per Spark job (so neither the driver
nor one task ever holds all paths), and reading is a separate map over the listed files, spread by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.constants import EXCLUDED_DIRECTORIES, SAMPLE_BYTES
from ..operators.paths import included, is_artefact, is_path
from .scratch import shared_folder

LISTED = "kind string, path string, rel string, length bigint, modificationTime timestamp, list_error string"
_LISTED_ARROW = pa.schema([
    ("kind", pa.string()), ("path", pa.string()), ("rel", pa.string()), ("length", pa.int64()),
    ("modificationTime", pa.timestamp("us", tz="UTC")), ("list_error", pa.string()),
])
READ = "path string, rel string, length bigint, modificationTime timestamp, {} binary, read_error string"
CHANGED = "SourceChangedDuringConversion: the file changed while it was read"
READ_BATCH_BYTES = 32 << 20
# A row holds a value of at most 2 GB; larger files can be detected from a prefix but not read whole.
ROW_BYTES = (1 << 31) - (1 << 20)
SLICE_BYTES, SLICE_FILES = 128 << 20, 20_000


def _open(path: str, known: dict | None = None) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a plain path or a URI, on the driver or in a task.

    ``known`` keeps one file system per scheme and authority.
    """
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")  # as Spark writes local paths
    if "://" not in path:
        path = f"file://{_quote(path)}"
    elif path.startswith("s3a://"):
        path = "s3://" + path.removeprefix("s3a://")
    if known is None:
        return pafs.FileSystem.from_uri(path)
    scheme, _, rest = path.partition("://")
    authority = rest.split("/", 1)[0]
    if (scheme, authority) not in known:
        system, inner = pafs.FileSystem.from_uri(path)
        known[scheme, authority] = system, bool(authority) and inner.startswith(authority)
    system, with_authority = known[scheme, authority]
    return system, _unquote(rest if with_authority else rest[len(authority):])


def _unquote(path: str) -> str:
    from urllib.parse import unquote

    return unquote(path)


def _quote(path: str) -> str:
    from urllib.parse import quote

    return quote(path)


def _is_link(system: pafs.FileSystem, path: str) -> bool:
    import os

    return isinstance(system, pafs.LocalFileSystem) and os.path.islink(path)


def _child(parent: str, name: str) -> str:
    return f"{parent.rstrip('/')}/{name}"


def _hidden(name: str, directory: bool) -> bool:
    """Names that Spark's file sources leave out."""
    if directory and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _list_directory(path: str, rel: str, known: dict, as_spark: bool = False) -> Iterator[dict]:
    """Rows for the entries of one directory; a row of kind "error" when it cannot be listed.

    ``as_spark`` lists what Spark's file sources would: links are followed, hidden names and directories gone meanwhile left out.
    """
    try:
        system, inner = _open(path, known)
        entries = system.get_file_info(pafs.FileSelector(inner, recursive=False))
    except (OSError, ValueError) as e:
        if not (as_spark and rel and isinstance(e, FileNotFoundError)):
            yield {"kind": "error", "path": path, "rel": rel, "list_error": str(e)}
        return
    for entry in entries:
        directory = entry.type == pafs.FileType.Directory
        if _hidden(entry.base_name, directory) if as_spark else _is_link(system, entry.path):
            continue
        row = {"path": _child(path, entry.base_name), "rel": f"{rel}/{entry.base_name}" if rel else entry.base_name}
        if directory:
            if as_spark or entry.base_name.lower() not in EXCLUDED_DIRECTORIES:
                yield {"kind": "directory", **row}
        elif entry.type == pafs.FileType.File:
            yield {"kind": "file", **row, "length": entry.size, "modificationTime": entry.mtime}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    pending: list[dict] = []
    for row in rows:
        pending.append(row)
        if len(pending) >= size:
            yield pa.RecordBatch.from_pylist(pending, schema=schema)
            pending = []
    if pending:
        yield pa.RecordBatch.from_pylist(pending, schema=schema)


def _lister(as_spark: bool):
    def list_many(directories: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            known: dict = {}
            for batch in directories:
                for d in batch.to_pylist():
                    yield from _list_directory(d["path"], d["rel"], known, as_spark)

        yield from _batches(rows(), _LISTED_ARROW)

    return list_many


def list_directories(directories: DataFrame, as_spark: bool = False) -> DataFrame:
    """Entries of each (path, rel) directory; unlistable ones give a row of kind "error"."""
    return directories.select("path", "rel").mapInArrow(_lister(as_spark), LISTED)


def list_tree(spark: SparkSession, base: str, recursive: bool = True, as_spark: bool = False) -> DataFrame:
    """All files below ``base``, excluded directories left out; also the directories that failed to list.

    Each level of the tree is listed by one job and stored as a table in the shared folder. ``as_spark`` takes the rules of Spark's
    file sources instead: no directory is excluded by name but the hidden ones, and links are followed.
    """
    store = shared_folder(spark, "listing")
    frontier = spark.createDataFrame([(base.rstrip("/") or "/", "")], "path string, rel string")
    level = 0
    while True:
        target = f"{store}/level={level}"
        list_directories(frontier, as_spark).write.parquet(target)
        if not recursive:
            break
        found = spark.read.schema(LISTED).parquet(target).filter("kind = 'directory'").select("path", "rel")
        waiting = found.count()
        if waiting == 0:
            break
        # rows are tiny and their cost is not: an explicit number keeps them from being coalesced
        frontier = found.repartition(min(waiting, max(spark.sparkContext.defaultParallelism, waiting // 1000)))
        level += 1
    return spark.read.schema(LISTED).parquet(*[f"{store}/level={i}" for i in range(level + 1)])


def listing_warnings(listing: DataFrame) -> DataFrame:
    """Directories that could not be listed."""
    return listing.filter("kind = 'error'").select("path", "list_error")


def listed_files(
    listing: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
    excluded_path: str | None = None,
) -> DataFrame:
    """Files of a listing that pass the path rules, decided before any is opened."""
    rel = F.col("rel")
    keep: Column = (F.col("kind") == "file") & ~is_artefact(rel) & included(rel, include, exclude)
    if excluded_path:
        keep = keep & ~is_path(F.col("path"), excluded_path)
    return listing.filter(keep).select("path", "rel", "length", "modificationTime")


def _reader(max_bytes: int | None, column: str, carried: tuple[str, ...] = ()):
    def read_many(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("rel", pa.string()), ("length", pa.int64()),
            ("modificationTime", pa.timestamp("us", tz="UTC")), (column, pa.binary()), ("read_error", pa.string()),
            *((name, pa.int64()) for name in carried),
        ])
        pending, held, known = [], 0, {}
        for batch in files:
            for row in batch.to_pylist():
                data = error = None
                try:
                    system, inner = _open(row["path"], known)
                    before = system.get_file_info(inner)
                    if before.type != pafs.FileType.File:
                        raise FileNotFoundError(f"no such file: {row['path']}")
                    # length and time are those at opening, not those of an older listing
                    row |= {"length": before.size, "modificationTime": before.mtime}
                    if max_bytes is None and before.size > ROW_BYTES:
                        raise ValueError(f"{before.size} bytes are more than one row can hold")
                    with system.open_input_file(inner) as f:
                        data = f.read(max_bytes) if max_bytes is not None else f.read()
                    after = system.get_file_info(inner)
                    whole = before.size if max_bytes is None else min(before.size, max_bytes)
                    if (after.size, after.mtime) != (before.size, before.mtime) or len(data) != whole:
                        raise ValueError(CHANGED)
                except (OSError, ValueError) as e:
                    data, error = None, str(e)
                if pending and (held + len(data or b"") > READ_BATCH_BYTES or len(pending) >= 4096):
                    yield pa.RecordBatch.from_pylist(pending, schema=schema)
                    pending, held = [], 0
                pending.append({**row, column: data, "read_error": error})
                held += len(data or b"")
        if pending:
            yield pa.RecordBatch.from_pylist(pending, schema=schema)

    return read_many


def read_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Listed files with their ``content``, or with a ``sample`` of their first ``max_bytes``.

    A file that cannot be read, or that changes meanwhile, keeps its row and says so in ``read_error``. A sample never bears
    the name of a content, so it cannot be converted or backed up as one. The files are dealt out evenly first: a listing has
    one partition per batch of directories, and one directory may hold most files.
    """
    rows = files.select("path", "rel", "length", "modificationTime")
    spread = rows.repartition(_slices(rows, max_bytes))
    column = "content" if max_bytes is None else "sample"
    return spread.mapInArrow(_reader(max_bytes, column), READ.format(column))


def read_samples(files: DataFrame, sample_bytes: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Samples of (path, rel, length, modificationTime) rows where they are; also for streams. ``carried`` names bigint columns to keep."""
    schema = READ.format("sample") + "".join(f", {name} bigint" for name in carried)
    return files.select("path", "rel", "length", "modificationTime", *carried).mapInArrow(_reader(sample_bytes, "sample", carried), schema)


def _slices(files: DataFrame, max_bytes: int | None) -> int:
    """Tasks for a read: about 128 MB and at most 20,000 files each."""
    size = F.col("length") if max_bytes is None else F.least(F.col("length"), F.lit(max_bytes))
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return max(files.sparkSession.sparkContext.defaultParallelism, total // SLICE_BYTES, n // SLICE_FILES)


def scan_prefixes(
    spark: SparkSession, base: str, recursive: bool = True, include: list[str] | None = None,
    exclude: list[str] | None = None, excluded_path: str | None = None, sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """(path, rel, length, modificationTime, sample, read_error) with at most ``sample_bytes`` per file."""
    if sample_bytes <= 0:
        raise ValueError("sample_bytes must be positive")
    listing = list_tree(spark, base, recursive)
    return read_files(listed_files(listing, include, exclude, excluded_path), sample_bytes)


def scan_files(
    spark: SparkSession, base: str, recursive: bool = True, include: list[str] | None = None,
    exclude: list[str] | None = None, excluded_path: str | None = None,
) -> DataFrame:
    """Like ``scan_prefixes``, with the whole ``content``."""
    listing = list_tree(spark, base, recursive)
    return read_files(listed_files(listing, include, exclude, excluded_path))


def reachable(base: str) -> bool:
    """Whether tasks can open the store of ``base``; some stores only Spark's own readers reach."""
    try:
        _open(base)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def qualified(spark: SparkSession, base: str) -> str:
    """The path as Spark's file sources write it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def list_binary_files(spark: SparkSession, base: str, recursive: bool = True) -> DataFrame:
    """(path, rel, length, modificationTime) of the files Spark's own reader finds: neither empty nor hidden ones.

    Spark lists on the driver, which then holds every path; here no process does. As with Spark, a directory that cannot be listed
    ends the job.
    """
    listing = list_tree(spark, qualified(spark, base), recursive, as_spark=True)
    failed = listing_warnings(listing).first()
    if failed:
        raise OSError(f"cannot list {failed.path}: {failed.list_error}")
    return listing.filter("kind = 'file' and length > 0").select("path", "rel", "length", "modificationTime")


def scan_binary_files(spark: SparkSession, base: str, recursive: bool = True) -> DataFrame:
    """The rows of Spark's own reader, for trees without empty or hidden files: (path, modificationTime, length, content).

    The listing is spread and stored; a file that cannot be read ends the job. Where only Spark reaches the store its reader is
    taken, and then the driver holds all paths.
    """
    if not reachable(qualified(spark, base)):
        return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(base)
    failed = F.raise_error(F.concat("path", F.lit(": "), "read_error")).cast("binary")
    return read_files(list_binary_files(spark, base, recursive)).select(
        "path", F.date_trunc("millisecond", "modificationTime").alias("modificationTime"), "length",
        F.when(F.col("read_error").isNull(), F.col("content")).otherwise(failed).alias("content"))
