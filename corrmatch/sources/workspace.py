"""The files of a folder, hidden ones included, as a table.

``spark.read.format("workspace")`` lists names: the driver looks at the two upper levels of
folders, and a task lists each folder below.  ``scan`` numbers the names in order and reads
the contents where the numbered names are, so contents are not shuffled.  The folder must be
one that driver and executors reach.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Exclusions
from ..functions import charsets, globs, text
from ..operators.lineage import numbered

NAMES = "filename string, relative_dir string, full_path string"
FILES = f"ord long, {NAMES}, size long, mtime string, content binary"
#: Bytes of contents that a task holds at a time, about.
BATCH = 16 << 20


class _Part(InputPartition):
    def __init__(self, folder: str, below: bool):
        self.folder, self.below = folder, below


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.normpath(options.get("path", ""))
        if not os.path.isdir(self.root):
            raise ValueError(f"Directory not found: {self.root}")

    def partitions(self) -> list[InputPartition]:
        upper = [self.root, *_subfolders(self.root)]
        return [*[_Part(f, False) for f in upper], *[_Part(g, True) for f in upper[1:] for g in _subfolders(f)]]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for folder, _, names in os.walk(partition.folder):
            inner = os.path.relpath(folder, self.root).replace(os.sep, "/")
            for name in names:
                yield name, "" if inner == "." else inner, os.path.join(folder, name)
            if not partition.below:
                break


def _subfolders(folder: str) -> list[str]:
    try:
        with os.scandir(folder) as found:
            return sorted(e.path for e in found if e.is_dir() and not e.is_symlink())
    except OSError:
        return []


class WorkspaceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return NAMES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered names with size, time of change and bytes; all null where a file cannot be read."""
    kinds = {"size": pa.int64(), "mtime": pa.string(), "content": pa.binary()}

    def row(path: str) -> tuple:
        try:
            about = os.stat(path)
            with open(path, "rb") as f:
                return about.st_size, datetime.fromtimestamp(about.st_mtime).strftime("%Y-%m-%d %H:%M:%S"), f.read()
        except OSError:  # listed all the same
            return None, None, None

    for batch in batches:
        at, rows, held = 0, [], 0
        paths = batch.column(batch.schema.get_field_index("full_path")).to_pylist()
        for i, path in enumerate(paths, 1):
            rows.append(row(path))
            held += rows[-1][0] or 0
            if held >= BATCH or i == len(paths):
                part = batch.slice(at, i - at)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())]], [*part.schema.names, *kinds])
                at, rows, held = i, [], 0


def scan(spark: SparkSession, root: str, side: str, exclusions: Exclusions = Exclusions(), charset: str = "auto", ignore_case: bool = False) -> DataFrame:
    """The files of a workspace and the two folder aliases, which are ignored.

    ``ord`` numbers a side's files by path: the order in which files choose partners.
    """
    spark.dataSource.register(WorkspaceSource)
    names = spark.read.format("workspace").option("path", root).load()
    names = numbered(names.withColumn("path", text.relative_path(F.col("relative_dir"), F.col("filename"))), "ord", "path")
    names = names.select("ord", *[c.split()[0] for c in NAMES.split(", ")]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ord")
    files = names.mapInArrow(_contents, FILES)
    files = files.withColumn("sniff", charsets.inspect("content", F.lit(charset)))
    reason = globs.reasons(F.col("filename"), F.col("relative_dir"), exclusions.files, exclusions.dirs, ignore_case)
    binary = F.col("sniff.is_binary")
    rows = files.select(
        "ord", "filename", "relative_dir", "full_path", text.extension(F.col("filename")).alias("extension"), "size", "mtime",
        binary.alias("is_binary"), F.col("sniff.text_encoding").alias("text_encoding"), (reason != "").alias("ignored"), reason.alias("ignored_reason"), "content",
        F.when(~binary, charsets.decode("content", F.lit(charset))).alias("text"),
    )
    root = os.path.normpath(root)
    # The aliases and their reason.
    names = [(-2, ".", root), (-1, "..", os.path.dirname(root))]
    aliases = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(n).alias("filename"), F.lit(p).alias("full_path")) for i, n, p in names])))
    aliases = aliases.withColumns({"relative_dir": F.lit(""), "extension": F.lit(""), "is_binary": F.lit(False), "text_encoding": F.lit(""), "ignored": F.lit(True), "ignored_reason": F.lit("Directory alias (not a file)")})
    rows = rows.unionByName(aliases, allowMissingColumns=True)
    return rows.withColumns({"side": F.lit(side), "relative_path": text.relative_path(F.col("relative_dir"), F.col("filename"))})


def folders(path: str) -> list[str]:
    """The folders that a folder picker shows, by lower-case name."""
    # Names that are not shown.
    hidden = {"node_modules", "__pycache__", "$recycle.bin", "system volume information", "recovery"}
    with os.scandir(path) as found:
        return sorted((e.name for e in found if e.is_dir() and not e.name.startswith(".") and e.name.lower() not in hidden), key=str.lower)
