"""What daily files hold, as a Spark data source: one row per file, read where the file is read.

A task opens a few files each and takes their header (CSV) or footer (Parquet); nothing is opened on the driver, which
only lists names. A range of dates is a pushed filter: files outside it become no partition. A file that cannot be used
is a row with its reason.
"""

from __future__ import annotations

import csv
import json
import posixpath
import re
from collections.abc import Iterable, Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from helmtrace.schemas import PING_COLUMNS

#: Stores that tasks open themselves; others (any that only Hadoop knows) need ``daily.file_layouts``.
SCHEMES = ("file", "s3", "s3a", "s3n", "gs", "hdfs")
HEADER_BYTES = 1 << 16
LAYOUT = "file_date date, path string, format string, bytes long, layout string, missing array<string>, problem string"
# The names of daily files.
_NAME = re.compile(r"(?:(?:ais-)?(\d{4})-(\d{2})-(\d{2})|AIS_(\d{4})_(\d{2})_(\d{2}))\.(?:csv|parquet)")


def reachable(folder: str) -> bool:
    """Whether tasks can open files of this folder by themselves."""
    scheme = folder.split(":", 1)[0] if re.match(r"\w+:/", folder) else "file"
    return scheme in SCHEMES


def _opened(folder: str):
    """File system and path of a folder."""
    from pyarrow import fs

    if not re.match(r"\w+:/", folder):
        return fs.LocalFileSystem(), folder
    plain = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", folder))
    return fs.FileSystem.from_uri(plain)


def date_of_name(path: str) -> date | None:
    """The date in a file's name, or in the name of the folder it is a part file of."""
    folder, name = posixpath.split(path)
    for text in (name, posixpath.basename(folder)):
        found = _NAME.fullmatch(text)
        if found:
            try:
                return date(*(int(g) for g in found.groups() if g))
            except ValueError:
                continue
    return None


class _Files(InputPartition):
    def __init__(self, files: list[tuple[date, str, int]]):
        super().__init__(None)
        self.files = files


class LayoutReader(DataSourceReader):
    """Lists dated files below a folder; tasks read what the files say about themselves."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.files_at_once = int(options.get("filesPerPartition", 16))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in"}
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute == ("file_date",):
                continue
            if type(f) in kinds and f.attribute == ("file_date",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def wanted(self, day: date) -> bool:
        """Whether a date passes all pushed filters."""
        checks = {"eq": lambda v: day == v, "gt": lambda v: day > v, "ge": lambda v: day >= v, "lt": lambda v: day < v, "le": lambda v: day <= v, "in": lambda v: day in v}
        return all(checks[kind](value) for kind, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, top = _opened(self.folder)
        found = []
        for info in store.get_file_info(fs.FileSelector(top, recursive=True)):
            name = info.base_name
            if info.type != fs.FileType.File or name.startswith(("_", ".")) or not name.lower().endswith((".csv", ".parquet")):
                continue
            day = date_of_name(info.path)
            if day is not None and self.wanted(day):
                found.append((day, info.path, info.size))
        found.sort()
        return [_Files(found[i : i + self.files_at_once]) for i in range(0, len(found), self.files_at_once)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, top = _opened(self.folder)
        # Names as Spark gives them: below the folder as it was asked for.
        root = self.folder.rstrip("/")
        for day, path, size in partition.files:
            form = "csv" if path.lower().endswith(".csv") else "parquet"
            layout = problem = None
            missing: list[str] = []
            try:
                layout = csv_layout(store, path) if form == "csv" else parquet_layout(store, path)
                missing = [c for c in PING_COLUMNS if c not in layout.names]
            except Exception as broken:  # any damage of one file is that file's report
                problem = f"{type(broken).__name__}: {broken}"[:500]
            yield day, root + path[len(top.rstrip("/")) :], form, size, layout and layout.json(), missing, problem


class DayLayouts(DataSource):
    """``spark.read.format("daily_layouts").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "daily_layouts"

    def schema(self) -> str:
        return LAYOUT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LayoutReader(self.options)


def csv_layout(store, path: str) -> T.StructType:
    """Column names of a CSV file's first line, all text."""
    with store.open_input_stream(path) as stream:
        head = bytes(stream.read(HEADER_BYTES))
    line = head.split(b"\n", 1)[0].decode("utf-8").lstrip("\ufeff").rstrip("\r")
    if not line:
        raise ValueError("no header")
    return T.StructType([T.StructField(c, T.StringType()) for c in next(csv.reader([line]))])


def parquet_layout(store, path: str) -> T.StructType:
    """The columns in a Parquet file's footer: as Spark noted them, else by their types."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    with store.open_input_file(path) as file:
        schema = pq.ParquetFile(file).schema_arrow
    noted = (schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    if noted:
        return T.StructType.fromJson(json.loads(noted))
    plain = [f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in schema]
    return from_arrow_schema(pa.schema(plain))


def file_report(spark: SparkSession, folder: str, start: str | date, end: str | date) -> DataFrame:
    """One row per daily file of an inclusive range: date, path, format, bytes, layout, missing columns and problem.

    ``layout`` is the file's schema as JSON; a file is of use if nothing is missing and ``problem`` is null. A folder without such
    files gives no rows.
    """
    spark.dataSource.register(DayLayouts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("daily_layouts").load(folder)
    return rows.where(F.col("file_date").between(F.to_date(F.lit(str(start))), F.to_date(F.lit(str(end)))))


def usable(report: DataFrame) -> DataFrame:
    """The files of a report that can be read."""
    return report.where(F.col("problem").isNull() & (F.size("missing") == 0))


def refused(report: DataFrame) -> DataFrame:
    """The files of a report that cannot, with the reason in words."""
    lacking = F.concat(F.lit("no "), F.array_join("missing", ", "))
    return report.where(F.col("problem").isNotNull() | (F.size("missing") > 0)).select(
        "file_date", "path", "format", "bytes", F.coalesce("problem", lacking).alias("reason")
    )
