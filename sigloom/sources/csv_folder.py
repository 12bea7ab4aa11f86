"""Folders of CSV files that differ in their headers, as a Python data source.

Every file has a header of its own, whose names are trimmed and lower-cased and by which its cells are mapped; files may
order, quote and choose their columns as they like. All cells are text, empty ones NULL. Neighbouring files share a
partition up to `partition_bytes`; a file is streamed, so its size does not matter. The folder is listed once, on the
driver, through pyarrow's file systems.

A file without one of the required columns is left out (missing="skip") or an error that names it (missing="fail").
csv_report() says which files were left out, and why. A row shorter than the header is filled with NULL, blank lines are
left out, a row with more filled cells than the header is an error, as its columns can't be told.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS = 10_000
REPORT = "file string, rows long, missing array<string>"


class CsvFiles(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def file_name(path: str) -> str:
    """The name of a file without its ending, in upper case."""
    return path.rsplit("/", 1)[-1].removesuffix(".csv").upper()


class CsvFolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str], report: bool):
        self.path = options["path"]
        self.columns = json.loads(options["columns"])
        self.required = json.loads(options["required"])
        self.named = options.get("from_name") or None
        self.fail = options.get("missing") == "fail"
        self.partition_bytes = int(options["partition_bytes"])
        self.report = report

    def partitions(self) -> list[CsvFiles]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(root if files.get_file_info(root).is_file else fs.FileSelector(root, allow_not_found=False))
        found = sorted((f for f in ([found] if isinstance(found, fs.FileInfo) else found) if f.is_file and f.path.endswith(".csv")), key=lambda f: f.path)
        if not found:
            raise FileNotFoundError(f"no CSV files in {self.path}")
        out: list[list[str]] = []
        held = self.partition_bytes
        for f in found:
            if held + f.size > self.partition_bytes:
                out.append([])
                held = 0
            out[-1].append(f.path)
            held += f.size
        return [CsvFiles(paths) for paths in out]

    def read(self, partition: CsvFiles) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with files.open_input_stream(path, compression=None) as raw:
                rows = csv.reader(io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8-sig", errors="replace", newline=""), skipinitialspace=True)
                header = [c.strip().lower() for c in next(rows, [])]
                missing = [c for c in self.required if c not in header]
                if self.report:
                    n = sum(1 for row in rows if any(row))
                    yield pa.RecordBatch.from_pylist([{"file": file_name(path), "rows": n, "missing": missing}], schema=pa.schema([("file", pa.string()), ("rows", pa.int64()), ("missing", pa.list_(pa.string()))]))
                elif not missing:
                    yield from self._batches(path, header, rows)
                elif self.fail:
                    raise ValueError(f"{path}: missing columns: {missing}")

    def _batches(self, path: str, header: list[str], rows: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        place = {c: header.index(c) for c in self.columns if c in header}
        held: list[list[str]] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([file_name(path)] * len(held))]
            for c in self.columns:
                if c in place:
                    at = place[c]
                    columns.append(pa.array([(row[at].strip() or None) if at < len(row) else None for row in held], pa.string()))
                else:
                    columns.append(columns[0] if c == self.named else pa.nulls(len(held), pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=["file", *self.columns])

        for row in rows:
            if not any(row):
                continue
            if len(row) > len(header) and any(row[len(header) :]):
                raise ValueError(f"{path}: a row with {len(row)} cells under {len(header)} names: {row[:3]}")
            held.append(row)
            if len(held) >= BATCH_ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class CsvFolder(DataSource):
    """Rows of all files: file, and the columns asked for."""

    @classmethod
    def name(cls) -> str:
        return "sigloom_csv_folder"

    def schema(self) -> str:
        return "file string, " + ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> CsvFolderReader:
        return CsvFolderReader(dict(self.options), report=False)


class CsvFolderReport(CsvFolder):
    """A row per file."""

    @classmethod
    def name(cls) -> str:
        return "sigloom_csv_report"

    def schema(self) -> str:
        return REPORT

    def reader(self, schema) -> CsvFolderReader:
        return CsvFolderReader(dict(self.options), report=True)


def _load(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


def csv_folder(spark: SparkSession, path: str, columns: list[str], required: tuple[str, ...] = (), missing: str = "skip", from_name: str | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    """file and the columns as text, from all files at path (a folder or a file); a column that a file lacks is NULL.

    from_name: a column that files without it take from their name.
    """
    return _load(spark, CsvFolder, path, columns=json.dumps(columns), required=json.dumps(list(required)), missing=missing, from_name=from_name or "", partition_bytes=str(partition_bytes))


def csv_report(spark: SparkSession, path: str, required: tuple[str, ...], partition_bytes: int = 64 << 20) -> DataFrame:
    """file, rows, missing (required columns that it lacks) and left_out, for each file."""
    df = _load(spark, CsvFolderReport, path, columns="[]", required=json.dumps(list(required)), partition_bytes=str(partition_bytes))
    return df.withColumn("left_out", F.size("missing") > 0)
