"""CSV files as a Spark data source: a partition for every file, records instead of lines.

A quoted field may hold line breaks, so a file cannot be cut where it is convenient; each is read
as a stream by one task, record by record, in the memory of one batch.  Files of a table that should
be read by more tasks are written as more files.  Files are opened through their own file system
(``pyarrow.fs``), on the executors.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.network import SITE_FILE
from .durable import children

# The source travels by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SITE_LINE = "site_line"
#: Records of a batch, and its characters, about.
BATCH_ROWS, BATCH_CHARS = 10_000, 8 << 20


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def records(path: str, quote: str = '"') -> Iterator[list[str]]:
    """The records of one file; a doubled quote inside quotes is a quote."""
    csv.field_size_limit(sys.maxsize)
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place) as raw:
        text = io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8-sig", newline="")
        yield from csv.reader(text, quotechar=quote)


class RecordReader(DataSourceReader):
    def __init__(self, files: Sequence[str], names: Sequence[str], headers: bool):
        self.files, self.names, self.headers = list(files), list(names), headers

    def partitions(self) -> Sequence[InputPartition]:
        return [FilePartition(f) for f in self.files]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        rows = records(partition.path)
        header = next(rows, [])
        if self.headers:
            if header:
                yield pa.record_batch({"path": [partition.path], "header": [header]})
            return
        at = [header.index(n) if n in header else None for n in self.names]
        batch: list[list[str | None]] = []
        size, first = 0, 1
        for row in rows:
            if not row:  # an empty line is no record
                continue
            if len(row) > len(header):
                raise ValueError(f"record {first + len(batch)} of {partition.path} has {len(row)} fields")
            row += [""] * (len(header) - len(row))
            batch.append([(row[i] or None) if i is not None else None for i in at])
            size += sum(map(len, row))
            if len(batch) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield self._batch(partition.path, first, batch)
                first, batch, size = first + len(batch), [], 0
        if batch:
            yield self._batch(partition.path, first, batch)

    def _batch(self, path: str, first: int, rows: list[list[str | None]]) -> pa.RecordBatch:
        columns = {n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(self.names)}
        columns[SITE_FILE] = pa.array([path] * len(rows), pa.string())
        columns[SITE_LINE] = pa.array(range(first, first + len(rows)), pa.int64())
        return pa.record_batch(columns)


class RecordFiles(DataSource):
    """Options: files and names (JSON lists), headers (true: one row per file, with its header)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        if self.options.get("headers") == "true":
            return "path string, header array<string>"
        fields = [f"`{n}` string" for n in json.loads(self.options["names"])]
        return ", ".join([*fields, f"{SITE_FILE} string", f"{SITE_LINE} long"])

    def reader(self, schema) -> DataSourceReader:
        files, names = (json.loads(self.options[o]) for o in ("files", "names"))
        return RecordReader(files, names, self.options.get("headers") == "true")


def csv_files(spark: SparkSession, pattern: str) -> list[str]:
    """Non-hidden ``.csv`` files in the folders that match ``pattern``, or that match it themselves."""
    found = children(spark, f"{pattern}/*.csv") + [p for p in children(spark, pattern) if p.endswith(".csv")]
    return sorted(p for p in found if not Path(p).name.startswith((".", "_")))


def record_files(
    spark: SparkSession, files: Sequence[str], names: Sequence[str], headers: bool = False
) -> DataFrame:
    spark.dataSource.register(RecordFiles)
    options = {"files": json.dumps(list(files)), "names": json.dumps(list(names)), "headers": str(headers).lower()}
    return spark.read.format("record_files").options(**options).load()
