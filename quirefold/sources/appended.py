"""A CSV data set that grows by appends and has one header: a data source with job commits.

Tasks write parts without header below ``_staging``, under names of their own, so that a failed or repeated attempt harms
nothing. The commit of a job writes one small record that names its parts, in order of partitions, and then moves them to
their places; a part that no record names does not exist for readers. `recover` moves what a commit that was interrupted
has left. Files sort by job and partition after the one with the header, so the data set's files one after the other are
one CSV file. One driver appends at a time.

Defined results: an append without rows is a record without parts; columns are the first append's, in its order, others
are an error; nulls are empty fields; nested columns are an error (make texts of them); quotes, separators and line ends
within values are quoted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quirefold.sources.shared import ship

STAGING, RECORDS, HEADER = "_staging", "_records", "00000000-header.csv"


@dataclass
class Part(WriterCommitMessage):
    """A part that a task has written; None if it had no rows."""

    partition: int
    name: str | None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    system, where = fs.FileSystem.from_uri(path)
    return system, where.rstrip("/")


def _names(system: fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File)


def _records(system: fs.FileSystem, where: str) -> list[dict]:
    out = []
    for name in _names(system, f"{where}/{RECORDS}"):
        if name.endswith(".json"):
            with system.open_input_stream(f"{where}/{RECORDS}/{name}") as f:
                out.append(json.loads(f.read()))
    return out


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """All of the file or nothing of it is seen."""
    with system.open_output_stream(f"{path}.new") as f:
        f.write(data)
    system.move(f"{path}.new", path)


def _line(values: list[str]) -> bytes:
    table = pa.table({str(i): [v] for i, v in enumerate(values)})
    out = pa.BufferOutputStream()
    pc.write_csv(table, out, pc.WriteOptions(include_header=False, quoting_style="needed"))
    return out.getvalue().to_pybytes()


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.columns, self.job, self.overwrite = path, columns, uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, where = opened(self.path)
        partition, name, out = task.partitionId() if task else 0, None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(f"{where}/{STAGING}/{self.job}", recursive=True)
                name = f"{partition:08d}-{uuid.uuid4().hex}.csv"
                out = system.open_output_stream(f"{where}/{STAGING}/{self.job}/{name}")
            pc.write_csv(pa.Table.from_batches([batch]), out, pc.WriteOptions(include_header=False, quoting_style="needed"))
        if out is not None:
            out.close()
        return Part(partition, name)

    def commit(self, messages: list[Part | None]) -> None:
        system, where = opened(self.path)
        if self.overwrite and system.get_file_info(where).type != fs.FileType.NotFound:
            for name in (HEADER, *(n for r in _records(system, where) for n in r["parts"].values())):
                if system.get_file_info(f"{where}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{where}/{name}")
            if system.get_file_info(f"{where}/{RECORDS}").type == fs.FileType.Directory:
                system.delete_dir(f"{where}/{RECORDS}")
        system.create_dir(f"{where}/{RECORDS}", recursive=True)
        header = _line(self.columns)
        if system.get_file_info(f"{where}/{HEADER}").type == fs.FileType.NotFound:
            _put(system, f"{where}/{HEADER}", header)
        else:
            with system.open_input_stream(f"{where}/{HEADER}") as f:
                if f.read() != header:
                    raise ValueError("the data set has other columns")
        number = 1 + max((r["number"] for r in _records(system, where)), default=0)
        parts = sorted((m.partition, m.name) for m in messages if m is not None and m.name)
        record = {"number": number, "job": self.job, "parts": {name: f"{number:08d}-{k:08d}.csv" for k, (_, name) in enumerate(parts)}}
        _put(system, f"{where}/{RECORDS}/{number:08d}.json", json.dumps(record).encode())
        recover(self.path)

    def abort(self, messages: list[Part | None]) -> None:
        system, where = opened(self.path)
        if system.get_file_info(f"{where}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{where}/{STAGING}/{self.job}")


class AppendedCsv(DataSource):
    """``df.write.format("appended_csv").mode("append").save(path)``, after `register`."""

    @classmethod
    def name(cls) -> str:
        return "appended_csv"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(AppendedCsv)


def append(df: DataFrame, path: str) -> None:
    """Add df's rows to the data set at path, all of them or none."""
    register(df.sparkSession)
    df.write.format("appended_csv").mode("append").save(path)


def recover(path: str) -> None:
    """Move the parts of committed jobs that are still staged."""
    system, where = opened(path)
    for r in _records(system, where):
        staged = f"{where}/{STAGING}/{r['job']}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            for name in _names(system, staged):
                if name in r["parts"]:
                    system.move(f"{staged}/{name}", f"{where}/{r['parts'][name]}")
            system.delete_dir(staged)


def files(path: str) -> list[str]:
    """The data set's files in order, that of the header first; those of no commit are not among them."""
    system, where = opened(path)
    recover(path)
    named = sorted(n for r in _records(system, where) for n in r["parts"].values())
    return [f"{path.rstrip('/')}/{n}" for n in ([HEADER] if named or _names(system, f"{where}/{RECORDS}") else []) + named]


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The data set's rows; they are read by Spark, file by file."""
    parts = files(path)[1:]
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(parts, header=False, multiLine=True, escape='"') if parts else empty
