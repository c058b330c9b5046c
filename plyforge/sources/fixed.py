"""Files of fixed-width records as a data source: ``spark.read.format("position_records")`` and its sink.

A record is 90 bytes of FEN, 13 terms and a score as floats, and 64 piece classes. Files are read in ranges of whole records, as
many ranges as their bytes need, decoded a range of columns at a time. A task writes a draft; the driver renames the drafts of the
attempts that count when all are whole, and takes the others away, so a task that dies or runs twice leaves nothing. All of it goes
through the API of the file system that the path names, on whatever machine a task runs.

Options: ``path`` (a URI, or a path of the local file system); ``limit``, the records of each file that are read;
``range``, the bytes of a range.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RECORD = np.dtype([("fen", "S90"), ("terms", "<f4", 13), ("score", "<f4"), ("labels", "u1", 64)])
SIZE = RECORD.itemsize
SCHEMA = "fen string, terms array<float>, score float, labels array<int>"
#: Bytes of a range, and records of a batch.
RANGE, BATCH = 32 << 20, 10_000


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a path names, and the path there."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pyarrow.fs.LocalFileSystem(), path


def records_of(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the record files under a path; a file that holds a part of a record is an error."""
    fs, folder = place(path)
    found = sorted((f.path, f.size) for f in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.base_name.startswith("part-") and f.base_name.endswith(".bin"))
    for name, size in found:
        if size % SIZE:
            raise ValueError(f"{name}: {size} bytes are no whole number of records of {SIZE} bytes")
    return found


def decoded(data: bytes) -> pa.RecordBatch:
    rows = np.frombuffer(data, RECORD)
    lists = lambda values, n: pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), n)
    fens = pa.array(rows["fen"], pa.binary()).cast(pa.string())
    terms, labels = lists(np.ascontiguousarray(rows["terms"]), 13).cast(pa.list_(pa.float32())), lists(np.ascontiguousarray(rows["labels"]).astype(np.int32), 64).cast(pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([fens, terms, pa.array(np.ascontiguousarray(rows["score"])), labels], names=["fen", "terms", "score", "labels"])


def encoded(fens: list[bytes], terms: np.ndarray, scores: np.ndarray, labels: np.ndarray) -> bytes:
    rows = np.zeros(len(fens), RECORD)
    rows["fen"], rows["terms"], rows["score"], rows["labels"] = np.array(fens, "S90"), terms, scores, labels
    return rows.tobytes()


@dataclass
class Range(InputPartition):
    name: str
    start: int
    bytes: int


class Reader(DataSourceReader):
    def __init__(self, path: str, limit: int | None, range_: int):
        self.path, self.limit, self.range = path, limit, max(SIZE, range_ // SIZE * SIZE)

    def partitions(self):
        step, out = self.range, []
        for name, size in records_of(self.path):
            size = size if self.limit is None else min(size, self.limit * SIZE)
            out += [Range(name, at, min(step, size - at)) for at in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if partition.bytes:
            fs, _ = place(self.path)
            with fs.open_input_file(partition.name) as file:
                for at in range(partition.start, partition.start + partition.bytes, BATCH * SIZE):
                    yield decoded(file.read_at(min(BATCH * SIZE, partition.start + partition.bytes - at), at))


@dataclass
class Written(WriterCommitMessage):
    draft: str
    name: str
    records: int


class Writer(DataSourceArrowWriter):
    """Takes records that are encoded: fen (binary), terms, score, labels."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator):
        task = TaskContext.get()
        fs, folder = place(self.path)
        name = f"part-{task.partitionId():06d}-{self.job}.bin"
        draft, n = f"{folder}/_draft-{self.job}/{task.partitionId():06d}-{task.taskAttemptId()}", 0
        fs.create_dir(f"{folder}/_draft-{self.job}", recursive=True)
        with fs.open_output_stream(draft) as out:
            for batch in iterator:
                lists = lambda c, n: np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(-1, n)  # noqa: B023, E731
                out.write(encoded([f.encode()[:90] for f in batch.column("fen").to_pylist()], lists("terms", 13), batch.column("score").to_numpy(zero_copy_only=False), lists("labels", 64)))
                n += batch.num_rows
        return Written(draft, name, n)

    def _drop_drafts(self) -> None:
        fs, folder = place(self.path)
        if fs.get_file_info(f"{folder}/_draft-{self.job}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{folder}/_draft-{self.job}")

    def commit(self, messages):
        fs, folder = place(self.path)
        old = [name for name, _ in records_of(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.records:
                fs.move(m.draft, f"{folder}/{m.name}")
        for name in old:
            fs.delete_file(name)
        self._drop_drafts()

    def abort(self, messages):
        self._drop_drafts()


class PositionRecords(DataSource):
    @classmethod
    def name(cls):
        return "position_records"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        limit = self.options.get("limit")
        return Reader(self.options["path"], int(limit) if limit else None, int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PositionRecords)
    return spark
