"""Vectors in binary matrices: a data source that reads byte ranges of files, and its writer.

A store is a folder of `.npy` files, each a matrix of the vectors of consecutive ids, with `manifest.json`, which names the
files that count. A plain `.npy` file reads as a store of one file. The reader plans from the headers alone, so a file of any
size is read by as many tasks as it has ranges; a task holds a batch of rows. Paths may have any scheme that pyarrow knows.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "vector_files"
SCHEMA = "node_id long, vec array<float>"
MANIFEST = "manifest.json"
TASK_BYTES = 64 << 20
BATCH_BYTES = 4 << 20


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Matrix:
    """A file of a store: ids first, first + 1, ... with one row each, from byte `start` on."""

    name: str
    first: int
    rows: int
    dim: int
    dtype: str
    start: int


def matrix_of(fs: pyarrow.fs.FileSystem, name: str, first: int = 0) -> Matrix:
    """The matrix whose header a file has. A file that isn't as long as its header says is an error."""
    with fs.open_input_file(name) as f:
        size = f.size()
        head = io.BytesIO(f.read(1 << 16))
    try:
        read = {1: np.lib.format.read_array_header_1_0, 2: np.lib.format.read_array_header_2_0}[np.lib.format.read_magic(head)[0]]
        shape, by_columns, dtype = read(head)
    except (KeyError, ValueError) as e:
        raise ValueError(f"{name} has no header of a matrix: {e}") from e
    if len(shape) != 2 or by_columns or dtype.kind != "f":
        raise ValueError(f"{name} holds {dtype} of shape {shape}; rows of floats are needed")
    start = head.tell()
    if size != start + shape[0] * shape[1] * dtype.itemsize:
        raise ValueError(f"{name} has {size} bytes, which is not what its header says")
    return Matrix(name, first, shape[0], shape[1], dtype.str, start)


def header(rows: int, dim: int) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (rows, dim)})
    return out.getvalue()


def manifest_of(fs: pyarrow.fs.FileSystem, root: str) -> dict | None:
    """The manifest of a folder, or None where there is none."""
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def matrices(fs: pyarrow.fs.FileSystem, root: str) -> list[Matrix]:
    """The files of a store in the order of their ids."""
    if fs.get_file_info(root).type == pyarrow.fs.FileType.File:
        return [matrix_of(fs, root)]
    kept = manifest_of(fs, root)
    if kept is None:
        raise ValueError(f"{root} is no matrix and has no {MANIFEST}")
    found = []
    for name, first, rows in kept["files"]:
        m = Matrix(f"{root}/{name}", first, rows, kept["dim"], "<f4", len(header(rows, kept["dim"])))
        found.append(m)
    return found


@dataclass
class Range(InputPartition):
    """Rows [at, stop) of a matrix."""

    matrix: Matrix
    at: int
    stop: int


class RangeReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int, least: int, most: int | None):
        self.path, self.task_bytes, self.least, self.most = path, task_bytes, least, most

    def partitions(self) -> list[Range]:
        fs, root = file_system(self.path)
        found = []
        for m in matrices(fs, root):
            step = max(1, self.task_bytes // max(1, m.dim * np.dtype(m.dtype).itemsize))
            at, stop = max(0, self.least - m.first), m.rows if self.most is None else min(m.rows, self.most + 1 - m.first)
            found += [Range(m, i, min(i + step, stop)) for i in range(at, stop, step)]
        return found or [Range(Matrix("", 0, 0, 0, "<f4", 0), 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        m, at = partition.matrix, partition.at
        if at >= partition.stop:
            return
        fs, _ = file_system(self.path)
        width = m.dim * np.dtype(m.dtype).itemsize
        step = max(1, BATCH_BYTES // max(1, width))
        with fs.open_input_file(m.name) as f:
            f.seek(m.start + at * width)
            while at < partition.stop:
                n = min(step, partition.stop - at)
                data = f.read(n * width)
                if len(data) != n * width:
                    raise ValueError(f"{m.name} ends before row {at + n}")
                values = pa.array(np.frombuffer(data, m.dtype).astype(np.float32))
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.dim), values)
                ids = pa.array(np.arange(m.first + at, m.first + at + n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids, vec], names=["node_id", "vec"])
                at += n


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]


class MatrixWriter(DataSourceArrowWriter):
    """Each task writes whole files under names of its own; the manifest, written last, names those of the tasks that count,
    so a task that runs again leaves no trace in the store."""

    def __init__(self, path: str, rows: int, dim: int, rows_per_file: int):
        self.path, self.rows, self.dim, self.rows_per_file = path, rows, dim, rows_per_file

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files, out, due, end = [], None, -1, -1
        for batch in iterator:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(ids), self.dim)
            at = 0
            while at < len(ids):
                if out is None:
                    due = int(ids[at])
                    end = min(due + self.rows_per_file, self.rows)
                    if due % self.rows_per_file or due >= self.rows:
                        raise ValueError(f"ids are not 0 to {self.rows - 1}: a file would begin with {due}")
                    name = f"{due:015d}-{uuid.uuid4().hex}.npy"
                    files.append((name, due, end - due))
                    out = fs.open_output_stream(f"{root}/{name}")
                    out.write(header(end - due, self.dim))
                n = min(len(ids) - at, end - due)
                if not np.array_equal(ids[at : at + n], np.arange(due, due + n)):
                    raise ValueError(f"ids are not 0 to {self.rows - 1}, each once: see those from {due} on")
                out.write(flat[at : at + n].tobytes())
                at, due = at + n, due + n
                if due == end:
                    out.close()
                    out = None
        if out is not None:
            out.close()
            raise ValueError(f"ids are not 0 to {self.rows - 1}: {due} is missing")
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        due = 0
        for _, first, rows in files:
            if first != due:
                raise ValueError(f"ids {due} to {first - 1} are missing or repeated")
            due += rows
        if due != self.rows:
            raise ValueError(f"ids {due} to {self.rows - 1} are missing")
        before = manifest_of(fs, root)
        new = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as f:
            f.write(json.dumps({"dim": self.dim, "files": files}).encode())
        fs.move(new, f"{root}/{MANIFEST}")
        for name, _, _ in (before or {"files": []})["files"]:
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            for name, _, _ in m.files if m else []:
                fs.delete_file(f"{root}/{name}")


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        o = self.options
        return RangeReader(o["path"], int(o.get("task_bytes", TASK_BYTES)), int(o.get("least", 0)), int(o["most"]) if "most" in o else None)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        if not overwrite:
            raise ValueError("a store of vectors is written whole: use mode overwrite")
        return MatrixWriter(*(self.options["path"], *(int(self.options[k]) for k in ("rows", "dim", "rows_per_file"))))


def read_vectors(spark: SparkSession, path: str, least: int = 0, most: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(node_id, vec) of a store or a `.npy` file. Only the bytes of ids from least to most are read. Files of 2, 4 and 8 byte
    floats give floats. A header that doesn't fit its file, or a folder without a manifest, is an error; an empty store has no rows."""
    spark.dataSource.register(VectorFiles)
    made = spark.read.format(FORMAT).option("path", path).option("least", least).option("task_bytes", task_bytes)
    return (made if most is None else made.option("most", most)).load()


def write_vectors(vectors: DataFrame, path: str, rows_per_file: int = 1 << 18) -> None:
    """Write (node_id, vec) as a store; the ids must be 0, 1, ... without gaps or repeats, all vectors of one length, and no
    component null. Else it fails, and the store before stays. Other columns are left out. A file's rows are one task's
    work, so its size bounds the task; no row passes the driver."""
    spark = vectors.sparkSession
    spark.dataSource.register(VectorFiles)
    v = vectors.select(F.col("node_id").cast("long").alias("node_id"), F.col("vec").cast("array<float>").alias("vec"))
    faulty = F.col("node_id").isNull() | F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull())
    s = v.agg(F.count("*").alias("rows"), F.coalesce(F.count_if(faulty), F.lit(0)).alias("faulty"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if s.faulty or s.least != s.most:
        raise ValueError(f"{s.faulty} rows have no id or no whole vector; vectors have {s.least} to {s.most} components")
    files = -(-s.rows // rows_per_file)
    block = F.floor(F.col("node_id") / rows_per_file)
    placed = v.repartition(max(1, files), block).sortWithinPartitions("node_id")
    options = {"path": path, "rows": s.rows, "dim": s.least or 0, "rows_per_file": rows_per_file}
    placed.write.format(FORMAT).options(**options).mode("overwrite").save()
