"""Packed float32 vectors: little-endian rows of one length, in the order of ``embedding_row``.

Row ``i`` lies at byte ``4 * dim * i``, so a pack is read in byte ranges by many tasks, each of which knows its first
row from its offset.  A pack is one file, or a folder of ``part-<first row>.f32`` files that follow one another.

A pack is written by range partitions of ``embedding_row``; each task streams its rows to a file of its own.  The
commit sees that the files' ranges follow one another from row 0 without a gap, gives them their names and puts the
pack in place in one step; a task that was killed or ran twice leaves nothing in it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.contracts import ContractError
from .run_folders import store_of

RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20
ROWS_PER_FILE = 1 << 20
PART = re.compile(r"part-(\d+)\.f32$")


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    rows: int
    first: int


class PackReader(DataSourceReader):
    def __init__(self, path: str, dim: int, range_bytes: int):
        self.path, self.dim, self.rows = path, dim, max(1, range_bytes // (4 * dim))

    def _files(self) -> list[tuple[str, int, int]]:
        """Path, first row and size of each file."""
        store, path = store_of(self.path)
        info = store.get_file_info(path)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pa.fs.FileType.File:
            return [(path, 0, info.size)]
        found = [(f.path, PART.search(f.path), f.size) for f in store.get_file_info(pa.fs.FileSelector(path)) if f.is_file]
        return sorted(((p, int(m.group(1)), n) for p, m, n in found if m), key=lambda f: f[1])

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        upto = 0
        for path, first, size in self._files():
            rows, rest = divmod(size, 4 * self.dim)
            if rest:
                raise ContractError(f"{path} has {size} bytes, which are no rows of {self.dim} float32 values")
            if first != upto:
                raise ContractError(f"{path} begins at row {first}, not at {upto}")
            out += [Range(path, k, min(self.rows, rows - k), first + k) for k in range(0, rows, self.rows)]
            upto = first + rows
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, width = store_of(self.path)[0], 4 * self.dim
        step = max(1, READ_BYTES // width)
        with store.open_input_file(partition.path) as file:
            for k in range(0, partition.rows, step):
                n = min(step, partition.rows - k)
                raw = file.read_at(n * width, (partition.begin + k) * width)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * self.dim)
                values = pa.array(np.frombuffer(raw, "<f4"))
                rows = pa.array(np.arange(partition.first + k, partition.first + k + n))
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(ends, values)], ["embedding_row", "embedding"])


@dataclass
class Wrote(WriterCommitMessage):
    files: list[tuple[str, int, int]]


class PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dim: int):
        self.path, self.dim = path, dim
        self.staging = f"{path}._staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        store, staging = store_of(self.staging)
        store.create_dir(staging, recursive=True)
        name, first, upto, out = f"{staging}/{uuid.uuid4().hex}", 0, None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            rows, vectors = batch.column("embedding_row").to_numpy(), batch.column("embedding")
            if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != self.dim).any():
                raise ContractError(f"a vector is null or has not {self.dim} values")
            values = vectors.flatten()
            if values.null_count:
                raise ContractError("a vector holds a null")
            if out is None:
                first = upto = int(rows[0])
                out = store.open_output_stream(name)
            if (rows != np.arange(upto, upto + len(rows))).any():
                raise ContractError(f"embedding rows repeat or leave a gap behind {upto}")
            out.write(values.to_numpy().astype("<f4").tobytes())
            upto += len(rows)
        if out is None:
            return Wrote([])
        out.close()
        return Wrote([(name, first, upto - first)])

    def commit(self, messages: list[Wrote | None]) -> None:
        store, staging = store_of(self.staging)
        final = store_of(self.path)[1]
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        starts = np.cumsum([0, *(n for _, _, n in files)]).tolist()
        if [f[1] for f in files] != starts[:-1]:
            self.abort(messages)
            raise ContractError("embedding rows don't follow one another from 0")
        if len(files) <= 1:  # one file is the pack itself
            store.create_dir(staging, recursive=True)
            if not files:
                store.open_output_stream(f"{staging}/empty").close()
            store.move(files[0][0] if files else f"{staging}/empty", final)
        else:
            draft = f"{staging}/pack"
            store.create_dir(draft, recursive=True)
            for name, first, _ in files:
                store.move(name, f"{draft}/part-{first:015d}.f32")
            store.move(draft, final)
        store.delete_dir(staging)

    def abort(self, messages: list[Wrote | None]) -> None:
        store, staging = store_of(self.staging)
        if store.get_file_info(staging).type != pa.fs.FileType.NotFound:
            store.delete_dir(staging)


class VectorPacks(DataSource):
    """Options ``path``, ``dim`` and, for reading, ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "sensorframe_vectors"

    def schema(self) -> str:
        return "embedding_row bigint, embedding array<float>"

    def reader(self, schema) -> PackReader:
        return PackReader(self.options["path"], int(self.options["dim"]), int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], int(self.options["dim"]))


def read_vectors(spark: SparkSession, path: str, dim: int, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``embedding_row, embedding`` of a pack."""
    if dim < 1:
        raise ValueError(f"dim {dim}: want 1 or more")
    spark.dataSource.register(VectorPacks)
    return spark.read.format(VectorPacks.name()).option("dim", dim).option("range_bytes", range_bytes).load(path)


def write_vectors(vectors: DataFrame, path: str, dim: int, *, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``embedding_row, embedding`` of one run, whose rows count from 0, as a pack at ``path``.

    Up to ``rows_per_file`` rows are one file, more are a folder.  A path that exists is refused.
    """
    spark = vectors.sparkSession
    spark.dataSource.register(VectorPacks)
    store, place = store_of(path)
    if store.get_file_info(place).type != pa.fs.FileType.NotFound:
        raise FileExistsError(path)
    rows = vectors.select(F.col("embedding_row").cast("long"), F.col("embedding").cast("array<float>"))
    files = max(1, -(-rows.count() // rows_per_file))
    laid = rows.repartitionByRange(files, "embedding_row").sortWithinPartitions("embedding_row") if files > 1 else rows.coalesce(1).sortWithinPartitions("embedding_row")
    laid.write.format(VectorPacks.name()).option("dim", dim).mode("append").save(path)
