"""Run folders, as other tools exchange them: ``<root>/<run>/events.csv``, ``tracks.csv``, ..., ``run_manifest.json``.

A Python data source writes them.  Rows reach it sorted by run, table and place, so a task streams one file after
another and holds none.  A run's large table is cut into parts of ``rows_per_file`` rows (``events.csv`` is then a folder of
``part-*.csv``), so a run with a third of all rows is written by many tasks.

Nothing is seen before it is whole:

1. tasks write below ``<root>/_staging-<id>``, under names of their own, and list what they wrote with its digest in
   a journal; a task's commit message is the name of its journal;
2. the commit stores the names of the journals that count, so rows of a task that was killed or ran twice don't;
   an abort removes the staging folder;
3. a second job puts each run together: files get their names, the manifest with rows, bytes and digests of every
   file is written, and the folder is moved to its place in one step.  Doing this again changes nothing.

Stores are opened by ``pyarrow.fs`` (a shared mount, HDFS, S3, GCS).  Where a store can't move folders in one step
the manifest comes last, and readers know a run by its manifest.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.contracts import ContractError
from ..operators.sequence import number_rows
from ..schemas import TABLES, conform
from .tables import EXCHANGE, METADATA

ROWS_PER_FILE = 2_000_000
MANIFEST = "run_manifest.json"
LINES = "folder string, name string, part int, line string"
JOURNAL = "folder string, name string, part int, path string, rows bigint, bytes bigint, sha256 string"


def store_of(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pa.fs.FileSystem.from_uri(uri)


@dataclass
class Journal(WriterCommitMessage):
    name: str | None


class _File:
    """One file of one run while it is written."""

    def __init__(self, store: pa.fs.FileSystem, staging: str, key: tuple[str, str, int], header: str):
        self.key, self.path = key, f"{staging}/files/{uuid.uuid4().hex}"
        self.out, self.digest, self.rows, self.bytes = store.open_output_stream(self.path), hashlib.sha256(), 0, 0
        self.put(header + "\n")

    def put(self, text: str) -> None:
        raw = text.encode()
        self.out.write(raw)
        self.digest.update(raw)
        self.bytes += len(raw)

    def done(self) -> dict:
        self.out.close()
        folder, name, part = self.key
        return {"folder": folder, "name": name, "part": part, "path": self.path, "rows": self.rows, "bytes": self.bytes, "sha256": self.digest.hexdigest()}


class RunFolderWriter(DataSourceArrowWriter):
    def __init__(self, staging: str, headers: dict[str, str]):
        self.staging, self.headers = staging, headers

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Journal:
        store, staging = store_of(self.staging)
        now: _File | None = None
        wrote: list[str] = []
        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("folder", "name", "part", "line")]
            lines: list[str] = []
            for folder, name, part, line in zip(*columns, strict=True):
                if now is None or now.key != (folder, name, part):
                    if now is not None:
                        now.put("".join(lines))
                        wrote.append(json.dumps(now.done()))
                    now, lines = _File(store, staging, (folder, name, part), self.headers[name]), []
                lines.append(line + "\n")
                now.rows += 1
            if now is not None:
                now.put("".join(lines))
        if now is None:
            return Journal(None)
        wrote.append(json.dumps(now.done()))
        journal = f"{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{staging}/journals/{journal}") as out:
            out.write("\n".join(wrote).encode())
        return Journal(journal)

    def commit(self, messages: list[Journal | None]) -> None:
        store, staging = store_of(self.staging)
        with store.open_output_stream(f"{staging}/committed.json") as out:
            out.write("\n".join(json.dumps({"journal": m.name}) for m in messages if m and m.name).encode())

    def abort(self, messages: list[Journal | None]) -> None:
        store, staging = store_of(self.staging)
        store.delete_dir(staging)


class RunFolders(DataSource):
    """Write-only source; options ``staging`` and ``headers`` (a JSON object of file names and header lines)."""

    @classmethod
    def name(cls) -> str:
        return "sensorframe_run_folders"

    def schema(self) -> str:
        return LINES

    def writer(self, schema, overwrite: bool) -> RunFolderWriter:
        return RunFolderWriter(self.options["staging"], json.loads(self.options["headers"]))


def folder_of(run_id):
    """Folder names of run ids: characters that paths don't take are written as in URLs."""

    @F.arrow_udf("string")
    def name(ids: pa.Array) -> pa.Array:
        return pa.array([quote(i, safe=" ") for i in ids.to_pylist()], pa.string())

    return F.when(run_id.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"), run_id).otherwise(name(F.coalesce(run_id, F.lit(""))))


def _lines(name: str, df: DataFrame, rows_per_file: int) -> DataFrame:
    """A table's CSV lines in the order of its frames, cut into files."""
    columns = [c for c in EXCHANGE[name] if c != "run_id"]
    out = conform(df, TABLES[name])
    place = F.coalesce("frame_ordinal", "frame_number", F.lit(-1))
    order = [place, *(F.col(c).asc_nulls_first() for c in columns)]
    bucket = F.floor(place / 4096)
    numbered = number_rows(out.withColumn("_n", F.lit(0).cast("long")), ["run_id"], bucket, order, "_n")
    part = ((F.col("_n") - 1) / rows_per_file).cast("int")
    line = F.to_csv(F.struct(*columns), {"quote": '"', "escape": '"', "escapeQuotes": "true", "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return numbered.select("run_id", F.lit(f"{name}.csv").alias("name"), part.alias("part"), "_n", line.alias("line"))


def _existing(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for batch in batches:
            found = [f for f in batch.column("folder").to_pylist() if store.get_file_info(f"{base}/{f}").type != pa.fs.FileType.NotFound]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["folder"])

    return run


def _publish(root: str, staging: str, headers: dict[str, str]):
    """Put runs together and move each to its place; done runs are left alone."""

    def part_name(name: str, part: int, parts: int) -> str:
        return name if parts == 1 else f"{name}/part-{part:05d}.csv"

    def one(store: pa.fs.FileSystem, base: str, below: str, row: dict) -> str:
        final, draft = f"{base}/{row['folder']}", f"{below}/runs/{row['folder']}"

        def there(path: str) -> bool:
            return store.get_file_info(path).type != pa.fs.FileType.NotFound

        if there(f"{final}/{MANIFEST}"):
            with store.open_input_stream(f"{final}/{MANIFEST}") as found:
                if json.loads(found.read()).get("write_id") == row["write_id"]:
                    return row["folder"]
            raise FileExistsError(f"{final} holds a run already")
        files = []
        store.create_dir(draft, recursive=True)
        for name, header in headers.items():
            held = sorted((f for f in row["files"] if f["name"] == name), key=lambda f: f["part"])
            if not held:
                raw = (header + "\n").encode()
                with store.open_output_stream(f"{draft}/{name}") as out:
                    out.write(raw)
                files.append({"name": name, "rows": 0, "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()})
            if len(held) > 1:
                store.create_dir(f"{draft}/{name}", recursive=True)
            for f in held:
                target = part_name(name, f["part"], len(held))
                if there(f["path"]):  # else moved by an earlier try
                    store.move(f["path"], f"{draft}/{target}")
                files.append({"name": target, "rows": f["rows"], "bytes": f["bytes"], "sha256": f["sha256"]})
        document = json.loads(row["document"]) | {"write_id": row["write_id"], "files": files}
        document["artifacts"] = {name.replace(".", "_"): name for name in headers}
        with store.open_output_stream(f"{draft}/{MANIFEST}") as out:
            out.write(json.dumps(document, indent=2).encode())
        store.move(draft, final)
        return row["folder"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        below = store_of(staging)[1]
        for batch in batches:
            done = [one(store, base, below, row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["folder"])

    return run


def write_runs(tables: Mapping[str, DataFrame], manifests: DataFrame, root: str, *, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write a folder per row of ``manifests`` (``run_id`` and any further fields) with its rows of ``tables``.

    Returns the number of runs.  Runs that exist already, rows of runs without a manifest, null and repeated run ids
    are refused before anything is published.
    """
    spark: SparkSession = manifests.sparkSession
    spark.dataSource.register(RunFolders)
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    store, below = store_of(staging)
    for name in ("files", "journals", "runs"):
        store.create_dir(f"{below}/{name}", recursive=True)
    try:
        top = [c for c in manifests.columns if c not in (*METADATA, "metadata")]
        inner = F.struct(*[F.col(c).alias(c) for c in METADATA if c in manifests.columns])
        document = F.to_json(F.struct(*top, inner.alias("metadata")), {"ignoreNullFields": "false"})
        documents = manifests.select("run_id", folder_of(F.col("run_id")).alias("folder"), document.alias("document"), F.lit(staging.rsplit("-", 1)[1]).alias("write_id"))
        wrong = documents.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1 OR run_id IS NULL OR run_id = ''").limit(3).collect()
        if wrong:
            raise ContractError(f"run ids that are empty or repeat: {[r.run_id for r in wrong]}")
        taken = documents.select("folder").mapInArrow(_existing(root), "folder string").limit(3).collect()
        if taken:
            raise FileExistsError(f"runs exist below {root}: {[r.folder for r in taken]}")
        headers = {f"{n}.csv": ",".join(c for c in EXCHANGE[n] if c != "run_id") for n in tables}
        stacked = None
        for name, df in tables.items():
            rows = _lines(name, df, rows_per_file)
            stacked = rows if stacked is None else stacked.union(rows)
        if stacked is not None:
            laid = stacked.repartition("run_id", "name", "part").sortWithinPartitions("run_id", "name", "part", "_n")
            laid = laid.select(F.coalesce("run_id", F.lit("")).alias("folder"), "name", "part", "line")
            laid.write.format(RunFolders.name()).option("staging", staging).option("headers", json.dumps(headers)).mode("append").save()
        journals = spark.read.schema(JOURNAL).json(f"{staging}/journals").withColumn("journal", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        valid = spark.read.schema("journal string").json(f"{staging}/committed.json") if stacked is not None else spark.createDataFrame([], "journal string")
        files = journals.join(valid, "journal", "left_semi").withColumnRenamed("folder", "run_id")
        strays = files.join(documents, "run_id", "left_anti").select("run_id").distinct().limit(3).collect()
        if strays:
            raise ContractError(f"no manifest for runs {[r.run_id for r in strays]}")
        of_run = files.groupBy("run_id").agg(F.collect_list(F.struct("name", "part", "path", "rows", "bytes", "sha256")).alias("files"))
        plan = documents.join(of_run, "run_id", "left").select("folder", "document", "write_id", F.coalesce("files", F.array()).alias("files"))
        return plan.mapInArrow(_publish(root, staging, headers), "folder string").count()
    finally:
        if store.get_file_info(below).type != pa.fs.FileType.NotFound:
            store.delete_dir(below)
