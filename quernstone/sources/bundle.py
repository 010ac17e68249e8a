"""A sink with a commit protocol: a run's rows as JSON lines and a manifest of their digests.

``df.write.format("bundle").option("path", root).option("run", run_id).mode("append").save()`` writes
one file a task into a staging folder of its own.  Each task returns its file's rows and SHA-256.
The commit moves the files to ``root/run`` and writes ``manifest.json`` last, so a run without a
manifest was never there; an abort deletes what was staged, whatever failed.  A second write of the
same rows, dealt to the same tasks, finds its manifest and changes nothing; other rows under the same
name are refused.

``root`` is a folder that all executors and the driver share, as a path or a URI that Arrow can open.
Lines are canonical: keys sorted, no blanks, non-ASCII as it is; times and days in ISO form, decimals
and bytes as text.  A null stays null; a number that isn't finite fails its task.  An empty table
gives a manifest without rows.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    """One file of a run."""

    name: str
    rows: int
    sha256: str


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def line(row: dict) -> bytes:
    return (json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=_shown) + "\n").encode()


def _shown(value: object) -> str:
    if isinstance(value, (datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, decimal.Decimal):
        return str(value)
    raise TypeError(f"no JSON for {type(value).__name__}")


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.root, self.run = options["path"].rstrip("/"), options["run"]
        if not self.run or "/" in self.run or self.run.startswith("."):
            raise ValueError("a run's name is one step of a path")
        self.staging = f"{self.root}/.staging-{self.run}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.jsonl"
        system, folder = place(self.staging)
        # attempts of one task stage apart; the commit takes the one that it is told of
        staged = f"{folder}/{context.taskAttemptId()}-{name}"
        system.create_dir(folder, recursive=True)
        digest, rows = hashlib.sha256(), 0
        with system.open_output_stream(staged) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    text = line(row)
                    digest.update(text)
                    out.write(text)
                    rows += 1
        return Part(f"{context.taskAttemptId()}-{name}", rows, digest.hexdigest())

    def commit(self, messages: list) -> None:
        system, folder = place(self.staging)
        _, target = place(f"{self.root}/{self.run}")
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name.split("-", 1)[1])
        files = [{"file": m.name.split("-", 1)[1], "rows": m.rows, "sha256": m.sha256} for m in parts]
        manifest = line({"run": self.run, "rows": sum(m.rows for m in parts), "files": files})
        held = read_manifest(self.root, self.run)
        if held is not None:
            self._drop()
            if line(held) != manifest:
                raise ValueError(f"{self.run} was written before, with other rows")
            return
        if system.get_file_info(target).type != fs.FileType.NotFound:
            system.delete_dir(target)  # files of a commit that didn't end
        system.create_dir(target, recursive=True)
        for m, f in zip(parts, files):
            system.move(f"{folder}/{m.name}", f"{target}/{f['file']}")
        with system.open_output_stream(f"{target}/{MANIFEST}.new") as out:
            out.write(manifest)
        system.move(f"{target}/{MANIFEST}.new", f"{target}/{MANIFEST}")
        self._drop()

    def abort(self, messages: list) -> None:
        self._drop()

    def _drop(self) -> None:
        system, folder = place(self.staging)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class Bundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def writer(self, schema: object, overwrite: bool) -> BundleWriter:
        if overwrite:
            raise ValueError("a run is written once")
        return BundleWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Bundle)


def read_manifest(root: str, run: str) -> dict | None:
    """The manifest of a committed run, or None."""
    system, path = place(f"{root.rstrip('/')}/{run}/{MANIFEST}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def damaged(root: str, run: str) -> list[str]:
    """Files of a committed run that are missing, changed or strange; without a manifest, the manifest."""
    manifest = read_manifest(root, run)
    if manifest is None:
        return [MANIFEST]
    system, folder = place(f"{root.rstrip('/')}/{run}")
    held = {i.base_name for i in system.get_file_info(fs.FileSelector(folder))} - {MANIFEST}
    bad = held ^ {f["file"] for f in manifest["files"]}
    for f in manifest["files"]:
        if f["file"] in held:
            digest = hashlib.sha256()
            with system.open_input_stream(f"{folder}/{f['file']}") as data:
                while block := data.read(1 << 20):
                    digest.update(block)
            if digest.hexdigest() != f["sha256"]:
                bad.add(f["file"])
    return sorted(bad)
