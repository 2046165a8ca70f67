"""Results as files of lines, written whole or not at all: spark's writers with format("lines"), in batch and as a stream.

Each task writes a file in the folder's _staged part; the driver's commit renames them to part-BATCH-N and then writes _committed/BATCH, which lists them. A batch that a restarted stream writes again is
dropped if it is committed, and replaces what an unfinished commit left. committed() reads what the lists name. The folder must be seen by all machines under one local path.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class Folder:
    """The steps of a commit."""

    def __init__(self, path: str):
        self.path = path
        self.staged, self.lists = os.path.join(path, "_staged"), os.path.join(path, "_committed")

    def stage(self, rows: Iterator[Row]) -> _Written:
        os.makedirs(self.staged, exist_ok=True)
        out, n = _Written(uuid.uuid4().hex, 0), 0
        with open(os.path.join(self.staged, out.name), "w", encoding="utf-8", newline="\n") as f:
            for r in rows:
                f.write(f"{r[0]}\n")
                n += 1
        out.rows = n
        return out

    def commit(self, batch: str, messages: list[_Written | None]) -> None:
        os.makedirs(self.lists, exist_ok=True)
        done = os.path.join(self.lists, batch)
        if os.path.exists(done):
            self.abort(messages)
            return
        for f in os.listdir(self.path):  # of a commit that was cut off
            if f.startswith(f"part-{batch}-"):
                os.remove(os.path.join(self.path, f))
        names = []
        for i, m in enumerate(m for m in messages if m is not None):
            if m.rows:
                names.append(f"part-{batch}-{i:05d}.txt")
                os.replace(os.path.join(self.staged, m.name), os.path.join(self.path, names[-1]))
            else:
                os.remove(os.path.join(self.staged, m.name))
        half = f"{done}.{uuid.uuid4().hex}.half"
        with open(half, "w", encoding="utf-8") as f:
            json.dump({"files": names, "rows": sum(m.rows for m in messages if m is not None)}, f)
        os.replace(half, done)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(at := os.path.join(self.staged, m.name)):
                os.remove(at)

    def files(self) -> list[str]:
        """Of all committed batches."""
        names = sorted(f for f in os.listdir(self.lists) if not f.endswith(".half")) if os.path.isdir(self.lists) else []
        return [os.path.join(self.path, x) for f in names for x in json.load(open(os.path.join(self.lists, f), encoding="utf-8"))["files"]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.folder, self.overwrite, self.batch = Folder(path), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        return self.folder.stage(iterator)

    def commit(self, messages: list[_Written | None]) -> None:
        old = [(os.path.join(self.folder.lists, f)) for f in (os.listdir(self.folder.lists) if os.path.isdir(self.folder.lists) else [])] if self.overwrite else []
        files = self.folder.files() if self.overwrite else []
        self.folder.commit(self.batch, messages)
        for f in old + files:
            os.remove(f)

    def abort(self, messages: list[_Written | None]) -> None:
        self.folder.abort(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.folder = Folder(path)

    def write(self, iterator: Iterator[Row]) -> _Written:
        return self.folder.stage(iterator)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        self.folder.commit(f"{batchId:010d}", messages)

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        self.folder.abort(messages)


class LinesSink(DataSource):
    """Option: path, a folder. Rows have one column, the line; its text should have no line feed if lines are to be told apart."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesSink)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of all committed batches."""
    files = Folder(path).files()
    return spark.read.text(files) if files else spark.createDataFrame([], "value string")
