"""Text files with given names, written by tasks into a staging folder and moved to their places on commit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tremorframe.sources.records import located


@dataclass
class StagedFiles(WriterCommitMessage):
    folder: str
    names: list[str]


class NamedTextWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.stage = path, f"{path}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> StagedFiles:
        system, base = located(self.stage)
        folder = f"{base}/{TaskContext.get().taskAttemptId()}"
        system.create_dir(folder)
        names: list[str] = []
        out = None
        for batch in iterator:
            for name, line in zip(batch.column("file_name").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if not names or name != names[-1]:
                    if not name or "/" in name or name[0] in "._":
                        raise ValueError(f"not a file name: {name!r}")
                    if out:
                        out.close()
                    out = system.open_output_stream(f"{folder}/{name}")
                    names.append(name)
                out.write((line + "\n").encode())
        if out:
            out.close()
        return StagedFiles(folder, names)

    def commit(self, messages: list[StagedFiles | None]) -> None:
        system, base = located(self.path)
        moves = [(f"{m.folder}/{n}", f"{base}/{n}") for m in messages if m for n in m.names]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of the same name")
        for staged, to in moves:
            system.move(staged, to)
        self.abort(messages)

    def abort(self, messages: list[StagedFiles | None]) -> None:
        system, stage = located(self.stage)
        system.delete_dir_contents(stage, missing_dir_ok=True)
        if system.get_file_info(stage).type.name == "Directory":
            system.delete_dir(stage)


class NamedTextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_text_files"

    def schema(self) -> str:
        return "file_name string, line string"

    def writer(self, schema, overwrite: bool) -> NamedTextWriter:
        return NamedTextWriter(self.options["path"])


def write_named_files(rows: DataFrame, path: str, order: list[str]) -> None:
    """``rows`` with ``file_name`` and ``line``: a file per name, its lines in the given order.

    Files of the same name are replaced, others stay. Tasks (and their repeated attempts) write into folders of their own;
    only a whole job's files are moved to their names, and a failed job leaves nothing.
    """
    rows.sparkSession.dataSource.register(NamedTextFiles)
    grouped = rows.repartition("file_name").sortWithinPartitions("file_name", *order, "line")
    grouped.select(F.col("file_name").cast("string"), F.col("line").cast("string")).write.format("named_text_files").mode("append").save(path)
