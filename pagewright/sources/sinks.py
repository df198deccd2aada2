"""Sinks whose tasks write files, and which show all of them at once or none.

Tasks write into a staging folder, each attempt into one of its own. When all
have succeeded, the files of those that count are moved to their places and the
document that names them is written; when a task has failed for good, staging is
deleted and nothing is shown. Folders are paths or URIs that Arrow's file
systems know and that all executors reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pagewright.operators import manifest
from pagewright.shared import cut


@dataclass
class _Written(WriterCommitMessage):
    """What a task has staged: its folder, its files' names, and its first row's place."""

    folder: str = ""
    files: list[str] = field(default_factory=list)
    place: Any = None


class _Staging(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.stage = f"_staging-{uuid.uuid4().hex}"

    def _open(self) -> tuple[FileSystem, str]:
        system, root = FileSystem.from_uri(self.folder)
        return system, root.rstrip("/")

    def _own(self) -> tuple[FileSystem, str, str]:
        """(file system, root, a fresh folder below the staging folder)."""
        system, root = self._open()
        own = f"{self.stage}/{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{own}", recursive=True)
        return system, root, own

    def _show(self, messages: list[_Written]) -> None:
        system, root = self._open()
        for m in messages:
            for name in m.files:
                system.move(f"{root}/{m.folder}/{name}", f"{root}/{name}")

    def _clear(self) -> None:
        system, root = self._open()
        if any(x.base_name == self.stage for x in system.get_file_info(FileSelector(root, allow_not_found=True))):
            system.delete_dir(f"{root}/{self.stage}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


class CorpusWriter(_Staging):
    """Rows (place, case, image, content): images as files, then ``ground-truth.json`` with the cases in the order of places."""

    def write(self, rows: Iterator[Row]) -> _Written:
        system, root, own = self._own()
        said = _Written(own)
        with system.open_output_stream(f"{root}/{own}/_cases") as listed:
            for row in rows:
                with system.open_output_stream(f"{root}/{own}/{row.image}") as out:
                    out.write(row.content)
                said.files.append(row.image)
                listed.write((", " if said.place is not None else "").encode() + row.case.encode())
                said.place = row.place if said.place is None else said.place
        return said

    def commit(self, messages: list[_Written]) -> None:
        system, root = self._open()
        parts = sorted((m for m in messages if m is not None and m.place is not None), key=lambda m: m.place)
        self._show(parts)
        with system.open_output_stream(f"{root}/{self.stage}/manifest") as out:
            out.write(json.dumps({"schema_version": manifest.VERSION})[:-1].encode() + b', "cases": [')
            for i, m in enumerate(parts):
                out.write(b", " if i else b"")
                with system.open_input_stream(f"{root}/{m.folder}/_cases") as listed:
                    while block := listed.read(1 << 20):
                        out.write(block)
            out.write(b"]}")
        system.move(f"{root}/{self.stage}/manifest", f"{root}/ground-truth.json")
        self._clear()


class ResultsWriter(_Staging):
    """Rows (engine, device, row: JSON) in the order of engines: documents {engine, device, rows}, one of each task and engine."""

    def write(self, rows: Iterator[Row]) -> _Written:
        system, root, own = self._own()
        said = _Written(own, place=0)
        out, now = None, None
        for row in rows:
            if out is None or now != (row.engine, row.device):
                if out is not None:
                    out.write(b"]}\n")
                    out.close()
                now = (row.engine, row.device)
                said.files.append(f"{row.part:08d}-{len(said.files):04d}.json")
                out = system.open_output_stream(f"{root}/{own}/{said.files[-1]}")
                out.write(json.dumps({"engine": row.engine, "device": row.device}, ensure_ascii=False)[:-1].encode() + b', "rows": [' + row.row.encode())
            else:
                out.write(b",\n" + row.row.encode())
        if out is not None:
            out.write(b"]}\n")
            out.close()
        return said

    def commit(self, messages: list[_Written]) -> None:
        self._show([m for m in messages if m is not None])
        self._clear()


class CorpusSink(DataSource):
    """``df.write.format("corpus")``."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def writer(self, schema: Any, overwrite: bool) -> CorpusWriter:
        return CorpusWriter(self.options["path"])


class ResultsSink(DataSource):
    """``df.write.format("results")``."""

    @classmethod
    def name(cls) -> str:
        return "results"

    def writer(self, schema: Any, overwrite: bool) -> ResultsWriter:
        return ResultsWriter(self.options["path"])


def write_corpus(cases: DataFrame, folder: str) -> int:
    """Writes ``cases`` (place, case: JSON, image, content), checked first; how many there were.

    Pages are made once, kept in the shared folder and written by tasks; the
    driver sees neither images nor cases.
    """
    spark = cases.sparkSession
    spark.dataSource.register(CorpusSink)
    kept = cut(cases.select("place", "case", "image", "content"))
    manifest.validated(kept.select("place", "case"))
    n = kept.count()
    dealt = kept.repartitionByRange(max(1, min(n, spark.sparkContext.defaultParallelism)), "place").sortWithinPartitions("place")
    dealt.write.format("corpus").mode("append").save(folder)
    return n


def write_results(rows: DataFrame, path: str, *, document_rows: int = 100_000) -> None:
    """Writes ``rows`` (engine, device, id and others) as results documents of about so many rows, by engine and id."""
    spark = rows.sparkSession
    spark.dataSource.register(ResultsSink)
    keys = ("engine", "device", "id")
    others = [c for c in rows.columns if c not in keys]
    row = F.to_json(F.struct("id", *others), {"ignoreNullFields": "false"})
    own = cut(rows.select(*keys, row.alias("row")))
    dealt = own.repartitionByRange(max(1, -(-own.count() // document_rows)), *keys).sortWithinPartitions(*keys)
    dealt.select("engine", "device", "row", F.spark_partition_id().alias("part")).write.format("results").mode("append").save(path)
