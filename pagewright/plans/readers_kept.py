"""Reading by other programs that stay open: one process for each selection in a task, one request and one answer a page."""

from __future__ import annotations

import json
import os
import select
import subprocess
import tempfile
import time
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

READ = "id string, selection string, ms double, error string, observed_lines array<string>"


class Process:
    """A program that reads a path a line and answers with a JSON array of lines; started when first asked, again after it failed."""

    def __init__(self, command: Sequence[str], seconds: float):
        self.command, self.seconds = list(command), seconds
        self.running: subprocess.Popen | None = None
        self.rest = b""

    def close(self) -> None:
        if self.running is not None:
            self.running.kill()
            self.running.wait()
            for pipe in (self.running.stdin, self.running.stdout):
                pipe.close()
        self.running, self.rest = None, b""

    def _answer(self) -> bytes:
        """The next line of the answer, within the time limit."""
        until = time.monotonic() + self.seconds
        out = self.running.stdout.fileno()
        while b"\n" not in self.rest:
            if not select.select([out], [], [], max(0.0, until - time.monotonic()))[0]:
                raise TimeoutError(f"no answer in {self.seconds:g} s")
            more = os.read(out, 1 << 16)
            if not more:
                raise EOFError(f"exit {self.running.wait()}")
            self.rest += more
        line, _, self.rest = self.rest.partition(b"\n")
        return line

    def ask(self, path: str) -> list[str]:
        try:
            if self.running is None:
                self.running = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
            self.running.stdin.write(path.encode() + b"\n")
            self.running.stdin.flush()
            lines = json.loads(self._answer())
            if not isinstance(lines, list) or not all(isinstance(x, str) for x in lines):
                raise ValueError("the answer is no array of texts")
            return [x for x in lines if x.strip()]
        except BaseException:
            self.close()  # what it may still say belongs to no later page
            raise


def read_kept(cases: DataFrame, commands: Mapping[str, Sequence[str]], *, seconds: float = 60.0) -> DataFrame:
    """``READ`` of cases (id, selection, image: PNG or JPEG bytes), each by the program of its selection.

    A page whose program fails, answers with something else or not in time is a
    row with ``error``; the next page of that selection starts it anew. A
    selection without a program is an error too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Process] = {}
        try:
            with tempfile.TemporaryDirectory() as scratch:  # for the program's input alone, in the task that runs it
                path = os.path.join(scratch, "page")
                for batch in batches:
                    for case, selection, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        error, lines, took = None, [], None
                        try:
                            if selection not in commands:
                                raise KeyError(f"no program for {selection}")
                            with open(path, "wb") as out:
                                out.write(image or b"")
                            own = kept.setdefault(selection, Process(commands[selection], seconds))
                            began = time.perf_counter()
                            lines = own.ask(path)
                            took = (time.perf_counter() - began) * 1000
                        except (OSError, ValueError, EOFError, KeyError) as failure:
                            error = f"{type(failure).__name__}: {failure}"
                        yield pa.record_batch([pa.array([case], pa.string()), pa.array([selection], pa.string()), pa.array([took], pa.float64()), pa.array([error], pa.string()), pa.array([lines], pa.list_(pa.string()))], ["id", "selection", "ms", "error", "observed_lines"])
        finally:
            for own in kept.values():
                own.close()

    return cases.select("id", "selection", "image").mapInArrow(run, READ)
