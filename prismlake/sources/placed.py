"""Sinks whose rows have fixed places in one file.

Tasks write their rows at these places of a staging file beside the target, and
say which pixels they wrote. Only when all have ended and every pixel is there
exactly once, the staging file takes the target's name; otherwise it goes. A
task that runs again writes the same bytes at the same places. The folder must
be shared by driver and executors.

A partial file may lack pixels. Their bytes are zero, and a second file of one
byte a pixel marks those that are there, since no value can say that one is not.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

#: Rows that a task gathers before it writes, by bytes of their values.
BUFFER_BYTES = 32 << 20
#: Marks of pixels that are counted at a time.
MARKS = 16 << 20


@dataclass
class Written(WriterCommitMessage):
    """Runs (first, last + 1) of pixels; of a partial file, only how many."""

    runs: list[tuple[int, int]] = field(default_factory=list)
    pixels: int = 0


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def runs_of(p: np.ndarray) -> list[np.ndarray]:
    """Index ranges of a sorted array within which numbers follow one another."""
    return np.split(np.arange(len(p)), np.flatnonzero(np.diff(p) != 1) + 1) if len(p) else []


def check_covered(runs: list[tuple[int, int]], pixels: int) -> None:
    """Refuses runs that don't make up 0 to pixels exactly once."""
    written = sum(b - a for a, b in runs)
    if written != pixels:
        raise ValueError(f"{written} pixels written, {pixels} are expected")
    at = 0
    for a, b in sorted(runs):
        if a != at:
            raise ValueError(f"pixel {min(a, at)} is missing or double")
        at = b


def count_marks(path: str) -> int:
    """How many pixels are marked, a part of the file at a time."""
    n = 0
    with open(path, "rb") as f:
        while part := f.read(MARKS):
            n += int(np.count_nonzero(np.frombuffer(part, "u1")))
    return n


class PlacedWriter(DataSourceArrowWriter):
    """Writes columns p and one other; size: the file's bytes. Subclasses place a run of values, and may add files at the end.

    marks: of a partial file, the file that marks its pixels. It is there only if some are missing.
    """

    def __init__(self, target: str, size: int, pixels: int, column: str, marks: str = ""):
        self.target, self.pixels, self.column, self.marks = target, pixels, column, marks
        self.staging = f"{target}.{uuid.uuid4().hex}.part"
        self.marking = f"{self.staging}.marks" if marks else ""
        for path, n in ((self.staging, size), (self.marking, pixels)):
            if path:
                with open(path, "wb") as f:
                    f.truncate(n)

    def values(self, column: pa.Array) -> np.ndarray:
        raise NotImplementedError

    def place(self, f, p: int, values: np.ndarray) -> None:
        """Write the values of the pixels from p on."""
        raise NotImplementedError

    def finish(self) -> None:
        os.replace(self.staging, self.target)
        if self.marking and count_marks(self.marking) < self.pixels:
            os.replace(self.marking, self.marks)
        elif self.marking:
            os.unlink(self.marking)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def mark(p: np.ndarray) -> None:
            done.pixels += len(p)
            with open(self.marking, "r+b") as f:
                for r in runs_of(p):
                    f.seek(int(p[r[0]]))
                    f.write(b"\1" * len(r))

        def flush(f):
            p = np.concatenate([h[0] for h in held])
            x = np.concatenate([h[1] for h in held])
            order = np.argsort(p, kind="stable")
            p, x = p[order], x[order]
            for r in runs_of(p):
                self.place(f, int(p[r[0]]), x[r[0] : r[-1] + 1])
                if self.marking:
                    continue
                if done.runs and done.runs[-1][1] == p[r[0]]:
                    done.runs[-1] = (done.runs[-1][0], int(p[r[-1]]) + 1)
                else:
                    done.runs.append((int(p[r[0]]), int(p[r[-1]]) + 1))
            if self.marking:
                mark(p)
            held.clear()

        with open(self.staging, "r+b") as f:
            for b in iterator:
                if not b.num_rows:
                    continue
                if b["p"].null_count:
                    raise ValueError("a pixel has no place")
                p, x = b["p"].to_numpy().astype(np.int64), self.values(b[self.column])
                if p.min() < 0 or p.max() >= self.pixels:
                    raise ValueError(f"a pixel lies outside 0 to {self.pixels - 1}")
                held.append((p, x))
                size += x.nbytes
                if size >= BUFFER_BYTES:
                    flush(f)
                    size = 0
            if held:
                flush(f)
            f.flush()
            os.fsync(f.fileno())
        return done

    def commit(self, messages: list[Written | None]) -> None:
        try:
            if self.marking:
                written, marked = sum(m.pixels for m in messages if m is not None), count_marks(self.marking)
                if written != marked:
                    raise ValueError(f"{written} pixels written at {marked} places: one is double")
            else:
                check_covered([r for m in messages if m is not None for r in m.runs], self.pixels)
        except ValueError:
            self.abort(messages)
            raise
        self.finish()

    def abort(self, messages: list[Written | None]) -> None:
        for path in (self.staging, self.marking):
            if path and os.path.exists(path):
                os.unlink(path)
