"""Token-ID output: one wavelet matrix per shard.

A shard holds the token ids of a range of documents as succinct bit-planes, one
for each bit of an id from the highest down. Each plane has a rank directory, so
a token, the count of a token in a range, and the k-th place of a token are found
with a few reads and no decoding of the rest.
"""

from __future__ import annotations

import bisect
import mmap
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, exact_id, in_worker, text_of

MAGIC = b"PLWM0002"
_HEADER = struct.Struct("<8sQIIQQ")
#: Bits between two entries of the rank directory.
STEP = 512
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
END_ID = 0


def pack_shard(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, without_id: int = 0) -> bytes:
    """The file of one shard: header, documents, and for each plane its zeros, bits and ranks.

    ids: all ids in order. doc_ids, ends: each document and where its ids end;
    so many of the first documents have no id, whatever doc_ids says.
    """
    n, bits = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    parts = [_HEADER.pack(MAGIC, n, bits, STEP, len(doc_ids), without_id), doc_ids.astype("<i8").tobytes(), ends.astype("<i8").tobytes()]
    for level in range(bits - 1, -1, -1):
        bit = (a & (1 << level)) != 0
        words = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-n // STEP) * STEP // 8, dtype=np.uint8)
        padded[: len(words)] = words
        per_step = np.bitwise_count(padded.view("<u8")).reshape(-1, STEP // 64).sum(axis=1, dtype=np.int64) if n else np.zeros(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(per_step))).astype("<u4")
        ones = int(ranks[-1])
        parts += [struct.pack("<Q", n - ones), padded.tobytes(), ranks.tobytes()]
        a = np.concatenate((a.take(np.flatnonzero(~bit)), a.take(np.flatnonzero(bit))))
    return b"".join(parts)


class Shard:
    """Reads a shard from bytes, a memory map, or anything with the buffer protocol."""

    def __init__(self, raw):
        magic, self.n, self.bits, self.step, docs, self.without_id = _HEADER.unpack_from(raw, 0)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = _HEADER.size
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.ends = np.frombuffer(raw, "<i8", docs, at + 8 * docs)
        at += 16 * docs
        steps = -(-self.n // self.step)
        self.planes = []
        for _ in range(self.bits):
            zeros = struct.unpack_from("<Q", raw, at)[0]
            plane = np.frombuffer(raw, np.uint8, steps * self.step // 8, at + 8)
            at += 8 + len(plane)
            ranks = np.frombuffer(raw, "<u4", steps + 1, at)
            at += 4 * (steps + 1)
            self.planes.append((zeros, plane, ranks))

    @staticmethod
    def open(path: str) -> Shard:
        """A shard's file, mapped into memory."""
        with open(path, "rb") as f:
            return Shard(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _ones(self, plane, ranks, i: int) -> int:
        """Ones before place i."""
        k = i // self.step
        first, last = k * self.step // 8, i // 8
        ones = int(ranks[k]) + int(np.bitwise_count(plane[first:last]).sum())
        return ones + (int(plane[last]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else ones

    def _select(self, plane, ranks, k: int, one: bool) -> int:
        """The place of the k-th one or zero, from 0."""
        before = lambda j: int(ranks[j]) if one else j * self.step - int(ranks[j])
        block = bisect.bisect_right(range(len(ranks)), k, key=before) - 1
        bits = np.unpackbits(plane[block * self.step // 8 : (block + 1) * self.step // 8], bitorder="little")
        return block * self.step + int(np.flatnonzero(bits == one)[k - before(block)])

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for zeros, plane, ranks in self.planes:
            one = plane[i // 8] >> (i % 8) & 1
            ones = self._ones(plane, ranks, i)
            value, i = value * 2 + int(one), zeros + ones if one else i - ones
        return value

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level, (zeros, plane, ranks) in zip(range(self.bits - 1, -1, -1), self.planes, strict=True):
            a, b = self._ones(plane, ranks, first), self._ones(plane, ranks, last)
            first, last = (zeros + a, zeros + b) if token >> level & 1 else (first - a, last - b)
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """How often token stands in [first, last)."""
        a, b = self._range(token, first, self.n if last is None else last)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of token, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level, (zeros, plane, ranks) in zip(range(self.bits), reversed(self.planes), strict=True):
            one = bool(token >> level & 1)
            i = self._select(plane, ranks, i - zeros if one else i, one)
        return i

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the lowest."""
        a = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level, (zeros, plane, _) in zip(range(self.bits), reversed(self.planes), strict=True):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~bit)] = a[:zeros]
            up[np.flatnonzero(bit)] = a[zeros:] | a.dtype.type(1 << level)
            a = up
        return a


@in_worker("tokens")
def _encode_shards(vocabulary: str, end_id: int, shard_ids: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, number, own = TaskContext.get().partitionId(), 0, tokens.encoder(vocabulary)
    end = np.uint32(end_id).tobytes()
    held: list[bytes] = []
    docs: list[str | None] = []
    size = before = 0

    def close():
        nonlocal held, docs, size, number, before
        ids = np.frombuffer(b"".join(held), "<u4")
        ends = np.cumsum([len(x) // 4 for x in held])
        row = pd.DataFrame({"part": [part], "number": [number], "before": [before], "n_ids": [len(ids)], "shard": [pack_shard(ids, np.array([int(d or 0) for d in docs], np.int64), ends, docs.count(None))]})
        held, docs, size, number, before = [], [], 0, number + 1, before + len(ids)
        return row

    for frame in frames:
        texts, doc_ids = frame["text"].tolist(), frame["id"].tolist()
        for lot in tokens.in_lots(texts):
            for k, raw in zip(lot, own.encode([texts[k] for k in lot]), strict=True):
                held.append(raw + end)
                docs.append(doc_ids[k])
                size += len(raw) // 4 + 1
                if size >= shard_ids:
                    yield close()
    if held:
        yield close()


def _read_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part, before, raw in zip(frame["part"], frame["before"], frame["shard"], strict=True):
            shard = Shard(raw)
            ids = shard.decode().astype("<u4").tobytes()
            ends = shard.ends
            starts = np.concatenate(([0], ends[:-1]))
            view = memoryview(ids)
            yield pd.DataFrame({"part": part, "id": [None] * shard.without_id + list(map(str, shard.doc_ids[shard.without_id :].tolist())), "at": before + starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]})


def write_shards(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY, end_id: int = END_ID, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """Write the ids of all documents, in ascending id order, as shards; the table of shards.

    Columns: part and number (in this order the shards continue one another),
    before (ids of the same part in earlier shards), n_ids, shard (the file's bytes). Documents are dealt by ranges of ids, so a
    shard is closed inside one task and nothing but its own documents is held.
    A null text is an empty document, of the end id alone. Rows with one id are
    dealt by a hash of their texts, so many of them share out over tasks; those
    with a null id come first. Repeated rows are written again, next to each other.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(partitions, "id", "h").sortWithinPartitions("id", "h", "text").select(exact_id("id").alias("id"), "text")
    made = spread.mapInPandas(lambda frames: _encode_shards(vocabulary, end_id, shard_ids, frames), "part int, number int, before long, n_ids long, shard binary")
    return scratch.save(made, "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """From the shards: doc_id, start, n_tokens, ids_crc32 of each document.

    Where a part starts is the sum of those before it; the driver sees one
    number for each part, never one for each document.
    """
    spark = shards.sparkSession
    sizes = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    first, total = [], 0
    for part, n in sizes:
        first.append((part, total))
        total += n
    places = spark.createDataFrame(first, "part int, first long")
    docs = shards.select("part", "before", "shard").mapInPandas(_read_shards, "part int, id string, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(places), "part").select(F.col("id").cast("long").alias("doc_id"), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Each shard as a file of its own in a folder that all machines have mounted; path, part, number. Shard.open maps such a file.

    A file is written beside its place and then renamed, so a task that runs again leaves it whole.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            paths = [os.path.join(folder, f"{p:06d}-{n:06d}.wavelet") for p, n in zip(f["part"], f["number"], strict=True)]
            for path, raw in zip(paths, f["shard"], strict=True):
                own = f"{path}.{os.getpid()}"
                with open(own, "wb") as out:
                    out.write(raw)
                os.replace(own, path)
            yield pd.DataFrame({"path": paths, "part": f["part"], "number": f["number"]})

    os.makedirs(folder, exist_ok=True)
    return shards.select("part", "number", "shard").mapInPandas(write, "path string, part int, number int")
