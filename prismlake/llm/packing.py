"""Packing of tokenized documents into as few sequences as possible.

How documents are packed depends only on how many pieces there are of each
length, at most ``capacity`` numbers whatever the size of the corpus. A grouping
genetic algorithm works on that histogram: a solution is a set of bin patterns,
each with the number of bins that have it, so crossover moves thousands of equal
bins at once. Islands evolve as Spark tasks and send their elites on between
epochs. The best solution is then dealt out: the r-th piece of a length, counted
over all partitions, takes the r-th place that the patterns have for that length.
"""

from __future__ import annotations

import bisect
import json
import random
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, exact_id, in_worker, text_of

CAPACITY = 1024
END_ID = 2
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 6, 3, 20, 10, 2

#: A solution: pattern (lengths, longest first) -> number of bins.
Solution = dict[tuple[int, ...], int]


class Bins:
    """Open bins by the room left in them; equal ones are counted, not listed."""

    def __init__(self, capacity: int, start: Solution | None = None):
        self.capacity = capacity
        self.rooms: dict[int, Counter] = defaultdict(Counter)
        for pattern, n in (start or {}).items():
            self.rooms[capacity - sum(pattern)][pattern] += n
        self.open = sorted(r for r, found in self.rooms.items() if found)

    def _put(self, room: int, pattern: tuple[int, ...], n: int) -> None:
        if not self.rooms[room]:
            at = bisect.bisect_left(self.open, room)
            if at == len(self.open) or self.open[at] != room:
                self.open.insert(at, room)
        self.rooms[room][pattern] += n

    def _take(self, room: int, pattern: tuple[int, ...], n: int) -> None:
        left = self.rooms[room]
        left[pattern] -= n
        if not left[pattern]:
            del left[pattern]
        if not left:
            self.open.pop(bisect.bisect_left(self.open, room))

    def best_fit(self, length: int, n: int) -> None:
        """Place n pieces of one length, each in the fullest bin that has room for it."""
        while n:
            at = bisect.bisect_left(self.open, length)
            if at == len(self.open):
                room, pattern, there = self.capacity, (), n
            else:
                room = self.open[at]
                pattern, there = next(iter(self.rooms[room].items()))
            each = min(room // length, n)
            bins = min(there, n // each)
            if pattern:
                self._take(room, pattern, bins)
            self._put(room - each * length, tuple(sorted(pattern + (length,) * each, reverse=True)), bins)
            n -= bins * each

    def solution(self) -> Solution:
        out: Counter = Counter()
        for found in self.rooms.values():
            out.update(found)
        return dict(out)


def pack_in_order(lengths: list[tuple[int, int]], capacity: int, start: Solution | None = None) -> Solution:
    bins = Bins(capacity, start)
    for length, n in lengths:
        bins.best_fit(length, n)
    return bins.solution()


def pack_exactly(lengths: list[tuple[int, int]], capacity: int, rng: random.Random) -> Solution:
    """Fill bins without a gap, from the longest piece down, with two to four pieces; best-fit what is left."""
    left = dict(lengths)
    out: Counter = Counter()
    rest: list[tuple[int, int]] = []
    while left:
        first = max(left)
        room = capacity - first
        order = sorted((x for x in left if x <= room), reverse=True)
        pattern = (first,) if not room else (first, room) if room in left else None
        if pattern is None:
            pattern = next(((first, x, room - x) for x in order if room - x in left), None)
        if pattern is None and order:
            for x in rng.sample(order, min(len(order), 40)):
                if found := next(((first, x, y, room - x - y) for y in order if room - x - y in left), None):
                    pattern = tuple(sorted(found, reverse=True))
                    break
        held = Counter(pattern) if pattern else None
        n = min(left[x] // m for x, m in held.items()) if held else 0
        if n:
            out[pattern] += n
            for x, m in held.items():
                left[x] -= m * n
                if not left[x]:
                    del left[x]
        else:
            rest.append((first, left.pop(first)))
    return pack_in_order(rest, capacity, dict(out))


def cost(solution: Solution, capacity: int) -> tuple[int, float]:
    """The number of bins; among equals, the one with fuller full bins is better."""
    bins = sum(solution.values())
    return bins, -sum(n * (sum(p) / capacity) ** 2 for p, n in solution.items()) / max(bins, 1)


def crossover(a: Solution, b: Solution, capacity: int, rng: random.Random) -> Solution:
    """Inject well-filled bins of b into a, remove bins of a that hold the same pieces, best-fit what they displace."""
    well = sorted(b, key=lambda p: (sum(p), rng.random()), reverse=True)
    chosen: Solution = {}
    share = rng.uniform(0.2, 0.6)
    for p in well[: max(1, int(len(well) * share))]:
        if n := min(b[p], max(1, round(b[p] * rng.uniform(0.3, 1.0)))):
            chosen[p] = n
    need: Counter = Counter()
    for p, n in chosen.items():
        for x in p:
            need[x] += n
    child: Counter = Counter(chosen)
    displaced: Counter = Counter()
    for p in sorted(a, key=lambda p: (sum(p), rng.random())):
        have, held = a[p], Counter(p)
        out = min(have, max((-(-need[x] // m) for x, m in held.items() if need[x] > 0), default=0))
        for x, m in held.items():
            used = min(need[x], out * m)
            need[x] -= used
            if out * m > used:
                displaced[x] += out * m - used
        if have > out:
            child[p] += have - out
    return pack_in_order(sorted(displaced.items(), reverse=True), capacity, dict(child))


def mutate(a: Solution, capacity: int, rng: random.Random) -> Solution:
    """Empty some of the least filled bins and a few others, and place their pieces again in an order near to longest first."""
    order = sorted(a, key=sum)
    gone = set(order[: max(2, len(order) // 20)]) | set(rng.sample(order, min(len(order), 5)))
    loose: Counter = Counter()
    for p in gone:
        for x in p:
            loose[x] += a[p]
    return pack_in_order(sorted(loose.items(), key=lambda x: x[0] * rng.uniform(0.8, 1.2), reverse=True), capacity, {p: n for p, n in a.items() if p not in gone})


def evolve(lengths: list[tuple[int, int]], capacity: int, seed: int, arrived: list[Solution], generations: int, population: int) -> list[Solution]:
    """One island's epoch; the best solutions, best first."""
    rng = random.Random(seed)
    least = -(-sum(x * n for x, n in lengths) // capacity)
    people = [dict(s) for s in arrived]
    if not people:
        people = [pack_in_order(sorted(lengths, reverse=True), capacity), pack_exactly(lengths, capacity, rng)]
    while len(people) < population:
        people.append(pack_in_order(sorted(lengths, key=lambda x: x[0] * rng.uniform(0.7, 1.3), reverse=True), capacity))
    people.sort(key=lambda s: cost(s, capacity))
    for _ in range(generations):
        if cost(people[0], capacity)[0] <= least:
            break
        children = []
        for _ in range(population // 2):
            pick = lambda: min(rng.sample(people, min(2, len(people))), key=lambda s: cost(s, capacity))
            children.append(crossover(pick(), pick(), capacity, rng))
        children.append(mutate(people[0], capacity, rng))
        people = sorted(people + children, key=lambda s: cost(s, capacity))[:population]
    return people


def _to_json(s: Solution) -> str:
    return json.dumps([[list(p), n] for p, n in s.items()])


def _from_json(s: str) -> Solution:
    return {tuple(p): n for p, n in json.loads(s)}


def solve(spark: SparkSession, lengths: list[tuple[int, int]], capacity: int, seed: int = 7, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, elites: int = ELITES) -> Solution:
    """The best packing found for the histogram (length, number); islands are tasks, and the driver passes elites around the ring."""
    if not lengths:
        return {}
    least = -(-sum(x * n for x, n in lengths) // capacity)
    arrived: list[list[str]] = [[] for _ in range(islands)]
    best: Solution = pack_in_order(sorted(lengths, reverse=True), capacity)
    for epoch in range(epochs):
        if sum(best.values()) <= least:
            break

        def island(frames: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k, came in zip(frame["island"], frame["arrived"], strict=True):
                    found = evolve(lengths, capacity, seed + 1009 * epoch + int(k), [_from_json(x) for x in came], generations, population)
                    yield pd.DataFrame({"island": [k], "found": [[_to_json(s) for s in found[:elites]]]})

        start = spark.createDataFrame([(k, x) for k, x in enumerate(arrived)], "island int, arrived array<string>")
        sent = {r["island"]: list(r["found"]) for r in start.repartition(islands).mapInPandas(island, "island int, found array<string>").collect()}
        best = min([best, *(_from_json(x[0]) for x in sent.values())], key=lambda s: cost(s, capacity))
        # Each island keeps its best and gets the elites of the one before it in the ring.
        arrived = [sent[k][:1] + sent[(k - 1) % islands] for k in range(islands)]
    return best


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, solution: Solution):
        first_bin, by_length = 0, defaultdict(list)
        for pattern, bins in sorted(solution.items()):
            offset = 0
            for length, m in sorted(Counter(pattern).items(), reverse=True):
                by_length[length].append((m, bins, first_bin, offset))
                offset += m * length
            first_bin += bins
        self.tables = {}
        for length, rows in by_length.items():
            m, bins, first, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            self.tables[length] = (np.concatenate(([0], np.cumsum(m * bins)))[:-1], m, first, offset)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            start, m, first, off = self.tables[int(x)]
            k = np.searchsorted(start, rank[at], side="right") - 1
            q = rank[at] - start[k]
            sequence[at], offset[at] = first[k] + q // m[k], off[k] + (q % m[k]) * x
        return sequence, offset


@in_worker("tokens")
def _cut(vocabulary: str, end_id: int, capacity: int, kept: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, own, seen = TaskContext.get().partitionId(), tokens.encoder(vocabulary, kept), defaultdict(int)
    narrow = "<u2" if max(own.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    end = np.uint32(end_id).tobytes()
    for frame in frames:
        texts, ids = frame["text"].tolist(), frame["id"].tolist()
        for lot in tokens.in_lots(texts, min(4 * kept, 2_000_000)):
            rows = []
            for k, raw in zip(lot, own.encode([texts[k] for k in lot]), strict=True):
                raw += end
                n = len(raw) // 4
                small = np.frombuffer(raw, "<u4").astype(narrow).tobytes()
                width = len(small) // n
                first, piece = 0, 0
                length = n % capacity or capacity
                while first < n:
                    nth = seen[length]
                    seen[length] = nth + 1
                    rows.append((ids[k], piece, first, length, zlib.crc32(raw[4 * first : 4 * (first + length)]), part, nth, small[width * first : width * (first + length)]))
                    first, piece, length = first + length, piece + 1, capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])


def cut_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, kept: int = tokens.CACHED_PIECES) -> DataFrame:
    """Pieces of at most capacity ids; only a document's first piece may be shorter if it has several.

    ids holds the ids as unsigned little-endian integers, of 16 bits where the
    vocabulary allows; part and nth number the pieces of a length within a task.
    """
    rows = df.select(exact_id(id_col).alias("id"), text_of(text_col).alias("text"))
    made = rows.mapInPandas(lambda frames: _cut(vocabulary, end_id, capacity, kept, frames), "doc_id string, piece int, start long, length long, ids_crc32 long, part int, nth long, ids binary")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, kept: int = tokens.CACHED_PIECES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    A sequence's pieces fill it from offset 0 without gaps. Full pieces are
    sequences of their own, with negative numbers. A null or empty text is a
    piece of the end id alone; a null id is kept as it is; repeated rows are
    packed as often as they occur; an empty table gives no rows. Other columns
    are not read. kept bounds the pieces of text that a worker remembers, about
    170 bytes each; fewer take less memory and more time.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    cut = cut_documents(df, id_col, text_col, vocabulary, end_id, capacity, kept)
    cut.write.option("compression", "zstd").parquet(scratch.path("pieces"))
    pieces = spark.read.schema(cut.schema).parquet(scratch.path("pieces"))

    by_part = pieces.where(F.col("length") < capacity).groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.save(by_part, "counts")
    histogram = sorted((r["length"], r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())
    places = Places(solve(spark, histogram, capacity))

    from pyspark.sql import Window

    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    full = pieces.where(F.col("length") >= capacity).select(*_OUT, (-1 - F.col("part") * F.lit(1 << 40) - F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Both sides by a shuffle: before has a row for each task and length, so it grows with the corpus.
    ranked = pieces.where(F.col("length") < capacity).join(before.hint("merge"), ["part", "length"]).select(*_OUT, (F.col("before") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    text_ids = ranked.withColumn("doc_id", F.col("doc_id").cast("string"))
    return full.unionByName(text_ids.mapInPandas(lambda frames: _place(places, frames), text_ids.schema).withColumn("doc_id", F.col("doc_id").cast("long")))


_OUT = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")


def _place(places: Places, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """sequence_id comes as the rank within the length."""
    for frame in frames:
        sequence, offset = places.of(frame["length"].to_numpy(), frame["sequence_id"].to_numpy())
        yield frame.assign(sequence_id=sequence, offset=offset)
