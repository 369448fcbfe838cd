"""The nearest target in libraries too large for a constant in the plan.

Targets are clustered, and a cluster is skipped for all pixels whose angle to
its centre, less its radius, exceeds the best angle so far: angles between
directions keep the triangle inequality, so the result is exact. Of few bands,
targets are in a tree of boxes instead, in which the work of a pixel grows with
the depth. A library larger than one part is cut into parts of neighbouring
directions: the driver holds one at a time, and a pixel skips those that are too
far. One pass over the pixels takes several parts; if there are more, the best
target so far stays beside the pixels from pass to pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import RIGHT_ANGLE
from .scoring import FEW_BANDS, _stack

#: Bytes of the part of a library that the driver holds at a time.
PART_BYTES = 64 << 20
#: Parts that a pass over the pixels takes.
PASS_PARTS = 8
#: Targets that centres are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 6
#: Pixels that are compared with the centres at a time.
ROWS = 2048
#: Rows of a leaf at most, children of a node (a power of two), leaves that are searched first, and pairs of pixel and node held at a time.
LEAF, FAN, BEAM, PAIRS = 32, 8, 3, 1 << 18
#: What a bound may be off by rounding: the angle of nearly equal directions is known to about 1e-8.
SLACK = 1e-7


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled first so that no square overflows; rows without energy stay zero."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)


def _nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + ROWS] @ centres.T).argmax(axis=1) for i in range(0, len(x), ROWS)])


@dataclass(frozen=True)
class Index:
    """Directions of distinct targets, cluster after cluster: cluster c has rows ends[c] to ends[c + 1].

    blank is the first target without energy, at a right angle to all pixels;
    first is the first of all. Both are -1 where there is none.
    """

    ids: np.ndarray
    units: np.ndarray
    ends: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    blank: int
    first: int

    def search(self, x: np.ndarray, target: np.ndarray, score: np.ndarray) -> int:
        """Improve target and score in place; how many angles it took. Rows with a value that is no number stay as they are."""
        return search_parts([self], x, target, score)

    def bound(self, u: np.ndarray) -> np.ndarray:
        """No target has a smaller angle from these directions."""
        return np.zeros(len(u))

    def _search(self, u: np.ndarray, rows: np.ndarray, target: np.ndarray, score: np.ndarray) -> int:
        away = np.arccos(np.clip(u @ self.centres.T, -1, 1))
        bound, own, taken = away - self.radii, away.argmin(axis=1), away.size
        for near in (True, False):  # each pixel's nearest cluster comes first, so that bounds cut
            for c in range(len(self.centres)):
                at = np.flatnonzero(own == c if near else (own != c) & (bound[:, c] <= score[rows] + SLACK))
                if len(at):
                    part = slice(self.ends[c], self.ends[c + 1])
                    cosines = u[at] @ self.units[part].T
                    best = cosines.argmax(axis=1)
                    self._offer(target, score, rows[at], self.ids[part][best], np.arccos(np.clip(cosines[np.arange(len(at)), best], -1, 1)))
                    taken += cosines.size
        return taken

    @staticmethod
    def _offer(target: np.ndarray, score: np.ndarray, rows: np.ndarray, ids, angles) -> None:
        """Take what is nearer, or as near with a smaller id."""
        ids, angles = np.broadcast_to(ids, rows.shape), np.broadcast_to(angles, rows.shape)
        won = (angles < score[rows]) | ((angles == score[rows]) & (ids < target[rows]))
        target[rows[won]], score[rows[won]] = ids[won], angles[won]


@dataclass(frozen=True)
class Tree(Index):
    """Targets of few bands: leaves of at most LEAF rows, and boxes around what lies below each node.

    levels has (lows, highs) of the nodes from the top down to the leaves; node k
    of a level has the nodes FAN * k to FAN * k + FAN - 1 of the next one. A box
    that is farther from a pixel than its best target so far is skipped, so the
    work of a pixel grows with the depth of the tree. centres and radii are empty.
    """

    levels: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    def bound(self, u: np.ndarray) -> np.ndarray:
        top = np.arange(len(self.levels[0][0]))
        return 2 * np.arcsin(np.minimum(np.sqrt(self._away(u, 0, np.arange(len(u))[:, None], top).min(axis=1)) / 2, 1)) - SLACK

    def _away(self, u: np.ndarray, level: int, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of directions from boxes; rows and nodes may be broadcast."""
        low, high = self.levels[level]
        out = 0.0
        for b in range(u.shape[1]):
            x = u[rows, b]
            gap = np.maximum(np.maximum(low[nodes, b] - x, x - high[nodes, b]), 0)
            out = out + gap * gap
        return out

    def _search(self, u: np.ndarray, rows: np.ndarray, target: np.ndarray, score: np.ndarray) -> int:
        every = np.arange(len(u))
        # The nearest nodes of each level lead to leaves that are searched first, so that bounds cut.
        nodes, taken = np.broadcast_to(np.arange(len(self.levels[0][0])), (len(u), len(self.levels[0][0]))), 0
        for level in range(len(self.levels)):
            away = self._away(u, level, every[:, None], nodes)
            taken += away.size
            if nodes.shape[1] > BEAM:
                nodes = np.take_along_axis(nodes, np.argpartition(away, BEAM - 1, axis=1)[:, :BEAM], axis=1)
            if level + 1 < len(self.levels):
                nodes = (nodes[:, :, None] * FAN + np.arange(FAN)).reshape(len(u), -1)
        first = nodes
        for k in range(first.shape[1]):
            taken += self._leaves(u, every, first[:, k], rows, target, score)
        # Then all others whose boxes are near enough, level by level.
        limit = (2 * np.sin(np.minimum(score[rows], np.pi) / 2) + SLACK) ** 2
        return taken + self._below(u, 0, np.repeat(every, len(self.levels[0][0])), np.tile(np.arange(len(self.levels[0][0])), len(u)), first, limit, rows, target, score)

    def _below(self, u, level: int, who: np.ndarray, nodes: np.ndarray, first: np.ndarray, limit: np.ndarray, rows: np.ndarray, target: np.ndarray, score: np.ndarray) -> int:
        """Search the leaves below pairs of a pixel and a node, at most PAIRS of them at a time; first are those searched before."""
        taken = 0
        for i in range(0, len(who), PAIRS):
            w, n = who[i : i + PAIRS], nodes[i : i + PAIRS]
            near = self._away(u, level, w, n) <= limit[w]
            taken += len(w)
            w, n = w[near], n[near]
            if level + 1 < len(self.levels):
                taken += self._below(u, level + 1, np.repeat(w, FAN), (n[:, None] * FAN + np.arange(FAN)).reshape(-1), first, limit, rows, target, score)
            else:
                new = (first[w] != n[:, None]).all(axis=1)
                taken += self._leaves(u, w[new], n[new], rows, target, score)
        return taken

    def _leaves(self, u: np.ndarray, who: np.ndarray, leaves: np.ndarray, rows: np.ndarray, target: np.ndarray, score: np.ndarray) -> int:
        """Offer the best target of a leaf to a pixel, for pairs of them."""
        taken = 0
        for i in range(0, len(who), PAIRS // LEAF):
            w, n = who[i : i + PAIRS // LEAF], leaves[i : i + PAIRS // LEAF]
            at = np.minimum(self.ends[n][:, None] + np.arange(LEAF), self.ends[n + 1][:, None] - 1)
            cosines = np.zeros(at.shape)
            for b in range(u.shape[1]):
                cosines += u[w, b][:, None] * self.units[at, b]
            best = cosines.argmax(axis=1)
            best, ids = cosines[np.arange(len(w)), best], self.ids[at[np.arange(len(w)), best]]
            # Of a pixel's leaves the best one is offered, of equal ones that with the smallest id.
            order = np.lexsort((ids, -best, w))
            order = order[np.concatenate(([True], np.diff(w[order]) != 0))] if len(w) else order
            self._offer(target, score, rows[w[order]], ids[order], np.arccos(np.clip(best[order], -1, 1)))
            taken += cosines.size
        return taken


def _build_tree(ids: np.ndarray, units: np.ndarray, blank: int, first: int) -> Tree:
    """Halves along the widest side, down to leaves whose sizes differ by one at most."""
    cuts = np.array([0, len(units)])
    while np.diff(cuts).max() > LEAF:
        node = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        side = (np.maximum.reduceat(units, cuts[:-1], axis=0) - np.minimum.reduceat(units, cuts[:-1], axis=0)).argmax(axis=1)
        # Sorted by node and value, all nodes at once; what the sum rounds away makes a box wider at most.
        order = np.argsort(4.0 * node + units[np.arange(len(units)), side[node]])
        ids, units = ids[order], units[order]
        cuts = np.sort(np.concatenate((cuts, (cuts[:-1] + cuts[1:]) // 2)))
    # Ids stay in order within a leaf.
    order = np.lexsort((ids, np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))))
    ids, units = ids[order], units[order]
    levels = [(np.minimum.reduceat(units, cuts[:-1], axis=0), np.maximum.reduceat(units, cuts[:-1], axis=0))]
    while len(levels[0][0]) >= FAN:
        low, high = (side.reshape(-1, FAN, side.shape[1]) for side in levels[0])
        levels.insert(0, (low.min(axis=1), high.max(axis=1)))
    return Tree(ids, units, cuts, units[:0], np.zeros(0), blank, first, tuple(levels))


def build_index(ids: np.ndarray, values: np.ndarray, seed: int = 11) -> Index:
    """An index of targets; those with a value that is no number are left out, of equal ones the smallest id stands for all."""
    some = np.isfinite(values).all(axis=1)
    ids, values = ids[some], values[some]
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    first = int(ids[0]) if len(ids) else -1
    dark = ~values.any(axis=1)
    blank = int(ids[dark][0]) if dark.any() else -1
    ids, values = ids[~dark], values[~dark]
    order = np.lexsort(values.T)  # stable, so the smallest id comes first
    kept = np.ones(len(ids), bool)
    kept[order[1:]] = (values[order[1:]] != values[order[:-1]]).any(axis=1)
    ids, units = ids[kept], _units(values[kept])
    if not len(ids):
        return Index(ids, units, np.zeros(1, np.int64), units, np.zeros(0), blank, first)
    if units.shape[1] <= FEW_BANDS:
        return _build_tree(ids, units, blank, first)
    rng = np.random.default_rng(seed)
    fitted = units[rng.choice(len(units), min(SAMPLE, len(units)), replace=False)]
    centres = fitted[: max(1, int(np.sqrt(len(units))))]
    for _ in range(ROUNDS):
        own, sums = _nearest_centres(fitted, centres), np.zeros_like(centres)
        np.add.at(sums, own, fitted)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    own = _nearest_centres(units, centres)
    used, own = np.unique(own, return_inverse=True)
    order = np.argsort(own, kind="stable")  # ids stay in order within a cluster
    ids, units, own, centres = ids[order], units[order], own[order], centres[used]
    radii = np.zeros(len(centres))
    np.maximum.at(radii, own, np.arccos(np.clip((units * centres[own]).sum(axis=1), -1, 1)))
    return Index(ids, units, np.concatenate(([0], np.cumsum(np.bincount(own)))), centres, radii, blank, first)


def search_parts(parts: list[Index], x: np.ndarray, target: np.ndarray, score: np.ndarray) -> int:
    """Improve target and score in place by the parts of a library: each pixel's nearest part comes first, and those too far are skipped."""
    usable, offer, taken = np.isfinite(x).all(axis=1), Index._offer, 0
    dark = usable & ~x.any(axis=1)
    lit = np.flatnonzero(usable & ~dark)
    for part in parts:
        if part.first >= 0:
            offer(target, score, np.flatnonzero(dark), part.first, RIGHT_ANGLE)
        if part.blank >= 0:
            offer(target, score, lit, part.blank, RIGHT_ANGLE)
    parts = [part for part in parts if len(part.ids)]
    step = ROWS * len(parts) if parts and isinstance(parts[0], Tree) else ROWS  # about ROWS for each part
    for i in range(0, len(lit), step) if parts else ():
        rows = lit[i : i + step]
        u = _units(x[rows])
        bounds = np.stack([part.bound(u) for part in parts])
        own = bounds.argmin(axis=0)
        for near in (True, False):
            for k, part in enumerate(parts):
                at = np.flatnonzero((own == k if near else own != k) & (bounds[k] <= score[rows] + SLACK))
                if len(at):
                    taken += part._search(u[at], rows[at], target, score)
    return taken


def _pass(pixels: DataFrame, column: str, bands: int, shared: list) -> DataFrame:
    """pixels with __target and __score, improved where they are there already; shared: broadcast parts of the library."""
    rest = [c for c in pixels.columns if c not in ("__target", "__score")]
    started = len(rest) < len(pixels.columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in pixels.select(*rest).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            get = lambda c: b.column(b.schema.get_field_index(c))
            target = get("__target").to_numpy().copy() if started else np.full(b.num_rows, -1, np.int64)
            score = get("__score").to_numpy().copy() if started else np.full(b.num_rows, np.inf)
            search_parts([s.value for s in shared], _stack(get(column), bands), target, score)
            yield pa.RecordBatch.from_arrays([*(get(c) for c in rest), pa.array(target), pa.array(score)], names=[*rest, "__target", "__score"])

    return pixels.mapInArrow(run, f"{schema}, __target long, __score double")


def _halves(units: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sides and places of the cuts that halve directions along the widest side, depth times over; node k is cut into 2 * k + 1 and 2 * k + 2."""
    sides, places = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    below = {0: units}
    for k in range(len(sides)):
        x = below.pop(k)
        if len(x):
            sides[k] = (x.max(axis=0) - x.min(axis=0)).argmax()
            places[k] = np.median(x[:, sides[k]])
        right = x[:, sides[k]] > places[k]
        below[2 * k + 1], below[2 * k + 2] = x[~right], x[right]
    return sides, places


def _with_part(library: DataFrame, bands: int, sides: np.ndarray, places: np.ndarray) -> DataFrame:
    """The library with part, a number for neighbouring directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b.column(1), bands)
            x = _units(np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0))
            node, every = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(node) and node[0] < len(sides):  # all nodes of a round are of one level
                node = 2 * node + 1 + (x[every, sides[node]] > places[node])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node - len(sides))], names=["target_id", "values", "part"])

    return library.mapInArrow(run, "target_id long, values array<double>, part long")


def _parts(library: DataFrame, n: int, bands: int, most: int, folder: str) -> Iterator[DataFrame]:
    """Parts of a library of n targets, of 2 * most at most: neighbouring directions, and where too many are alike, any of them."""
    spark, depth = library.sparkSession, 0
    while (most << depth) * 4 < n * 5:  # a fifth to spare: parts aren't quite equal
        depth += 1
    fitted = library.sample(min(1.0, 1.2 * SAMPLE / n), 11).limit(SAMPLE).toArrow().column("values").combine_chunks()
    x = _stack(fitted, bands)
    dealt = _with_part(library, bands, *_halves(_units(x[np.isfinite(x).all(axis=1)]), depth))
    dealt.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)
    for k, size in sorted(dealt.groupBy("part").count().collect()):
        mine = spark.read.parquet(f"{folder}/part={k}")
        pieces = 1 if size <= 2 * most else -(-size * 5 // (most * 4))
        for j in range(pieces):
            yield mine.where(F.pmod(F.xxhash64("target_id"), F.lit(pieces)) == j) if pieces > 1 else mine


def sam_nearest(pixels: DataFrame, library: DataFrame, column: str = "spectrum", folder: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The nearest target of each pixel in a library of any size: target, score (its angle); (-1, infinity) for null spectra and without targets.

    library: target_id (distinct), values. Targets that are null or hold a null
    or NaN are left out; ragged ones are refused. Ties go to the smaller id. A
    library of more than part_bytes is cut into parts, written to folder, one
    that driver and executors share; with more than PASS_PARTS of them, the
    pixels are written there after each pass. With a folder, the library is
    computed only once.
    """
    rest = [c for c in pixels.columns if c != column]
    some = library.select(F.col("target_id").cast("long").alias("target_id"), F.col("values").cast("array<double>").alias("values")).where("values is not null and target_id is not null")
    spark = pixels.sparkSession
    if folder is not None:
        some.write.mode("overwrite").parquet(f"{folder}/library")
        some = spark.read.parquet(f"{folder}/library")
    sizes = some.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("values")).alias("least"), F.max(F.size("values")).alias("bands")).first()
    if sizes["least"] != sizes["bands"]:
        raise ValueError(f"targets differ in their number of bands: {sizes['least']} to {sizes['bands']}")
    if not sizes["n"]:
        return pixels.select(*rest, F.lit(-1).cast("long").alias("target"), F.lit(float("inf")).alias("score"))
    most = max(1, part_bytes // (8 * sizes["bands"]))
    if sizes["n"] > most and folder is None:
        raise ValueError(f"a library of {sizes['n']} targets is searched in parts of {most}, which need a folder")
    found, shared, passes = pixels, [], 0
    for mine in _parts(some, sizes["n"], sizes["bands"], most, folder) if sizes["n"] > most else [some]:
        if len(shared) == PASS_PARTS:
            found, shared = _pass(found, column, sizes["bands"], shared), []
            found.write.mode("overwrite").parquet(f"{folder}/pass{passes}")
            found, passes = spark.read.parquet(f"{folder}/pass{passes}"), passes + 1
        got = mine.limit(2 * most + 1).toArrow()
        if got.num_rows > 2 * most:
            raise ValueError("target ids aren't distinct: a part of the library is far larger than the others")
        shared.append(spark.sparkContext.broadcast(build_index(got.column("target_id").to_numpy(), _stack(got.column("values").combine_chunks(), sizes["bands"]))))
    found = _pass(found, column, sizes["bands"], shared)
    return found.select(*rest, F.col("__target").alias("target"), F.col("__score").alias("score"))
