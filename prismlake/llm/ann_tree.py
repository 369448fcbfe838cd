"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The top of the tree is fitted on a bounded sample, but every vector is put in its
leaf. Leaves that hold many vectors are split by trees of their own, each fitted
in a task on vectors placed there, until all are small: leaves grow in number with
the table, not in size. Only the top is on the driver and broadcast; trees below
are rows of a table, joined to vectors and queries by leaf.

A query takes leaves from a priority queue, nearest centre first; how many is set
at each level by widening the visits until the neighbours of a calibration set,
found by brute force, are reached. Visits meet vectors by leaf, both in blocks,
and cosines are computed on the original vectors in double precision.

Equal vectors are searched once: of each, the smallest ids stand for all, as no
more than k + 1 can be among a query's k nearest.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, in_worker

#: Vectors that the tree is fitted on at most, children of a node, sample vectors below which a node is a leaf.
SAMPLE, BRANCHES, LEAF = 20_000, 12, 64
#: Vectors above which a leaf is split, vectors of a leaf that its tree is fitted on about at most, and levels below the top at most:
#: leaves that are still larger then, or whose vectors all have one direction, are searched in more blocks.
LEAF_ROWS, LEAF_SAMPLE, LEVELS = 1024, 8192, 8
#: Queries of the calibration set, and the share of their neighbours that visits must reach.
CALIBRATION, RECALL = 200, 0.95
#: Rows of a block of vectors and of a block of queries.
BLOCK = 4096


class Tree:
    """Centres of all nodes in one array; children[i] are the nodes below i, none for a leaf."""

    def __init__(self, centres: np.ndarray, children: list[list[int]]):
        self.centres, self.children = centres, children

    @property
    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, going to the nearest centre at every node."""
        at = np.zeros(len(x), dtype=np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            below = self.children[node]
            if not below or not len(rows):
                at[rows] = node
                continue
            nearest = (x[rows] @ self.centres[below].T).argmax(axis=1)
            waiting += [(below[j], rows[nearest == j]) for j in range(len(below))]
        return at

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves from the priority queue, best bin first."""
        return [node for node, _ in self.scored_visits(q, most)]

    def scored_visits(self, q: np.ndarray, most: int, root: float = 1.0) -> list[tuple[int, float]]:
        """Leaves from the priority queue with the nearness of their centres; root is that of a tree without branches."""
        queue, out = [(-root, 0)], []
        while queue and len(out) < most:
            near, node = heapq.heappop(queue)
            below = self.children[node]
            if below:
                for j, s in zip(below, (self.centres[below] @ q).tolist(), strict=True):
                    heapq.heappush(queue, (-s, j))
            else:
                out.append((node, -near))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centres and each row's centre."""
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    own = np.zeros(len(x), dtype=np.int64)
    for i in range(rounds):
        new = (x @ centres.T).argmax(axis=1)
        if i and (new == own).all():
            break
        own = new
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres, own


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 5) -> Tree:
    """x: unit rows of the sample."""
    rng = np.random.default_rng(seed)
    centres, children = [x.mean(axis=0) if len(x) else np.zeros(1)], [[]]
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        node, rows = waiting.pop()
        if len(rows) <= leaf:
            continue
        own_centres, own = k_means(x[rows], branches, rng)
        used = np.unique(own)
        if len(used) < 2:
            continue
        for j in used:
            centres.append(own_centres[j])
            children.append([])
            children[node].append(len(centres) - 1)
            waiting.append((len(centres) - 1, rows[own == j]))
    return Tree(np.array(centres), children)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


@in_worker("ann")
def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors that take part, as bytes of doubles, with a digest of them."""
    for frame in frames:
        ids, raw, digests, sizes = [], [], [], []
        for i, v in zip(frame["id"].tolist(), frame["v"], strict=True):
            if v is None or not len(v):
                continue
            x = np.array([np.nan if e is None else e for e in v] if getattr(v, "dtype", object) == object or isinstance(v, list) else v, dtype="<f8")
            if np.isfinite(x).all() and x.any():
                b = (x + 0.0).tobytes()
                ids.append(i)
                raw.append(b)
                digests.append(hashlib.md5(b, usedforsecurity=False).digest())
                sizes.append(len(x))
        if ids:
            yield pd.DataFrame({"id": ids, "digest": digests, "size": sizes, "vec": raw})


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query, the k nearest of rows, ties to the smaller first member: query (its digest), members, score."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query": [], "members": [], "score": []})
    first = np.array([m[0] for m in rows["members"]], dtype=np.int64)
    rows = rows.iloc[np.argsort(first, kind="stable")]
    q, x = _matrix(queries["vec"]), _matrix(rows["vec"])
    # Scaled first: cosines are the same, and products neither overflow nor vanish.
    q, x = q / np.abs(q).max(axis=1, keepdims=True), x / np.abs(x).max(axis=1, keepdims=True)
    s = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    # All that reach the k-th, with those that tie with it; columns are in the order of first members.
    edge = np.partition(s, -k, axis=1)[:, -k] if len(x) > k else s.min(axis=1)
    of, near = np.nonzero(s >= edge[:, None])
    order = np.lexsort((near, -s[of, near], of))
    of, near = of[order], near[order]
    kept = np.arange(len(of)) - np.searchsorted(of, of) < k
    of, near = of[kept], near[kept]
    return pd.DataFrame({"query": queries["digest"].to_numpy()[of], "members": rows["members"].to_numpy()[near], "score": s[of, near]})


_FOUND = "query binary, members array<long>, score double"


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each query vector: query, near: array of (score, id), nearest first."""
    each = found.select("query", F.explode("members").alias("id"), "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near"))


def _calibrated(needed: np.ndarray, recall: float) -> tuple[int, float]:
    """The visits that reach recall with two standard errors to spare, and what they reach; needed: the visits that find each neighbour."""
    if not len(needed):
        return 1, 1.0
    share = min(1.0, recall + 2 * (recall * (1 - recall) / len(needed)) ** 0.5)
    visits = int(np.sort(needed)[max(0, int(np.ceil(share * len(needed))) - 1)])
    return visits, float((needed <= visits).mean())


def _named(leaf: str, tree: Tree, node: int) -> str:
    """The name of a leaf of the tree that splits another: x is one that can't be split."""
    return f"{leaf}.{node}" if tree.children[0] else f"{leaf}.x"


_PLACED = "digest binary, members array<long>, vec binary, leaf string"
_ASKED = "digest binary, vec binary, leaf string, score double"


def split_leaves(placed: DataFrame, scratch: Scratch, leaf_rows: int, leaf_sample: int) -> tuple[DataFrame, list[DataFrame]]:
    """Split leaves of more than leaf_rows vectors until none is left; the vectors in their new leaves, and the trees (leaf, tree) of each level.

    A leaf's name is that of the leaf it was split from with a part more. Trees
    meet vectors by leaf and block, so no task gets more than a block of a leaf.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("digest")
        x = unit(_matrix(frame["vec"]))
        small = max(LEAF if len(x) > LEAF * BRANCHES else 2, int(leaf_rows / 2 * len(x) / frame["n"].iat[0]))
        return pd.DataFrame({"leaf": [frame["leaf"].iat[0]], "tree": [pickle.dumps(fit_tree(x, leaf=small))]})

    def place(trees: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows[["digest", "members", "vec", "leaf"]]
        leaf, tree = rows["leaf"].iat[0], pickle.loads(trees["tree"].iat[0])
        names = [_named(leaf, tree, node) for node in tree.place(unit(_matrix(rows["vec"]))).tolist()]
        return rows[["digest", "members", "vec"]].assign(leaf=names)

    levels: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        counts = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        large = scratch.save(counts.where((F.col("n") > leaf_rows) & ~F.col("leaf").endswith("x")), f"large-{level}")
        if large.isEmpty():
            break
        share = F.pmod(F.xxhash64("digest"), F.lit(1 << 40)) < (1 << 40) * F.lit(leaf_sample) / F.col("n")
        trees = placed.join(large, "leaf").where(share).select("leaf", "digest", "vec", "n").groupBy("leaf").applyInPandas(fit, "leaf string, tree binary")
        levels.append(scratch.save(trees, f"trees-{level}"))
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        # A leaf whose share of the hashes holds no vector has no tree in this level and stays as it is.
        split = large.join(levels[-1].select("leaf"), "leaf")
        left = levels[-1].join(large, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        right = placed.join(split, "leaf").select("digest", "members", "vec", "leaf", F.pmod(F.xxhash64("digest"), blocks).cast("int").alias("block"))
        moved = left.groupBy("leaf", "block").cogroup(right.groupBy("leaf", "block")).applyInPandas(place, _PLACED)
        placed = scratch.save(placed.join(split, "leaf", "left_anti").select("digest", "members", "vec", "leaf").unionByName(moved), f"placed-{level}")
    return placed, levels


def _descend(asked: DataFrame, trees: DataFrame, most: int | None) -> DataFrame:
    """Visits of leaves that trees split become visits of the leaves below, of each query the best `most` over all its trees (None: all)."""
    n = asked.join(trees.select("leaf"), "leaf").groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns"))
    left = trees.join(n, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    right = asked.join(n, "leaf").withColumn("turn", F.pmod(F.xxhash64("digest"), F.col("turns")).cast("int"))

    def below(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            leaf, tree = rows["leaf"].iat[0], pickle.loads(own["tree"].iat[0])
            for digest, raw, q, score in zip(rows["digest"], rows["vec"], unit(_matrix(rows["vec"])), rows["score"].tolist(), strict=True):
                found = tree.scored_visits(q, len(tree.children) if most is None else most, score)
                out += [(digest, raw, _named(leaf, tree, node), s) for node, s in found]
        return pd.DataFrame(out, columns=["digest", "vec", "leaf", "score"])

    lower = left.groupBy("leaf", "turn").cogroup(right.groupBy("leaf", "turn")).applyInPandas(below, _ASKED)
    every = asked.join(trees.select("leaf"), "leaf", "left_anti").select("digest", "vec", "leaf", "score").unionByName(lower)
    order = Window.partitionBy("digest").orderBy(F.desc("score"), "leaf")
    ranked = every.withColumn("r", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("r") <= most).drop("r")


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, recall: float = RECALL, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, leaf_sample: int = LEAF_SAMPLE) -> tuple[DataFrame, dict]:
    """(result, what was measured). The result's rows: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by every; a query's candidates
    are all other rows. Null, empty and zero vectors and those with null or
    non-finite components take no part, nor do vectors of another length than
    the most frequent (of equally frequent, the longest). Rows with a null id
    are left out, repeated rows with one id count once. An empty table gives no
    rows.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "ann")
    read = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    vectors = scratch.save(read.mapInPandas(_read, "id long, digest binary, size int, vec binary"), "vectors")
    sizes = vectors.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), {"leaves": 0}
    vectors = vectors.where(F.col("size") == sizes["size"])
    least = Window.partitionBy("digest").orderBy("id")
    distinct_ids = vectors.groupBy("digest", "id").agg(F.first("vec").alias("vec"))
    few = distinct_ids.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    reps = scratch.save(few.groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("members"), F.first("vec").alias("vec")), "reps")

    fitted_on = bounded_sample(reps.select("digest", "vec"), sample, "digest").toPandas()
    tree = fit_tree(unit(_matrix(fitted_on["vec"])))
    shared = spark.sparkContext.broadcast(tree)

    def place(frames):
        for f in frames:
            if len(f):
                yield f.assign(leaf=shared.value.place(unit(_matrix(f["vec"]))).astype(str))

    placed, levels = split_leaves(scratch.save(reps.mapInPandas(place, _PLACED), "placed"), scratch, leaf_rows, leaf_sample)
    query_ids = vectors.where(F.col("id") % every == 0).select("id", "digest").distinct()
    queries = placed.join(query_ids.select("digest").distinct(), "digest", "left_semi").select("digest", "vec")

    # Calibration: brute force for a bounded set of queries, then the visits that reach its neighbours.
    chosen = bounded_sample(queries, CALIBRATION, "digest").toPandas()
    known = spark.sparkContext.broadcast(chosen)

    def brute(frames):
        for f in frames:
            if len(f):
                got = _best(known.value, f, k + 1).itertuples(index=False)
                own = {m[0]: (leaf, d) for m, leaf, d in zip(f["members"], f["leaf"], f["digest"], strict=True)}
                # A query's own vector is no neighbour unless another row has it too.
                rows = [(q, m[0], s, own[m[0]][0]) for q, m, s in got if len(m) > 1 or own[m[0]][1] != q]
                yield pd.DataFrame(rows, columns=["query", "id", "score", "leaf"])

    truth = placed.mapInPandas(brute, "query binary, id long, score double, leaf string")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    truth = truth.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).toPandas()
    # Each level may miss its part of what the recall leaves.
    wanted = 1 - (1 - recall) / (len(levels) + 1)
    ranks = {bytes(d): {str(leaf): i for i, leaf in enumerate(tree.visits(unit(_matrix([v]))[0], len(tree.children)))} for d, v in zip(chosen["digest"], chosen["vec"], strict=True)}
    visits, reached = _calibrated(np.array([ranks[bytes(q)][leaf.split(".")[0]] + 1 for q, leaf in zip(truth["query"], truth["leaf"], strict=True)]), wanted)

    def visit(frames):
        for f in frames:
            if len(f):
                found = [shared.value.scored_visits(q, visits) for q in unit(_matrix(f["vec"]))]
                yield f[["digest", "vec"]].assign(leaves=[[str(node) for node, _ in x] for x in found], scores=[[s for _, s in x] for x in found])

    asked = queries.mapInPandas(visit, "digest binary, vec binary, leaves array<string>, scores array<double>")
    asked = asked.select("digest", "vec", F.explode(F.arrays_zip("leaves", "scores")).alias("x")).select("digest", "vec", F.col("x.leaves").alias("leaf"), F.col("x.scores").alias("score"))
    calibrating = F.broadcast(spark.createDataFrame([(bytearray(d),) for d in chosen["digest"]], "digest binary"))
    for level, trees in enumerate(levels, 1):
        asked = scratch.save(asked, f"asked-{level - 1}")
        wide = _descend(asked.join(calibrating, "digest", "left_semi"), trees, None).select(F.col("digest").alias("query"), "leaf", "r")
        there = spark.createDataFrame([(bytearray(q), ".".join(leaf.split(".")[: level + 1])) for q, leaf in zip(truth["query"], truth["leaf"], strict=True)], "query binary, leaf string")
        visits, share = _calibrated(there.join(wide, ["query", "leaf"]).select("r").toPandas()["r"].to_numpy(), wanted)
        reached += share - 1
        asked = _descend(asked, trees, visits)
    asked = scratch.save(asked.select("digest", "vec", "leaf"), "asked")
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    turns = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns"))
    dealt = blocks.join(turns, "leaf")
    if not levels:  # at most one row for each leaf of the top, as many as the bounded sample allows
        dealt = F.broadcast(dealt)
    part = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(dealt, "leaf").select("leaf", all_of("blocks").alias("block"), part("turns").alias("turn"), "digest", "vec")
    right = placed.join(dealt, "leaf").select("leaf", part("blocks").alias("block"), all_of("turns").alias("turn"), "members", "vec")
    keys = ("leaf", "block", "turn")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _best(a, b, k + 1), _FOUND)
    near = _merge(found, k + 1)
    # A query's own row is among the k + 1 nearest of its vector at most once.
    own = query_ids.join(near, query_ids["digest"] == near["query"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    result = own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
    leaves = placed.select("leaf").distinct().count() if levels else len(tree.leaves)
    return result, {"leaves": leaves, "levels": len(levels) + 1, "visits": visits, "recall": reached, "calibrated_on": len(chosen)}
