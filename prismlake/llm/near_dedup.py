"""Near-duplicate detection with HyperMinHash signatures.

A document's set of word shingles is reduced to registers: for each bucket, the
leading zeros of the least hash and a few bits of its mantissa. Bands of
registers give buckets of candidates; a Jaccard estimate corrected for chance
collisions thins them, and links are confirmed on the full sets.

No bucket is expanded into all its pairs. Equal sets are one representative,
known by their digest; a bucket's members are first compared with one leader, the
member that shares the most buckets with others. Followers of a leader that end
in different components are then compared with one another in blocks: first by
registers alone, and where some pass the same test of the estimate, by full sets,
which are fetched for those members only. Only links come out of a block, so no
link between different components is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, enter, exact_id, in_worker, release, text_of
from .components import components

MANTISSA = 10
#: (bands, registers of a band) up to a threshold: a pair at the threshold shares no band with a probability below 1e-6.
BANDS = ((0.82, (30, 4)), (1.01, (24, 5)))
LEAST_SIMILARITY = 0.8
#: A pair at the threshold is left out for its estimate with at most this probability.
MISS = 1e-6
#: Members of a block, minor members of a block, shingles of a block, and shingles that a block's table holds at a time.
BLOCK, MINOR_BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 256, 400_000, 8192
#: Small groups are handled several at a time: rows and shingles of such a lot.
LOT_ROWS, LOT_SHINGLES = 1500, 600_000
#: At most so many sets, those with the most rows, are broadcast at the end.
HOT_SHARE = 2000
_M64 = (1 << 64) - 1


def _bands(threshold: float) -> tuple[int, int]:
    if threshold < LEAST_SIMILARITY:
        raise ValueError(f"near duplicates are found from a similarity of {LEAST_SIMILARITY} on; below, the bands would miss links")
    return next(shape for limit, shape in BANDS if threshold < limit)


def least_estimate(threshold: float, count: int) -> float:
    """The estimate below which pairs are left out: the binomial quantile at MISS of equal registers, and one register less for the correction."""
    total = 0.0
    for equal in range(count + 1):
        total += math.comb(count, equal) * threshold**equal * (1 - threshold) ** (count - equal)
        if total > MISS:
            return (equal - 1) / count
    return 1.0


def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "little") | 1 for i in range(n)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles of width words.

    Words stand between ASCII white space, A-Z in lower case. With fewer words
    than width, the whole sequence is one shingle; without words, there is none.
    """
    words = [t.encode("utf-8", "replace").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    h = np.frombuffer(b"".join([x for w in words for x in map(xxhash.xxh3_64_digest, w)]), ">u8").astype(np.uint64)
    factors = _constants(width, 1)
    ends = np.cumsum(sizes)
    full = np.zeros(0, dtype=np.uint64)
    if len(h) >= width:
        n = len(h) - width + 1
        full = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            full += _mix(h[j : j + n] ^ factors[j]) * factors[j]
        full = _mix(full)
    out = []
    for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(full[end - n : end - width + 1]))
        elif n:
            x = np.array([n], dtype=np.uint64)
            for j in range(end - n, end):
                x = _mix(x * np.uint64(3) + h[j : j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """HyperMinHash registers of non-empty sets: for each bucket 6 bits of leading zeros and MANTISSA bits after the first one."""
    least = np.zeros((len(sets), count), dtype=np.uint64)
    salt, factor = _constants(count, 2), _constants(count, 3)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (size == 0 or size + len(sets[last]) <= 1 << 16):
            size += len(sets[last])
            last += 1
        u = np.concatenate(sets[first:last])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[first:last]])[:-1]))
        for i in range(count):
            least[first:last, i] = np.minimum.reduceat((u ^ salt[i]) * factor[i], starts)
        first = last
    mantissa, exponent = np.frexp(least.astype(np.float64))
    part = np.minimum((mantissa * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).clip(0).astype(np.uint16)
    return ((64 - exponent).clip(0, 63).astype(np.uint16) << np.uint16(MANTISSA)) | part


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(regs), bands), dtype=np.uint64)
    tags = _constants(bands, 4)
    for b in range(bands):
        x = np.full(len(regs), tags[b])
        for r in range(rows):
            x = _mix(x + regs[:, b * rows + r].astype(np.uint64))
        keys[:, b] = x
    return keys.view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that a register of two disjoint sets of n and m elements is equal."""
    p = np.zeros(len(n))
    both = (n + m).astype(float)
    for i in range(48):
        low, high = 2.0 ** -(i + 1), 2.0**-i
        p += low / (1 << MANTISSA) * n * m * (np.exp(-both * low) - np.exp(-both * high)) / both
    return np.minimum(p, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for chance collisions."""
    p = chance(n, m)
    return ((a == b).mean(axis=1) - p) / (1 - p)


def _lots(frame: pd.DataFrame, chars: int = 2_000_000):
    first, total = 0, 0
    sizes = frame["text"].str.len().to_numpy()
    for k, n in enumerate(sizes):
        total += n
        if total > chars:
            yield frame.iloc[first : k + 1]
            first, total = k + 1, 0
    if first < len(frame):
        yield frame.iloc[first:]


@in_worker("near")
def _sign(width: int, bands: int, rows: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lot in _lots(frame):
            sets = shingle_sets(lot["text"].tolist(), width)
            some = [i for i, s in enumerate(sets) if len(s)]
            regs = registers([sets[i] for i in some], bands * rows)
            keys = band_keys(regs, bands, rows)
            place = {i: k for k, i in enumerate(some)}
            yield pd.DataFrame({
                "id": lot["id"].to_numpy(),
                "of_text": lot["of_text"].to_numpy(),
                "n": [len(s) for s in sets],
                "same": [_digest(s) for s in sets],
                "regs": [regs[place[i]].tobytes() if i in place else b"" for i in range(len(sets))],
                "bands": [keys[place[i]] if i in place else [] for i in range(len(sets))],
            })


def _digest(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes(), usedforsecurity=False).digest()


@in_worker("near")
def _collect_sets(width: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lot in _lots(frame):
            yield pd.DataFrame({"same": lot["same"].to_numpy(), "grams": [g.view(np.int64) for g in shingle_sets(lot["text"].tolist(), width)]})


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b: a product of incidence tables over the elements that occur in several sets."""
    sizes = [len(x) for x in a] + [len(x) for x in b]
    values, column, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = times > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        table = np.zeros((len(sizes), COLUMNS), dtype=np.float32)
        table[row[lo:hi], column[lo:hi] - first] = 1
        out += table[: len(a)] @ table[len(a) :].T
    return out.astype(np.int64)


def _matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1)


def _likely(percent: int, least: float, own: pd.DataFrame, rest: pd.DataFrame) -> np.ndarray:
    """Which minor members may be linked to which others: components, sizes and estimates."""
    n, m = own["n"].to_numpy()[:, None], rest["n"].to_numpy()[None, :]
    out = (own["component"].to_numpy()[:, None] != rest["component"].to_numpy()[None, :]) & (100 * n >= percent * m) & (100 * m >= percent * n)
    i, j = np.nonzero(out)
    a, b, n, m = _matrix(own["regs"]), _matrix(rest["regs"]), n[:, 0], m[0]
    for first in range(0, len(i), 1 << 16):
        x, y = i[first : first + (1 << 16)], j[first : first + (1 << 16)]
        out[x, y] = estimate(a[x], b[y], n[x], m[y]) >= least
    return out


def _blocks(lot: pd.DataFrame):
    """(minor members, others) of each block of a lot."""
    for _, block in lot.groupby(["unit", "i", "j"], sort=False):
        own, rest = block[block["minor"]], block[~block["minor"]]
        if len(own) and len(rest):
            yield own, rest


def _thin_blocks(percent: int, least: float, lot: pd.DataFrame) -> pd.DataFrame:
    """The members of blocks that may be linked to another one there."""
    enter("near")
    kept = [lot.iloc[:0]]
    for own, rest in _blocks(lot):
        likely = _likely(percent, least, own, rest)
        kept += [own[likely.any(axis=1)], rest[likely.any(axis=0)]]
    return pd.concat(kept)[list(_MEMBER)]


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Of links between numbered components, the places of those that join what the ones before left apart: one fewer than there are components, at most."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    _, first = np.unique(np.minimum(a, b) * (1 + max(a.max(initial=0), b.max(initial=0))) + np.maximum(a, b), return_index=True)
    for k in np.sort(first).tolist():
        x, y = top(int(a[k])), top(int(b[k]))
        if x != y:
            above[y] = x
            out.append(k)
    return out


def _compare_blocks(percent: int, least: float, lot: pd.DataFrame) -> pd.DataFrame:
    """Links between minor members and the others, where their components differ, by full sets: of each block, those that span what its links join."""
    enter("near")
    found = [pd.DataFrame({"a": [], "b": []}, dtype=object)]
    for own, rest in _blocks(lot):
        likely = _likely(percent, least, own, rest)
        n, m = own["n"].to_numpy()[:, None], rest["n"].to_numpy()[None, :]
        both = shared_counts([np.asarray(g) for g in own["grams"]], [np.asarray(g) for g in rest["grams"]])
        i, j = np.nonzero(likely & (100 * both >= percent * (n + m - both)))
        parts = pd.factorize(np.concatenate((own["component"].to_numpy(), rest["component"].to_numpy())))[0].astype(np.int64)
        some = _spanning(parts[: len(own)][i], parts[len(own) :][j])
        found.append(pd.DataFrame({"a": own["same"].to_numpy()[i[some]], "b": rest["same"].to_numpy()[j[some]]}))
        del both, likely
    if len(lot) > MINOR_BLOCK:
        release()
    return pd.concat(found)


_LOT = ("lot", "unit", "i", "j", "minor")
_MEMBER = (*_LOT, "same", "component", "n", "regs")
_MEMBER_TYPES = "lot long, unit binary, i int, j int, minor boolean, same binary, component binary, n long, regs binary"


class _Job:
    """One call: the tables it writes and the settings it has. A set of shingles is known by its digest, same."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.spark, self.width, self.percent = df.sparkSession, width, percent
        self.scratch = Scratch(self.spark, "near")
        self.docs = df.select(exact_id(id_col).alias("id"), text_of(text_col).alias("text"), F.md5(text_of(text_col)).alias("of_text"))
        self.bands, self.rows = _bands(percent / 100)
        self.least = least_estimate(percent / 100, self.bands * self.rows)

    def near(self, pairs: DataFrame, regs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that may be linked by their sizes and estimates."""
        least, percent = self.least, self.percent
        left, right = (regs.select(F.col("same").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab")
        sized = pairs.join(left, "a").join(right, "b").where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))

        @in_worker("near")
        def thin(frames):
            for f in frames:
                if len(f):
                    f = f[estimate(_matrix(f["regs_a"]), _matrix(f["regs_b"]), f["n_a"].to_numpy(), f["n_b"].to_numpy()) >= least]
                yield f[["a", "b"]]

        return sized.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInPandas(thin, "a binary, b binary")

    def collect_sets(self, sets: DataFrame, wanted: DataFrame) -> DataFrame:
        """The full sets of the digests wanted, from one document of each; texts are moved once, and only here."""
        width = self.width
        chosen = sets.join(wanted, "same", "left_semi").select("same", "one.*")
        texts = self.docs.select(F.coalesce("id", F.lit("")).alias("id"), "text", "of_text").join(chosen.hint("shuffle_hash"), ["of_text", "id"])
        made = texts.select("same", "text").mapInPandas(lambda frames: _collect_sets(width, frames), "same binary, grams array<long>")
        return self.scratch.save(made.dropDuplicates(["same"]), "grams")

    def linked(self, pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
        """Of pairs (a, b), those linked by their full sets; a comparison for each row."""
        left, right = (sets.select(F.col("same").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
        both = pairs.join(right, "b").join(left, "a").select("a", "b", F.size("grams_a").cast("long").alias("n"), F.size("grams_b").cast("long").alias("m"), F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("both"))
        return self.scratch.save(both.where(100 * F.col("both") >= self.percent * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b"), label)

    def blocks(self, followers: DataFrame, labels: DataFrame, regs: DataFrame) -> DataFrame:
        """Followers (a: leader, b) of one leader that are in different components so far, dealt to blocks.

        A follower outside the component that most of them are in is minor;
        a block pairs some minor ones with some of all. Groups of one block are
        put together to lots. The leader itself has been compared.
        """
        rows = followers.join(labels.select(F.col("id").alias("b"), "component"), "b", "left").select(F.col("a").alias("unit"), F.col("b").alias("same"), F.coalesce("component", "b").alias("component"))
        rows = self.scratch.save(rows.join(regs.select("same", "n"), "same"), "rows")
        sizes = rows.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
        units = sizes.groupBy("unit").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("components")).where("components > 1")
        minor = F.col("k") - F.col("most.k")
        blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
        minors = F.greatest(F.ceil(minor / MINOR_BLOCK), F.ceil(minor / F.col("k") * F.col("n") / BLOCK_SHINGLES)).cast("int")
        units = self.scratch.save(units.select("unit", F.col("most.component").alias("major"), minors.alias("minors"), blocks.alias("blocks"), "k", "n"), "units")
        small = units.where("minors = 1 and blocks = 1").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
        lots = 1 + max((small["k"] or 0) // LOT_ROWS, (small["n"] or 0) // LOT_SHINGLES)
        placed = rows.join(units.drop("k", "n"), "unit")
        spread = F.xxhash64("same", "unit")
        rest = ("same", "component", "n")
        every = F.explode(F.sequence(F.lit(0), F.col("minors") - 1)), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        own = placed.where("component <> major").select("unit", F.pmod(spread, F.col("minors")).cast("int").alias("i"), every[1].alias("j"), F.lit(True).alias("minor"), "minors", "blocks", *rest)
        others = placed.select("unit", every[0].alias("i"), F.pmod(spread, F.col("blocks")).cast("int").alias("j"), F.lit(False).alias("minor"), "minors", "blocks", *rest)
        one = (F.col("minors") == 1) & (F.col("blocks") == 1)
        # Lots of small groups are numbered from 0, blocks of large ones by a hash below 0.
        lot = F.when(one, F.pmod(F.xxhash64("unit"), F.lit(lots))).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("unit", "i", "j"), 1))
        dealt = own.unionByName(others).select(lot.alias("lot"), "unit", "i", "j", "minor", *rest)
        return dealt.join(regs.select("same", "regs"), "same").select(*_MEMBER)

    def cross(self, blocks: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between members of blocks."""
        percent, least = self.percent, self.least
        likely = self.scratch.save(blocks.groupBy("lot").applyInPandas(lambda lot: _thin_blocks(percent, least, lot), _MEMBER_TYPES), "likely")
        found = likely.join(sets, "same").groupBy("lot").applyInPandas(lambda lot: _compare_blocks(percent, least, lot), "a binary, b binary")
        return self.scratch.save(found.distinct(), "more-links")


def _join_spread(rows: DataFrame, keyed: DataFrame, key: str, times: str) -> DataFrame:
    """rows joined with a written table of one row for each key, in which times is how often rows have the key.

    Keys with more than one row in HOT_SHARE are fewer than HOT_SHARE: those are
    broadcast, so that their many rows stay where they are.
    """
    total = keyed.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n")).first()["n"]
    hot = (F.col(times) > total // HOT_SHARE) & (F.col(times) > 1)
    values = [c for c in keyed.columns if c not in rows.columns and c != times]
    marked = rows.join(F.broadcast(keyed.where(hot).select(key, F.struct(*values).alias("hot"))), key, "left")
    rest = marked.where("hot is null").drop("hot").join(keyed.where(~hot).select(key, *values), key)
    return rest.unionByName(marked.where("hot is not null").select(*rows.columns, "hot.*"))


def _decide(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """For each row of df: id, of_text (a digest of the text), n, component (the smallest id of its component; null if there is none), group (what tells components apart)."""
    job = _Job(df, id_col, text_col, width, percent)
    scratch, bands, rows = job.scratch, job.bands, job.rows
    signed = scratch.save(job.docs.mapInPandas(lambda frames: _sign(width, bands, rows, frames), "id string, of_text string, n long, same binary, regs binary, bands array<long>").withColumn("id", F.col("id").cast("long")), "signed")
    some = signed.where("n > 0")
    one = F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "of_text")
    sets = scratch.save(some.groupBy("same").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"), F.min(one).alias("one")), "sets")
    # Equal sets have equal registers: any row of them will do.
    first = scratch.save(some.dropDuplicates(["same"]).select("same", "n", "regs", "bands"), "first")
    members = first.select("same", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.save(members.join(sizes, "key"), "shared")
    regs = first.select("same", "n", "regs")
    degree = shared.groupBy("same").agg(F.sum("size").alias("degree"))
    leaders = shared.join(degree, "same").groupBy("key").agg(F.max(F.struct("degree", "same")).alias("best")).select("key", F.col("best.same").alias("a"))
    followers = scratch.save(shared.join(leaders, "key").where("a <> same").select("a", F.col("same").alias("b")).distinct(), "followers")
    grams = job.collect_sets(sets, shared.select("same").distinct())
    links = job.linked(scratch.save(job.near(followers, regs), "leader-pairs"), grams, "leader-links")
    labels = components(links, scratch, "components")
    more = job.cross(job.blocks(followers, labels, regs), grams)
    if not more.isEmpty():
        labels = components(links.unionByName(more), scratch, "all-components")
    placed = scratch.save(sets.join(labels.withColumnRenamed("id", "same"), "same", "left").select("same", "least", "times", F.coalesce("component", "same").alias("group")), "placed")
    least = placed.groupBy("group").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    decided = scratch.save(_join_spread(placed.select("same", "times", "group"), scratch.save(least, "least"), "group", "members"), "decided")
    with_words = _join_spread(some.select("id", "of_text", "n", "same"), decided, "same", "times").select("id", "of_text", "n", "component", "group")
    return with_words.unionByName(signed.where("n = 0").select("id", "of_text", "n", F.col("id").alias("component"), F.lit(None).cast("binary").alias("group")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared shingles >= percent * all shingles of
    both; component_id is the smallest id that links reach, kept whether it is
    the document's own. Null, empty and white texts have no shingles and no
    links. Repeated rows share a component; rows with one id and different texts
    are documents of their own. A row with a null id links others, and gets
    their smallest id; where no row of its component has an id, component_id is
    null and kept is true. An empty table gives no rows. Other columns are not read.
    """
    rows = _decide(df, id_col, text_col, width, percent)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that stay, columns as in df: all without words, and of each component one row, that with the smallest id.

    Null ids come last; of several rows with that id, the one stays whose text
    has the least digest, and of rows that are equal in both, any one.
    """
    rows = _decide(df, id_col, text_col, width, percent)
    no_id = lambda c: c.isNull().alias("__none")
    order = F.struct(no_id(F.col("id")), "id", "of_text")
    best = rows.where("group is not null").groupBy("group").agg(F.min(order).alias("b"))
    own = lambda c: F.coalesce(c, F.lit(0))
    kept = best.select(own(F.col("b.id")).alias("__id"), F.col("b.__none").alias("__none"), F.col("b.of_text").alias("__of_text"))
    keys = ["__id", "__none", "__of_text"]
    ready = df.select("*", own(F.col(id_col).cast("long")).alias("__id"), no_id(F.col(id_col)), F.md5(text_of(text_col)).alias("__of_text"), text_of(text_col).rlike(r"[^\x20\x09-\x0D]").alias("__words"))
    chosen = ready.where("__words").join(kept, keys, "left_semi")
    # Whole rows are moved once more only where some are equal in id and text.
    if not rows.where("n > 0").groupBy("id", "of_text").count().where("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(keys)
    return chosen.unionByName(ready.where("not __words")).select(*df.columns)
