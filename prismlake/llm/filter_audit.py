"""What filters take away in every order they could be applied in.

Each document gets a mask of the filters that it fails, and everything that is
asked for is a sum over masks: a filter at its place takes those that fail it
and none of the filters before. The one filter that looks at other documents,
duplicates, is found by sorting: rows are dealt into ranges of fingerprint and
id, sorted by fingerprint, whole text and id within, and compared with their
predecessors. A group of copies that lies across a border of two ranges is
settled by a small table of what stands at the borders. Masks then become one
row of 32 counters for each part, and the orders are read off those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_worker, prepare, text_of

FILTERS = "ABCDE"
#: Least words; least percentage of distinct ones; most percentage of capitals; marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
#: Rows (a range, a number, an id) that are broadcast at most: one a range, more only where texts share a fingerprint.
MOST_BORDERS = 100_000
_MASKS = 1 << len(FILTERS)
_DUPLICATE = 1 << FILTERS.index("E")
_NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
#: The white space that parts words, as bytes.split() takes it.
SPACES = r"[\x20\x09-\x0D]"


def mask_of(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()
    distinct, length = len(set(words)), len(text.decode())
    capitals = len(text.translate(None, _NOT_CAPITALS))
    failed = (len(words) < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * length, len(text.translate(None, MARKS)) < len(text))
    return sum(bit << k for k, bit in enumerate(failed))


@in_worker("filter_audit")
def _first_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.encode() for t in b.column("text").to_pylist()]
        prints = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column("part"), b.column("id"), pa.array(prints, pa.binary()), pa.array([mask_of(t) for t in texts], pa.int32()), b.column("text")], names=["part", "id", "print", "mask", "text"]
        )


_MASKED = "part string, id long, print binary, mask int, text string"


@in_worker("filter_audit")
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range: whether each has a predecessor of the same text and a smaller id in this range; and what stands at its borders.

    Rows of the range's first fingerprint, whose group may have begun in a range before, have the group's number in it. Border rows
    have no mask, but the text and the smallest id of each group of the first fingerprint, numbered, and of the last, not numbered.
    """
    here = TaskContext.get().partitionId()
    first_print = last = None
    smallest = 0
    groups: list[tuple[str, int]] = []
    head: list[tuple[str, int]] | None = None
    for b in batches:
        prints, texts, ids = b.column("print").to_pylist(), b.column("text").to_pylist(), b.column("id").to_pylist()
        duplicate, number = [], []
        for fingerprint, text, i in zip(prints, texts, ids, strict=True):
            if last is None:
                first_print = fingerprint
            elif last[0] != fingerprint:
                head, groups = groups if head is None else head, []
            if last != (fingerprint, text):
                last, smallest = (fingerprint, text), i
                groups.append((text, i))
            duplicate.append(i > smallest)
            number.append(len(groups) - 1 if head is None else None)
        masks = [m | (_DUPLICATE if d else 0) for m, d in zip(b.column("mask").to_pylist(), duplicate, strict=True)]
        yield _ranged(here, b.column("part"), b.column("id"), masks, number)
    if last is not None:
        first = groups if head is None else head
        borders = [(first_print, k, *g) for k, g in enumerate(first)] + ([(last[0], None, *g) for g in groups] if head is not None else [])
        prints, number, texts, ids = zip(*borders, strict=True)
        n = len(borders)
        yield _ranged(here, pa.nulls(n, pa.string()), pa.array(ids, pa.int64()), [None] * n, number, prints, texts)


_RANGED = "part string, id long, mask int, range int, number int, print binary, text string"


def _ranged(here, part, ids, masks, number, prints=None, texts=None) -> pa.RecordBatch:
    n = len(ids)
    columns = [part, ids, pa.array(masks, pa.int32()), pa.array([here] * n, pa.int32()), pa.array(number, pa.int32()), pa.array(prints or [None] * n, pa.binary()), pa.array(texts or [None] * n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "id", "mask", "range", "number", "print", "text"])


def failure_masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each row of df: part (null as an empty string), id and mask, the filters that the document fails as bits, A the lowest.

    A row fails E if a row of df with a smaller id has the same text, null counting as empty. Repeated rows have the same mask. A
    row with a null id has no smaller id before it and none after: it never fails E, and makes none fail.
    """
    spark = prepare(df.sparkSession)
    rows = df.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    masked = rows.where(F.col("id").isNotNull()).mapInArrow(_first_masks, _MASKED)
    # Ids are part of the ranges, so copies in a third of all rows lie in many of them. Texts are not: they would be sampled to the driver.
    ranges = masked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "print", "id").sortWithinPartitions("print", "text", "id")
    ranged = Scratch(spark, "filter-audit").save(ranges.mapInArrow(_compare, _RANGED), "ranged", compression="zstd")
    # A group that goes on from an earlier range has its smallest id there. One row for each range's first fingerprint, without texts.
    borders = ranged.where(F.col("mask").isNull()).groupBy("print", "text").agg(F.min("id").alias("smallest"), F.collect_list(F.struct("range", "number")).alias("places"))
    begun = Scratch(spark, "filter-borders").save(borders.select("smallest", F.explode("places").alias("p")).where("p.number is not null").select("p.range", "p.number", "smallest"), "begun")
    opened = ranged.where(F.col("mask").isNotNull() & F.col("number").isNotNull())
    found = opened.join(F.broadcast(begun) if begun.count() <= MOST_BORDERS else begun, ["range", "number"])
    settled = found.select("part", "id", F.when(F.col("id") > F.col("smallest"), F.col("mask").bitwiseOR(F.lit(_DUPLICATE))).otherwise(F.col("mask")).alias("mask"))
    closed = ranged.where(F.col("mask").isNotNull() & F.col("number").isNull()).select("part", "id", "mask")
    without = rows.where(F.col("id").isNull()).mapInArrow(_first_masks, _MASKED).select("part", "id", "mask")
    return closed.union(settled).union(without)


def count_masks(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part three arrays of 32 counts by mask: n of all, good and toxic of those that labels (doc_id, quality, toxic) call so.

    An id with several labels is good (toxic) if one of them says so. A part's counts add up from tasks; labels meet only ids and masks.
    """
    named = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    named = named.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic")
    marked = masks.where(F.col("id").isNotNull()).join(named, "id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    counted = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    of = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0).cast("long")) for m in range(_MASKS)]).alias(c)
    return counted.union(marked).groupBy("part").agg(of("n"), of("good"), of("toxic"))


def _clear(counts: str) -> Column:
    """For each set of filters, as a mask, the documents that fail none of them."""
    return F.array(*[sum((F.col(counts)[m] for m in range(1, _MASKS) if not m & s), F.col(counts)[0]) for s in range(_MASKS)])


def audit_orders(counts: DataFrame) -> DataFrame:
    """For each part of count_masks and each order of the filters and step, what the step's filter does there."""
    shares = F.array(*[sum((F.col("n")[m] * (120 // m.bit_count()) for m in range(_MASKS) if m >> k & 1), F.lit(0).cast("long")) for k in range(len(FILTERS))])
    parts = counts.select("part", "n", _clear("n").alias("clear"), _clear("good").alias("clear_good"), _clear("toxic").alias("clear_toxic"), shares.alias("shares"))
    # Every order and step: the letters, the step, the filter and the filters before it.
    steps = [(order, k + 1, FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])) for order in map("".join, permutations(FILTERS)) for k in range(len(order))]
    fields = ("filter_order", "step", "own", "before")
    plan = F.from_json(F.lit("[" + ",".join('{{"filter_order":"{}","step":{},"own":{},"before":{}}}'.format(*s) for s in steps) + "]"), "array<struct<filter_order string, step int, own int, before int>>")
    rows = parts.select("*", F.explode(plan).alias("s")).select("part", "n", "clear", "clear_good", "clear_toxic", "shares", *[F.col(f"s.{f}").alias(f) for f in fields])
    bit = F.call_function("shiftleft", F.lit(1), F.col("own"))
    after = F.col("before").bitwiseOR(bit)
    gone = lambda c: F.get(F.col(c), F.col("before")) - F.get(F.col(c), after)
    fails = F.get("clear", F.lit(0)) - F.get(F.col("clear"), bit)
    return rows.select(
        "part", "filter_order", "step", F.get(F.col("clear"), after).alias("kept"), gone("clear").alias("removed"), (fails - gone("clear")).alias("redundant"),
        F.get(F.col("n"), bit).alias("unique_fails"), gone("clear_good").alias("good_lost"), gone("clear_toxic").alias("toxic_lost"), F.get(F.col("shares"), F.col("own")).alias("shapley"),
    )


def audit_filters(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Documents fail A with under 200 words, B if under half of the words are distinct,
    C if over 2 % of the code points are A-Z, D with any of ``#$%&*|``, and E as in
    failure_masks. An empty or null text fails A only, and E with a smaller id before
    it. Counts are of df's rows within the part, repeated rows counting each;
    good_lost and toxic_lost as in count_masks. An empty table gives no rows; other
    columns are not read.
    """
    masks = Scratch(df.sparkSession, "filter-masks").save(failure_masks(df, id_col, text_col, part_col), "masks")
    return audit_orders(count_masks(masks, labels))


#: By definition: every document, order and step, without masks.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM words GROUP BY text
), failed AS (
  SELECT d.doc_id, part,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text), regexp_matches(d.text, '[#$%&*|]'), coalesce(first < d.doc_id, false)] AS f
  FROM words d JOIN firsts USING (text)
), named AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM failed LEFT JOIN named USING (doc_id)
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders), met AS (
  SELECT part, o, step, good, toxic, o[step] AS own, f[o[step]] AS fails, len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 AS before, len(list_filter(f, lambda x: x)) AS n_failed
  FROM docs, steps
), said AS (
  SELECT part, o, step, own, count(*) FILTER (NOT before AND NOT fails) AS kept, count(*) FILTER (NOT before AND fails) AS removed, count(*) FILTER (before AND fails) AS redundant,
    count(*) FILTER (fails AND n_failed = 1) AS unique_fails, count(*) FILTER (NOT before AND fails AND good) AS good_lost, count(*) FILTER (NOT before AND fails AND toxic) AS toxic_lost
  FROM met GROUP BY part, o, step, own
)
SELECT part, list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM said
"""
