"""Exact deduplication on text without white space, with DataFrame functions only.

Texts are grouped by a 128-bit content hash together with the normalised bytes
themselves, so two texts that collide in the hash stay apart. Spark aggregates
within each map task before the shuffle: a text copied into a third of all rows
crosses the network once for each task. The decision is joined back by digests,
without texts; a group that is much larger than others is split by Spark's
skew-join handling, since both sides are plain exchanges. Where only one row of
each group is wanted, the aggregation itself carries it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Deleted before texts are compared.
SPACES = r"[\x20\x09-\x0D]+"
_SHIFT, _MIDDLE = Decimal(2**65), Decimal(2**63)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, text_sha256.

    Of texts that are equal without white space, the row with the most code
    points in the original text stays, then the one with the smallest id, null
    ids last.

    Null texts count as empty, and all texts without other characters form one
    group. Repeated rows count in group_size and share one decision: kept says
    that a row has the id and the length of the one that stays, so rows alike in
    both are all kept here (keep_first_copies leaves one). keep_id is null where a row with a
    null id stays. An empty table gives no rows. Other columns, whatever
    their names, are not read.
    """
    text = text_of(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.char_length(text).alias("n"), F.regexp_replace(text, SPACES, "").alias("bare"))
    digests = (F.unhex(F.md5("bare")).alias("h128"), F.unhex(F.sha2("bare", 256)).alias("h256"))
    # One number that orders by length, then by smaller id, null last: a fixed-width buffer,
    # so that Spark aggregates in a hash map instead of sorting whole texts.
    wide = lambda x: x.cast("decimal(21,0)")
    rank = F.coalesce(wide(F.lit(_MIDDLE)) - wide(F.col("id")), wide(F.lit(0)))
    order = (F.col("n").cast("decimal(12,0)") * wide(F.lit(_SHIFT)) + rank).cast("decimal(38,0)")
    groups = rows.groupBy(F.unhex(F.md5("bare")).alias("h128"), "bare").agg(F.count(F.lit(1)).alias("group_size"), F.max(order).alias("best"))
    low = F.pmod(F.col("best"), wide(F.lit(_SHIFT)))
    best_id = F.when(low > 0, (wide(F.lit(_MIDDLE)) - low).cast("long"))
    decided = groups.select("h128", F.unhex(F.sha2("bare", 256)).alias("h256"), "group_size", best_id.alias("keep_id"), ((F.col("best") - low) / wide(F.lit(_SHIFT))).cast("long").alias("most"))
    return rows.select("id", "n", *digests).join(decided, ["h128", "h256"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("most"))).alias("kept"), F.lower(F.hex("h256")).alias("text_sha256")
    )


def keep_first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of texts that are equal without white space, columns as in df.

    The row is chosen as in exact_dedup, among rows and not ids: of repeated rows
    one stays, and rows with one id and different texts are apart. A row with a
    null id stays if no other row has its text.
    """
    text, bare = text_of(text_col), F.regexp_replace(text_of(text_col), SPACES, "")
    order = F.struct(F.char_length(text).alias("n"), (-1 - F.col(id_col).cast("long")).alias("rank"))
    best = df.groupBy(F.unhex(F.md5(bare)).alias("__h128"), bare.alias("__bare")).agg(F.max_by(F.struct("*"), order).alias("__row"))
    return best.select("__row.*")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
