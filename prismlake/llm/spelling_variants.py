"""Words that differ by one edit, grouped under their frequent form.

A word's mask holds, for each letter, whether it occurs an odd number of times.
One inserted or deleted code point flips one bit of it, a replaced one at most
two; so of three bands of the mask, at least one is equal in two near words. An
edit also leaves what stands before or behind it as it is: half of the word is
equal too. Words are joined by an equal band, the length and an equal half,
which splits the bands' large groups; pairs whose masks differ by no more than
an edit can do are then verified. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: One of so many pairs of document and word loses a code point.
LOSS = 97
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
BANDS = 3
#: Letters a-z have bits of their own, the others share the bits above by code point: a shared bit can flip less often, never more.
_LETTERS, _BITS = 26, 60


def words_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (word) for each run of letters of all texts, A-Z as a-z, with the planned losses of a code point."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = df.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text_of(text_col), upper, lower), F.lit(RUN), 0)).alias("run"),
    )
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % LOSS == 0, shorter).otherwise(F.col("run")).alias("word"))


def letter_parity(word: Column) -> Column:
    """A bit for each letter: whether it occurs an odd number of times."""
    code = lambda c: F.ascii(c)
    bit = lambda c: F.when(code(c) < 128, code(c) - 97).otherwise(_LETTERS + (code(c) - 192) % (_BITS - _LETTERS))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int"))
    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: word.substr(i, F.lit(1)))
    return F.aggregate(letters, F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(one(c)))


def _band(k: int) -> int:
    """The bits of a band: every third letter."""
    return sum(1 << b for b in range(k, _BITS, BANDS))


def _keyed(words: DataFrame, shorter: bool) -> DataFrame:
    """A row for each band, half and word, as the shorter (or equally long) word of a pair or as the longer one.

    Halves are cut by the shorter word's length: the first half of it, or the rest counted from the end.
    """
    base = F.col("size") - (0 if shorter else 1)
    first = F.floor(base / 2).cast("int")
    half = lambda side: F.when(side == 0, F.col("word").substr(F.lit(1), first)).otherwise(F.col("word").substr(F.col("size") - (base - first) + 1, base - first))
    bands = F.array(*[F.col("mask").bitwiseAND(F.lit(_band(k))) for k in range(BANDS)])
    out = words.select("rank", "word", "size", "mask", F.posexplode(bands).alias("band", "bits"))
    out = out.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    return out.select("rank", "word", "size", "mask", "band", "side", F.xxhash64("band", "bits", "side", half(F.col("side")), base).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of ranks of words (rank, word, size, mask) that differ by exactly one inserted, deleted or replaced code point, each once.

    A pair that is joined by several bands or both halves is put out by the first of them only. The key is a hash; what it
    joins by chance is sorted out by the verification.
    """
    a = _keyed(words, True).alias("a")
    same, longer = _keyed(words, True), _keyed(words.where(F.col("size") > LEAST_LENGTH), False)
    b = same.union(longer).alias("b")
    differ = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    equal = lambda k: differ.bitwiseAND(F.lit(_band(k))) == 0
    first_band = F.when(equal(0), 0).when(equal(1), 1).otherwise(2)
    size = F.col("a.size")
    first = F.floor(size / 2).cast("int")
    starts_alike = F.col("a.word").substr(F.lit(1), first) == F.col("b.word").substr(F.lit(1), first)
    one_edit = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    lengths = (F.col("b.size") == size + 1) | ((F.col("b.size") == size) & (F.col("a.rank") < F.col("b.rank")))
    first_found = (F.col("a.band") == first_band) & (F.col("a.band") == F.col("b.band")) & (F.col("a.side") == F.col("b.side")) & (F.col("a.side") == F.when(starts_alike, 0).otherwise(1))
    found = a.join(b, F.col("a.key") == F.col("b.key")).where(lengths & (F.bit_count(differ) <= 2) & first_found & one_edit)
    return found.select(F.col("a.rank").alias("a"), F.col("b.rank").alias("b"))


def group_variants(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """For each row of counts (word, n; words distinct, not null) its form, root, n_near and form_n, as group_spelling_variants returns them."""
    # Ranks rise with falling n, then with the word: the form is the near word of least rank.
    ordered = counts.orderBy(F.desc("n"), "word").select("word", "n", F.length("word").alias("size"), letter_parity(F.col("word")).alias("mask"), F.monotonically_increasing_id().alias("rank"))
    words = scratch.save(ordered, "words")
    pairs = near_pairs(words.select("rank", "word", "size", "mask"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rank"), F.col("b").alias("near")), F.struct(F.col("b").alias("rank"), F.col("a").alias("near")))).alias("p")).select("p.*")
    near = scratch.save(both.groupBy("rank").agg(F.count("*").alias("n_near"), F.min("near").alias("form_rank")), "near")
    named = words.select(F.col("rank").alias("form_rank"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    forms = words.select("rank", "word", "n").join(near, "rank", "left").join(named, "form_rank", "left")
    holds = F.col("form_n") >= FACTOR * F.col("n")
    forms = scratch.save(forms.select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(holds, F.col(c)).alias(c) for c in ("form", "form_n", "form_rank")]), "forms")
    # n at least doubles from form to form, so chains are short, and each jump halves them.
    links = forms.where(F.col("form_rank").isNotNull()).select("rank", F.col("form_rank").alias("to"))
    most = counts.agg(F.max("n")).first()[0] or 1
    for k in range(max(1, math.ceil(math.log2(max(2.0, math.log2(most)))))):
        further = links.select(F.col("rank").alias("to"), F.col("to").alias("next"))
        links = scratch.save(links.join(further, "to", "left").select("rank", F.coalesce("next", "to").alias("to")), f"links-{k}")
    roots = links.join(words.select(F.col("rank").alias("to"), F.col("word").alias("root")), "to").select("rank", "root")
    return forms.join(roots, "rank", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF of all texts, only
    A-Z in lower case, of at least 5 code points and with at least 3 occurrences
    (n); of the runs of a document whose crc32 with its id is divisible by 97, a
    code point is deleted first. n_near counts the words that differ by exactly one
    inserted, deleted or replaced code point. form is the near word of largest n,
    ties by code points, if its n (form_n) is at least twice the word's; root is
    where forms lead to, the word itself if it has none.

    Null texts have no words; a null id counts as an empty string, and repeated
    rows count again. An empty table gives no rows; other columns are not read.
    """
    counts = words_of(df, id_col, text_col).groupBy("word").agg(F.count("*").alias("n"))
    scratch = Scratch(df.sparkSession, "spelling")
    kept = scratch.save(counts.where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH)), "counts")
    return group_variants(kept, scratch)


#: CRC-32 is spelled out, a byte at a time by a table; near words are found by deleting one code point at each place.
ORACLE_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
), counted AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS k FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(key))), lambda i: CAST(('0x' || substr(hex(encode(key)), 2 * CAST(i AS INTEGER) + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + CAST(xor(c, b) & 255 AS INTEGER)])), 4294967295) AS h
  FROM counted, steps
), results AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, n, p, substr(word, 1, CAST(p AS INTEGER) - 1) || substr(word, CAST(p AS INTEGER) + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, {'n': -near_n, 'w': encode(near)}) AS form, max(near_n) AS form_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, coalesce(form, word) AS reached, 1 AS step FROM forms
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON c.reached = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word) r ON f.word = r.word
"""
