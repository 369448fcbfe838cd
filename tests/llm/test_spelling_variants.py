import re
import zlib
from collections import Counter

from helpers import duck
from pyspark.sql import functions as F

from prismlake.llm import registry
from prismlake.llm import spelling_variants as S
from prismlake.llm.common import Scratch

LOWER = {i: i + 32 for i in range(65, 91)}


def near(a, b):
    """By definition: one code point replaced, or one deleted from the longer word."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(n):
    out = []
    forms, counts = {}, {}
    for w in n:
        around = [v for v in n if near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None
        counts[w] = len(around)
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], counts[w], n[forms[w]] if forms[w] else None))
    return sorted(out)


def brute_counts(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in seen.items() if k >= 3 and len(w) >= 5}


def as_rows(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_against_brute_force_on_words_that_are_often_near(spark):
    import random

    rng = random.Random(2)
    words = {"".join(rng.choice("abÉé÷ß") for _ in range(rng.randint(5, 7))) for _ in range(500)} | {"letter", "leter", "lettre", "étter", "Étter"}
    n = {w: rng.choice([3, 3, 4, 7, 20, 60]) for w in sorted(words)}
    got = S.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"), Scratch(spark, "test-spelling"))
    assert as_rows(got) == brute_groups(n)


def test_masks_flip_two_bits_at_most(spark):
    pairs = [("letter", "leter"), ("letter", "litter"), ("École", "école"), ("zoëßÿ", "zoëÿ"), ("aaaaa", "aaaa")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for r in rows.select(F.bit_count(S.letter_parity(F.col("a")).bitwiseXOR(S.letter_parity(F.col("b")))).alias("k")).collect():
        assert r["k"] <= 2
    one = spark.createDataFrame([("abcab", "zÿ")], "a string, b string").select(S.letter_parity(F.col("a")).alias("a"), S.letter_parity(F.col("b")).alias("b")).first()
    assert one["a"] == 4 and one["b"] == (1 << 25) + (1 << (26 + (0xFF - 0xC0) % 34))
    assert sum(S._band(k) for k in range(3)) == (1 << 60) - 1


def test_long_chains_of_forms_reach_their_root(spark):
    words = [("a" * k + "x" * (40 - k), 3 * 2**k) for k in range(20)]
    got = as_rows(S.group_variants(spark.createDataFrame(words, "word string, n long"), Scratch(spark, "test-chain")))
    assert got == brute_groups(dict(words)) and {r[2] for r in got} == {words[-1][0]}


def test_awkward_rows(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    more = [(None, "colour colour colour color"), (20, "Color color color colors COLOUR"), (20, "Color color color colors COLOUR"), (21, None), (22, "Ärger Ärger ärger ärger ärger ärger Ärger"), (23, "a" * 200_000 + " word")]
    df = docs.select("doc_id", "text", "id", "n", "key", "a", "b", "words").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert as_rows(S.group_spelling_variants(df)) == brute_groups(brute_counts(rows + more))
    assert S.group_spelling_variants(docs.where("false")).count() == 0


def test_losses_and_counts_of_the_sample(spark, sample, sample_texts):
    got = S.words_of(sample).groupBy("word").count().where("count >= 3 and length(word) >= 5").collect()
    assert {r["word"]: r["count"] for r in got} == brute_counts(sample_texts.items())


def test_query_and_sql_agree(spark):
    sf = "/root/testdata/sf0.001"
    got = as_rows(registry.queries()["op12_parity_spelling_variants"](spark, sf))
    assert got and got == sorted(duck(sf).sql(registry.oracle_sql()["op12_parity_spelling_variants"]).fetchall())
