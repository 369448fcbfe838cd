import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismlake.llm import prefix_tokens as P
from prismlake.llm import registry, tokens

ALPHABET = " \n\t'abrevlsdé12.,!ñ漢字🙂\xa0　"
HARD = [
    "", "don't we're they've 'll I'll x're ''re", "a  b\n\n c \n d", "<|endoftext|>x <|endoftext|><|endof", "<|<|endoftext|> ", "    hello     world   ", "漢字かな混じり文", "a" * 300,
    " " * 40 + "x", "\n" * 9 + "y", "tail<|endoftext|>", "é" * 70, "x" * 65 + " y", "'re", "\x85\x1c x",
]


@pytest.fixture(scope="module")
def own():
    return P.PrefixCounter()


def brute(own, text):
    return [len(own.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_every_prefix_as_the_library_counts_it(own):
    rng = random.Random(1)
    for text in [*HARD, *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(200))]:
        assert P.prefix_counts_of(own.stored([text])[0]).tolist() == brute(own, text), text


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=0, max_size=25))
def test_any_text(text):
    own = P.counter(tokens.DEFAULT_VOCABULARY)
    assert P.prefix_counts_of(own.stored([text])[0]).tolist() == brute(own, text)


def test_prefixes_of_documents(own, sample_texts):
    for text in list(sample_texts.values())[:40]:
        text = text[:250]
        assert P.prefix_counts_of(own.stored([text])[0]).tolist() == brute(own, text)


def test_words_alone_and_together_are_counted_alike(own):
    words = [" hello", "unbelievably", "naïveté", "日本語日本語", "x" * 64, "\t\t", "éé"]
    for w, steps in zip(words, own.steps_of_words(words), strict=True):
        counts = own._one(w.encode())
        assert np.cumsum(steps).tolist() == [counts[len(w[:k].encode())] for k in range(1, len(w) + 1)]


def test_very_long_text(own):
    text = "word after word, " * 70_000 + "x" * 50_000
    counts = P.prefix_counts_of(own.stored([text])[0])
    assert len(counts) == len(text) + 1 and counts[-1] == len(own.library.encode(text, add_special_tokens=False).ids)


def test_steps_beyond_a_byte_are_stored_wide(own):
    raw = b"\x04" + np.array([200, -100, 1], "<i4").tobytes()
    assert P.prefix_counts_of(raw).tolist() == [0, 200, 100, 101]
    assert P.prefix_counts_of(b"\x01").tolist() == [0]


def test_query_on_awkward_rows(spark, own, docs):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in P.count_tokens(docs).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        text = r["text"] or ""
        n = len(own.library.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 1024))
    assert got == sorted(want)
    assert P.count_tokens(docs.where("false")).count() == 0
    ids = spark.createDataFrame([(None, "a b"), (2**62 + 1, "c"), (2**62 + 1, "c")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in P.count_tokens(ids).collect()) == sorted([str(2**62 + 1)] * 2 + ["None"])


def test_budgets_and_cuts_from_what_is_stored(spark, own, docs):
    texts = ["strawberries and unbelievable words", "", "漢字かな", "a  b  "]
    stored = P.store_prefix_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    for limit in (0, 1, 3, 100):
        for r in P.answer_budgets(stored, (limit,)).collect():
            counts = brute(own, texts[int(r["id"])])
            assert r["fits"][0] == max(k for k, n in enumerate(counts) if n <= limit)
    for r in P.tokens_at(stored, [0, 2, 99]).collect():
        counts = brute(own, texts[int(r["id"])])
        assert r["n_tokens"] == [0, counts[min(2, len(counts) - 1)], counts[-1]]
    with pytest.raises(ValueError):
        P.answer_budgets(stored, (-1,))
    cut = P.truncate(docs, 5)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    for r in cut.select("doc_id", "text").collect():
        assert r["text"] is None or brute(own, r["text"])[-1] <= 5 or r["text"] == ""


def test_the_whole_sample(spark, own, sample_texts):
    rows = registry.queries()["op11_prefix_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(own.library.encode(t, add_special_tokens=False).ids) for i, t in sample_texts.items()}
    assert all((r["fit_chars"] < len(sample_texts[r["doc_id"]])) or not r["over_limit"] for r in rows)


def test_merges_out_of_order_are_refused():
    class Odd:
        width, rank_of, made_of_rank = 10, {4 * 10 + 1: 0, 1 * 10 + 2: 1}, [5, 4]

    with pytest.raises(ValueError):
        P.Borders(Odd())


def test_stored_counts_outlive_the_read(spark, docs):
    from prismlake.llm.common import Scratch

    kept = Scratch(spark, "test-prefix").save(P.store_prefix_counts(docs), "stored")
    assert kept.where(F.octet_length("steps") == 1).count() == 2  # the null and the empty text
