import hashlib
import zlib

import numpy as np
import pytest

from prismlake.llm import bpe_lexicon as B
from prismlake.llm import packing as P
from prismlake.llm import tokens as T
from prismlake.llm import wavelet as W
from prismlake.llm.common import Scratch

ODD = ["", " ", "\n", "a", "a\n", "\na", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "tab\tx", "it's we'll I'D", "12 345,6", "a" * 700, "é" * 300, "日本語 ՘ 😀", "x<|endoftext|>y <|endoftext|>", "nb sp \u0085", "end.\r\n", "!!! $$$ ...", "ß ǅ ʰ ²³ ½", "\x00 \x7f \x1c", "aaaa aaaaa aaa"]


@pytest.fixture(scope="module")
def library():
    return T.PieceEncoder().library


def expected(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("kept", [0, 50, 10**6])
def test_pieces_are_encoded_as_the_library_does(library, sample_texts, kept, monkeypatch):
    monkeypatch.setattr(T, "CACHED_PIECES", kept)
    texts = ODD + list(sample_texts.values())[:60]
    own = T.PieceEncoder()
    for first in range(0, len(texts), 7):
        lot = texts[first : first + 7]
        assert own.encode(lot) == [expected(library, t) for t in lot]


def test_lexicon_and_merges_are_exact(library, sample_texts):
    merges = B.Merges()
    words = [w for w in {w for t in sample_texts.values() for w in t.split()} if w][:3000]
    one = [np.array(merges.one(w.encode()), "<u4").tobytes() for w in words]
    assert merges.many([w.encode() for w in words]) == one == [expected(library, w) for w in words]
    half = {(" " + w).encode(): expected(library, " " + w) for w in words[::2]}
    own = B.LexiconEncoder(B.Lexicon(B.compile_lexicon(half)))
    for t in ODD + list(sample_texts.values())[:60]:
        ids = own.encode([t])[0]
        assert ids == expected(library, t), t
        got = np.frombuffer(ids, "<u4").tolist()
        assert own.decode(got) == library.decode(got, skip_special_tokens=False)


def test_automaton_is_minimal_and_numbers_words():
    words = {w.encode(): bytes(4 * (i % 3 + 1)) for i, w in enumerate(["walking", "talking", "walked", "talked", "walk", "talk", "a", "", "é"])}
    raw = B.compile_lexicon(words)
    lexicon = B.Lexicon(raw)
    assert sorted(lexicon.numbers(list(words)).tolist()) == list(range(len(words)))
    assert all(lexicon.ids_of(k) == words[w] for w, k in zip(words, lexicon.numbers(list(words)).tolist(), strict=True))
    assert lexicon.numbers([b"wal", b"walks", b"b", b"\xff"]).tolist() == [-1] * 4
    # walk and talk share all states after the first letter
    alone = B.Lexicon(B.compile_lexicon({w: b"" for w in words if w[:1] != b"t"}))
    assert len(lexicon.keys) == len(alone.keys) + 1
    assert B.Lexicon(B.compile_lexicon({})).numbers([b"a"]).tolist() == [-1]


def test_round_trip_of_awkward_rows(docs, texts, library):
    rows = B.round_trip(docs).collect()
    assert len(rows) == 14
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert B.round_trip(docs.where("false")).count() == 0


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (511, 2), (512, 50_000), (5000, 50_000), (3000, 70_000)])
def test_wavelet_matrix_answers_by_rank_and_select(n, top):
    ids = np.random.default_rng(n).zipf(1.4, n).clip(0, top - 1).astype(np.uint32)
    shard = W.Shard(W.pack_shard(ids, np.array([7]), np.array([n])))
    assert (shard.decode() == ids).all() and shard.doc_ids.tolist() == [7]
    for i in range(0, n, max(1, n // 40)):
        t = int(ids[i])
        before = int((ids[:i] == t).sum())
        assert shard.access(i) == t and shard.count(t, 0, i) == before and shard.locate(t, before) == i
    assert shard.count(1 << 25) == 0
    with pytest.raises(IndexError):
        shard.locate(0, n + 1)
    with pytest.raises(ValueError):
        W.Shard(b"x" * 64)


def test_shards_hold_all_documents_in_order(spark, docs, texts, library):
    shards = W.write_shards(docs, Scratch(spark, "t"), shard_ids=50, partitions=3)
    rows = sorted(tuple(r) for r in W.read_documents(shards).collect())
    assert shards.count() > 3 and len(rows) == 14
    start = 0
    for doc_id, at, n, crc in sorted(rows, key=lambda r: (r[0], r[1])):
        ids = expected(library, texts[doc_id]) + bytes(4)
        assert (at, n, crc) == (start, len(ids) // 4, zlib.crc32(ids))
        start += n
    assert W.read_documents(W.write_shards(docs.where("false"), Scratch(spark, "t"))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_solutions_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [(int(x), int(rng.integers(1, 40))) for x in rng.choice(np.arange(1, 101), 30, replace=False)]
    least = -(-sum(x * n for x, n in lengths) // 100)
    greedy = P.pack_in_order(sorted(lengths, reverse=True), 100)
    people = P.evolve(lengths, 100, seed, [], 8, 6)
    for s in [greedy, *people, P.pack_exactly(lengths, 100, P.random.Random(1))]:
        held = P.Counter()
        for p, n in s.items():
            assert sum(p) <= 100
            for x in p:
                held[x] += n
        assert held == dict(lengths)
    assert least <= P.cost(people[0], 100)[0] <= P.cost(greedy, 100)[0]


def test_packed_documents(spark, docs, texts, library):
    rows = P.pack_documents(docs, capacity=16).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"], np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = b"".join(p[4] for p in sorted(pieces))
        assert ids == expected(library, texts[doc_id]) + (2).to_bytes(4, "little")
        assert all(zlib.crc32(p[4]) == p[3] for p in pieces) and [p[2] for p in sorted(pieces)][1:] == [16] * (len(pieces) - 1)
    assert P.pack_documents(docs.where("false")).count() == 0


def test_sequences_of_the_sample_are_few(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.pack_documents(docs).select("sequence_id", "length").toPandas()
    total = rows.groupby("sequence_id")["length"].sum()
    least = -(-int(rows["length"].sum()) // P.CAPACITY)
    assert total.max() <= P.CAPACITY and len(total) <= least * 1.002 + 1, (len(total), least)


def test_rows_of_one_id_are_dealt_over_parts(spark, library):
    """A third of all rows and more may have one id: their texts share them out, and no row is lost."""
    rows = [(7, f"text number {i}") for i in range(600)] + [(i, "other") for i in range(8, 20)] + [(None, f"none {i}") for i in range(40)]
    shards = W.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "hot"), partitions=4)
    assert shards.select("part").distinct().count() == 4
    got = W.read_documents(shards).orderBy("start").collect()
    assert len(got) == len(rows) and [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert sum(r["n_tokens"] for r in got) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
