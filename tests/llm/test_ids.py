"""Ids beside a null are exact in every operator, and rows without an id have a result."""

import pytest

from prismlake.llm import ann_tree, bayes_quality, bpe_lexicon, exact_dedup, feistel_pii, hmm_scoring, near_dedup, packing, secret_scan, wavelet
from prismlake.llm.common import Scratch

BIG = 2**53 + 1
IDS = [None, BIG, BIG + 2, -5, -(2**63), 2**63 - 1, None]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"some words of text number {k} and a few more", "en", "a") for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


RUNS = {
    "op1": exact_dedup.exact_dedup,
    "op3": near_dedup.near_duplicates,
    "op4": lambda df: wavelet.read_documents(wavelet.write_shards(df, Scratch(df.sparkSession, "t"), partitions=2)),
    "op5": packing.pack_documents,
    "op6": secret_scan.scan_secrets,
    "op7": lambda df: bayes_quality.classify(df, df.select("doc_id", df["doc_id"].isNotNull().cast("int").alias("quality"))),
    "op8": lambda df: feistel_pii.pseudonymise(df, key="k"),
    "op9": bpe_lexicon.round_trip,
    "op9 encode": lambda df: bpe_lexicon.encode_documents(df).withColumnRenamed("id", "doc_id"),
    "op10": hmm_scoring.score_documents,
    "exact copies": exact_dedup.keep_first_copies,
    "near copies": near_dedup.keep_one_of_each,
}


@pytest.mark.parametrize("name", list(RUNS))
def test_ids_are_exact_beside_nulls(odd, name):
    got = [r["doc_id"] for r in RUNS[name](odd).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted(IDS, key=str)


def test_vector_ids_are_exact_beside_nulls(spark):
    rows = [(i, [float(k), 1.0, float(k * k)]) for k, i in enumerate(IDS)] + [(50 * 2**54, [1.0, 1.0, 1.0])]
    got = ann_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=9)[0].collect()
    assert {r["vec_id"] for r in got if r["query_id"] == 50 * 2**54} == set(IDS) - {None}


def test_shards_as_mapped_files(spark, odd, tmp_path):
    shards = wavelet.write_shards(odd, Scratch(spark, "t"), shard_ids=20, partitions=2)
    files = wavelet.export_shards(shards, str(tmp_path / "shards")).orderBy("part", "number").collect()
    opened = [wavelet.Shard.open(f["path"]) for f in files]
    assert len(opened) > 1 and sum(s.without_id for s in opened) == 2
    assert [i for s in opened for i in s.doc_ids.tolist()[s.without_id :]] == sorted(i for i in IDS if i is not None)
    assert sum(s.count(0) for s in opened) == len(IDS)
