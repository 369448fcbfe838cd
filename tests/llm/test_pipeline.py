import importlib
import re

import numpy as np
from test_near_dedup import brute

import corpus_pipeline as P
from prismlake.llm import registry
from prismlake.llm.common import Scratch
from prismlake.llm.tokens import PieceEncoder

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, columns = Scratch(spark, "t"), docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() <= sizes[-1]
        sizes.append(docs.count())
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "pii":
            assert all(before[k] == v for k, v in after.items())
        else:
            assert set(after) == set(before)
        before = after
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]
    assert not any(labels.get(k) == 0 for k in before)
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(before)


def test_stages_bear_awkward_rows(spark, docs):
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= 14, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert P.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == 13


def test_run_gives_the_last_stage(spark):
    rows = P.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows.columns) and rows.count()
    full = rows.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert full.max() <= 1024 and np.isfinite(full).all()


def test_everything_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and set(registry.oracle_sql()) == {"op1_exact_dedup", "op12_parity_spelling_variants", "op13_filter_interaction_audit"}


def test_deduplication_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, best = dict(P.STAGES), {}
    for r in docs.collect():
        bare = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[bare] = min(best.get(bare, (0, 1 << 62)), (-len(r["text"] or ""), r["doc_id"]))
    exact = Scratch(spark, "t").save(stages["exact_dedup"](spark, docs, SF), "exact")
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(i for _, i in best.values())
    texts = {r["doc_id"]: r["text"] or "" for r in exact.collect()}
    near = stages["near_dedup"](spark, exact, SF)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, (_, c) in brute(texts, 5, 80).items() if i == c)


def test_packed_sequences_hold_the_library_s_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library, pieces = PieceEncoder().library, {}
    rows = P.STAGES[-1][1](spark, docs, SF).collect()
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], np.frombuffer(r["ids"], "<u2").tolist()))
    for r in docs.collect():
        got = [i for _, x in sorted(pieces[r["doc_id"]]) for i in x]
        assert got == [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 1024
