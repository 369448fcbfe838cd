import hashlib
import re

from helpers import duck

from prismlake.llm import exact_dedup as E
from prismlake.llm import registry

SPACES = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACES.sub("", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        bare = SPACES.sub("", t or "")
        keep = min(groups[bare])[1]
        out.append((i, keep, len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in E.exact_dedup(docs).collect())
    assert got == brute(rows)
    assert {r[1] for r in got if r[0] in (1, 2, 3)} == {3}  # the longest original stays
    assert {r[1] for r in got if r[0] in (4, 5, 6)} == {6}


def test_ties_go_to_the_smallest_id_and_extremes_are_exact(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([(big, "ab"), (-big - 1, "ab"), (0, "a b"), (5, "xy"), (-7, "xy")], "doc_id long, text string")
    keep = {r["doc_id"]: r["keep_id"] for r in E.exact_dedup(df).collect()}
    assert keep == {big: 0, -big - 1: 0, 0: 0, 5: -7, -7: -7}
    assert E.exact_dedup(df.where("doc_id <> 0 and doc_id <> 5 and doc_id <> -7")).select("keep_id").distinct().first()[0] == -big - 1


def test_rows_stay_as_they_are(docs):
    kept = E.keep_first_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {3, 6, 7, 8, 9}
    assert E.exact_dedup(docs.where("false")).count() == 0


def test_query_and_sql_agree(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in registry.queries()["op1_exact_dedup"](spark, sf).collect())
    assert got == sorted(duck(sf).sql(registry.oracle_sql()["op1_exact_dedup"]).fetchall())


def test_rows_with_one_id_or_none_are_chosen_as_rows(spark):
    rows = [(7, "x"), (7, "x"), (8, "x"), (7, "other"), (None, "x y"), (None, "alone"), (None, "alone"), (3, None), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in E.keep_first_copies(df).collect())))
    assert kept == sorted(map(str, [(7, "x"), (7, "other"), (None, "x y"), (None, "alone"), (4, " ")]))
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in E.exact_dedup(df).collect())
    assert got == sorted([("7", "7", 3, True), ("7", "7", 3, True), ("8", "7", 3, False), ("7", "7", 1, True), ("None", "None", 1, True), ("None", "None", 2, True), ("None", "None", 2, True), ("3", "4", 2, False), ("4", "4", 2, True)])
