import re
from collections import Counter
from itertools import permutations

from helpers import duck

from prismlake.llm import filter_audit as A
from prismlake.llm import registry

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    """By definition, for (id, text, part) rows: the letters of failed filters."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = SPACES.findall(t)
        f = ""
        f += "A" * (len(words) < 200)
        f += "B" * (100 * len(set(words)) < 50 * len(words))
        f += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t))
        f += "D" * any(c in "#$%&*|" for c in t)
        f += "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        out.append(f)
    return out


def brute(rows, good, toxic):
    said = Counter()
    failed = failures(rows)
    parts = {p or "" for _, _, p in rows}
    for part in parts:
        own = [(i, set(f)) for (i, _, p), f in zip(rows, failed, strict=True) if (p or "") == part]
        lost = {}
        for order in map("".join, permutations("ABCDE")):
            left = list(range(len(own)))
            for step, letter in enumerate(order, 1):
                gone = [k for k in left if letter in own[k][1]]
                left = [k for k in left if letter not in own[k][1]]
                lost[letter] = lost.get(letter, 0) + len(gone)
                said[part, order, step] = (
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == {letter} for _, f in own), sum(own[k][0] in good for k in gone), sum(own[k][0] in toxic for k in gone), letter,
                )
        for key in said:
            if key[0] == part:
                said[key] = (*said[key][:6], lost[said[key][6]])
    return dict(said)


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_against_brute_force(spark, docs):
    text = " ".join(f"w{k}" for k in range(250))
    more = [(30, text, "a"), (31, text, "b"), (29, text + " $", "a"), (32, text + " $", None), (32, text + " $", None), (None, text, "a"), (None, None, ""), (33, "A " * 400, "a"), (34, "A " * 400, "c"), (1 << 60, "", "zz")]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] + more
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(30, 1, 0), (31, 0, 1), (32, 1, 1), (32, 0, None), (None, 1, 1), (33, None, 1), (7, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = as_dict(A.audit_filters(df, labels))
    assert got == brute(rows, {30, 32, 7}, {31, 32, 33})
    assert len(got) == 600 * len({p or "" for _, _, p in rows})
    assert A.audit_filters(df.where("false"), labels).count() == 0
    assert len(as_dict(A.audit_filters(df, labels.where("false")))) == len(got)


def test_a_group_of_copies_over_many_ranges(spark):
    """A third of all rows are one text, ids in no order; ranges have a few rows each."""
    hot, other = "the same words again", "other words"
    rows = [((k * 7919) % 3001, hot if k % 3 == 0 else f"text {k % 500}", "s") for k in range(3000)] + [(5000, other, "s"), (4999, other, "s")]
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        masks = {r["id"]: r["mask"] for r in A.failure_masks(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    first = {}
    for i, t, _ in rows:
        first[t] = min(first.get(t, i), i)
    assert len(masks) == len(rows)
    assert {i for i, m in masks.items() if m >> 4} == {i for i, t, _ in rows if i > first[t]}


def test_texts_with_one_fingerprint_stay_apart(spark, monkeypatch):
    """All fingerprints equal: whole texts decide, also over borders of ranges."""
    import pyarrow as pa

    one_print = A._first_masks

    def collide(batches):
        for b in one_print(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([b"\0"] * b.num_rows, pa.binary()), *b.columns[3:]], names=b.schema.names)

    monkeypatch.setattr(A, "_first_masks", collide)
    rows = [((k * 37) % 401, f"text {k % 6}", "s") for k in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        masks = {r["id"]: r["mask"] for r in A.failure_masks(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    first = {}
    for i, t, _ in rows:
        first[t] = min(first.get(t, i), i)
    assert {i for i, m in masks.items() if m >> 4} == {i for i, t, _ in rows if i > first[t]}


def test_very_long_text():
    assert A.mask_of(("word " * 1_000_000).encode()) == 0b00010
    assert A.mask_of(b"") == 1 and A.mask_of("É Ü".encode()) == 1 and A.mask_of(b"x" * 49 + b"X") == 1 and A.mask_of(b"x" * 48 + b"X") == 0b101
    assert A.mask_of("\xa0".join("abc").encode()) == 1  # no white space between words


def test_query_and_sql_agree(spark):
    sf = "/root/testdata/sf0.001"
    got = as_dict(registry.queries()["op13_filter_interaction_audit"](spark, sf))
    c = duck(sf)
    rel = c.sql(registry.oracle_sql()["op13_filter_interaction_audit"])
    want = {tuple(dict(zip(rel.columns, r, strict=True))[k] for k in ("part", "filter_order", "step")): tuple(dict(zip(rel.columns, r, strict=True))[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rel.fetchall()}
    assert got == want and len(got) % 600 == 0
