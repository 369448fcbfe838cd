import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from prismlake.llm import near_dedup as N
from prismlake.llm.common import Scratch
from prismlake.llm.components import components


def brute(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    where, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for own in where.values():
        shared.update((a, b) for k, b in enumerate(own) for a in own[:k])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def result(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, **kw).collect()}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_sample_documents(sample, sample_texts, width, percent):
    assert result(sample, width=width, percent=percent) == brute(sample_texts, width, percent)


def test_awkward_rows(docs, texts):
    got = N.near_duplicates(docs, width=3, percent=85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(texts, 3, 85)
    assert got.count() == 14 and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())
    assert N.near_duplicates(docs.where("false")).count() == 0
    assert N.keep_one_of_each(docs).columns == docs.columns


def test_a_large_group_with_members_at_all_distances(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(160):  # some follow the leader, some only one another, some nothing
        w = list(base)
        for k in rng.choice(150, size=int(rng.integers(0, 9)), replace=False):
            w[k] = f"x{rng.integers(10**9)}"
        texts[i] = " ".join(w)
    far = list(base)
    for k in range(0, 150, 19):
        far[k] = f"far{k}"
    for i in range(160, 180):
        w = list(far)
        w[int(rng.integers(150))] = f"y{i}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert result(df, width=3, percent=85) == brute(texts, 3, 85)


def test_blocks_count_exactly():
    rng = np.random.default_rng(1)
    make = lambda n: [np.unique(rng.integers(0, 300, int(rng.integers(1, 80)))).astype(np.int64) for _ in range(n)]
    a, b = make(13), make(17)
    assert (N.shared_counts(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_estimates_are_close_to_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.5, 0.9):
        both = rng.integers(0, 2**63, int(2000 * share)).astype(np.uint64)
        x, y = (np.unique(np.concatenate((both, rng.integers(0, 2**63, 2000 - len(both)).astype(np.uint64)))) for _ in range(2))
        true = len(both) / (len(x) + len(y) - len(both))
        r = N.registers([x, y], 960)
        assert N.estimate(r[:1], r[1:], np.array([len(x)]), np.array([len(y)]))[0] == pytest.approx(true, abs=0.06)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(500, 560)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        return i if up[i] == i else root(up[i])

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df, Scratch(spark, "t"), "c").collect()}
    assert got == {i: root(i) for i in up}
    assert components(df.where("false"), Scratch(spark, "t"), "e").count() == 0


def test_an_id_with_several_texts_and_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    t = " ".join(words)
    rows = [(1, "short"), (1, t), (2, t + " extra"), (3, t + " more"), (None, t + " other"), (None, "alone here"), (9, "same text now"), (9, "same text now"), (None, "same text now"), (7, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in N.near_duplicates(df, width=3, percent=85).collect())
    assert got == sorted([("1", 1, "1", True), ("1", 58, "1", True), ("2", 59, "1", False), ("3", 59, "1", False), ("None", 59, "1", False), ("None", 1, "None", True), ("9", 1, "9", True), ("9", 1, "9", True), ("None", 1, "9", False), ("7", 0, "7", True), ("7", 0, "7", True)])
    kept = sorted(str((r["doc_id"], r["text"])) for r in N.keep_one_of_each(df, width=3, percent=85).collect())
    assert kept == sorted(map(str, [(1, "short"), (1, t), (None, "alone here"), (9, "same text now"), (7, ""), (7, None)]))


def test_template_pages_that_are_half_alike(spark):
    rng = np.random.default_rng(4)
    frame = [f"t{i}" for i in range(80)]
    texts = {i: " ".join(frame + [f"v{rng.integers(10**9)}" for _ in range(38)]) for i in range(600)}
    for i in range(600, 640):  # some have a near copy
        texts[i] = texts[i - 600] + f" tail{i}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert result(df, width=3, percent=85) == brute(texts, 3, 85)


def test_estimates_are_cut_where_few_links_are_lost():
    for threshold, count in ((0.85, 120), (0.8, 120)):
        below = N.least_estimate(threshold, count) * count + 1
        lost = sum(math.comb(count, x) * threshold**x * (1 - threshold) ** (count - x) for x in range(round(below)))
        more = lost + math.comb(count, round(below)) * threshold ** round(below) * (1 - threshold) ** (count - round(below))
        assert lost <= N.MISS < more


def test_a_block_puts_out_a_spanning_forest():
    """200 alike members, none in a component yet: 199 links, not one for each pair."""
    import pandas as pd

    grams = np.sort(N.shingle_sets(["one two three four five six seven eight nine ten"], 3)[0])
    same = [bytes([k]) * 16 for k in range(200)]
    regs = np.zeros(120, np.uint16).tobytes()
    member = {"lot": 0, "unit": b"u", "i": 0, "j": 0}
    rows = [member | {"minor": m, "same": s, "component": s, "n": len(grams), "regs": regs, "grams": grams} for m in (True, False) for s in same]
    got = N._compare_blocks(85, 0.0, pd.DataFrame(rows))
    assert len(got) == 199
    joined = {s: s for s in same}
    for a, b in zip(got["a"], got["b"], strict=True):
        old, new = joined[b], joined[a]
        joined = {k: new if v == old else v for k, v in joined.items()}
    assert len(set(joined.values())) == 1


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(0)
    for n, m in ((1, 0), (10, 5), (60, 200), (300, 250)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)

        def groups(pairs):
            at = list(range(n))
            for x, y in pairs:
                at = [at[x] if v == at[y] else v for v in at]
            return [[i for i in range(n) if at[i] == at[k]] for k in range(n)]

        some = N._spanning(a, b)
        assert groups(zip(a, b, strict=True)) == groups(zip(a[some], b[some], strict=True)) and len(some) < max(n, 1)


def test_a_similarity_below_the_bands_is_refused(docs):
    with pytest.raises(ValueError, match="0.8"):
        N.near_duplicates(docs, width=5, percent=79)
