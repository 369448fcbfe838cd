"""The whole classifier against a plain version: loops over documents, sites as dictionaries."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from prismlake.llm import bayes_quality as Q

SF = "/root/testdata/sf0.001"


def features(text):
    raw = text.encode()
    groups = Counter()
    for b in raw:
        c = chr(b)
        groups["lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit() and b < 128 else "space" if c == " " else "line" if c == "\n" else "high" if b > 127 else c if c in Q._MARKS else "other"] += 1
    order = ["other", "lower", "upper", "digit", "space", "line", "high", *Q._MARKS]
    words, lines = re.findall(r"\S+", text), text.split("\n")
    n = max(1, len(words))
    tail = [math.log(1 + len(words)) / 4, min(4.0, len(raw) / n / 10), len(set(words)) / n, 1 - len(set(lines)) / len(lines), sum(w.isupper() for w in words) / n, sum(w.isalpha() for w in words) / n]
    return [math.sqrt(groups[k] / max(1, len(raw))) for k in order] + tail


def plain(rows, labels):
    """doc_id -> (evidence, posterior); the penalised likelihood is climbed step by step."""
    x = {i: np.array(features(t or "")) for i, t, _, _ in rows}
    known = [i for i in sorted(x) if i in labels]
    z = np.array([x[i] for i in known])
    mean, scale = z.mean(axis=0), z.std(axis=0)
    scale[scale < 1e-6] = 1
    z, y = np.column_stack(((z - mean) / scale, np.ones(len(z)))), np.array([labels[i] for i in known], float)
    w, penalty = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ np.diag(p * (1 - p)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1, 5 / np.abs(step).max())
    odds = {i: float(np.clip((v - mean) / scale @ w[:-1] + w[-1], -20, 20)) for i, v in x.items()}
    p = {i: 1 / (1 + math.exp(-o)) for i, o in odds.items()}
    host, path = defaultdict(list), defaultdict(list)
    for i, _, h, q in rows:
        host[h or ""].append(i)
        path[h or "", q or ""].append(i)
    n = len(rows)
    rate = min(max(sum(p.values()) / n, 1e-4), 1 - 1e-4)
    avg = lambda ids: sum(p[i] for i in ids) / len(ids)

    # Nested analysis of variance, by loops over documents.
    within = sum((p[j] - avg(d)) ** 2 for d in path.values() for j in d)
    noise = within / (n - len(path))
    between = sum((avg(path[h or "", q or ""]) - avg(host[h or ""])) ** 2 for _, _, h, q in rows)
    free = len(path) - len(host)
    spread = n - sum(len(d) ** 2 / len(host[h]) for (h, _), d in path.items())
    at_path = (between - free * noise) / spread if free and spread > 0 and between - free * noise > 2 * free * noise * math.sqrt(2 / free) else 0
    between = sum((avg(host[h or ""]) - sum(p.values()) / n) ** 2 for _, _, h, _ in rows)
    free = len(host) - 1
    expected = free * noise + at_path * sum(len(d) ** 2 * (1 / len(host[h]) - 1 / n) for (h, _), d in path.items())
    at_host = (between - expected) / (n - sum(len(d) ** 2 for d in host.values()) / n) if free and between - expected > 2 * expected * math.sqrt(2 / free) else 0
    strength = lambda v: min(max(rate * (1 - rate) / v - 1, 1), 1e6) if v > 0 else 1e6
    host_k, path_k = strength(at_host), strength(at_path)
    inside = lambda v: min(max(v, 1e-6), 1 - 1e-6)
    logit = lambda v: math.log(v / (1 - v))
    out = {}
    for i, _, h, q in rows:
        ids, own = host[h or ""], path[h or "", q or ""]
        at_host = inside((host_k * rate + max(0, sum(p[j] for j in ids) - p[i])) / (host_k + len(ids) - 1))
        at_path = inside((path_k * at_host + max(0, sum(p[j] for j in own) - p[i])) / (path_k + len(own) - 1))
        out[i] = odds[i], 1 / (1 + math.exp(-(odds[i] + logit(at_path) - logit(rate))))
    return out


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    return docs, labels, plain(rows, {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None})


def test_whole_classifier_by_definition(judged):
    docs, labels, expected = judged
    got = {r["doc_id"]: r for r in Q.classify(docs, labels).collect()}
    assert set(got) == set(expected)
    for i, (odds, posterior) in expected.items():
        assert got[i]["evidence"] == pytest.approx(odds, rel=1e-4, abs=1e-4) and got[i]["posterior"] == pytest.approx(posterior, rel=1e-3, abs=1e-4)
        assert got[i]["kept"] == (got[i]["posterior"] >= Q.THRESHOLD)


def test_kept_rows_are_those_of_the_definition(judged):
    docs, labels, expected = judged
    kept = {r["doc_id"] for r in Q.keep_good(docs, labels).collect()}
    assert kept == {i for i, (_, posterior) in expected.items() if posterior >= Q.THRESHOLD}


def test_an_id_with_several_labels_has_the_worst(spark):
    rows = [(k, "plain words in a row " * (k % 5 + 1), "en", "a") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    once = [(k, int(k % 3 > 0)) for k in range(20)]
    twice = once + [(k, 1) for k in range(20)]
    a, b = (sorted((r["doc_id"], round(r["posterior"], 9)) for r in Q.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (once, twice))
    assert a == b


def strengths(spark, hosts, paths, documents, host_sd=0.0, path_sd=0.0, seed=3):
    from prismlake.llm.common import Scratch

    rng = np.random.default_rng(seed)
    rows = []
    for h in range(hosts):
        at_host = rng.normal(0, host_sd)
        for q in range(paths):
            at_path = rng.normal(0, path_sd)
            rows += [(f"h{h}", f"p{q}", float(np.clip(0.5 + at_host + at_path + rng.normal(0, 0.15), 0.01, 0.99))) for _ in range(documents)]
    rates, rate = Q.site_rates(spark.createDataFrame(rows, "host string, path string, p double"), Scratch(spark, "test-strengths"))
    first = rates.first()
    return first["host_k"], first["path_k"], rate


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_sites_that_do_not_differ_are_not_told_apart(spark, seed):
    host_k, path_k, rate = strengths(spark, 60, 20, 3, seed=seed)
    assert host_k > 1000 and path_k > 1000 and rate == pytest.approx(0.5, abs=0.02)


def test_strengths_follow_what_differs(spark):
    # A prior of variance v counts for rate * (1 - rate) / v - 1 documents.
    host_k, path_k, _ = strengths(spark, 200, 5, 4, host_sd=0.1)
    assert host_k == pytest.approx(0.25 / 0.1**2 - 1, rel=0.35) and path_k > 1000
    host_k, path_k, _ = strengths(spark, 60, 20, 4, path_sd=0.1)
    assert host_k > 1000 and path_k == pytest.approx(0.25 / 0.1**2 - 1, rel=0.25)
    host_k, path_k, _ = strengths(spark, 200, 8, 4, host_sd=0.12, path_sd=0.1)
    assert host_k == pytest.approx(0.25 / 0.12**2 - 1, rel=0.4) and path_k == pytest.approx(0.25 / 0.1**2 - 1, rel=0.3)
    assert strengths(spark, 40, 10, 1)[1] == Q.MOST_STRENGTH  # one document a path says nothing of paths
    assert strengths(spark, 1, 1, 1)[:2] == (Q.MOST_STRENGTH, Q.MOST_STRENGTH)
