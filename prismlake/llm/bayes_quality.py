"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model on the shape of a text gives each document's evidence. Expected
numbers of good documents, summed for each host and each path of a host, give
posterior rates that shrink toward the global rate where a site has few
documents; how strongly is estimated from how much hosts differ, and paths of a
host, beyond what the scatter of their documents explains. A document's
posterior combines its own evidence with the rate of the other documents of its
path. Where a table has no addresses, other columns stand for them: by default
its source is the host, and its language the path.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, enter, in_worker, release, text_of

#: Labelled documents that the logistic model is fitted on at most.
SAMPLE = 20_000
#: Paths up to which their rates are broadcast, about 100 bytes each; beyond, they are joined by a shuffle.
BROADCAST_PATHS = 100_000
#: Documents at or above this posterior stay.
THRESHOLD = 0.5
SALTS = 32
#: A prior's strength where sites don't differ.
MOST_STRENGTH = 1e6

_MARKS = "!$%&*#|.,;:?-_/\\'\"()[]{}<>=+@~^`"
_COLUMN = np.zeros(256, dtype=np.int64)
for _name, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10,), range(128, 256)), start=1):
    _COLUMN[list(_bytes)] = _name
for _k, _c in enumerate(_MARKS, start=7):
    _COLUMN[ord(_c)] = _k
_CLASSES = 7 + len(_MARKS)
_WORD = re.compile(r"\S+")
FEATURES = _CLASSES + 6


def shape(text: str) -> np.ndarray:
    """Features of one text, each about within [0, 3]."""
    raw = text.encode("utf-8", "replace")
    out = np.zeros(FEATURES)
    out[:_CLASSES] = np.sqrt(np.bincount(_COLUMN[np.frombuffer(raw, np.uint8)], minlength=_CLASSES) / max(1, len(raw)))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    out[_CLASSES:] = (
        math.log1p(len(words)) / 4,
        len(raw) / n / 10 if len(raw) < 40 * n else 4.0,
        len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
    )
    return out


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -20, 20)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> Logistic:
    """Newton's method on the penalised likelihood. Without both classes, the constant of the smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return Logistic(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), math.log(rate / (1 - rate)))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def _shapes(texts: pd.Series) -> np.ndarray:
    return np.stack([shape(t or "") for t in texts]) if len(texts) else np.zeros((0, FEATURES))


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> tuple[Logistic, float]:
    """The model, and the rate of good documents in its sample: the sample rows with the least hash of the id."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y is not null")
    chosen = bounded_sample(known, sample, "__id", "__y")
    rows = df.select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "__id").select("__id", "__y", "text")

    @in_worker("quality")
    def features(frames):
        for f in frames:
            yield pd.DataFrame({"i": f["__id"], "y": f["__y"], "x": list(_shapes(f["text"]))})

    # An id that occurs in several rows counts once: with its worse label, and of its texts the one with the least features.
    got = rows.mapInPandas(features, "i long, y int, x array<double>").groupBy("i").agg(F.min(F.struct("y", "x")).alias("least")).select("i", "least.*").toPandas().sort_values("i")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, FEATURES))
    y = got["y"].to_numpy(dtype=float)
    return fit_logistic(x, y), float((y.sum() + 1) / (len(y) + 2))


def evidence_udf(model: Logistic):
    @F.pandas_udf("double")
    def evidence(text: pd.Series) -> pd.Series:
        enter("quality")
        out = pd.Series(model.log_odds(_shapes(text)), dtype=float)
        release()
        return out

    return evidence


def _variance(scatter: float, noise: float, spread: float, freedom: float) -> float:
    """How much sites differ: what their scatter has beyond the noise, by the method of moments; 0 where two standard errors of noise explain it."""
    if spread <= 0 or freedom <= 0 or scatter - noise <= 2 * noise * math.sqrt(2 / freedom):
        return 0.0
    return (scatter - noise) / spread


def _strength(variance: float, rate: float) -> float:
    """Documents that a prior of this variance counts for."""
    return float(np.clip(rate * (1 - rate) / variance - 1 if variance > 0 else MOST_STRENGTH, 1.0, MOST_STRENGTH))


def site_rates(scored: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """For each host and path: n, good, host_n, host_good and the two strengths; and the global rate.

    The noise is the scatter of documents within their path; where no path has
    two, within their host. What path means scatter beyond it is the paths'
    variance, and what host means scatter beyond both is the hosts'. Aggregated
    within tasks before the shuffle, so a host with a third of all documents
    arrives as one row from each task.
    """
    paths = scratch.save(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * F.col("p")).alias("squares")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.sum("squares").alias("host_squares"))
    joined = paths.join(hosts, "host")
    n, good, host_n, host_good = (F.col(c).cast("double") for c in ("n", "good", "host_n", "host_good"))
    at_path = joined.agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(good).alias("good"), F.sum(F.col("squares") - good * good / n).alias("within"),
        F.sum(n * (good / n - host_good / host_n) ** 2).alias("scatter"), F.sum(n * n / host_n).alias("shares"), F.sum(n * n).alias("nn"),
    ).first()
    total = at_path["n"] or 0.0
    mean = (at_path["good"] or 0.0) / total if total else 0.5
    rate = float(np.clip(mean, 1e-4, 1 - 1e-4))
    at_host = hosts.agg(F.count(F.lit(1)).alias("sites"), F.sum(F.col("host_squares") - host_good * host_good / host_n).alias("within"), F.sum(host_n * (host_good / host_n - mean) ** 2).alias("scatter"), F.sum(host_n * host_n).alias("nn")).first()
    host_var = path_var = 0.0
    if total:
        alone = total == at_path["sites"]
        noise = max(0.0, at_host["within"] / max(1.0, total - at_host["sites"]) if alone else at_path["within"] / (total - at_path["sites"]))
        freedom = at_path["sites"] - at_host["sites"]
        path_var = 0.0 if alone else _variance(at_path["scatter"], freedom * noise, total - at_path["shares"], freedom)
        freedom = at_host["sites"] - 1
        host_var = _variance(at_host["scatter"], freedom * noise + path_var * (at_path["shares"] - at_path["nn"] / total), total - at_host["nn"] / total, freedom)
    host_k, path_k = _strength(host_var, rate), _strength(path_var, rate)
    return joined.select("host", "path", "n", "good", "host_n", "host_good", F.lit(host_k).alias("host_k"), F.lit(path_k).alias("path_k")), rate


def _with_posterior(rows: DataFrame, rate: float, own: str) -> DataFrame:
    """Adds host_rate, path_rate and posterior; the document itself (own: its probability) isn't counted for its sites."""
    logit = lambda c: F.log(c / (1 - c))
    host = (F.col("host_k") * rate + F.greatest(F.col("host_good") - F.col(own), F.lit(0.0))) / (F.col("host_k") + F.col("host_n") - 1)
    rows = rows.withColumn("host_rate", F.greatest(F.least(host, F.lit(1 - 1e-6)), F.lit(1e-6)))
    path = (F.col("path_k") * F.col("host_rate") + F.greatest(F.col("good") - F.col(own), F.lit(0.0))) / (F.col("path_k") + F.col("n") - 1)
    rows = rows.withColumn("path_rate", F.greatest(F.least(path, F.lit(1 - 1e-6)), F.lit(1e-6)))
    odds = F.col("evidence") + logit(F.col("path_rate")) - math.log(rate / (1 - rate))
    return rows.withColumn("posterior", 1 / (1 + F.exp(-odds)))


def _join_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """By broadcast where the rates are few, else by a join in which each path is dealt to SALTS tasks."""
    if rates.count() <= BROADCAST_PATHS:
        return rows.join(F.broadcast(rates), ["host", "path"])
    salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"]).drop("salt")


def _site(host_col: str, path_col: str):
    return F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of df: doc_id, host, path, evidence, host_rate, path_rate, posterior, kept.

    labels has id_col and label_col (1: good). evidence is the model's log odds.
    A null text counts as empty, a null host or path as the empty name; null
    labels are not used. Repeated rows are documents of their own; in the sample,
    an id with several labels has the worst one. Without
    labels of both classes, all documents have the same evidence. An empty table
    gives no rows.
    """
    scratch = Scratch(df.sparkSession, "quality")
    model, _ = fit(df, labels, id_col, text_col, label_col, sample)
    rows = df.select(F.col(id_col).cast("long").alias("id"), *_site(host_col, path_col), evidence_udf(model)(text_of(text_col)).alias("evidence"))
    scored = scratch.save(rows.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "scored")
    rates, rate = site_rates(scored, scratch)
    out = _with_posterior(_join_rates(scored, rates), rate, "p")
    return out.select(F.col("id").alias("doc_id"), "host", "path", "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of df that classify keeps, columns as in df. Texts are not shuffled: the evidence is computed again beside them."""
    scratch = Scratch(df.sparkSession, "quality")
    model, _ = fit(df, labels, id_col, text_col, label_col, sample)
    evidence = evidence_udf(model)
    rows = df.select(*_site(host_col, path_col), evidence(text_of(text_col)).alias("evidence"))
    scored = rows.withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    rates, rate = site_rates(scored, scratch)
    own = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), *_site(host_col, path_col), evidence(text_of(text_col)).alias("evidence"))
    judged = _with_posterior(_join_rates(own.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), rates), rate, "p")
    return judged.where(F.col("posterior") >= threshold).select("row.*")
