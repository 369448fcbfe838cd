"""Secret scans: fixed shapes, and a battery of randomness tests on other tokens.

A token is reported as random when it can't pass for text and passes for random:
it rejects a letter-pair model of the whole corpus, whose likelihood ratio
against the inferred encoding gives a p-value that falls with the token's length,
and it is not rejected by tests for uniform letters (chi-squared), runs and
serial correlation. A name, a path or a prefix before the value is part of the token:
the parts between '=', and between marks of different alphabets, are tested too.
The false-discovery rate over all parts tested is held within each band of lengths.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, exact_id, in_worker, text_of

# The base shapes, in the order that breaks ties.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

#: Tokens that are tested, and their encodings from the narrowest to the widest.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
TOKEN_MIN = 20
#: Parts of a token: '=' parts them unless it is padding at the token's end; then they are taken whole and between marks that one alphabet doesn't hold together.
PART = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
SPLITS = tuple(re.compile(p) for p in (r".{20,}", r"[^+/]{20,}", r"[^_-]{20,}", r"[^+/_-]{20,}"))
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "lower": _LOWER, "upper": _UPPER,
    "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER, "letters": _UPPER + _LOWER, "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _DIGITS + _UPPER + _LOWER + "+/", "base64url": _DIGITS + _UPPER + _LOWER + "-_",
}
#: Numbers alone and words alone are no secrets.
_NO_SECRET = {"decimal", "lower", "upper", "letters"}
_RANK = {name: {c: i for i, c in enumerate(sorted(a))} for name, a in ENCODINGS.items()}
BANDS = (20, 32, 64)
#: The false-discovery rate, the level of the randomness tests, and the step of -log10 p in the histogram.
FDR, UNIFORM_LEVEL, STEP, MOST_STEPS = 0.001, 0.001, 0.25, 400

_SYMBOLS = _DIGITS + _UPPER + _LOWER + "+/=_-"
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[ord(c) for c in _SYMBOLS]] = np.arange(1, len(_SYMBOLS) + 1)
_N = len(_SYMBOLS) + 1


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-12:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * out


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer_encoding(token: str) -> str | None:
    own = set(token.rstrip("="))
    return next((name for name, a in ENCODINGS.items() if own <= set(a)), None)


def parts_of(token: str) -> dict[tuple[int, int], str]:
    """(start, end) of each part of a token that is tested, with its encoding."""
    out = {}
    for part in PART.finditer(token):
        for split in SPLITS:
            for m in split.finditer(token, part.start(), part.end()):
                name = infer_encoding(m.group())
                if name and name not in _NO_SECRET and len(m.group().rstrip("=")) >= TOKEN_MIN:
                    out[m.span()] = name
    return out


def uniformity(token: str, encoding: str) -> float:
    """The smallest p-value of the tests, corrected for their number.

    The chi-squared test needs groups of letters where a token is short for its
    alphabet; equal pairs of letters, nearly Poisson then, test single letters.
    """
    body = token.rstrip("=")
    rank, m, n = _RANK[encoding], len(ENCODINGS[encoding]), len(body)
    x = np.array([rank[c] for c in body], dtype=np.float64)
    groups = int(max(2, min(m, n // 5)))
    seen = np.bincount((x * groups // m).astype(int), minlength=groups)
    sizes = np.bincount((np.arange(m) * groups // m).astype(int), minlength=groups)
    expected = n * sizes / m
    p = [_upper_gamma((groups - 1) / 2, float(((seen - expected) ** 2 / expected).sum()) / 2)]
    times = np.bincount(x.astype(int), minlength=m)
    pairs = int((times * (times - 1) // 2).sum())
    p.append(1 - _upper_gamma(pairs, n * (n - 1) / 2 / m) if pairs else 1.0)
    high = x >= m / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b and n > 2:
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p.append(_two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2 * 0.5**n)
    y = x - x.mean()
    spread = float((y * y).sum())
    r = float((y[1:] * y[:-1]).sum()) / spread if spread else 1.0
    p.append(_two_sided((r + 1 / n) * math.sqrt(n)))
    return min(1.0, len(p) * min(p))


def text_p(token: str, encoding: str, log_text: np.ndarray) -> float:
    """log10 of the p-value under the letter-pair model: by Markov's inequality a
    likelihood ratio of 1/p or more has probability p at most; corrected for the
    choice among encodings."""
    body = token.rstrip("=")
    k = _CLASS[np.frombuffer(body.encode(), np.uint8)]
    ratio = -len(body) * math.log10(len(ENCODINGS[encoding])) - float(log_text[np.concatenate(([0], k[:-1])), k].sum())
    return min(0.0, math.log10(len(ENCODINGS)) - ratio)


@in_worker("secrets")
def _count_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(_N * _N, dtype=np.int64)
    for frame in frames:
        for first in range(0, len(frame), 256):
            k = _CLASS[np.frombuffer(("\n" + "\n".join(frame["text"].iloc[first : first + 256])).encode(), np.uint8)]
            total += np.bincount(k[:-1] * _N + k[1:], minlength=_N * _N)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"pair": at, "n": total[at]})


def letter_model(df: DataFrame, text_col: str) -> np.ndarray:
    """log10 P(letter | letter before it) over all texts, smoothed; a matrix of fixed size."""
    rows = df.select(text_of(text_col).alias("text")).mapInPandas(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = np.ones((_N, _N))
    for r in rows:
        n[r["pair"] // _N, r["pair"] % _N] += r["n"]
    return np.log10(n / n.sum(axis=1, keepdims=True))


def _band(n: int) -> int:
    return sum(n >= b for b in BANDS)


def base_spans(text: str, long_words: list[str] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base shapes, by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    if long_words is None or any(HEX.search(w) for w in long_words):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@in_worker("secrets")
def _scan(log_text: np.ndarray, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple[list[int], list[tuple[int, int, float]]]] = {}

    def judged(token: str) -> tuple[list[int], list[tuple[int, int, float]]]:
        """The bands of the parts tested, and (start, end, log10 p) of those that pass for random; of parts that overlap, the one with the least p."""
        if token not in known:
            if len(known) > 200_000:
                known.clear()
            parts, chosen = parts_of(token), []
            scored = sorted((text_p(token[a:b], name, log_text), a, b) for (a, b), name in parts.items())
            for p, a, b in scored:
                if p < -1 and not any(a < d and c < b for c, d, _ in chosen) and uniformity(token[a:b], parts[a, b]) >= UNIFORM_LEVEL:
                    chosen.append((a, b, p))
            known[token] = [_band(b - a) for a, b in parts], sorted(chosen)
        return known[token]

    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["id"].tolist(), frame["text"].tolist(), strict=True):
            words = [w for w in text.split() if len(w) >= HEX_MIN]
            base = base_spans(text, words)
            found = [t for w in words if len(w) >= TOKEN_MIN for t in TOKEN.findall(w)]
            bands = [k for t in found for k in judged(t)[0]]
            tested = np.bincount(bands, minlength=len(BANDS) + 1)[1:].tolist() if bands else [0] * len(BANDS)
            extra = []
            if any(judged(t)[1] for t in found):
                taken = [(a, b) for a, _, b in base]
                spans = [(m.start() + a, m.start() + b, p) for m in TOKEN.finditer(text) for a, b, p in judged(m.group())[1]]
                extra = [(c, d, p) for c, d, p in spans if not any(a < d and c < b for a, b in taken)]
            rows.append((doc_id, [a for a, _, _ in base], [k for _, k, _ in base], [b for _, _, b in base], [a for a, _, _ in extra], [b for _, b, _ in extra], [p for _, _, p in extra], tested))
        yield pd.DataFrame(rows, columns=["doc_id", "starts", "kinds", "ends", "x_starts", "x_ends", "x_log_p", "tested"])


_SCANNED = "doc_id string, starts array<long>, kinds array<int>, ends array<long>, x_starts array<long>, x_ends array<long>, x_log_p array<double>, tested array<long>"


def thresholds(histogram: list[tuple[int, int, int]], tested: list[int], fdr: float = FDR) -> list[float]:
    """For each band, the log10 p at or below which tokens are reported, by Benjamini and Hochberg over steps of -log10 p.

    histogram: (band from 1, steps, tokens); tested: parts of tokens tested in each band.
    """
    out = []
    for band, m in enumerate(tested, start=1):
        steps, total, found = {}, 0, -math.inf
        for b, s, n in histogram:
            if b == band:
                steps[s] = steps.get(s, 0) + n
        for s in sorted(steps, reverse=True):
            total += steps[s]
            if 10 ** (-s * STEP) <= fdr * total / m:
                found = -s * STEP
        out.append(found)
    return out


def _report(limits: list[float], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            base = list(zip(r.starts, r.kinds, r.ends, strict=True))
            extra = [(a, 3, b) for a, b, p in zip(r.x_starts, r.x_ends, r.x_log_p, strict=True) if p <= limits[_band(b - a) - 1]]
            said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            kinds = [k for _, k, _ in base]
            rows.append((r.doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(said(base).encode()).hexdigest(), said(sorted(base + extra)), len(extra)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row for each row of df: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    spans lists kind:start:end in code points by start, then kind; an assignment's
    span is the whole match. A random token's span is the part of it that is random,
without a name or path beside it. A random token that overlaps a base span isn't
    listed again. A null text is empty and has no spans; its digest is that of
    the empty string. Rows are independent but for the corpus's letter model and
    thresholds; repeated rows count in both. A null id is kept. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "secrets")
    log_text = letter_model(df, text_col)
    rows = df.select(exact_id(id_col).alias("id"), text_of(text_col).alias("text"))
    found = scratch.save(rows.mapInPandas(lambda frames: _scan(log_text, frames), _SCANNED), "found")
    tested = found.select(*[F.sum(F.get("tested", F.lit(k))).alias(f"t{k}") for k in range(len(BANDS))]).first()
    x = found.select(F.explode(F.arrays_zip("x_starts", "x_ends", "x_log_p")).alias("x"))
    length = F.col("x.x_ends") - F.col("x.x_starts")
    band = sum((length >= b).cast("int") for b in BANDS)
    steps = F.least(F.floor(-F.col("x.x_log_p") / STEP), F.lit(MOST_STEPS)).cast("int")
    histogram = [tuple(r) for r in x.groupBy(band.alias("band"), steps.alias("steps")).count().collect()]
    limits = thresholds(histogram, [int(n or 0) for n in tested], fdr)
    out = found.mapInPandas(lambda frames: _report(limits, frames), "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
