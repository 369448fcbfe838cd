"""What the PII operator finds, beside a second implementation that reads whole texts character by character, without zones."""

import datetime
import random

import pytest
import regex as re

from prismlake.llm import feistel_pii as F8

KEY = "key of the tests"

A = re.ASCII
CLOSED = {k: re.compile(p.replace(r"\z", r"\Z"), A) for k, p in F8.SHAPES.items() if k not in F8.OPEN_KINDS}
RUN, WORD = re.compile(F8.RUN, A), re.compile(F8.WORD, A)


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def dated(y, m, d):
    try:
        return 1800 <= datetime.date(y, m, d).year < 2200
    except ValueError:
        return False


def holds(kind, m):
    if kind == "date_iso":
        return dated(*map(int, m.split("-")))
    if kind == "date_local":
        a, b, y = map(int, re.split("[./]", m))
        return dated(y, b, a) or ("/" in m and dated(y, a, b))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0
    if kind == "phone":
        digits = re.sub(r"\D", "", m)
        ten = re.fullmatch(r"(\+\d{1,3}[ .-]?)?(\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}", m, A)
        return len(digits) >= 10 if ten or not re.match(r"\+\d{1,3}[ .-]", m, A) else 8 <= len(digits) <= 15
    return True


def rank(m, whole):
    bare = m.replace(" ", "")
    if re.fullmatch(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", m, A):
        if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
            return 0 if f"{bare[:2]}{len(bare)}" in F8.IBAN_LENGTHS.split() else 2
    elif re.fullmatch(r"\d(?:[ -]?\d){12,18}", m, A) and (whole or not (" " in m and "-" in m)) and luhn(re.sub(r"\D", "", m)):
        return 1 if re.fullmatch(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}", m, A) else 3
    return None


def closed(text):
    """Leftmost values of the closed kinds, in the order of SHAPES where several begin at one place."""
    at, found = 0, []
    while at <= len(text):
        hits = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(CLOSED.items()) if (m := p.search(text, at))]
        if not hits:
            return found
        start, _, kind, end = min(hits)
        if holds(kind, text[start:end]):
            found.append((start, end, kind))
        at = end
    return found


def opened(text, base):
    """IBANs and cards in a stretch without other values."""
    for run in RUN.finditer(text):
        words = [(run.start() + w.start(), run.start() + w.end()) for w in WORD.finditer(run.group())]
        hits = []
        for i, (start, _) in enumerate(words):
            for j in range(i, min(len(words), i + F8.MOST_WORDS)):
                m = text[start : words[j][1]]
                if (i or not run.group().startswith("+") or m[0].isalpha()) and (r := rank(m, i == 0 and j == len(words) - 1)) is not None:
                    hits.append((r, i, -j))
        chosen = []
        for r, i, j in sorted(hits):
            if all(-j < a or b < i for _, a, b in chosen):
                chosen.append((r, i, -j))
        for r, i, j in chosen:
            yield base + words[i][0], base + words[j][1], "iban" if r in (0, 2) else "card"


def find(text):
    """(start, end, kind) of all values of a text, in order."""
    found = closed(text)
    # Where a value was taken out, a mark stands that isn't part of a run.
    rest = "".join("\x01" if any(a <= i < b for a, b, _ in found) else c for i, c in enumerate(text))
    return sorted(found + list(opened(rest, 0)))


def compare(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id")
    got = {r["doc_id"]: r for r in F8.pseudonymise(df, key=KEY, counts=True).collect()}
    spans = [find(t) for t in texts]
    values = sorted({t[a:b] for t, s in zip(texts, spans, strict=True) for a, b, _ in s})
    alone = {r["v"]: r["text"] for r in F8.pseudonymise(spark.createDataFrame([(v, v) for v in values], "v string, text string").repartition(8), key=KEY).collect()}
    for i, (t, s) in enumerate(zip(texts, spans, strict=True)):
        counts = {k: sum(kind == k for *_, kind in s) for k in F8.KINDS}
        assert {k: got[i][f"n_{k}"] for k in F8.KINDS} == counts, (t, s)
        new, at = "", 0
        for a, b, _ in s:
            new, at = new + t[at:a] + alone[t[a:b]], b
        assert got[i]["text"] == new + t[at:], t
    return sum(map(len, spans))


VALUES = (
    "4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795", "378282246310005", "4041894974608796", "DE89 3704 0044 0532 0130 00", "BE68539007547034", "BE68 5390 0754 7034", "DE00 3704 0044 0532 0130 00",
    "GB82WEST12345698765432", "97.51.17.173", "300.1.1.1", "1.2.3.4.5", "2024-02-29", "2023-02-29", "2024-02-29T10:00", "29.2.2024", "2/29/2024", "13/13/2024", "123-45-6789", "666-45-6789", "+1 (234) 567-8901",
    "234-567-8901", "(234) 567-8901", "234 567 8901", "+44 20 7946 0958", "+4915112345678", "bob.x-1@mail3.example.com", "a@b", "x@y.org", "1700-01-01",
)
WORDS = ("the", "EUR", "TO", "AB12", "12", "1234", "12/27", "x", "É", "naïve", "A", "NO-GO", "v1.2", "#5", "ID:", "(", ")", "“q”", "USD.", "7")
MARKS = (" ", " ", " ", " ", "  ", ", ", "\n", "\t", "; ", ". ", "", "-", "/", " ", "　")


@pytest.mark.parametrize("seed", [1, 2])
def test_values_in_made_up_texts(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(VALUES if rng.random() < 0.4 else WORDS) + rng.choice(MARKS) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    assert compare(spark, texts) > 1500


def test_grouped_numbers_leave_what_follows(spark):
    """Fifteen digits at most: what follows a number is neither part of it nor hides it."""
    phone = "+44 20 7946 0958"
    texts = [f"{phone} 123-45-6789", f"{phone} 2024-02-29", f"{phone} 2024", f"{phone} 4041894974608795", f"{phone} 4041 8949 7460 8795", f"{phone} 97.51.17.173", f"{phone} {phone}", phone, "+1-2-3-4-5-6-7-8"]
    said = [[(t[a:b], kind) for a, b, kind in find(t)] for t in texts]
    assert all(s[0] == (phone, "phone") for s in said[:-1]) and not said[-1]
    assert [s[1][1] if len(s) > 1 else None for s in said] == ["ssn", "date_iso", None, "card", "card", "ip", "phone", None, None]
    compare(spark, texts)


def test_values_in_the_documents(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert compare(spark, [t or "" for t in texts]) > 20


def test_a_text_of_a_megabyte(spark):
    rng = random.Random(7)
    parts = [rng.choice(VALUES) if rng.random() < 0.01 else rng.choice(WORDS[:3]) for _ in range(300_000)]
    text = " ".join(parts)
    row = F8.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), key=KEY, counts=True).first()
    assert len(text) > 1_000_000 and row["n_email"] == sum(p in ("bob.x-1@mail3.example.com", "x@y.org") for p in parts)
    left = {v for v in ("4041894974608795", "97.51.17.173", "x@y.org", "123-45-6789") if v in row["text"]}
    assert not left
