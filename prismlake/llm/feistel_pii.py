"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Each value found is checked (Luhn, mod 97, calendar, ranges), written as a
vector of small numbers with a modulus for each place, and permuted by a keyed
Feistel network over that mixed-radix domain. Equal values get equal pseudonyms
in every document and on every executor, without a table of values: nothing is
shuffled, and a pseudonym has the punctuation, length and validity of the value.

Values hold digits or @, so a text is first cut into zones of words that do, and
of words in capitals beside them, by a pattern that reads each character about once;
the shapes are looked for in zones only. No value reaches beyond its zone.
"""

from __future__ import annotations

import warnings
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

ROUNDS = 8
#: The setting that names the key, and what registered queries take where it is unset: anyone can read it here and undo the pseudonyms.
KEY_SETTING, PUBLIC_KEY = "spark.prismlake.pii.key", "prismlake-public-key"

# The shapes of the values that are looked for, in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_AT_MOST_15 = r"(?<!\+" + r"[ .()-]{0,3}\d" * 16 + r"[ .()\d-]{0,48})"
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "date_iso": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?=T\d|[^\w-]|\z)",
    "date_local": r"(?<![\w/.])\d{1,2}([/.])\d{1,2}\1\d{4}(?![\w/])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{11,13}(?!\d)|(?<![\w+])(?<!\d[ -])\d{3} \d{3} \d{4}(?![ -]?\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\(?\d{1,5}\)?){2,5}(?![.-]?\d)" + _AT_MOST_15,
    "card": r"(?<![A-Za-z0-9+])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])",
}
KINDS = tuple(SHAPES)
#: Shapes that end where their value does; IBANs and cards are looked for among the words of a run instead, as their shapes also hold words and numbers beside the value.
OPEN_KINDS = ("iban", "card")
CLOSED_SHAPE = "|".join(f"(?:{p})" for k, p in SHAPES.items() if k not in OPEN_KINDS).replace(r"\1", "[/.]")
RUN = r"(?<![A-Za-z0-9])\+?(?=[A-Z -]*\d)[A-Z0-9][A-Z0-9 -]{10,}[A-Z0-9](?![A-Za-z0-9])"
WORD = "[A-Z0-9]+"
#: A word with a digit or @ and what follows it with spaces between: such words, and words in capitals.
_TELLING, _CAPITALS = r"\S*?[0-9@]\S*+", r"[A-Z-]++(?![a-z0-9@])[^\s0-9@]*+(?!\S)"
ZONE = rf"{_TELLING}(?: ++(?:{_CAPITALS}|{_TELLING}))*+"
_WHOLE_IBAN, _WHOLE_CARD = r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$", r"^\d(?:[ -]?\d){12,18}$"
_USUAL_CARD = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})$"
#: The most words of a value, and the length of IBANs by country.
MOST_WORDS = 19
IBAN_LENGTHS = (
    "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 "
    "AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 "
    "AL28 AZ28 BY28 CY28 DO28 GT28 HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33"
)
#: Stands for a value that is done while runs are searched; a first character in a text is followed by the second meanwhile.
_ESCAPE, _ESCAPED, _MARK = "\x01", "\x01\x02", "\x01\x03"


def _with(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digit_stream(key: str, kind: Column, turn: Column, place: Column, other: Column) -> Column:
    """A number below 2**48 from the other half (joined by commas), the round and the place."""
    said = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), place.cast("string"), other)
    return F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("long")


def feistel(values: Column, moduli: Column, kind: str | Column, key: str) -> Column:
    """Permute an array of longs, place j within [0, moduli[j]); a bijection for each key and kind."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def rounds(x: Column) -> Column:
        half = F.floor(F.size(x["v"]) / 2).cast("int")
        piece = lambda c: (F.slice(c, F.lit(1), half), F.slice(c, half + 1, F.size(c) - half))
        (left, right), (m_left, m_right) = piece(x["v"]), piece(x["m"])

        def step(state: Column, turn: Column) -> Column:
            # a moves by what b says, then they change places.
            moved = lambda said: F.transform(state["a"], lambda v, j: F.pmod(v + _digit_stream(key, kind, turn, j, said), F.get(state["ma"], j)))
            return F.struct(state["b"].alias("a"), state["mb"].alias("ma"), _with(F.array_join(state["b"].cast("array<string>"), ","), moved).alias("b"), state["ma"].alias("mb"))

        start = F.struct(left.alias("a"), m_left.alias("ma"), right.alias("b"), m_right.alias("mb"))
        # After an even number of rounds the halves are in their places again.
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda t: F.concat(t["a"], t["b"]))

    return _with(F.struct(values.alias("v"), moduli.alias("m")), rounds)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _class(c: Column) -> Column:
    """(base, size): digits and letters of one case are numbers from a base, other characters stay."""
    code = F.ascii(c)
    row = lambda base, size: F.struct(F.lit(base).alias("base"), F.lit(size).alias("size"))
    return F.when(code.between(48, 57), row(48, 10)).when(code.between(97, 122), row(97, 26)).when(code.between(65, 90), row(65, 26)).otherwise(F.struct(code.alias("base"), F.lit(1).alias("size")))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(shape: Column, new: Column, kept: str) -> Column:
    """shape with its characters of class kept replaced, in order, by those of new."""
    ordinal = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{kept}]", ""))
    return F.array_join(F.transform(_chars(shape), lambda c, i: F.when(c.rlike(f"[{kept}]"), F.substring(new, ordinal(i), F.lit(1))).otherwise(c)), "")


def _luhn_sum(payload: Column) -> Column:
    """Luhn's sum over the digits before the check digit."""
    places = F.transform(F.reverse(_chars(payload)), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x)


def _check_digit(payload: Column) -> Column:
    return F.pmod(-_luhn_sum(payload), F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _iban_holds(m: Column) -> Column:
    bare = F.regexp_replace(m, " ", "")
    return _mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1


def _card_holds(m: Column) -> Column:
    digits = _digits(m)
    return _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1)


#: A Gregorian cycle of 400 years has 146097 = 189 x 773 days.
_CYCLE, _CYCLE_START = (189, 773), "1800-01-01"


def _try_date(s: Column, pattern: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern)).cast("date")


def _day(m: Column) -> Column:
    """(day, pattern) of a date. Dots: day first. Slashes: month first where that is a date."""
    dated = lambda day, pattern: F.struct(day.alias("day"), F.lit(pattern).alias("pattern"))
    second = _try_date(m, "M/d/yyyy")
    return (
        F.when(m.contains("-"), dated(_try_date(m, "yyyy-MM-dd"), "yyyy-MM-dd")).when(m.contains("."), dated(_try_date(m, "d.M.yyyy"), "dd.MM.yyyy"))
        .when(second.isNotNull(), dated(second, "MM/dd/yyyy")).otherwise(dated(_try_date(m, "d/M/yyyy"), "dd/MM/yyyy"))
    )


#: A number with its country code apart, in groups that aren't those of ten digits.
_GROUPED = r"^\+\d{1,3}[ .-]"
_TEN = r"^(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}$"

def _rank(m: Column, whole: Column) -> Column:
    """0 to 3 for what m is by its shape and check, the likeliest first: IBAN of its country's length, card as usually written, other IBAN, other card; null if it is none."""
    bare = F.regexp_replace(m, " ", "")
    usual = F.lit(IBAN_LENGTHS).contains(F.concat(F.substring(bare, 1, 2), F.length(bare).cast("string")))
    # Groups with several kinds of marks between them are one card only if nothing is beside them.
    alike = whole | ~(m.contains(" ") & m.contains("-"))
    return F.when(m.rlike(_WHOLE_IBAN), F.when(_iban_holds(m), F.when(usual, 0).otherwise(2))).when(m.rlike(_WHOLE_CARD) & alike, F.when(_card_holds(m), F.when(m.rlike(_USUAL_CARD), 1).otherwise(3)))


def _in_run(run: Column, key: str) -> Column:
    """A run with the IBANs and cards among its words replaced, and how many they were: (new, n_iban, n_card).

    All spans of words are checked; of those that overlap, the likeliest stays, then the first, then the longest.
    """
    parts = F.struct(F.regexp_extract_all(run, F.lit(WORD), F.lit(0)).alias("words"), F.split(run, WORD, -1).alias("marks"))

    def of_words(x: Column) -> Column:
        words, marks = x["words"], x["marks"]
        n = F.size(words)

        def spans(i: Column) -> Column:
            ends = F.sequence(i, F.least(i + MOST_WORDS - 1, n - 1))
            said = lambda j: F.concat(F.array_join(F.slice(x["spaced"], i + 1, j - i), ""), F.get(words, j))
            rank = lambda j, m: F.when((i > 0) | (F.get(marks, F.lit(0)) == "") | m.rlike("^[A-Z]"), _rank(m, (i == 0) & (j == n - 1)))
            every = F.transform(ends, lambda j: _with(said(j), lambda m: F.struct(rank(j, m).alias("rank"), i.alias("i"), (-j).alias("j"), m.alias("m"))))
            return F.filter(every, lambda h: h["rank"].isNotNull())

        hits = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), spans)))
        apart = lambda chosen, h: ~F.exists(chosen, lambda c: (c["i"] <= -h["j"]) & (h["i"] <= -c["j"]))
        return F.aggregate(hits, F.slice(hits, F.lit(1), F.lit(0)), lambda chosen, h: F.when(apart(chosen, h), F.array_append(chosen, h)).otherwise(chosen))

    def rebuilt(x: Column) -> Column:
        kind = lambda ranks: F.size(F.filter(x["chosen"], lambda h: h["rank"].isin(*ranks)))
        new = lambda h: _pseudonym(h["m"], F.when(h["rank"].isin(0, 2), "iban").otherwise("card"), key)
        between = lambda a, b: F.array_join(F.slice(x["spaced"], a + 1, F.greatest(b - a, F.lit(0))), "")
        in_order = F.array_sort(F.transform(x["chosen"], lambda h: F.struct(h["i"].alias("i"), (-h["j"]).alias("j"), h["rank"].alias("rank"), h["m"].alias("m"))))
        start = F.struct(F.lit(0).alias("at"), F.get(x["marks"], F.lit(0)).alias("out"))
        step = lambda s, h: F.struct((h["j"] + 1).alias("at"), F.concat(s["out"], between(s["at"], h["i"]), new(h), F.get(x["marks"], h["j"] + 1)).alias("out"))
        text = F.aggregate(in_order, start, step, lambda s: F.concat(s["out"], between(s["at"], F.size(x["words"]))))
        return F.struct(text.alias("new"), kind((0, 2)).alias("n_iban"), kind((1, 3)).alias("n_card"))

    with_spaced = lambda x: F.struct(x["words"].alias("words"), x["marks"].alias("marks"), F.zip_with(x["words"], F.slice(x["marks"], F.lit(2), F.size(x["words"])), lambda w, mark: F.concat(w, mark)).alias("spaced"))
    with_chosen = lambda x: F.struct(x["words"].alias("words"), x["marks"].alias("marks"), x["spaced"].alias("spaced"), of_words(x).alias("chosen"))
    return _with(parts, lambda p: _with(with_spaced(p), lambda x: _with(with_chosen(x), rebuilt)))


def _kind(m: Column) -> Column:
    """The name of the first closed shape that m has."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(m.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date_iso")
        .when(m.rlike(r"^\d{1,2}[/.]\d{1,2}[/.]\d{4}$"), "date_local").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").otherwise("phone")
    )


def _lettered(m: Column, kind: Column) -> Column:
    """What is permuted character by character: the name of an e-mail address, an IBAN after its check digits, a card without its check digit, a grouped phone number after its country code."""
    digits = _digits(m)
    return (
        F.when(kind == "email", F.substring_index(m, "@", 1)).when(kind == "iban", F.substring(F.regexp_replace(m, " ", ""), 5, 64))
        .when(kind == "card", F.substring(digits, F.lit(1), F.length(digits) - 1)).when(kind == "grouped", F.regexp_replace(m, r"^\+\d{1,3}", ""))
    )


def _numbers(m: Column, kind: Column) -> Column:
    """(values, moduli) of what isn't permuted character by character; null where the value is none of its kind."""
    row = lambda values, moduli: F.struct(values.alias("v"), moduli.alias("m"))
    fixed = lambda *sizes: F.array(*[F.lit(x).cast("long") for x in sizes])
    nth = F.date_diff(_day(m)["day"], F.lit(_CYCLE_START).cast("date")).cast("long")
    date = _with(nth, lambda n: F.when((n >= 0) & (n < _CYCLE[0] * _CYCLE[1]), row(F.array(F.floor(n / _CYCLE[1]), n % _CYCLE[1]), fixed(*_CYCLE))))
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    ssn = F.when(valid, row(F.array(F.when(area < 666, area - 1).otherwise(area - 2), group - 1, serial - 1), fixed(898, 99, 9999)))
    ten = F.transform(_chars(F.substring(_digits(m), -10, 10)), lambda c, i: F.struct(c.cast("long").alias("c"), F.when(~i.isin(0, 3), 10).when(c.cast("int") >= 2, 8).otherwise(2).cast("long").alias("size")))
    # Area and exchange keep whether they start with 2 to 9.
    phone = _with(ten, lambda t: row(F.transform(t, lambda d: d["c"] - F.when(d["size"] == 8, 2).otherwise(0)), F.transform(t, lambda d: d["size"])))
    ip = row(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), fixed(256, 256, 256, 256))
    return F.when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "phone", phone).when(kind == "ip", ip)


def _letters(s: Column) -> Column:
    """(values, moduli) of a text's characters."""
    of = lambda t: F.struct(F.transform(t, lambda x: (F.ascii(x["c"]) - x["k"]["base"]).cast("long")).alias("v"), F.transform(t, lambda x: x["k"]["size"].cast("long")).alias("m"))
    return _with(F.transform(_chars(s), lambda c: F.struct(c.alias("c"), _class(c).alias("k"))), of)


def _written(m: Column, kind: Column, s: Column, old: Column, new: Column) -> Column:
    """The pseudonym of m from its new numbers, in m's format. s: what was permuted character by character; old: the numbers before."""
    text = F.array_join(F.zip_with(_chars(s), F.zip_with(old, new, lambda a, b: b - a), lambda c, d: F.chr((F.ascii(c) + d).cast("long"))), "")
    number = lambda i: F.get(new, F.lit(i))
    day = F.date_add(F.lit(_CYCLE_START).cast("date"), (number(0) * _CYCLE[1] + number(1)).cast("int"))
    ssn = F.format_string("%03d-%02d-%04d", number(0) + F.when(number(0) < 665, 1).otherwise(2), number(1) + 1, number(2) + 1)
    digits, country = _digits(m), F.substring(m, 1, 2)
    first = F.transform(F.split(F.substring(digits, -10, 10), ""), lambda c, i: F.when(i.isin(0, 3) & (c >= "2"), 2).otherwise(0))
    ten = F.array_join(F.transform(new, lambda v, i: (v + F.get(first, i)).cast("string")), "")
    check = lambda t: F.lpad((98 - _mod97(F.concat(t, country, F.lit("00")))).cast("string"), 2, "0")
    return (
        F.when(kind == "email", F.concat(text, F.lit("@"), F.substring_index(m, "@", -1))).when(kind == "grouped", F.concat(F.regexp_extract(m, r"^\+\d{1,3}", 0), text))
        .when(kind == "iban", _with(text, lambda t: _refill(m, F.concat(country, check(t), t), "A-Z0-9"))).when(kind == "card", _with(text, lambda t: _refill(m, F.concat(t, _check_digit(t)), "0-9")))
        .when(kind == "date", F.call_function("date_format", day, _day(m)["pattern"])).when(kind == "ssn", ssn).when(kind == "ip", F.array_join(new, "."))
        .when(kind == "phone", _refill(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), ten), "0-9"))
    )


def _pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value; null where it fails its check. IBANs and cards have been checked."""
    phone = F.when(~m.rlike(_GROUPED) | m.rlike(_TEN), F.when(F.length(_digits(m)) >= 10, "phone")).when(F.length(_digits(m)).between(8, 15), "grouped")
    kind = F.when(kind.isin("date_iso", "date_local"), "date").when(kind == "phone", phone).otherwise(kind)
    said = lambda k: F.when(k == "grouped", "phone").otherwise(k)
    ready = lambda k: F.struct(k.alias("k"), _lettered(m, k).alias("s"))
    sized = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), F.when(x["s"].isNotNull(), _letters(x["s"])).otherwise(_numbers(m, x["k"])).alias("n"))
    moved = lambda x: _with(feistel(x["n"]["v"], x["n"]["m"], said(x["k"]), key), lambda new: _written(m, x["k"], x["s"], x["n"]["v"], new))
    return _with(kind, lambda k: _with(ready(k), lambda x: _with(sized(x), lambda y: F.when(y["n"].isNotNull(), moved(y)))))


def _in_zone(zone: Column, key: str) -> Column:
    """A zone with its values replaced, and how many of each kind: (new, n_<kind>...)."""
    joined = lambda pieces, news: F.array_join(F.zip_with(pieces, news, lambda a, x: F.concat(a, F.coalesce(x, F.lit("")))), "")

    def closed(z: Column) -> Column:
        found = F.transform(F.regexp_extract_all(z, F.lit(CLOSED_SHAPE), F.lit(0)), lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
        done = F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _pseudonym(x["m"], x["kind"], key).alias("new")))
        return F.struct(z.alias("zone"), done.alias("found"))

    def opened(x: Column) -> Column:
        # What fails its check stays in the text that is searched for runs.
        marked = joined(F.split(x["zone"], CLOSED_SHAPE, -1), F.transform(x["found"], lambda v: F.when(v["new"].isNull(), v["m"]).otherwise(_MARK)))
        runs = lambda m: F.struct(m.alias("marked"), F.transform(F.regexp_extract_all(m, F.lit(RUN), F.lit(0)), lambda r: _in_run(r, key)).alias("runs"))
        return F.struct(F.filter(x["found"], lambda v: v["new"].isNotNull()).alias("found"), _with(marked, runs).alias("open"))

    def rebuilt(x: Column) -> Column:
        unmarked = F.split(joined(F.split(x["open"]["marked"], RUN, -1), F.transform(x["open"]["runs"], lambda r: r["new"])), _MARK, -1)
        new = joined(unmarked, F.transform(x["found"], lambda v: v["new"]))
        number = lambda k: F.aggregate(x["open"]["runs"], F.lit(0), lambda a, r: a + r[f"n_{k}"]) if k in OPEN_KINDS else F.size(F.filter(x["found"], lambda v: v["kind"] == k))
        return F.struct(new.alias("new"), *[number(k).alias(f"n_{k}") for k in KINDS])

    return _with(closed(zone), lambda x: _with(opened(x), rebuilt))


@lru_cache(maxsize=8)
def _zones(key: str, application: str) -> Column:
    """The zones of __text with their values replaced; null without a digit or @. Kept for an application, as it takes seconds to put together."""
    replaced = F.transform(F.regexp_extract_all("__text", F.lit(ZONE), F.lit(0)), lambda z: _in_zone(z, key))
    return F.when(F.col("__text").rlike("[0-9@]"), replaced)


def session_key(spark: SparkSession) -> str:
    """The key that the session names; the public one, with a warning, where it names none."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms are made with a public key and can be undone", stacklevel=2)
    return named or PUBLIC_KEY


def pseudonymise(df: DataFrame, text_col: str = "text", *, key: str, counts: bool = False) -> DataFrame:
    """df with the personal data in text_col replaced; columns and rows as in df.

    Who has the key can undo the pseudonyms, so there is no default and an empty one is refused.
    E-mail addresses (the part before @; the domain stays), IBANs, IPv4 addresses, dates from
    1800 to 2199 (with a time after them too), US social security numbers, phone numbers, and payment cards.
    A phone number has ten digits in groups of three, three and four with or without a country code,
    or a '+' with its country code and two to five groups of digits, eight to fifteen in all (as many groups as keep
    to that and don't end within a dashed or dotted number), or it is '+' and 11 to 13 digits together.
    IBANs and cards are found beside numbers and capital words too. Values that fail their check stay as
    they are. With counts, a column n_<kind> for each kind of SHAPES
    follows; such a column of df is replaced.

    A null text stays null, an empty one empty; repeated rows, ties and empty
    tables need nothing special, as rows are independent. Whole texts are read.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.replace(text_of(text_col), F.lit(_ESCAPE), F.lit(_ESCAPED))
    taken = df.select("*", text.alias("__text")).withColumn("__zones", _zones(key, df.sparkSession.sparkContext.applicationId))
    some = F.col("__zones").isNotNull()
    around = F.zip_with(F.split("__text", ZONE, -1), "__zones", lambda a, z: F.concat(a, F.coalesce(z["new"], F.lit(""))))
    out = {text_col: F.when(some, F.replace(F.array_join(around, ""), F.lit(_ESCAPED), F.lit(_ESCAPE))).otherwise(F.col(text_col))}
    if counts:
        total = lambda k: F.aggregate(F.coalesce("__zones", F.array()), F.lit(0).cast("long"), lambda a, z: a + z[f"n_{k}"])
        out |= {f"n_{k}": total(k) for k in KINDS}
    return taken.withColumns(out).drop("__text", "__zones")
