"""Personal data spans, in Spark SQL expressions only: patterns propose, checksums confirm, context words adjust the score.

Every pattern is written so that Java's matcher needs time in proportion to the text and no recursion: runs are
possessive, and a run is entered only at its start (or where the match before ended), which changes no match.
Positions are code points from 0: the pieces between the matches of a kind give them.

Kinds: email, ip, card (Luhn), phone, then iban (mod 97) and secret (assigned tokens and passwords).
Defined results: a null or empty text has no spans; repeated rows are each answered; an empty input gives an empty output;
extra columns stay (one with the name of the output is replaced).  Spans of different kinds may overlap; ``redact`` covers the union.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import walk

# Characters of an account number by country, from the public IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An account number of just its country's length, in groups of four with or without blanks."""
    rest = {n: rf"(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n in IBAN_LENGTHS}
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(rf"(?:{'|'.join(IBAN_LENGTHS[n].split())})[0-9]{{2}}{rest[n]}" for n in IBAN_LENGTHS) + r")(?![A-Za-z0-9_])"


KINDS = ("email", "ip", "card", "phone", "iban", "secret")

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # The maximal chain of digits with single separators, entered at its first digit, if it has 16 to 19 of them.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\x22']?[A-Za-z0-9_/+-]{16,}+",
}
#: Signs without which a text has no match of the kind, and a plainer pattern that such a text must hold.
SIGNS = {"email": ("@",), "phone": ("+",), "secret": ("=", ":")}
HOLDS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "iban": r"[A-Z][A-Z][0-9][0-9]"}
SCORES = {"email": 0.85, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.8}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mailto)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client)\b",
    "card": r"(?i)\b(?:card|visa|master|credit|debit|payment|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|whatsapp)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "secret": r"(?i)\b(?:auth|bearer|login|key)\b",
}
AGAINST = r"(?i)\b(?:version|release|example|order|invoice|isbn|serial)\b"
AROUND = 40

_SPAN = "struct<start:bigint,end:bigint,text:string>"


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, text), in code points."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.split(text, pattern, -1).alias("gap"))

    def step(at: Column, pair: Column) -> Column:
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("state"), F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text"))).alias("out"))

    return walk(F.filter(pairs, lambda pair: pair["hit"].isNotNull()), F.lit(0).cast("bigint"), step, _SPAN)["out"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    weighed = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number passes the mod-97 check; letters count as 10 to 35."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97)) == 1


def confirmed(kind: str, text: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        value = lambda p: F.regexp_replace(p, "^0+", "")  # noqa: E731  equal lengths compare as numbers do
        return F.forall(F.split(text, r"\."), lambda p: (F.length(value(p)) < 3) | ((F.length(value(p)) == 3) & (value(p) <= "255")))
    if kind == "card":
        return luhn(_digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    if kind == "iban":
        return mod97(text)
    return F.lit(True)


def _scored(kind: str, text: Column, span: Column) -> Column:
    before = F.substring(text, F.greatest(span["start"] - AROUND + 1, F.lit(1)).cast("int"), F.least(span["start"], F.lit(AROUND)).cast("int"))
    score = F.lit(SCORES[kind]) + F.when(before.rlike(CONTEXT[kind]), 0.15).otherwise(0.0) - F.when(before.rlike(AGAINST), 0.25).otherwise(0.0)
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["text"].alias("text"), F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2).alias("score"))


def _part(kind: str, text: Column) -> Column:
    valid = F.filter(spans_of(text, PATTERNS[kind]), lambda s: confirmed(kind, s["text"]))
    return F.transform(valid, lambda s: _scored(kind, text, s))


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds ``out_col``: array of (kind, start, end, text, score), by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>")
    parts = []
    for kind in kinds:
        part = _part(kind, text)
        if kind in SIGNS:
            may = reduce(or_, [F.instr(text, sign) > 0 for sign in SIGNS[kind]])
        else:
            may = text.rlike(HOLDS[kind])
        parts.append(F.when(may, part).otherwise(none))
    return docs.withColumn(out_col, F.concat(*parts))


def redact(docs: DataFrame, text_col: str = "text", pii_col: str = "pii", least_score: float = 0.0) -> DataFrame:
    """Replaces the union of the spans by ``<KIND>`` of the span that starts first; a null text stays null."""
    text = F.col(text_col)
    spans = F.array_sort(F.transform(F.filter(F.col(pii_col), lambda s: s["score"] >= least_score), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> Column:
        kept = F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int"))
        tag = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(at, s["end"]).alias("state"), F.when(s["start"] >= at, F.array(kept, tag)).otherwise(F.array().cast("array<string>")).alias("out"))

    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0).cast("bigint"))
    clean = F.concat(F.array_join(walk(spans, F.lit(0).cast("bigint"), step, "string")["out"], ""), F.substring(text, (last + 1).cast("int"), F.length(text)))
    return docs.withColumn(text_col, F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(clean))
