"""Personal data: patterns propose spans, checks confirm them, words nearby adjust a score. DataFrame functions only.

A kind's matches are found by ``regexp_extract_all``; their places by ``split`` with the same pattern: the pieces between
the matches and the matches themselves alternate, so running sums of code points give start and end. Patterns are
written for Java's engine so that neither long runs cost quadratic time nor long repetitions deep recursion: repetitions
that can't profit from giving back are possessive, and a match only begins where a run begins.

Base kinds are exact (no score): email, ip, card (Luhn), phone. Added kinds need a score of ``THRESHOLD`` or more:

* iban: two letters, two digits, more characters in groups, whose rest modulo 97 is 1. A country of ``IBAN_LENGTHS`` takes
  exactly its length and scores 0.6, another one 11 to 30 more characters and 0.3; a context word adds 0.3. So it takes
  context where the country is not registered.
* ssn: three, two and four digits with hyphens, no part of a longer number, area neither 000, 666 nor from 900,
  no part all zeros. Score 0.3, and 0.4 more for a context word. So it takes context.
* Context is the ``CONTEXT_CHARS`` characters before a span, whatever matches lie in them, and as many whole words after it as
  follow in the same clause before any digit. A span that follows an accepted one of its kind with at most
  ``CONTEXT_CHARS`` characters between, no letter or digit among them, goes on a list: it scores at least what the one
  before it scored, so a list may be longer than the context.
* Base spans have score 1.
* A span of an added kind that touches a base span is left out.

Defined cases: a null or empty text has no spans and the digest of the empty string; null ids and repeated rows come out
as they came in; an empty table gives an empty result; other columns are ignored by ``find_spans`` and kept by ``mask``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
CONTEXT_CHARS = 48

# Registered countries of account numbers and the length of their numbers (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_REGISTERED = f"(?:{'|'.join(IBAN_LENGTHS)})"


def _iban_pattern() -> str:
    """A registered country with its length (so a capital or a number after it is not taken in), or another country."""
    by_length: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    known = "|".join(f"(?:{'|'.join(names)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, names in sorted(by_length.items()))
    other = rf"(?!{_REGISTERED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})(?![A-Za-z0-9])"


# A match of the first two may also begin where the one before it ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
# Score without context, what a context word adds, context words.
CONTEXT = {
    "iban": (0.3, 0.3, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer|bic|swift)\b"),
    "ssn": (0.3, 0.4, r"(?i)\b(?:ssn|social|security|taxpayer|tax)\b"),
}
REGISTERED_SCORE = 0.6
# What follows a match, to the end of a word, clause or digit-free stretch; always there, if need be empty.
_AFTER = rf"(?=((?:[^,;.!?\n0-9]{{0,{CONTEXT_CHARS}}}(?![\p{{L}}\p{{N}}]))?))"
_LIST_GAP = rf"^[^\p{{L}}\p{{N}}]{{0,{CONTEXT_CHARS}}}$"
# What a text must contain for the pattern to be tried at all.
_NEEDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "phone": lambda t: t.contains("+"),
}


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test."""

    def worth(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.regexp_replace(match, " ", "")
        return F.when(F.length(plain).between(15, 34), _mod97(plain)).otherwise(False)
    return F.lit(True)


def _score(kind: str, match: Column, before: Column, after: Column) -> Column:
    base, bonus, words = CONTEXT[kind]
    alone = F.lit(base)
    if kind == "iban":
        alone = F.when(match.rlike(f"^{_REGISTERED}"), REGISTERED_SCORE).otherwise(base)
    near = F.right(before, F.lit(CONTEXT_CHARS)).rlike(words) | after.rlike(words)
    return alone + F.when(near, bonus).otherwise(0.0)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _spans_of(kind: str, text: Column, matches: Column) -> Column:
    """The confirmed matches of a kind with their places: one pass over what lies between matches, and the matches."""
    rank = (*BASE_KINDS, *ADDED_KINDS).index(kind)
    scored = kind in ADDED_KINDS
    columns = [F.split(text, PATTERNS[kind]).alias("gap"), matches.alias("match")]
    if scored:
        columns.append(F.regexp_extract_all(text, F.lit(PATTERNS[kind] + _AFTER), F.lit(1)).alias("after"))
    pieces = F.arrays_zip(*columns)

    def step(state: Column, piece: Column) -> Column:
        gap, match = piece["gap"], piece["match"]
        start = state["at"] + F.length(gap)
        end = start + F.coalesce(F.length(match), F.lit(0))
        good = match.isNotNull() & _confirmed(kind, match)
        score = F.lit(1.0)
        if scored:
            listed = F.when(gap.rlike(_LIST_GAP), state["listed"]).otherwise(0.0)
            before = F.concat(state["before"], F.right(gap, F.lit(CONTEXT_CHARS)))
            score = F.greatest(listed, _score(kind, match, before, piece["after"]))
            good &= score >= THRESHOLD
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
        found = F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        if not scored:
            return F.struct(end.alias("at"), found.alias("found"))
        tail = F.right(F.concat(before, F.coalesce(match, F.lit(""))), F.lit(CONTEXT_CHARS))
        return F.struct(end.alias("at"), found.alias("found"), tail.alias("before"), F.when(good, score).otherwise(0.0).alias("listed"))

    state = [F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found")]
    begin = F.struct(*state, *((F.lit("").alias("before"), F.lit(0.0).alias("listed")) if scored else ()))
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(F.size(matches) > 0, F.aggregate(pieces, begin, step, lambda state: state["found"])).otherwise(none)


def _with_spans(df: DataFrame, text_col: str, base: str, spans: str) -> DataFrame:
    """``df`` with arrays ``base`` and ``spans`` (base and added ones), each in order of start and kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = (*BASE_KINDS, *ADDED_KINDS)
    names = {kind: f"{base}_{kind}" for kind in kinds}
    matched = {}
    for kind in kinds:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        needs = _NEEDS.get(kind)
        matched[names[kind]] = F.when(needs(text), found).otherwise(F.array().cast("array<string>")) if needs else found
    df = df.withColumns(matched)
    df = df.withColumns({name: _spans_of(kind, text, F.col(name)) for kind, name in names.items()})
    df = df.withColumn(base, F.array_sort(F.concat(*(F.col(names[kind]) for kind in BASE_KINDS))))
    added = F.concat(*(F.col(names[kind]) for kind in ADDED_KINDS))
    free = F.filter(added, lambda a: ~F.exists(F.col(base), lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    df = df.withColumn(spans, F.when(F.size(added) > 0, F.array_sort(F.concat(F.col(base), free))).otherwise(F.col(base)))
    return df.drop(*names.values())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of start, rank, end, kind, score; code points, end exclusive) of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_spans(rows, "text", "base", "spans").select("doc_id", "base", "spans")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans and all spans as text, from ``find_spans``."""

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("base"), lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with each span of its text replaced by its kind in brackets; spans that overlap become one, of the first kind."""
    base, spans = "__tidemark_base", "__tidemark_spans"
    text = F.col(text_col)

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        name = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], gap, name)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(F.col(spans), begin, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    out = _with_spans(df, text_col, base, spans)
    return out.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).select(df.columns)
