from __future__ import annotations

import hashlib
import random
import re

import pytest

from tidemark.llm import pii
from tidemark.llm.queries import op4_personal_data

PARTS = ["a", "b.c", "@", "@x.y", ".", "1", "22", "333", "256", "4111 1111 1111 1111", "-", " ", "+", "+1 (555) 123-4567", "_", "%", "é", "🙂", "\n", "(", "0", "1.2.3.4", "007.1.1.1"]


def luhn(number):
    total = 0
    for place, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m.group())]
    return sorted(found)


def digest(text):
    spans = base_spans(text or "")
    count = lambda kind: sum(s[3] == kind for s in spans)
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
    return count("email"), count("ip"), count("card"), count("phone"), hashlib.sha256(joined.encode()).hexdigest()


def test_base_spans_of_the_whole_table(spark, sf_dir, texts):
    rows = op4_personal_data(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in rows} == {i: digest(t) for i, t in texts.items()}
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows) > 0


def test_base_spans_of_random_texts(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    texts += ["1 " * 40_000, "a." * 30_000, "+" + "1 " * 30_000, "9" * 50_000, None, "", "x@y.z" * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:6] for r in pii.span_digests(pii.find_spans(frame)).collect()}
    assert found == {i: digest(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("pay DE89 3704 0044 0532 0130 00.", ["iban"]),
        ("pay DE88 3704 0044 0532 0130 00.", []),
        ("my ssn is 123-45-6789", ["ssn"]),
        ("part no 123-45-6789", []),
        ("ssn 000-45-6789, ssn 666-12-3456, ssn 123-00-4567", []),
        ("ssn 123-45-6789 then " + "x " * 60 + "123-45-6780", ["ssn"]),
    ],
)
def test_added_kinds_take_checks_and_context(spark, text, expected):
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["base"] == []
    assert [s["kind"] for s in row["spans"]] == expected
    assert all(text[s["start"] : s["end"]].strip() == text[s["start"] : s["end"]] for s in row["spans"])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SSN 123-45-6789, 234-56-7890", 2),
        ("ssn: " + ", ".join(f"123-45-{n}" for n in range(1000, 1030)), 30),
        ("ssn 123-45-6789 or else 234-56-7890", 2),  # the word is within the context of both
        ("part 123-45-6789, tax 234-56-7890", 1),
        ("part 123-45-6789, 234-56-7890", 0),
        ("ssn 123-45-6789 " + "x " * 30 + "234-56-7890, 345-67-8901", 1),
    ],
)
def test_context_reaches_over_earlier_numbers(spark, text, expected):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [s["kind"] for s in pii.find_spans(frame).first()["spans"]] == ["ssn"] * expected
    assert pii.mask(frame).first()["text"].count("[SSN]") == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("see DE89 3704 0044 0532 0130 00 Please", [("DE89 3704 0044 0532 0130 00", 0.6)]),  # a capital after it is no part of it
        ("DE89 3704 0044 0532 0130 00 GB29NWBK60161331926819", [("DE89 3704 0044 0532 0130 00", 0.6), ("GB29NWBK60161331926819", 0.6)]),
        ("our bank: DE89370400440532013000", [("DE89370400440532013000", 0.9)]),
        ("DE89370400440532013000 is our account", [("DE89370400440532013000", 0.9)]),
        ("DE8937040044053201300", []),  # one character short
        ("code ZZ02ABCDEFGHIJK", []),  # no such country, no context
        ("iban ZZ02ABCDEFGHIJK", None),
        ("123-45-6789 (SSN)", [("123-45-6789", 0.7)]),
        ("123-45-6789 is a social number; " + "x " * 30 + "234-56-7890", [("123-45-6789", 0.7)]),
        ("part 123-45-6789, ssn follows", []),  # another clause
        ("part 123-45-6789 9 ssn", []),  # another number
        ("123-45-6789 " + "x " * 23 + "taxonomy", []),
        ("123-45-6789" + "y" * 60, []),
        ("ssn 123-45-6789 / 234-56-7890", [("123-45-6789", 0.7), ("234-56-7890", 0.7)]),
    ],
)
def test_scores(spark, text, expected):
    if expected is None:  # the check digits that make the made-up number right
        head, body = text.split("ZZ02")
        number = next(f"ZZ{n:02}{body}" for n in range(2, 99) if int("".join(str(int(c, 36)) for c in body + "ZZ") + f"{n:02}") % 97 == 1)
        plain = spark.createDataFrame([(1, f"code {number}"), (2, head + number), (3, f"{number} (iban)")], "doc_id long, text string")
        found = {r["doc_id"]: [round(s["score"], 6) for s in r["spans"]] for r in pii.find_spans(plain).collect()}
        assert found == {1: [], 2: [0.6], 3: [0.6]}
        return
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(text[s["start"] : s["end"]], round(s["score"], 6)) for s in row["spans"]] == expected


def test_a_long_list_of_numbers_is_linear(spark):
    text = "ssn " + ", ".join(["123-45-6789"] * 3000) + " GB29 NWBK 6016 1331 9268 19" * 300
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s["kind"] for s in row["spans"]] == ["ssn"] * 3000 + ["iban"] * 300


def test_masking(spark, odd):
    frame = spark.createDataFrame([(1, "mail a@b.co or +1 (555) 123-4567!", 7), (2, "none", 8), (3, None, 9)], "doc_id long, text string, base int")
    masked = pii.mask(frame)
    assert masked.columns == frame.columns
    assert [r["text"] for r in masked.orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE]!", "none", None]
    assert pii.mask(odd).exceptAll(odd).count() == 0


def test_odd_rows(odd, none):
    rows = pii.span_digests(pii.find_spans(odd)).collect()
    assert len(rows) == odd.count() and all(r["spans"] == "" for r in rows)
    assert pii.span_digests(pii.find_spans(none)).count() == 0


def test_the_plan_is_native(odd):
    plan = pii.mask(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
