import re
import time

import numpy as np
import pytest

from quarry.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TEXTS = [
    "write to a.b+c@mail.example.org, or x@y; a@b.com_x@y.com d@e.f@g.h",
    "hosts 1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.002.003.0255 and 1.2.3.99999999999999999999",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111, 378282246310005 5",
    "call +1 (743) 555-3824 or +49 30 123456--7 +1 +22 +123456789012345678",
    "é ü 日本 a@b.co 👍 10.0.0.1 👍 +4930123456789",
    "", None, "7" * 30000, "a" * 20000 + "@" + "b" * 100, "x@" * 5000, "+1 " * 5000, "1.2.3." * 5000, "@@@ +++ ...",
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.find(df).select("doc_id", pii.listing(pii.F.col("pii"), True).alias("base"), pii.listing(pii.F.col("pii")).alias("every"), "pii").collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_base_spans_are_those_of_the_patterns(found, i):
    assert found[i]["base"] == brute(TEXTS[i] or "")


def test_added_kinds(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 ok", "iban GB82 WEST 1234 5698 7654 33 no", "my ssn is 123-45-6789", "part 123-45-6789", "ssn 000-12-3456"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r["doc_id"]: [s["kind"] for s in r["pii"] if s["kind"] in ("iban", "ssn")] for r in pii.find(df).collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: []}


def test_context_raises_the_score(spark):
    df = spark.createDataFrame([("my card 4111111111111111",), ("number 4111111111111111",)], "text string")
    a, b = (r["pii"][0]["score"] for r in pii.find(df).collect())
    assert a > b


def test_redaction_and_clashes(spark):
    df = spark.createDataFrame([("mail a@b.co or 10.0.0.1!",), (None,)], "text string")
    assert [r["text"] for r in pii.redact(pii.find(df)).collect()] == ["mail <email> or <ip>!", None]
    assert pii.find(df.where("false")).count() == 0
    assert pii.find(df.withColumn("pii", pii.F.lit(1))).columns == ["text", "pii"]
    with pytest.raises(ValueError):
        pii.find(df, out_col="text")


def test_very_many_numbers_in_one_text(spark):
    """Two megabytes of numbers, of which some are cards, with places as a plain search finds them."""
    rng = np.random.default_rng(4)
    words = [str(n) if n % 50 else "4111 1111 1111 1111 é" for n in rng.integers(100000, 999999, 300_000).tolist()]
    text = ", ".join(words)
    assert len(text) > 2_000_000
    began = time.monotonic()
    spans = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["pii"]
    assert time.monotonic() - began < 60
    wanted = [m.span() for m in re.finditer("[0-9](?:[ -]?[0-9])+", text) if m.end() - m.start() > 10]
    assert [(s["start"], s["end"]) for s in spans if s["kind"] == "card"] == wanted
    assert all(text[s["start"] : s["end"]] == s["match"] for s in spans)
