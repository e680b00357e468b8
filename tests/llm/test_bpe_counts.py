import base64
import hashlib

import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from quarry.llm import bpe, token_counts  # noqa: E402

TEXTS = [
    (1, "Hello world, it's 12345 things!\n\n  and   more   "),
    (2, ""),
    (3, None),
    (4, "naïve café — 日本語 текст 👩‍👩‍👧   x"),
    (5, "<|endoftext|> is text <|endoftext|>"),
    (6, "a" * 5000 + " " * 3000 + "\t\n" * 50),
    (7, "Hello world, it's 12345 things!\n\n  and   more   "),
    (8, "՘ ꟎ \U00010940 \x1c\x1d\x85 ¼ ² Ⅷ"),
    (9, "word " * 20000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, ids_of string")


def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes(spark, docs):
    rows = bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    enc = reference()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = dict(TEXTS)[r["doc_id"]] or ""
        assert list(r["ids"]) == enc.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_encode_and_decode_apart(spark, docs):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, ranks, P.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids_of", "ids"]
    back = bpe.decode(coded.drop("text"), ranks).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back} == {i: t or "" for i, t in TEXTS}


def test_digest(spark):
    df = spark.createDataFrame([([1, 22, 333],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(bpe.ids_digest("ids")).collect()] == [hashlib.sha256(b"1 22 333").hexdigest(), hashlib.sha256(b"").hexdigest()]


def test_null_ids(spark):
    df = spark.createDataFrame([(None,), ([15496, None, 995],)], "ids array<int>")
    rows = bpe.decode(df, P.path("byte_bpe_50k.tiktoken")).collect()
    assert bytes(rows[0]["decoded"]) == b"" and bytes(rows[1]["decoded"]) == b"Hello world"


def test_empty_and_clashes(spark, docs):
    ranks = P.path("byte_bpe_50k.tiktoken")
    assert bpe.round_trip(docs.where("false"), ranks, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, ranks, P.PATTERN, ids_col="TEXT")
    clash = docs.withColumn("IDS", F.lit("x")).withColumn("decoded", F.lit("y"))
    assert bpe.round_trip(clash, ranks, P.PATTERN).columns == ["doc_id", "ids_of", "ids", "decoded"]
    counted = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN, out_col="ids_of")
    assert counted.schema["ids_of"].dataType.simpleString() == "bigint"


def test_small_tables_of_known_pretokens(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PRETOKENS", 3)
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    tokens = sorted(ranks, key=ranks.get)
    e = bpe.Encoder(bpe.serialize_model(ranks), tokens, P.PATTERN)
    enc = reference()
    for _ in range(2):
        for _, t in TEXTS:
            found = e.encode_all([t or ""])[0]
            assert [i for ids in found for i in ids] == enc.encode_ordinary(t or "")


def test_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in TEXTS}
    assert token_counts.count_tokens(docs.where("false"), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_ranks_without_gaps():
    with pytest.raises(ValueError):
        bpe.serialize_model({b"a": 0, b"b": 2})


def test_columns_pass_through(spark, docs):
    assert bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).where(F.col("ids_of") == "x").count() == len(TEXTS)


def test_counts_by_slices_and_buckets(spark, monkeypatch):
    """Slices of a few texts, with nearly all pre-tokens counted in buckets; repeated rows, nulls and a long text."""
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "FREQUENT", 2)
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 500)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé ü1$\n") for _ in range(rng.randint(1, 12)))
    texts = [t for _, t in TEXTS] + [" the".join(word() for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", "same words", "same words", " ".join(word() for _ in range(30_000)), "z" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "n_bytes long, text string").repartition(3)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = token_counts.count_tokens(df, P.path("byte_bpe_50k.json"), P.PATTERN, keep_text=False).collect()
    assert [tuple(r) for r in sorted(rows)] == [(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)]
