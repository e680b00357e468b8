"""One query per operator, with production parameters, over whole tables; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the tokenizer files; None: where the installed package keeps them.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import pii

    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    spans = F.col("pii")
    return found.select(
        "doc_id",
        *(pii.count(spans, kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")),
        F.sha2(pii.listing(spans, base_only=True).cast("binary"), 256).alias("base_sha256"),
        pii.listing(spans).alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import simhash

    return simhash.assign(table(spark, sf_dir, "documents"), words=3, budget=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import scratch, warc

    path = scratch.new_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    page = lambda urn: F.expr(f"try_cast(regexp_extract({urn}, '([0-9-]+)>$', 1) as bigint)")
    return warc.read(spark, path).select(
        page("record_id").alias("page_id"),
        F.coalesce(F.length("payload"), "payload_length").cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import token_counts

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    docs = table(spark, sf_dir, "documents").select("doc_id", n_bytes, "text")
    counted = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), split_pattern(), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import suffix_dedup

    return suffix_dedup.digests(table(spark, sf_dir, "documents"), width=200, keep_first=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import exact_dedup

    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import vamana

    return vamana.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.grade(docs, model).drop("text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


SQL: dict[str, str] = {}

SQL["op7_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM n
WINDOW g AS (PARTITION BY t)
"""


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(s, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
SQL["op4_warc"] = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS s,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS r
  FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = r THEN NULL ELSE r END AS refers_to
FROM p
"""


def _pii_sql() -> str:
    """The same spans by matching and splitting; look-behinds and possessive quantifiers only save time and are left out."""
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(0, length({digits})), lambda j: CASE WHEN j % 2 = 0 THEN CAST(substr({digits}, length({digits}) - j, 1) AS INTEGER)"
        f" ELSE CAST(substr('0246813579', CAST(substr({digits}, length({digits}) - j, 1) AS INTEGER) + 1, 1) AS INTEGER) END)) % 10 = 0"
    )
    compact = "replace(x.m, ' ', '')"
    moved = f"(substr({compact}, 5) || substr({compact}, 1, 4))"
    number = f"array_to_string(list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split({number}, ''), lambda c: CAST(c AS INTEGER))), lambda a, c: (a * 10 + c) % 97) = 1"
    near = "lower(substr(t, greatest(x.s - 40, 0) + 1, least(x.s, 40)) || ' ' || substr(t, x.e + 1, 40))"
    kinds = [
        ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
        ("ip", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0"),
        ("card", "[0-9](?:[\\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
        ("iban", "\\b[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}\\b", f"length({compact}) BETWEEN 15 AND 34 AND {mod97}"),
        ("ssn", "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b", f"NOT regexp_matches(x.m, '^(?:000|666|9)|-00-|-0000') AND regexp_matches({near}, '\\bssn\\b|social security')"),
    ]
    found = []
    for order, (kind, pattern, ok) in enumerate(kinds):
        m, g = f"regexp_extract_all(t, '{pattern}')", f"regexp_split_to_array(t, '{pattern}')"
        size = lambda x, to: f"coalesce(list_sum(list_transform({x}[1:{to}], lambda y: length(y))), 0)"
        start = f"CAST({size('g', 'i')} + {size('m', 'i - 1')} AS INTEGER)"
        spans = f"list_transform(range(1, len(m) + 1), lambda i: struct_pack(s := {start}, o := {order}, e := {start} + length(m[i]), k := '{kind}', m := m[i]))"
        found.append(f"SELECT doc_id, list_filter({spans}, lambda x: {ok}) AS spans FROM (SELECT doc_id, t, {m} AS m, {g} AS g FROM d)")
    listed = "coalesce(string_agg(x.k || ':' || x.s || ':' || x.e, ',' ORDER BY x.s, x.o) {}, '')"
    counts = ", ".join(f"count(*) FILTER (x.k = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(found)}),
x AS (SELECT doc_id, unnest(spans) AS x FROM f)
SELECT d.doc_id, {counts}, sha256({listed.format("FILTER (x.o < 4)")}) AS base_sha256, {listed.format("")} AS spans
FROM d LEFT JOIN x ON d.doc_id = x.doc_id GROUP BY d.doc_id
"""


SQL["op2_pii"] = _pii_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
