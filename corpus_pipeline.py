"""A corpus pipeline: from raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes what each
stage returns to the shared folder and reads it again for the next one.

1. ``quality``: the ordinal classifier, trained on the labels, rejects documents of the lowest grade.
2. ``exact_dedup``: of texts that are equal but for the case of A-Z, the document with the largest id stays.
3. ``near_dedup``: of documents whose five-word shingles overlap by 0.8 or more, as their SimHash fingerprints tell, the
   one with the smallest id stays.
4. ``mix``: documents are repeated or left out so that the sources come near their target shares of words.
5. ``encode``: every text becomes byte-level BPE ids, which are decoded again to prove that nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, exact_dedup, mixing, quality, scratch, simhash
from quarry.llm.queries import split_pattern, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text are graded as empty ones."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return quality.grade(docs.toDF(*places.values()), model, text_col=places["text"]).where("kept").select(*places.values()).toDF(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text are copies of empty ones; of rows that are equal in all but other columns one stays."""
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words are near duplicates of each other; those without id stay."""
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go through the mix without their texts, and meet them again by id and hash of the text.  Documents without
    words are never taken; null is a source like any other."""
    columns = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    carried = {f"__c{i}": c for i, c in enumerate(columns)}
    rows = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("__hash"), *(F.col(c).alias(k) for k, c in carried.items()))
    copies = mixing.mix(rows, carry=("__hash", *carried)).where("copies > 0")
    texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text_hash"), "text").dropDuplicates(["__id", "__text_hash"])
    taken = copies.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text_hash")))
    repeated = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("doc_id", "text", "source", *(F.col(k).alias(c) for k, c in carried.items())).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text have no ids."""
    coded = bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: The fitted classifier, the fingerprints and the merges can't be written in SQL; the stages have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs, table = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        new = scratch.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if table:
            table.drop()
        table, docs = new, new.df
    return docs
