"""Token counts of documents by a byte-level ``tokenizers`` file, without materialising ids.

Each document is reduced to the frequencies of its pre-tokens; the pieces of each distinct pre-token are counted once, by
the library; frequencies meet piece counts in a join, and a document's count is the frequency-weighted sum.

The join is packed, as one row per word would move many times the corpus:

1. The most frequent pre-tokens of a bounded sample (``SAMPLE_ROWS`` texts, ``FREQUENT`` pre-tokens of up to
   ``FREQUENT_LENGTH`` characters) are counted first and broadcast, which is a bounded table.  They are summed as they are
   met.  What the sample holds decides where a pre-token is counted, never the result.
2. All others are frequencies by place in the vocabulary of a slice, which is some ``SLICE_BYTES`` of texts.  Documents are
   written with these, and so are the vocabularies, cut into buckets by a hash of the pre-token.
3. Buckets are dealt by number.  A pre-token is in one bucket, whose task counts it once for all slices, and a slice's
   buckets return as piece counts by place.  However frequent, a pre-token comes once from each slice.
4. Documents and the piece counts of their slice are dealt by slice, and the sums are taken.

A task holds the pre-tokens of one bucket, or one slice.

The library takes added tokens out of a text first, so that their strings count as one token each and the text is cut
there.  Its character classes may belong to another Unicode version than those of ``regex``; characters are compared
once, when first met, and texts with a character that differs are cut by the library's own pre-tokeniser.

Defined cases: a null text counts as the empty text; very long texts are counted whole and make a slice of their own; an
empty table gives an empty table; other columns pass through, but for one with the name of the result, which is replaced;
repeated rows are counted alike, each by itself.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import scratch

SAMPLE_ROWS = 2048
FREQUENT, FREQUENT_LENGTH = 1 << 16, 32
#: Bytes of text whose pre-tokens share a vocabulary.
SLICE_BYTES = 16 << 20
#: Pre-tokens that the library encodes together.
ENCODED_AT_ONCE = 1 << 14


class PieceCounter:
    """Pre-tokens of texts, and the pieces of each.  ``spec`` is the content of a tokenizers JSON file with a byte-level
    pre-tokeniser."""

    def __init__(self, spec: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(pattern)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        plain = all(not (t.lstrip or t.rstrip or t.single_word) for t in self.tokenizer.get_added_tokens_decoder().values())
        if not plain or self.tokenizer.normalizer is not None:
            raise ValueError("only plain added tokens and no normaliser are supported")
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.same: set[str] = set(map(chr, range(0x21, 0x7F))) | {" ", "\n"}
        self.odd: set[str] = set()

    def _compare(self, characters: set[str]) -> None:
        for c in characters:
            probe = f"a{c}1{c}!{c}  {c} a"
            theirs = [end for _, (_, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            (self.same if theirs == [m.end() for m in self.find.finditer(probe)] else self.odd).add(c)

    def _split(self, segment: str) -> list[str]:
        if not segment.isascii() or not segment.isprintable():
            characters = set(segment) - self.same
            self._compare(characters - self.odd)
            if not self.odd.isdisjoint(characters):
                return [segment[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment)]
        return self.find.findall(segment)

    def frequencies(self, text: str) -> tuple[int, Counter[str]]:
        """The number of added tokens, and the frequencies of the pre-tokens between them."""
        segments = self.added.split(text) if self.added else [text]
        found: Counter[str] = Counter()
        for segment in segments:
            found.update(self._split(segment))
        return len(segments) - 1, found

    def pieces(self, pretokens: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        out = []
        for at in range(0, len(pretokens), ENCODED_AT_ONCE):
            out += [len(e.ids) for e in self.tokenizer.encode_batch(pretokens[at : at + ENCODED_AT_ONCE], add_special_tokens=False)]
        return out


_counters: dict[int, PieceCounter] = {}


def _counter(spec: str, pattern: str) -> PieceCounter:
    key = hash((spec, pattern))
    if key not in _counters:
        _counters.clear()
        _counters[key] = PieceCounter(spec, pattern)
    return _counters[key]


def frequent_pretokens(texts: DataFrame, spec, pattern: str) -> list[str]:
    """The pre-tokens that are most frequent in a sample of the texts (text); at most ``FREQUENT`` come to the driver."""
    # the distinct texts with the smallest hashes; only hashes are ordered
    hashed = texts.where("text is not null").withColumn("h", F.xxhash64("text"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value, pattern)
        for batch in batches:
            total: Counter[str] = Counter()
            for text in batch.column(0):
                total.update(counter.frequencies(text.as_py() or "")[1])
            short = [(p, n) for p, n in total.items() if len(p) <= FREQUENT_LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], names=["pretoken", "n"])

    counted = sample.mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return [r["pretoken"] for r in counted.orderBy(F.desc("n"), "pretoken").limit(FREQUENT).select("pretoken").collect()]


_SLICED = "slice long, bucket int, places array<int>, amounts array<int>, pretokens array<string>, counted long"


def _lists(lists: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array([x for own in lists for x in own], np.int32)))


def _sliced(df: DataFrame, text_at: int, kept: list[int], spec, frequent, pattern: str, buckets: int) -> DataFrame:
    """A row per document: its slice, the places and amounts of its pre-tokens, the sum of those that are counted, and the
    kept columns; and a row per slice and bucket (with ``bucket``): places and pre-tokens of the vocabulary."""
    fields = [T.StructField(f"c{i}", df.schema.fields[at].dataType) for i, at in enumerate(kept)]
    schema = T.StructType([*T._parse_datatype_string(_SLICED).fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = _counter(spec.value, pattern), frequent.value
        number = TaskContext.get().partitionId() << 33
        vocabulary: dict[str, int] = {}
        # places and amounts of a slice lie end to end, as a list of numbers per document holds ten times the memory
        rows, places, amounts, counts, counted, size = [], array("i"), array("i"), array("i"), array("q"), 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            n = len(counted)
            columns = [pa.concat_arrays([r[i] for r in rows]) for i in range(len(kept))]
            none = lambda kind: pa.nulls(n, kind)
            offsets = pa.array(np.cumsum([0, *counts], dtype=np.int32))
            packed = [pa.ListArray.from_arrays(offsets, pa.array(np.array(x, np.int32))) for x in (places, amounts)]
            own = [pa.array(np.full(n, number)), none(pa.int32()), *packed, none(pa.list_(pa.string())), pa.array(np.array(counted, np.int64))]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=schema.names)
            parts: dict[int, list[tuple[str, int]]] = {}
            for pretoken, place in vocabulary.items():
                parts.setdefault(zlib.crc32(pretoken.encode()) % buckets, []).append((pretoken, place))
            n = len(parts)
            if n:
                own = [
                    pa.array(np.full(n, number)), pa.array(list(parts), pa.int32()), _lists([[at for _, at in p] for p in parts.values()]), none(pa.list_(pa.int32())),
                    pa.array([[t for t, _ in p] for p in parts.values()], pa.list_(pa.string())), none(pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*own, *(none(c.type) for c in columns)], names=schema.names)
            number += 1
            size = 0
            vocabulary.clear()
            rows.clear()
            for x in (places, amounts, counts, counted):
                del x[:]

        for batch in batches:
            done = 0
            for i, text in enumerate(batch.column(text_at)):
                text = text.as_py() or ""
                total, found = counter.frequencies(text)
                before = len(places)
                for pretoken, n in found.items():
                    pieces = known.get(pretoken)
                    if pieces is None:
                        places.append(vocabulary.setdefault(pretoken, len(vocabulary)))
                        amounts.append(n)
                    else:
                        total += pieces * n
                counts.append(len(places) - before)
                counted.append(total)
                size += len(text)
                if size >= SLICE_BYTES or i + 1 == len(batch):
                    part = batch.slice(done, i + 1 - done)
                    rows.append([part.column(c) for c in kept])
                    done = i + 1
                if size >= SLICE_BYTES:
                    yield from close()
        if counted:
            yield from close()

    return df.mapInArrow(run, schema)


def _count_buckets(spec, pattern: str):
    """Vocabularies of one bucket's slices to piece counts by place; each distinct pre-token is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value, pattern)
        known: dict[str, int] = {}
        for batch in batches:
            lists = batch.column(2).to_pylist()
            new = list(dict.fromkeys(p for own in lists for p in own if p not in known))
            known.update(zip(new, counter.pieces(new), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([[known[p] for p in own] for own in lists])], names=["slice", "places", "amounts"])

    return run


def _sum_slices(names: list[str]):
    """Rows in the order of slices, piece counts before documents, to documents with their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, np.zeros(0, np.int64)
        for batch in batches:
            slices = batch.column(0).to_numpy()
            is_document = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(slices) != 0) | (np.diff(is_document.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                part = batch.slice(lo, hi - lo)
                if slices[lo] != now:
                    now, pieces = slices[lo], np.zeros(0, np.int64)
                places, amounts = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                if not is_document[lo]:
                    most = int(places.max(initial=-1)) + 1
                    if most > len(pieces):
                        pieces = np.concatenate([pieces, np.zeros(max(most, 2 * len(pieces)) - len(pieces), np.int64)])
                    pieces[places] = amounts
                else:
                    run_ = np.concatenate([[0], np.cumsum(pieces[places] * amounts)])
                    ends = np.cumsum(part.column(2).value_lengths().to_numpy())
                    sums = run_[ends] - run_[ends - part.column(2).value_lengths().to_numpy()]
                    total = part.column(4).to_numpy() + sums
                    yield pa.RecordBatch.from_arrays([*part.columns[5:], pa.array(total.astype(np.int64))], names=names)

    return run


def count_tokens(df: DataFrame, tokenizer_path: str, pattern: str, text_col: str = "text", out_col: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """Appends ``out_col`` (long): the number of tokens of each whole text.  ``keep_text``: whether the text stays."""
    df = scratch.without(df, (out_col,), (text_col,))
    spark = df.sparkSession
    scratch.small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    spec = spark.sparkContext.broadcast(content)
    text_at = df.columns.index(text_col)
    kept = [i for i in range(len(df.columns)) if keep_text or i != text_at]
    names = [df.columns[i] for i in kept]
    first = frequent_pretokens(df.select(df[text_col].alias("text")), spec, pattern)
    frequent = spark.sparkContext.broadcast(dict(zip(first, _counter(content, pattern).pieces(first), strict=True)))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = scratch.materialize(_sliced(df, text_at, kept, spec, frequent, pattern, buckets), "token-slices").df
    vocabularies = sliced.where("bucket is not null").repartition(buckets, "bucket").select("slice", "places", "pretokens")
    counts = scratch.materialize(vocabularies.mapInArrow(_count_buckets(spec, pattern), "slice long, places array<int>, amounts array<int>"), "piece-counts").df
    documents = sliced.where("bucket is null").drop("bucket", "pretokens")
    inner = [c for c in documents.columns if c not in ("slice", "places", "amounts", "counted")]
    columns = ["slice", "document", "places", "amounts", "counted", *inner]
    both = documents.withColumn("document", F.lit(True)).select(*columns).unionByName(counts.withColumn("document", F.lit(False)), allowMissingColumns=True)
    dealt = both.repartition("slice").sortWithinPartitions("slice", "document")
    fields = [T.StructField(n, df.schema.fields[i].dataType) for n, i in zip(names, kept, strict=True)]
    return dealt.mapInArrow(_sum_slices([*names, out_col]), T.StructType([*fields, T.StructField(out_col, T.LongType())]))
