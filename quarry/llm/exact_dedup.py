"""Exact deduplication over an extendible-hash index on shared files.

Building: every document gets a row number and the 64-bit head of the SHA-256 of its normalised text as hash key, and
all of it is written once as segment files in the shared folder.  Equal texts of one batch are collapsed on the way:
one entry row carries their count and the row that would stay, so that a group that holds a third of all rows enters
the index as one entry per batch.  The bytes of all entries are summed by key prefix (at most 2**MAX_DEPTH numbers),
and from these a directory is grown: it starts with one bucket, every overfull bucket is split by its next key bit,
and the directory doubles when a bucket as deep as the directory is split.  A bucket that cannot be split keeps
chaining.  Each bucket is a range of keys and has one owner task, which reads the entries in key order, chains entries
with the same key, and compares bytes: only identical texts share a chain link.

A key with very many entries is folded first: its entries are dealt to as many tasks as it needs, ``FOLD`` entries each,
and every task chains its own and hands one entry per text to the owner.  The ``HOT_KEYS`` keys with most entries are
folded; any other key has less than one in ``HOT_KEYS`` of all entries.

The owner holds one key's chain at a time; collisions are right by comparison, not by trust in the hash.

Defined cases: a null text counts as empty; of equal texts the row with the largest id stays, null ids being the
smallest; of rows that are equal in id and text one stays, the one with the largest row number; very long texts are
compared whole; an empty table gives an empty table.  Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import scratch

#: Text bytes that a bucket takes before it is split.
BUCKET_BYTES = 16 << 20
#: The directory has at most 2**MAX_DEPTH slots, as the driver holds it.  Beyond a terabyte of distinct texts its buckets
#: grow with them, to some 2 GB at 100 TB, which their owners read as sorted streams.
MAX_DEPTH = 16
#: Keys that can be folded before their owner sees them, and entries that a folding task takes of one key.
HOT_KEYS, FOLD = 1024, 64

_ADDED = [
    T.StructField("__seg_row", T.LongType()),
    T.StructField("__seg_entry", T.LongType()),
    T.StructField("__seg_key", T.LongType()),
    T.StructField("__seg_sha256", T.StringType()),
    T.StructField("__seg_count", T.LongType()),
    T.StructField("__seg_keep", T.LongType()),
    T.StructField("__seg_keep_id", T.LongType()),
]


def normalise(text: str | None) -> bytes:
    """A-Z become a-z, nothing else changes."""
    return (text or "").encode().lower()


@dataclass
class Bucket:
    prefix: int
    depth: int
    size: int


class Directory:
    """An extendible-hash directory over the sizes of the finest key prefixes."""

    def __init__(self, sizes: dict[int, int], finest: int, capacity: int):
        self.sizes, self.finest, self.capacity = sizes, finest, capacity
        self.depth = 0
        self.slots = [Bucket(0, 0, sum(sizes.values()))]
        full = [b for b in self.slots if b.size > capacity]
        while full:
            bucket = full.pop()
            if bucket.depth < finest:
                full += [b for b in self._split(bucket) if b.size > capacity]

    def _split(self, bucket: Bucket) -> list[Bucket]:
        if bucket.depth == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        shift = self.finest - bucket.depth - 1
        parts = [Bucket(bucket.prefix << 1 | bit, bucket.depth + 1, 0) for bit in (0, 1)]
        first = bucket.prefix << (shift + 1)
        for prefix in range(first, first + (2 << shift)):
            parts[(prefix >> shift) & 1].size += self.sizes.get(prefix, 0)
        width = 1 << (self.depth - bucket.depth - 1)
        for i, part in enumerate(parts):
            at = part.prefix * width
            self.slots[at : at + width] = [part] * width
        return parts

    def owners(self) -> list[int]:
        """The bucket number of each slot; numbers follow the key order."""
        out, last = [], None
        for bucket in self.slots:
            out.append(out[-1] + (bucket is not last) if out else 0)
            last = bucket
        return out


def write_segments(df: DataFrame, id_col: str, text_col: str, key_bits: int = 64) -> scratch.Table:
    """The documents, all columns, with row number, entry, key and digest."""
    scratch.small_batches(df.sparkSession)
    names = [*df.columns, *(f.name for f in _ADDED)]
    text_at, id_at = df.columns.index(text_col), df.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            first: dict[bytes, int] = {}
            entries, keys, digests, counts, keeps = [], [], [], [], []
            ids = batch.column(id_at).to_pylist()
            for i, text in enumerate(batch.column(text_at)):
                raw = normalise(text.as_py())
                at = first.setdefault(raw, i)
                entries.append(row + at)
                counts.append(0)
                if at == i:
                    digest = hashlib.sha256(raw).digest()
                    keys.append(int.from_bytes(digest[:8], "big", signed=True) >> (64 - key_bits) << (64 - key_bits))
                    digests.append(digest.hex())
                    keeps.append(i)
                else:
                    keys.append(keys[at])
                    digests.append(digests[at])
                    keeps.append(None)
                    if ids[keeps[at]] is None or ids[i] is not None and ids[i] >= ids[keeps[at]]:
                        keeps[at] = i
                counts[at] += 1
            added = [
                pa.array(range(row, row + len(batch)), pa.int64()),
                pa.array(entries, pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(counts, pa.int64()),
                pa.array([None if k is None else row + k for k in keeps], pa.int64()),
                pa.array([None if k is None else ids[k] for k in keeps], pa.int64()),
            ]
            row += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return scratch.materialize(df.mapInArrow(run, T.StructType([*df.schema.fields, *_ADDED])), "exact-segments")


def build_directory(entries: DataFrame, capacity: int = BUCKET_BYTES) -> Directory:
    """From text bytes by key prefix; at most 2**MAX_DEPTH rows come to the driver."""
    prefix = F.shiftrightunsigned("__seg_key", 64 - MAX_DEPTH).alias("prefix")
    found = entries.groupBy(prefix).agg(F.sum(F.octet_length("text") + 64).alias("size")).collect()
    sizes = {r["prefix"]: r["size"] or 0 for r in found}
    return Directory(sizes, MAX_DEPTH, max(capacity, sum(sizes.values()) >> MAX_DEPTH))


_RESOLVED = "entry long, keep_row long, keep_id long, group_size long"
_FOLDED = "__seg_key long, __seg_entry long, text string, __seg_count long, __seg_keep_id long, __seg_keep long, into long"


@dataclass
class Link:
    """A chain link: a text, its entries, their count, and the row that stays."""

    raw: bytes
    entries: list[int]
    count: int
    keep: tuple


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Link]]]:
    """Entries in the order of their keys, and of what else is dealt with them, to the chain of each."""
    key, links = None, []
    for batch in batches:
        for *now, entry, text, count, keep_id, keep_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if links:
                    yield key[0], links
                key, links = now, []
            raw = normalise(text)
            keep = (keep_id is not None, keep_id, keep_row)
            for link in links:
                if link.raw == raw:
                    link.entries.append(entry)
                    link.count += count
                    if _later(keep, link.keep):
                        link.keep = keep
                    break
            else:
                links.append(Link(raw, [entry], count, keep))
    if links:
        yield key[0], links


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order to resolved entries."""
    out = []
    for _, links in _chains(batches):
        for link in links:
            _, keep_id, keep_row = link.keep
            out.extend((e, keep_row, keep_id, link.count) for e in link.entries)
        if len(out) > 10_000:
            yield _resolved(out)
            out.clear()
    yield _resolved(out)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of key and share to one entry per text, and the entries that went into it."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    for key, links in _chains(batches):
        rows = []
        for link in links:
            first, *others = link.entries
            rows.append((key, first, link.raw.decode(), link.count, link.keep[1], link.keep[2], first))
            rows.extend((key, e, None, 0, None, None, first) for e in others)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _FOLDED.split(", ")])


def _later(a: tuple, b: tuple) -> bool:
    if a[0] != b[0]:
        return a[0]
    return (a[1], a[2]) > (b[1], b[2]) if a[0] else a[2] > b[2]


def _resolved(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["entry", "keep_row", "keep_id", "group_size"])


def _resolve(segments: scratch.Table, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """A row for each entry: the row that stays of its class, that row's id, and the size of the class."""
    rows = segments.df
    entries = rows.where(F.col("__seg_row") == F.col("__seg_entry")).select(
        "__seg_key", "__seg_entry", F.col(text_col).alias("text"), "__seg_count", "__seg_keep_id", "__seg_keep"
    )
    entries, folded = _folded(entries)
    directory = build_directory(entries, capacity)
    owners = directory.owners()
    # at most 2**MAX_DEPTH slots of two numbers: small at any size of the input
    slots = rows.sparkSession.createDataFrame(list(enumerate(owners)), "slot long, owner int")
    slot = F.shiftrightunsigned("__seg_key", 64 - directory.depth) if directory.depth else F.lit(0)
    dealt = (
        entries.withColumn("slot", slot.cast("long"))
        .join(F.broadcast(slots), "slot")
        .drop("slot")
        .repartitionById(owners[-1] + 1, F.col("owner"))
        .sortWithinPartitions("__seg_key")
        .drop("owner")
    )
    resolved = dealt.mapInArrow(_chain, _RESOLVED)
    if folded is None:
        return resolved
    resolved = scratch.materialize(resolved, "exact-resolved").df
    into = folded.where("`into` != __seg_entry").select(F.col("__seg_entry").alias("was"), F.col("into").alias("entry"))
    return resolved.union(into.join(resolved, "entry").select(F.col("was").alias("entry"), "keep_row", "keep_id", "group_size"))


def _folded(entries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The entries with those of hot keys folded, and what was folded into what; at most ``HOT_KEYS`` rows come to the
    driver and are broadcast."""
    many = entries.groupBy("__seg_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLD)
    hot = many.orderBy(F.desc("n"), "__seg_key").limit(HOT_KEYS).collect()
    if not hot:
        return entries, None
    keys = F.broadcast(entries.sparkSession.createDataFrame([(r["__seg_key"], -(-r["n"] // FOLD)) for r in hot], "__seg_key long, shares long"))
    own = entries.join(keys, "__seg_key").withColumn("share", F.pmod(F.xxhash64("__seg_entry"), F.col("shares")))
    dealt = own.select("__seg_key", "share", "__seg_entry", "text", "__seg_count", "__seg_keep_id", "__seg_keep")
    folded = scratch.materialize(dealt.repartition("__seg_key", "share").sortWithinPartitions("__seg_key", "share").mapInArrow(_fold, _FOLDED), "exact-folded").df
    rest = entries.join(keys, "__seg_key", "left_anti")
    return rest.union(folded.where("`into` = __seg_entry").drop("into")), folded


def _resolved_rows(df: DataFrame, id_col: str, text_col: str, capacity: int, key_bits: int) -> DataFrame:
    segments = write_segments(df, id_col, text_col, key_bits)
    resolved = _resolve(segments, id_col, text_col, capacity)
    return segments.df.withColumnRenamed("__seg_entry", "entry").join(resolved, "entry")


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of the normalised text."""
    rows = _resolved_rows(df.select(id_col, text_col), id_col, text_col, capacity, key_bits)
    return rows.select(
        id_col, "keep_id", "group_size", (F.col("__seg_row") == F.col("keep_row")).alias("kept"), F.col("__seg_sha256").alias("text_sha256")
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    # positions instead of names, which are free to clash with those of the index
    places = {c: f"c{i}" for i, c in enumerate(df.columns)}
    segments = write_segments(df.toDF(*places.values()), places[id_col], places[text_col])
    resolved = _resolve(segments, places[id_col], places[text_col], capacity).select(F.col("entry").alias("__seg_entry"), F.col("keep_row").alias("__seg_row"))
    return segments.df.join(resolved, ["__seg_entry", "__seg_row"]).select(*places.values()).toDF(*df.columns)
