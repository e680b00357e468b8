"""Removal of repeated passages: every byte that a repeated string of ``width`` bytes covers.

Within a text, longest previous factors come from the suffix order: for a position, the previous and the next smaller
position in suffix order hold its longest earlier matches.  Positions whose factor reaches ``width`` start a later copy,
and the smaller position that the factor was found at starts an earlier one.  With ``keep_first`` the later copies alone
are removed, without it the earlier ones as well.

Over a corpus, suffix order is taken within groups of places that hold all copies of what is in them.  The string of
``width`` bytes at each position is assigned to its anchor, the ``GRAM``-byte string within it with the smallest hash
(the leftmost of equals).  Equal strings have equal anchors, so the anchor's hash is a key that brings all copies of a
string together.  Neighbouring strings mostly share their anchor, and a maximal run of them is one place.

1. Equal texts are one text, known by 128 bits of its SHA-256, with the number of its copies.  A text with two copies
   repeats as a whole; what it shares with other texts is found with one of its copies.
2. Places of all texts, without their bytes, are written once.  Keys with one place hold nothing repeated.
3. Texts meet the list of their places with repeated keys, and those that have any are written with it.
4. Contents are known by 128 bits of XXH3 within their 64-bit key.  Of equal ones only one goes on with its bytes, and
   only if its key has others.  Those of keys of up to ``GROUP`` places are dealt by key and go into one suffix order with
   the rest of the task's batch.
5. Keys with more places are hot, and a suffix order of theirs would not fit one task.  Their strings are taken in blocks
   of ``BLOCK`` by their distance from the anchor.  All strings of a block hold its core, so a block whose core no other
   content has holds nothing repeated; blocks with equal contents repeat as a whole, and again only one goes on.  What is
   left, mostly the blocks at the ends of a passage, is told apart string by string.  Cores, blocks and strings are known
   by 128 bits of BLAKE2b, counted with partial aggregation, and matched in joins whose large partitions Spark can split.
   So a passage that a third of all documents share is never gathered in one task.  Bytes are not compared there: among
   10**12 strings, the chance of any two that differ and share a hash is below 10**-14.
6. Intervals are merged by text, and the bytes that remain are the result of every document with that text.

Defined cases: a null text counts as empty; texts shorter than ``width`` have no repeated strings; very long texts are cut
into overlapping parts to find places, and strings across parts are found; matches never cross documents; repeated rows
all lose their bytes (with ``keep_first``, of equal texts those with the smallest id keep theirs); a null id is the
smallest; copies that tie in id stand in the order of their texts' hashes; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import scratch

WIDTH = 200
GRAM = 32
#: Places of one key that are compared in one suffix order: with some 400 bytes each they fit ``ORDER_BYTES``.
GROUP = 4096
#: Strings of a hot place that are held against other places together; an anchor is in at most 13 * 13 strings.
BLOCK = 13
#: Bytes of text whose places are found together; longer texts are cut into overlapping parts.
PART_BYTES = 1 << 18
#: Bytes that go into one suffix order.
ORDER_BYTES = 1 << 21

#: What becomes of a place, as bits: it goes as a whole; it is compared in a suffix order; it is compared by blocks.
WHOLE, COLD, HOT = 1, 2, 4


# --- suffix order --------------------------------------------------------------------------------------------------


def _ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    sorted_ = values[order]
    out = np.empty(len(values), np.uint64)
    out[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]), dtype=np.uint64)
    return out


def prefix_ranks(raw: np.ndarray, width: int) -> np.ndarray:
    """The rank of each position by its next ``width`` bytes (zeros follow the end), by prefix doubling."""
    have = 1
    while have * 2 <= min(width, 8):
        have *= 2
    padded = np.concatenate([raw, np.zeros(width, np.uint8)])
    words = np.zeros(len(raw), np.uint64)
    for i in range(have):
        words = words << np.uint64(8) | padded[i : len(raw) + i]
    ranks = _ranks(words)
    while have < width:
        step = min(have, width - have)
        ahead = np.zeros(len(ranks), np.uint64)
        # past the end there are zeros only, which rank below all others
        ahead[: max(len(ranks) - step, 0)] = ranks[step:] + np.uint64(1)
        ranks = _ranks(ranks << np.uint64(32) | ahead)
        have += step
    return ranks


def smaller_neighbours(order: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the suffix-order places in ``among``: where the previous and the next smaller position stand (-1, n: none)."""
    n = len(order)
    out = []
    for step, end in ((-1, -1), (1, n)):
        jump = np.arange(n) + step
        todo = among[jump[among] != end]
        todo = todo[order[jump[todo]] > order[todo]]
        while len(todo):
            over = jump[todo]
            jump[todo] = jump[over]
            todo = todo[jump[todo] != end]
            todo = todo[order[jump[todo]] > order[todo]]
        out.append(jump[among])
    return out[0], out[1]


def repeated_starts(raw: np.ndarray, valid: np.ndarray, width: int, keep_first: bool = False) -> np.ndarray:
    """Which valid positions start a string of ``width`` bytes that starts at another valid position too.

    The longest previous factor of a position is its match with the previous or the next smaller position in suffix
    order.  It reaches ``width`` where one of the two shares the position's rank; that one starts the earlier copy.
    Positions without such a neighbour in suffix order have shorter factors, which are not computed."""
    out = np.zeros(len(raw), bool)
    ranks = prefix_ranks(raw, width)
    places = np.flatnonzero(valid)
    order = places[np.lexsort((places, ranks[places]))]
    same = ranks[order[1:]] == ranks[order[:-1]]
    among = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if not len(among):
        return out
    before, after = smaller_neighbours(order, among)
    own = ranks[order[among]]
    for side, end in ((before, -1), (after, len(order))):
        there = np.flatnonzero(side != end)
        long_enough = there[ranks[order[side[there]]] == own[there]]
        out[order[among[long_enough]]] = True
        if not keep_first:
            out[order[side[long_enough]]] = True
    return out


# --- places --------------------------------------------------------------------------------------------------------


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    h = raw.astype(np.uint64) + np.uint64(1)
    size, factor = 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor * 5 + 2 & (1 << 64) - 1 | 1
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def places(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with the same anchor, in texts [start, end) laid end to end: first string, count, key."""
    none = np.empty(0, np.int64)
    if not (ends - starts >= width).any():
        return none, none, np.empty(0, np.uint64)
    hashes = _gram_hashes(raw)
    low = np.uint64((1 << 20) - 1)
    least = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
    span, have = width - GRAM + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: have - span], least[span - have :])
    anchors = (least & low).astype(np.int64)
    change = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    inside = np.zeros(len(raw) + 1, np.int64)
    some = ends - starts >= width
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some] - width + 1, -1)
    valid = np.cumsum(inside)[: len(anchors)] > 0
    first = valid & (change | ~np.concatenate([[False], valid[:-1]]))
    at = np.flatnonzero(first)
    total = np.concatenate([[0], np.cumsum(valid)])
    count = total[np.concatenate([at[1:], [len(anchors)]])] - total[at]
    return at, count, hashes[anchors[at]]


def _parts(texts: list[bytes], width: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Bytes laid end to end, with (text, offset within the text, length) of each piece."""
    buffer, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - width + 1, 0), PART_BYTES):
            piece = text[at : at + PART_BYTES + width - 1]
            buffer.append(piece)
            pieces.append((i, at, len(piece)))
            size += len(piece)
            if size >= PART_BYTES:
                yield b"".join(buffer), pieces
                buffer, pieces, size = [], [], 0
    if pieces:
        yield b"".join(buffer), pieces


def _find_places(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first string, count, key, two halves of the content's hash) of all places."""
    import xxhash

    for joined, pieces in _parts(texts, width):
        raw = np.frombuffer(joined, np.uint8)
        which, offset, length = (np.array(c) for c in zip(*pieces, strict=True))
        ends = np.cumsum(length)
        at, count, key = places(raw, ends - length, ends, width)
        piece = np.searchsorted(ends, at, side="right")
        stops = at + count - 1 + width
        content = np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(at.tolist(), stops.tolist(), strict=True)), np.int64).reshape(-1, 2)
        yield which[piece], at - (ends - length)[piece] + offset[piece], count, key, content[:, 0], content[:, 1]


def _blocks(text: bytes, start: int, count: int, key: int, width: int) -> Iterator[tuple[int, int, int, int, tuple[int, bytes]]]:
    """The blocks of a place: two halves of the core's hash, two of the block's, (first string, bytes)."""
    # the anchor is the leftmost string with the key among those that all strings of the place hold
    common = np.frombuffer(text, np.uint8, width - count + 1, start + count - 1)
    anchor = start + count - 1 + int(np.flatnonzero(_gram_hashes(common).view(np.int64) == key)[0])
    for b in range((anchor - start - count + 1) // BLOCK, (anchor - start) // BLOCK + 1):
        nearest, farthest = anchor - b * BLOCK, anchor - b * BLOCK - BLOCK + 1
        first = max(start, farthest)
        content = text[first : min(start + count - 1, nearest) + width]
        core = hashlib.blake2b(text[nearest : farthest + width], digest_size=16, salt=b"%d" % b).digest()
        own = hashlib.blake2b(content, digest_size=16, salt=b"%d %d" % (b, anchor - first)).digest()
        yield *np.frombuffer(core + own, np.int64).tolist(), (first, content)


def _runs(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Sorted starts of strings to the intervals that they cover, one for each row of consecutive starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    first, last = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + width).tolist(), strict=True))


def _united(intervals: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Intervals to the maximal runs that they cover."""
    runs: list[list[int]] = []
    for s, e in sorted(intervals):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


# --- corpus --------------------------------------------------------------------------------------------------------

_INTERVAL = "h1 long, h2 long, s int, e int"


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, did, h1, h2, text): did orders copies, h1 and h2 are the first 128 bits of the text's SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"), text.alias("text"))
    half = lambda at: F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), at, 16), 16, -10).cast("long")
    return rows.select("id", "did", half(1).alias("h1"), half(17).alias("h2"), "text")


def _intervals(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    h1, h2, s, e = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["h1", "h2", "s", "e"])


def _cold(width: int, keep_first: bool):
    """Places with their bytes, in key order, to intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        contents: list[tuple[bytes, list[tuple[int, int, int, int]]]] = []
        size = 0
        key, group = None, {}

        def close():
            nonlocal size
            if len(group) == 1:
                (text, where), = group.items()
                where.sort()
                out.extend((h1, h2, s, s + len(text)) for _, h1, h2, s in where[keep_first:] if len(where) > 1)
            else:
                for text, where in group.items():
                    where.sort()
                    contents.append((text, where))
                    size += len(text)
            group.clear()

        def order():
            nonlocal size
            contents.sort(key=lambda c: c[1][0])
            joined = np.frombuffer(b"".join(t for t, _ in contents), np.uint8)
            valid = np.ones(len(joined), bool)
            ends = np.cumsum([len(t) for t, _ in contents])
            for end in ends:
                valid[end - width + 1 : end] = False
            found = repeated_starts(joined, valid, width, keep_first)
            at = 0
            for (text, where), end in zip(contents, ends.tolist(), strict=True):
                own = _runs(np.flatnonzero(found[at:end]), width)
                for i, (_, h1, h2, s) in enumerate(where):
                    # a content that occurs twice repeats as a whole; its first occurrence only as the order says
                    spans = own if len(where) == 1 or keep_first and i == 0 else [(0, len(text))]
                    out.extend((h1, h2, s + a, s + b) for a, b in spans)
                at = end
            contents.clear()
            size = 0

        for batch in batches:
            for k, d, h1, h2, s, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    close()
                    if size >= ORDER_BYTES:
                        order()
                    key = k
                group.setdefault(content, []).append((d, h1, h2, s))
            if len(out) > 50_000:
                yield _intervals(out)
                out.clear()
        close()
        if contents:
            order()
        yield _intervals(out)

    return run


def removed_intervals(docs: DataFrame, units: DataFrame, width: int = WIDTH, keep_first: bool = False) -> tuple[DataFrame, scratch.Table]:
    """docs (did, h1, h2, text), units (h1, h2, did): its distinct texts.  Intervals (h1, h2, s, e) to remove, which may
    overlap, and the table of the texts that have places with repeated keys."""

    scratch.small_batches(docs.sparkSession)
    docs = docs.where(F.octet_length("text") >= width).select("did", "h1", "h2", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            first = np.sort(np.unique(both, axis=0, return_index=True)[1])
            texts = [t.as_py().encode() for t in batch.column(2).take(pa.array(first))]
            h1, h2 = both[first].T
            for which, start, count, *hashes in _find_places(texts, width):
                columns = [h1[which], h2[which], start.astype(np.int32), count.astype(np.int32), *(h.view(np.int64) for h in hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["h1", "h2", "start", "n", "key", "c1", "c2"])

    schema = "h1 long, h2 long, start int, n int, key long, c1 long, c2 long"
    found = scratch.materialize(docs.select("h1", "h2", "text").mapInArrow(find, schema), "places")
    # copies of a text have the same places, so that only keys with two different ones hold something repeated
    bounds = [f(c).alias(f"{name}_{c}") for name, f in (("lo", F.min), ("hi", F.max)) for c in ("h1", "h2", "start", "c1", "c2")]
    differ = lambda *columns: reduce(or_, (F.col(f"lo_{c}") != F.col(f"hi_{c}") for c in columns))
    keys = found.df.groupBy("key").agg(F.count(F.lit(1)).alias("places"), *bounds).where(differ("h1", "h2", "start"))
    # written by itself, so that both sides of the join are plain shuffles whose hot partitions can be split
    keys = scratch.materialize(keys.select("key", "places", differ("c1", "c2").alias("differ")), "repeated-keys")
    repeated = scratch.materialize(found.df.join(keys.df, "key"), "repeated-places")
    found.drop()
    keys.drop()
    rows = repeated.df
    if keep_first:
        rows = rows.join(units.select("h1", "h2", "did"), ["h1", "h2"])
    place = F.struct(*(["did"] if keep_first else []), "h1", "h2", "start")
    one = ["key", "c1", "c2"]
    contents = scratch.materialize(rows.groupBy(*one).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")), "contents")
    is_first = place == F.col("first")
    whole = F.when((F.col("copies") > 1) & ~is_first if keep_first else F.col("copies") > 1, WHOLE).otherwise(0)
    order = F.when(is_first & F.col("differ"), F.when(F.col("places") > GROUP, HOT).otherwise(COLD)).otherwise(0)
    marked = rows.join(contents.df, one).select("h1", "h2", "start", "n", "key", (whole + order).alias("kind")).where("kind > 0")
    lists = marked.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "n", "key", "kind")).alias("places"))
    texts = docs.groupBy("h1", "h2").agg(F.min("did").alias("did"), F.first("text").alias("text"))
    with_places = scratch.materialize(texts.join(lists, ["h1", "h2"]), "texts-with-places")
    repeated.drop()
    contents.drop()

    def unpack(batch: pa.RecordBatch) -> Iterator[tuple]:
        for h1, h2, did, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield h1, h2, did, text.encode(), own

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = [(p["key"], did, h1, h2, p["start"], text[p["start"] : p["start"] + p["n"] - 1 + width]) for h1, h2, did, text, own in unpack(batch.slice(at, 256)) for p in own if p["kind"] & COLD]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "did", "h1", "h2", "start", "bytes"])

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = _united((p["start"], p["start"] + p["n"] - 1 + width) for p in own if p["kind"] & WHOLE)
                if runs:
                    yield _intervals([(h1, h2, s, e) for s, e in runs])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, did, text, own in unpack(batch):
                rows = []
                for p in own:
                    if p["kind"] & HOT:
                        rows.extend((*ids, did, h1, h2, *rest) for *ids, rest in _blocks(text, p["start"], p["n"], p["key"], width))
                if rows:
                    *longs, s, content = zip(*rows, strict=True)
                    columns = [*(pa.array(c, pa.int64()) for c in longs), pa.array(s, pa.int32()), pa.array(content, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "b1", "b2", "did", "h1", "h2", "s", "bytes"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows = [], []
            for did, h1, h2, s, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(len(content) - width + 1):
                    digests.append(hashlib.blake2b(content[i : i + width], digest_size=16).digest())
                    rows.append((did, h1, h2, s + i))
            if rows:
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                did, h1, h2, s = (pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (*[pa.int64()] * 3, pa.int32()), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), did, h1, h2, s], names=["b1", "b2", "did", "h1", "h2", "s"])

    def having(bit: int) -> DataFrame:
        return with_places.df.where(F.exists("places", lambda p: p["kind"].bitwiseAND(bit) > 0))

    dealt = having(COLD).mapInArrow(contexts, "key long, did long, h1 long, h2 long, start int, bytes binary").repartition("key").sortWithinPartitions("key")
    parts = [dealt.mapInArrow(_cold(width, keep_first), _INTERVAL)]
    parts.append(having(WHOLE).select("h1", "h2", "places").mapInArrow(wholes, _INTERVAL))
    place = "did long, h1 long, h2 long, s int"
    where = F.struct("did", "h1", "h2", "s")
    ends = (F.col("s") + F.octet_length("bytes")).alias("e")
    block = scratch.materialize(having(HOT).mapInArrow(blocks, f"k1 long, k2 long, b1 long, b2 long, {place}, bytes binary"), "hot-blocks")
    kinds = block.df.groupBy("k1", "k2", "b1", "b2").agg(F.count(F.lit(1)).alias("copies"), F.min(where).alias("first"), F.first("bytes").alias("bytes"))
    kinds = scratch.materialize(kinds, "hot-block-contents")
    again = block.df.join(kinds.df.where("copies > 1").select("k1", "k2", "b1", "b2", "first"), ["k1", "k2", "b1", "b2"])
    if keep_first:
        again = again.where(where != F.col("first"))
    parts.append(again.select("h1", "h2", "s", ends))
    cores = scratch.materialize(kinds.df.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hot-cores")
    left = kinds.df.join(cores.df.select("k1", "k2"), ["k1", "k2"]).select("first.*", "bytes")
    single = scratch.materialize(left.mapInArrow(strings, f"b1 long, b2 long, {place}"), "hot-strings")
    counts = [F.count(F.lit(1)).alias("n"), *([F.min(where).alias("first")] if keep_first else [])]
    counted = scratch.materialize(single.df.groupBy("b1", "b2").agg(*counts).where("n > 1"), "hot-repeated")
    again = single.df.join(counted.df, ["b1", "b2"])
    if keep_first:
        again = again.where(where != F.col("first"))
    parts.append(again.select("h1", "h2", "s", (F.col("s") + width).alias("e")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out, with_places


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, text, intervals) to the maximal removed runs and the bytes that remain."""
    names = ["h1", "h2", "n_removed", "spans", "kept"]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        removed, spans, kept = [], [], []
        for text, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw, runs = text.encode(), _united((i["s"], i["e"]) for i in own)
            at, rest = 0, []
            for s, e in runs:
                rest.append(raw[at:s])
                at = e
            kept.append(b"".join([*rest, raw[at:]]))
            removed.append(len(raw) - len(kept[-1]))
            spans.append([{"start": s, "end": e} for s, e in runs])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=names)


def _changed(docs: DataFrame, width: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (h1, h2, did, copies), and those of them that lose bytes to others or to themselves:
    (h1, h2, n_removed, spans, kept)."""
    counted = docs.groupBy("h1", "h2").agg(F.min("did").alias("did"), F.count(F.lit(1)).alias("copies"))
    units = scratch.materialize(counted, "distinct-texts").df
    found, with_places = removed_intervals(docs, units, width, keep_first)
    lists = found.groupBy("h1", "h2").agg(F.collect_set(F.struct("s", "e")).alias("intervals"))
    joined = with_places.df.select("h1", "h2", "text").join(lists, ["h1", "h2"])
    return units, joined.mapInArrow(_merged, "h1 long, h2 long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def _with_results(docs: DataFrame, units: DataFrame, results: DataFrame, width: int, keep_first: bool) -> DataFrame:
    """docs with the results of their texts, and whether the whole text goes as a copy of an equal one."""
    table = scratch.materialize(units.withColumnRenamed("did", "first_did").join(results, ["h1", "h2"], "left"), "text-results")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    if keep_first:
        whole &= F.col("did") != F.col("first_did")
    return docs.join(table.df, ["h1", "h2"]).withColumn("whole", whole)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_first: bool = False) -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, spans (start, end; in bytes) and kept (binary)."""
    docs = _keyed(df, id_col, text_col)
    units, changed = _changed(docs, width, keep_first)
    every = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    span = F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end"))
    return _with_results(every, units, changed, width, keep_first).select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.array(span)).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
        F.when(F.col("whole"), F.lit("").cast("binary")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept"),
    )


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_first: bool = False) -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, n_spans and kept_sha256; texts are not moved for it."""
    docs = _keyed(df, id_col, text_col)
    units, changed = _changed(docs, width, keep_first)
    short = changed.select("h1", "h2", "n_removed", F.size("spans").alias("n_spans"), F.sha2("kept", 256).alias("sha256"))
    every = docs.select("id", "did", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all_sha256"))
    zero, nothing = F.lit(0), F.sha2(F.lit("").cast("binary"), 256)
    return _with_results(every, units, short, width, keep_first).select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("n_spans", zero)).cast("long").alias("n_spans"),
        F.when(F.col("whole"), nothing).otherwise(F.coalesce("sha256", "all_sha256")).alias("kept_sha256"),
    )
