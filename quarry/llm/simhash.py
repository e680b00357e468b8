"""Near-duplicate detection by SimHash and a binary-trie self-join.

Fingerprints: lower-cased A-Z, words between ASCII white space, shingles of so many words, one XXH64 (seed 42) per
shingle, and a bit for each position that is set in over half of the hashes.  Documents with equal fingerprints form a
class, so that copies cost nothing beyond a partially aggregated ``min``.

Self-join: two classes link if their fingerprints differ in at most ``budget`` bits.  The 64 bits are cut into
``budget + 3`` blocks; whichever bits differ, three blocks stay equal, so each choice of three blocks makes a family of
tries: fingerprints that agree there share a trie over the remaining bits.  A trie is joined with itself level by
level: node pairs go down together, differing bits accumulate, and a pair is pruned once they exceed the budget or
once both nodes lie wholly in one component already.  A hot neighbourhood is spread over many tries, as its members
differ from each other in few bits: a trie holds only those that agree in three whole blocks.  Each task emits a
spanning forest of the links it finds, not the links, and components are then found over the whole corpus.

``near_duplicates`` works with longer shingles and a wider distance.  There the tries only propose pairs that draw large
groups together, the shingle sets decide, and an exact join of rare shingles finds every link between what is still apart.

Defined cases: a null text or one without words has fingerprint zero and links like any other; texts shorter than a
shingle count as one; rows with a null id take part and get the component of their class, null if no id is known in
it; repeated rows are of one class; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import scratch
from quarry.llm.components import connected_components

BITS = 64
#: Node pairs that a task takes down together.
PAIRS_AT_ONCE = 1 << 18
#: Shingles that are hashed together.
SHINGLES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero for no hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    scratch.small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.mapInArrow(run, "id long, fp long")


def block_choices(budget: int, equal: int = 3) -> list[list[int]]:
    """For each choice of ``equal`` of ``budget + equal`` blocks, all bit positions, those of the chosen blocks first."""
    cuts = np.linspace(0, BITS, budget + equal + 1).astype(int)
    blocks = [list(range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    out = []
    for chosen in combinations(range(len(blocks)), equal):
        head = [b for i in chosen for b in blocks[i]]
        out.append((len(head), head + [b for i in range(len(blocks)) if i not in chosen for b in blocks[i]]))
    return out


def _permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Bit order[0] becomes the most significant."""
    out = np.zeros(len(fp), np.uint64)
    for b in order:
        out = out << np.uint64(1) | fp >> np.uint64(b) & np.uint64(1)
    return out


class Forest:
    """Union-find over the rows of a task, vectorised: labels are the smallest row of the component."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.parent, a, b)


def trie_self_join(words: np.ndarray, families: np.ndarray, depth: int, budget: int, leaf=Forest.join) -> Forest:
    """Joins sorted, distinct (family, word) rows within families.

    words: left-aligned suffixes of ``depth`` bits as unsigned numbers, sorted within each family.  A node is a range of
    rows with the same leading bits; its pairs start with each family's root and itself.  leaf(forest, a, b) gets the
    pairs of rows within the budget and joins those that link."""
    n = len(words)
    forest = Forest(n)
    if not n:
        return forest
    roots = np.flatnonzero(np.concatenate([[True], families[1:] != families[:-1]]))
    ends = np.concatenate([roots[1:], [n]])
    many = ends - roots > 1
    lo, hi = roots[many], ends[many]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        level, alo, ahi, blo, bhi, bits = stack.pop()
        if not len(alo):
            continue
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            parts = (alo, ahi, blo, bhi, bits)
            stack += [(level, *(p[half:] for p in parts)), (level, *(p[:half] for p in parts))]
            continue
        label = forest.roots()
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (label[alo] == label[blo]) & (change[alo] == change[ahi - 1]) & (change[blo] == change[bhi - 1])
        alo, ahi, blo, bhi, bits = (p[~one] for p in (alo, ahi, blo, bhi, bits))
        if level == depth:
            ok = alo != blo
            leaf(forest, alo[ok], blo[ok])
            continue
        shift = np.uint64(depth - 1 - level)
        # ones: within a node the rows are sorted, so that a prefix sum of the bit finds where its ones start
        ones = np.concatenate([[0], np.cumsum((words >> shift & np.uint64(1)).astype(np.int64))])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        down = [(alo, amid, blo, bmid, bits, None), (amid, ahi, bmid, bhi, bits, None), (alo, amid, bmid, bhi, bits + 1, None), (amid, ahi, blo, bmid, bits + 1, ~same)]
        out = []
        for a0, a1, b0, b1, d, only in down:
            keep = (a0 < a1) & (b0 < b1) & (d <= budget)
            if only is not None:
                keep &= only
            out.append([x[keep] for x in (a0, a1, b0, b1, d)])
        a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*out, strict=True))
        # a leaf paired with itself has nothing below
        more = ~((a0 == b0) & (a1 - a0 == 1))
        stack.append((level + 1, *(x[more] for x in (a0, a1, b0, b1, d))))
    return forest


def links(classes: DataFrame, budget: int) -> DataFrame:
    """classes (node, fp), one row per fingerprint.  Links (a, b) between nodes that span all components."""
    choices = block_choices(budget)
    heads = {head for head, _ in choices}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp = batch.column(0), batch.column(1).to_numpy().view(np.uint64)
            for i, (head, order) in enumerate(choices):
                word = _permuted(fp, order)
                tail = np.uint64(BITS - head)
                columns = [pa.array(np.full(len(fp), i, np.int32)), pa.array((word >> tail).view(np.int64)), pa.array((word & (np.uint64(1) << tail) - np.uint64(1)).view(np.int64)), node]
                yield pa.RecordBatch.from_arrays(columns, names=["choice", "head", "word", "node"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if len(b)]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        choice, head, word, node = (c.to_numpy() for c in rows.columns)
        for width in sorted(heads):
            own = np.flatnonzero(np.isin(choice, [i for i, (h, _) in enumerate(choices) if h == width]))
            order = own[np.lexsort((word[own], head[own], choice[own]))]
            family = np.cumsum(np.concatenate([[0], (np.diff(choice[order]) != 0) | (np.diff(head[order]) != 0)])) if len(order) else order
            roots = trie_self_join(word[order].view(np.uint64), family, BITS - width, budget).roots()
            linked = np.flatnonzero(roots != np.arange(len(roots)))
            yield pa.RecordBatch.from_arrays([pa.array(node[order][linked]), pa.array(node[order][roots[linked]])], names=["a", "b"])

    dealt = classes.mapInArrow(spread, "choice int, head long, word long, node long")
    return dealt.repartition("choice", "head").mapInArrow(join, "a long, b long").distinct()


def _hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id it reaches."""
    marked = scratch.materialize(fingerprints(df, id_col, text_col, words), "fingerprints")
    classes = scratch.materialize(marked.df.groupBy("fp").agg(F.min("id").alias("node")), "classes")
    known = classes.df.where(F.col("node").isNotNull()).select("node", "fp")
    components, _ = connected_components(links(known, budget))
    named = classes.df.join(components, F.col("node") == F.col("vertex"), "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.df.join(named, "fp").select(F.col("id").alias(id_col), _hex("fp").alias("fingerprint"), "component_id")


# --- pairs of a wider distance ---------------------------------------------------------------------------------------
#
# Texts whose five-word shingles overlap by 0.8 differ in some 15 % of their fingerprint bits, about ten of 64: too many
# for blocks that must stay equal.  So fingerprints are wider (``WIDE`` words of 64 bits, which also tell the overlap more
# sharply), and there are several tries, each over the bits in another order.  Texts that agree in the first bits of an
# order meet in one task, which joins their trie over the rest.  The number of tries follows from the wanted recall.
# Every trie proposes a spanning forest of its close pairs, the closest first, and only pairs whose shingle sets are
# at least as similar as asked become links.

WIDE = 4
#: Wanted chance that a pair at the threshold meets in a trie; the exact join finds the others.
RECALL = 0.5


def flip_chance(similarity: float) -> float:
    """Chance that a bit differs between texts whose shingle sets have this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another hash of the same shingles, by a 64-bit finaliser; word 0 is the hash itself."""
    if not word:
        return hashes
    h = hashes + np.uint64(0x9E3779B97F4A7C15 * word & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


#: Bits of a parity sketch.
SKETCH = 1024


def parity_sketch(hashes: np.ndarray) -> bytes:
    """A bit per slot, set if an odd number of the hashes fall there: two sets differ in at least as many elements as their
    sketches differ in bits."""
    slots = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=SKETCH) & 1).tobytes()


def wide_fingerprints(df: DataFrame, id_col: str, text_col: str, words: int, common: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(id, fp, key, size, sketch, prefix): of the distinct shingles, ``WIDE`` 64-bit fingerprints in one binary, a 128-bit
    hash of the whole set, their number, a parity sketch, and those that every similar set shares one of."""
    scratch.small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    shared = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fps, keys, sizes, sketches, firsts = [], [], [], [], []
            for text in batch.column(1):
                distinct = np.unique(shingle_hashes(text.as_py(), words))
                fps.append(b"".join(fingerprint(_mixed(distinct, w)).to_bytes(8, "little") for w in range(WIDE)))
                keys.append(xxhash.xxh3_128_digest(distinct.astype("<u8").tobytes()))
                sizes.append(len(distinct))
                sketches.append(parity_sketch(distinct))
                firsts.append(prefix(distinct, shared.value, similarity).view(np.int64))
            columns = [batch.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "key", "size", "sketch", "prefix"])

    return docs.mapInArrow(run, "id long, fp binary, key binary, size long, sketch binary, prefix array<long>")


def _orders(prefix: int, similarity: float) -> list[np.ndarray]:
    """For each trie: the bits of its prefix, and then those of its word, as places among all bits."""
    meet = (1 - flip_chance(similarity)) ** prefix
    tries = int(np.ceil(np.log(1 - RECALL) / np.log(1 - meet)))
    random = np.random.default_rng(5)
    return [random.permutation(WIDE * BITS)[: prefix + BITS] for _ in range(tries)]


def closest_links(forest: Forest, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins what the pairs connect and returns the links of a spanning forest: in each round, every component takes its
    closest pair to another one."""
    out_a, out_b = [], []
    while len(a):
        roots = forest.roots()
        apart = roots[a] != roots[b]
        a, b, far = a[apart], b[apart], far[apart]
        own = np.concatenate([roots[a], roots[b]])
        order = np.lexsort((np.concatenate([far, far]), own))
        first = order[np.flatnonzero(np.diff(own[order], prepend=-1))] % max(len(a), 1)
        chosen = np.unique(first) if len(a) else first
        out_a.append(a[chosen])
        out_b.append(b[chosen])
        forest.join(a[chosen], b[chosen])
    return np.concatenate([*out_a, np.empty(0, np.int64)]), np.concatenate([*out_b, np.empty(0, np.int64)])


def wide_pairs(classes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """classes (node, fp binary), one row per set of shingles.  Pairs (a, b) of nodes that may be similar enough."""
    chance = flip_chance(similarity)
    # three standard deviations above what is expected at the threshold
    budget, word_budget = (int(n * chance + 3 * np.sqrt(n * chance * (1 - chance))) for n in (WIDE * BITS, BITS))
    prefix = int(np.clip(np.ceil(np.log2(max(classes.count(), 2))) - 2, 4, 40))
    orders = _orders(prefix, similarity)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                node, fp = batch.slice(at, 2048).columns
                raw = np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(len(fp), -1)
                bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.uint64)
                for i, order in enumerate(orders):
                    head, word = np.zeros(len(fp), np.uint64), np.zeros(len(fp), np.uint64)
                    for b in order[:prefix]:
                        head = head << np.uint64(1) | bits[:, b]
                    for b in order[prefix:]:
                        word = word << np.uint64(1) | bits[:, b]
                    columns = [pa.array(np.full(len(fp), i, np.int32)), pa.array(head.view(np.int64)), pa.array(word.view(np.int64)), node, fp]
                    yield pa.RecordBatch.from_arrays(columns, names=["trie", "head", "word", "node", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if len(b)]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        trie, head, word, node = (rows.column(i).to_numpy() for i in range(4))
        whole = np.frombuffer(b"".join(rows.column(4).to_pylist()), "<u8").reshape(-1, WIDE)
        word = word.view(np.uint64)
        order = np.lexsort((word, head, trie))
        trie, head, word, node, whole = trie[order], head[order], word[order], node[order], whole[order]
        family = np.cumsum(np.concatenate([[0], (np.diff(trie) != 0) | (np.diff(head) != 0)]))
        far = lambda a, b: np.bitwise_count(whole[a] ^ whole[b]).sum(axis=1)
        # rows of a family with equal words stand on one leaf: its first row stands for them in the trie, and the others
        # are held against it and against the row before them
        first = np.flatnonzero(np.concatenate([[True], (np.diff(family) != 0) | (word[1:] != word[:-1])]))
        on_leaf = np.repeat(first, np.diff(np.append(first, len(word))))
        rest = np.flatnonzero(on_leaf != np.arange(len(word)))
        found_a, found_b = [rest, rest], [on_leaf[rest], rest - 1]

        def leaf(forest: Forest, a: np.ndarray, b: np.ndarray) -> None:
            d = far(first[a], first[b])
            near = d <= budget
            a, b = closest_links(forest, a[near], b[near], d[near])
            found_a.append(first[a])
            found_b.append(first[b])

        trie_self_join(word[first], family[first], BITS, word_budget, leaf)
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        keep = (a != b) & (far(a, b) <= budget)
        a, b = node[a[keep]], node[b[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = classes.mapInArrow(spread, "trie int, head long, word long, node long, fp binary")
    # by ranges, so that a family of very many rows is cut into subtries of several tasks; what a boundary parts meets in
    # another trie or in the exact join
    return dealt.repartitionByRange("trie", "head", "word").mapInArrow(join, "a long, b long").distinct()


def similar_pairs(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) of ids, those whose sets of shingles have this Jaccard similarity at least."""
    asked = scratch.materialize(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "asked")
    docs = df.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(scratch.few(asked), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = scratch.materialize(docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>"), "shingle-sets")
    asked.drop()
    one, two = (sets.df.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in ("a", "b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    overlap = shared / F.greatest(F.size("sa") + F.size("sb") - shared, F.lit(1))
    return pairs.join(one, "a").join(two, "b").where(overlap >= similarity).select("a", "b")


# --- what the tries leave out -----------------------------------------------------------------------------------------
#
# Sets whose Jaccard similarity is t share at least t of the shingles of each, so in any common order of all shingles two
# such sets share one among the first n - ceil(t n) + 1 of each.  In the order used here, common shingles come last, so
# that these prefixes hold rare ones.  Which shingles are common is told by a sample: it moves work, never results.
# Prefixes meet by shingle, and only where documents of two components meet: pairs within one component can't change it.

#: One in so many documents is sampled for common shingles.
SAMPLED = 16
#: Documents that are sampled at least, if there are as many.
SAMPLED_LEAST = 8192
#: Shingles of so many sampled documents are common.
COMMON_FROM = 8
#: Common shingles that are kept in mind, those of most documents.
COMMON = 1 << 19


def common_shingles(df: DataFrame, id_col: str, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the common shingles, and in how many sampled documents they are."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    one_in = max(1, min(SAMPLED, docs.count() // SAMPLED_LEAST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text.as_py(), words)).view(np.int64))], names=["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "shingle long")
    counted = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_FROM)
    found = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingle, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefix_length(n: int, similarity: float) -> int:
    """Of n shingles in the common order, as many as hold one of every set that is similar enough."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a sorted set of shingles in the common order: by sampled documents, and then by hash."""
    known, counts = common
    weight = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        weight = np.where(known[at] == shingles, counts[at], 0)
    return shingles[np.argsort(weight, kind="stable")[: prefix_length(len(shingles), similarity)]]


def _reach(size: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """The size of the largest set that can be similar to a set of this size, if the first shingle that the two share
    stands at this place in its order: from there on it must hold all that they share."""
    share = similarity / (1 + similarity)
    return np.floor((size - at) / share - size + 1e-6)


def _cross(node: np.ndarray, size: np.ndarray, at: np.ndarray, component: np.ndarray, sketch: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that share a shingle to pairs of nodes of two components that may be similar.  Rows of the largest component
    are not held against each other; each other row meets the range of sizes that it can be similar to.  Sets that are
    similar differ in a limited part of their elements, and so do their sketches."""
    order = np.argsort(size, kind="stable")
    node, size, at, component, sketch = node[order], size[order], at[order], component[order], sketch[order]
    reach = _reach(size, at, similarity)
    names, counts = np.unique(component, return_counts=True)
    others = np.flatnonzero(component != names[np.argmax(counts)])
    is_other = np.zeros(len(node), bool)
    is_other[others] = True
    lo = np.searchsorted(size, np.ceil(similarity * size[others] - 1e-6), side="left")
    hi = np.searchsorted(size, np.minimum(np.floor(size[others] / similarity + 1e-6), reach[others]), side="right")
    many = np.maximum(hi - lo, 0)
    start = 0
    ends = np.cumsum(many)
    while start < len(others):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
        own = many[start:stop]
        x = np.repeat(others[start:stop], own)
        y = np.repeat(lo[start:stop] - np.cumsum(own) + own, own) + np.arange(own.sum())
        keep = (component[x] != component[y]) & (reach[y] >= size[x]) & ~(is_other[y] & (y < x))
        x, y = x[keep], y[keep]
        differ = np.zeros(len(x), np.int64)
        for word in sketch.T:
            differ += np.bitwise_count(word[x] ^ word[y])
        keep = differ <= np.floor((size[x] + size[y]) * (1 - similarity) / (1 + similarity) + 1e-6)
        yield np.minimum(node[x[keep]], node[y[keep]]), np.maximum(node[x[keep]], node[y[keep]])
        start = stop


def crossing_pairs(classes: DataFrame, components: DataFrame, similarity: float) -> DataFrame:
    """classes (node, size, sketch, prefix), components (vertex, component).  All pairs (a, b) of nodes of two components
    that may be similar enough.  A shingle's rows (some 160 bytes each) meet in one task; shingles of one component only
    are left out."""
    named = classes.join(components, F.col("node") == F.col("vertex"), "left").select("node", "size", "prefix", F.coalesce("component", "node").alias("component"))
    rows = named.select("node", F.col("size").cast("int").alias("size"), "component", F.posexplode("prefix").alias("at", "shingle"))
    met = scratch.materialize(
        rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle"), "met-shingles"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            *columns, sketches = zip(*parts, strict=True)
            sketch = np.frombuffer(b"".join(x for part in sketches for x in part.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            for a, b in _cross(*map(np.concatenate, columns), sketch, similarity):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            shingle, *columns = (c.to_numpy() for c in batch.columns[:-1])
            columns.append(batch.column(5))
            cuts = np.flatnonzero(np.diff(shingle)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shingle)], strict=True):
                if shingle[lo] != now:
                    if parts:
                        yield from close()
                    now, parts = shingle[lo], []
                parts.append([c[lo:hi] for c in columns])
        if parts:
            yield from close()

    sketches = classes.select(F.col("node").alias("vertex"), "sketch")
    kept = rows.join(met.df, "shingle").join(sketches, F.col("node") == F.col("vertex")).select("shingle", "node", "size", "at", "component", "sketch")
    return kept.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, "a long, b long").distinct()


def sharing_enough(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose prefixes share enough.  Of the set whose prefix ends first, all that is shared is among
    the shared ones of the prefixes or comes after its own; so prefixes, a fifth of the sets, rule out most pairs of long
    texts before whole sets are moved."""
    asked = scratch.materialize(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "asked")
    rows = classes.select("node", "size", "prefix").join(scratch.few(asked), "node")
    own = scratch.materialize(rows, "asked-prefixes").df
    one, two = (own.select(F.col("node").alias(n), F.col("size").alias(f"n{n}"), F.col("prefix").alias(f"p{n}")) for n in ("a", "b"))
    most = F.size(F.array_intersect("pa", "pb")) + F.greatest(*(F.ceil(similarity * F.col(n) - 1e-9) - 1 for n in ("na", "nb")))
    enough = most >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9
    return pairs.join(one, "a").join(two, "b").where(enough).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) of the documents that are near duplicates of one with a smaller id, which is the component."""
    common = common_shingles(df, id_col, text_col, words)
    marked = scratch.materialize(wide_fingerprints(df, id_col, text_col, words, common, similarity), "wide-fingerprints")
    firsts = marked.df.groupBy("key").agg(F.min("id").alias("node"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
    classes = scratch.materialize(firsts, "wide-classes")
    pairs = scratch.materialize(wide_pairs(classes.df.select("node", "fp"), similarity), "wide-pairs")
    close = scratch.materialize(similar_pairs(pairs.df, df, id_col, text_col, words, similarity), "close-pairs")
    drawn, _ = connected_components(close.df)
    crossing = scratch.materialize(crossing_pairs(classes.df, drawn, similarity), "crossing-pairs")
    likely = scratch.materialize(sharing_enough(crossing.df, classes.df, similarity), "likely-pairs")
    more = similar_pairs(likely.df, df, id_col, text_col, words, similarity)
    components, _ = connected_components(close.df.union(more))
    named = classes.df.join(components, F.col("node") == F.col("vertex"), "left").select("key", F.coalesce("component", "node").alias("component"))
    return marked.df.select("id", "key").join(named, "key").where("id != component").select("id", "component")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group the document with the smallest id stays.  Rows that share
    an id stay or go together, and rows without an id stay."""
    gone = scratch.materialize(near_duplicates(df, id_col, text_col, words, similarity).select(F.col("id").alias(id_col)).distinct(), "near-copies")
    return df.join(scratch.few(gone), id_col, "left_anti").select(*df.columns)
