"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased text, words ``[^\\x20\\x09-\\x0D]+``, word shingles joined by one space, XXH64 with seed 42; a
bit is 1 where it is set in over half of the shingles' hashes, repeats counted. Fingerprints of few differing bits link, and
linked documents form components.

The join of fingerprints is exact and spread over the cluster:

* Equal fingerprints are one *class*, by its smallest document id, before anything is compared.
* The 64 bits are cut into ``radius + 1`` blocks. Two fingerprints that differ in ``radius`` bits at most agree on one
  block at least, so each class goes to one bucket for each block, keyed by the block and its bits. Buckets hold a 65,536th
  of all classes, so what is compared in them is up to the index.
* A bucket of more than ``bucket_limit`` classes is divided again: the bits not yet fixed are cut into ``radius + 1``
  blocks, of which linked members share one, until buckets are small or so few bits are free that they must be.
* In a bucket, classes stand in the order of their Gray rank, where neighbours differ in few bits. Runs of them are leaves
  of a tree. A node holds a mask and a pattern, the bits that all below it share; what its parent shares already is left
  out of its mask. A search adds up differences from the root down and drops a whole group once the sum is over the radius,
  or if the group is of the searcher's component already. All links come from these searches.
* A bucket emits a star to the smallest id of each of its parts, at most one link for each member, never all pairs.
* Parts of all buckets are joined to components by alternating large-star and small-star rounds on tables of links,
  checkpointed to the shared folder.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; repeated rows
share a class; null ids are a class member but never a component's id unless all of its ids are null; an empty table gives
an empty table; columns of the names ``fingerprint`` and ``component_id`` are replaced in results, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import arrow_schema, extend, materialise, raw, slices, tidy

BITS = 64
SEED = 42
RADIUS = 3
BUCKET_LIMIT = 1 << 14
LEAF, FANOUT = 16, 8
#: Codes that the searches done at once may touch.
SEARCHED = 1 << 20

#: Bits of each byte value, most significant first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def shingle_hashes(text: bytes, words_each: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, in order, repeats included."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if n <= words_each:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    starts = np.cumsum(lengths) - lengths
    ends = (starts[words_each - 1 :] + lengths[words_each - 1 :] - 1).tolist()
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts[: n - words_each + 1].tolist(), ends, strict=True)], np.uint64)


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """The SimHash of a text; zero without words."""
    hashes = shingle_hashes(text, words_each)
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros((8, 256))
    lanes = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        part = lanes[at : at + (1 << 16)].astype(np.int64) + np.arange(8) * 256
        counts += np.bincount(part.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", words_each: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a LONG column of fingerprints (the 64 bits, signed) instead of the text."""

    def compute():
        def run(col: pa.Array) -> list:
            found = np.fromiter((fingerprint(t, words_each) for t in raw(col)), np.uint64, len(col))
            return [pa.array(found.view(np.int64))]

        return run

    added = T.StructType([T.StructField(name, T.LongType())])
    return extend(docs, text_col, added, compute, keep_text=False)


def gray_rank(code: Column) -> Column:
    """Where a code stands in the Gray sequence, as an unsigned number held in a LONG."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def split_bits(bits: list[int], parts: int) -> list[list[int]]:
    """Bit places cut into runs of nearly equal length."""
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def first_masks(radius: int) -> list[int]:
    """Masks of the first level: each of radius + 1 blocks."""
    return [_mask(block) for block in split_bits(list(range(BITS)), radius + 1)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks that fix one more block of the free bits of ``mask``; none if too few bits are free to divide."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    if len(free) <= radius + 1:
        return []
    return [_mask([b for b in range(BITS) if mask >> b & 1] + block) for block in split_bits(free, radius + 1)]


def differing(x: np.ndarray) -> np.ndarray:
    """Set bits in each row of 64-bit words."""
    return np.bitwise_count(x).sum(axis=1, dtype=np.int16)


class GrayIndex:
    """Trees over codes in Gray order, one for each run of equal buckets; nodes hold only the shared bits that their parents
    do not hold.

    Codes are rows of one or more 64-bit words. All trees have the same number of levels, so that all are built and
    searched at once.
    """

    def __init__(self, codes: np.ndarray, bucket: np.ndarray | None = None):
        self.codes = codes
        n = len(codes)
        owner = np.zeros(n, np.int64) if bucket is None else np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]])).astype(np.int64) if n else np.zeros(0, np.int64)
        self.bucket = owner
        self.sizes = np.bincount(owner)
        mask, pattern = np.full(codes.shape, 0xFFFFFFFFFFFFFFFF, np.uint64), codes
        begin = np.arange(n)
        levels: list[tuple] = []  # shared bits, pattern, first child, children, first code
        while n and (not levels or len(mask) > len(self.sizes)):
            edge = np.concatenate([[True], owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.flatnonzero(edge)[np.cumsum(edge) - 1]
            at = np.flatnonzero(place % (FANOUT if levels else LEAF) == 0)
            every, some = np.bitwise_and.reduceat(pattern, at, axis=0), np.bitwise_or.reduceat(pattern, at, axis=0)
            shared = np.bitwise_and.reduceat(mask, at, axis=0) & (every | ~some)
            children = np.diff(np.append(at, len(owner)))
            mask, pattern, owner, begin = shared, every & shared, owner[at], begin[at]
            levels.append((mask, pattern, at, children, begin))
        self.levels = []
        for up in range(len(levels) - 1, -1, -1):  # roots first
            mask, pattern, at, children, begin = levels[up]
            own = mask
            if up + 1 < len(levels):
                own = mask & ~np.repeat(levels[up + 1][0], levels[up + 1][3], axis=0)
            self.levels.append((own, pattern & own, at, children, begin))
        self.leaf_rest = ~np.repeat(levels[0][0], levels[0][3], axis=0) if n else codes

    def pairs(self, queries: np.ndarray, radius: int, before: bool, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (query, other) of codes of a bucket within the radius, and their differing bits.

        Others stand before the query if asked. ``labels`` tells the part of each code: groups that are of the query's
        part as a whole are left out.
        """
        q, node, sums = queries, self.bucket[queries], np.zeros(len(queries), np.int16)
        for i, (mask, pattern, first, children, begin) in enumerate(self.levels):
            if before:  # groups that start at the query or later are left out as a whole
                ok = begin[node] < q
                q, node, sums = q[ok], node[ok], sums[ok]
            if labels is not None:
                ok = self.common[i][node] != labels[q]
                q, node, sums = q[ok], node[ok], sums[ok]
            sums = sums + differing((self.codes[q] & mask[node]) ^ pattern[node])
            near = sums <= radius
            q, node, sums = q[near], node[near], sums[near]
            n = children[node]
            down = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q, sums, node = np.repeat(q, n), np.repeat(sums, n), down
        ok = node < q if before else node != q
        q, node, sums = q[ok], node[ok], sums[ok]
        sums = sums + differing((self.codes[q] ^ self.codes[node]) & self.leaf_rest[node])
        near = sums <= radius
        return q[near], node[near], sums[near]

    def mark(self, labels: np.ndarray) -> None:
        """Note for each node the part that all codes below it are of, -1 if there are several."""
        self.common = []
        low = high = labels
        for _, _, first, _, _ in reversed(self.levels):  # leaves first
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.common.append(np.where(low == high, low, -1))
        self.common.reverse()

    def blocks(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """The queries cut so that what a search of them may touch stays bounded."""
        reach = np.cumsum(self.sizes[self.bucket[queries]])
        cuts = np.searchsorted(reach, np.arange(SEARCHED, int(reach[-1]) if len(reach) else 0, SEARCHED)) + 1
        yield from (part for part in np.split(queries, np.unique(cuts)) if len(part))


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the parts of a[i] and b[i] in ``labels``, which holds the smallest place of each part."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels[:] = further


def strides(place: np.ndarray) -> Iterator[np.ndarray]:
    """Where the places in a bucket are, sparse ones first: multiples of a power of 4, then of the next lower one, to all."""
    step = 1
    while step <= int(place.max(initial=0)):
        step *= 4
    done = np.zeros(len(place), bool)
    while step:
        chosen = (place % step == 0) & ~done
        done |= chosen
        yield np.flatnonzero(chosen)
        step //= 4


def bucket_links(bucket: np.ndarray, codes: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) inside each run of equal buckets; codes in Gray order in each run.

    All links come from searches of the index. Sparse members search first; what they join is of one part, and groups of
    the searcher's own part are left out of the searches that follow, so crowds are not compared pair by pair.
    """
    n = len(codes)
    if not n:
        return nodes, nodes
    index, labels = GrayIndex(codes, bucket), np.arange(n)
    edge = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    place = np.arange(n) - np.flatnonzero(edge)[np.cumsum(edge) - 1]
    for queries in strides(place):
        for some in index.blocks(queries):
            index.mark(labels)
            q, other, _ = index.pairs(some, radius, before=False, labels=labels)
            hook(labels, q, other)
    least = nodes.copy()
    np.minimum.at(least, labels, nodes)
    target = least[labels]
    away = nodes != target
    return nodes[away], target[away]


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _linker(radius: int, words: int = 1):
    """Of rows (mask, key, words of the code, node) dealt and sorted by mask and key: the links of each bucket."""
    schema = arrow_schema(LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * (words + 3)
        for batch in batches:
            cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
            mask, key = cols[0], cols[1]
            if not len(key):
                continue
            # the last run may go on in the next batch
            cut = int(np.flatnonzero((key != key[-1]) | (mask != mask[-1])).max(initial=-1)) + 1
            rest = [c[cut:] for c in cols]
            if cut:
                yield emit([c[:cut] for c in cols])
        if len(rest[0]):
            yield emit(rest)
        tidy()

    def emit(cols):
        mask, key, *code, node = cols
        change = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        bucket = np.cumsum(change)
        shared = np.bincount(bucket)[bucket] > 1  # most buckets have one member
        a, b = bucket_links(bucket[shared], np.column_stack(code).view(np.uint64)[shared], node[shared], radius)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def links(classes: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) that connect all classes (code LONG, node LONG) whose codes differ in ``radius`` bits at most."""
    spark = classes.sparkSession

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        return rows.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks]))).select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("key"), "code", "node")

    rows = dealt(classes, first_masks(radius))
    masks = first_masks(radius)
    found = None
    while True:
        finer = {m: finer_masks(m, radius) for m in masks}
        divisible = [m for m in masks if finer[m]]
        crowded = rows.groupBy("mask", "key").count().where((F.col("count") > bucket_limit) & F.col("mask").isin(divisible)).select("mask", "key")
        crowded = materialise(crowded, "crowded")
        n_crowded = crowded.count()
        calm = rows if not n_crowded else rows.join(crowded, ["mask", "key"], "left_anti").select("mask", "key", "code", "node")
        linked = calm.repartition("mask", "key").sortWithinPartitions("mask", "key", gray_rank(F.col("code"))).select("mask", "key", "code", "node").mapInArrow(_linker(radius), LINK)
        found = linked if found is None else found.unionByName(linked)
        if not n_crowded:
            return found
        full = rows.join(crowded, ["mask", "key"], "left_semi")
        masks = sorted({r.mask for r in crowded.select("mask").distinct().collect()})
        table = spark.createDataFrame([(m, finer[m]) for m in masks], "mask long, finer array<long>")
        full = full.join(F.broadcast(table), "mask").select(F.explode("finer").alias("mask"), "code", "node")
        rows = materialise(full.select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("key"), "code", "node"), "divided")
        masks = sorted({x for m in masks for x in finer[m]})


def skew_join(many: DataFrame, few: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose two sides are both dealt anew, so that adaptive execution can split a key of very many rows."""
    keys = [keys] if isinstance(keys, str) else keys
    z = F.hash(*keys).alias("__tw_z")
    return many.select("*", z).join(few.select("*", z), [*keys, "__tw_z"], how).drop("__tw_z")


def components(found: DataFrame) -> DataFrame:
    """(node, root) of each node that has a link, the root the smallest node that it reaches."""
    state = found.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:  # each round brings every node's smallest known neighbour nearer to the smallest reachable, so it ends
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = skew_join(both, least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(large, low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = small.unionByName(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct().checkpoint()
        now = state.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def hexadecimal(code: Column) -> Column:
    """16 lowercase digits of a LONG's 64 bits."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = RADIUS) -> DataFrame:
    """A row for each document: id, ``fingerprint`` (LONG) and ``component_id``, the smallest id that it reaches by links."""
    prints = materialise(fingerprints(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), words_each=words_each, name="code"), "fingerprints")
    classes = prints.groupBy("code").agg(F.min("id").alias("node")).where(F.col("node").isNotNull())
    classes = materialise(classes, "classes")
    roots = components(links(classes, radius))
    moved = classes.join(roots, "node").select("code", "root")
    # only classes that moved are met again; a class of a third of all rows is split by the join like any other skewed key
    own = classes.select("code", F.col("node").alias("own")).join(moved, "code", "left").select("code", F.coalesce("root", "own").alias("component_id"))
    return skew_join(prints, own, "code", "left").select(F.col("id").alias(id_col), F.col("code").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without those whose component has a smaller id."""
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__tw_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__tw_gone"], "left_anti")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id (of rows of one id, all stay)."""
    return one_of_each(docs, simhash_groups(docs, id_col, text_col, words_each, radius), id_col)


# -- near copies by similarity -------------------------------------------------------------------------------------------

WORDS_EACH, SIMILARITY = 5, 0.8
CODE_WORDS = 4
#: The least count of a common shingle, and how many are told apart. They only order shingles.
COMMON_LEAST, COMMON = 5, 1 << 15
#: Shingles that a task counts at once; texts for a segment of the counts, and the most segments as a power of two.
COUNT_FLUSH, SEGMENT_TEXTS, SEGMENT_BITS = 1 << 21, 1 << 8, 14
NEAR_LIMIT = 1 << 12
#: Rows of a table of ids or keys that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000

SKETCH = T.StructType(
    [
        T.StructField("hi", T.LongType()),
        T.StructField("lo", T.LongType()),
        T.StructField("n", T.LongType()),
        *[T.StructField(f"{x}{i}", T.LongType()) for x in "cp" for i in range(CODE_WORDS)],
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)
#: A text's set of shingles, and the digest of its words.
SHINGLES = T.StructType([SKETCH["hi"], SKETCH["lo"], T.StructField("hashes", T.ArrayType(T.LongType()))])
#: Shingles of one segment that a task has counted: packed steps from hash to hash, and packed counts.
COUNTS = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("steps", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def similarity_radius(similarity: float, bits: int = CODE_WORDS * BITS) -> int:
    """Differing bits that texts of a Jaccard similarity exceed once in 10^9 pairs at most; it only proposes pairs.

    Large sets of similarity s meet at an angle of cosine 2s / (1 + s) at least; each bit differs with the angle over pi. In
    small sets ties add up to a quarter to that (4 shingles against 5 at 0.8), so the radius is 6 deviations over it.
    """
    p = min(0.5, 1.25 * float(np.arccos(2 * similarity / (1 + similarity)) / np.pi))
    return int(np.ceil(bits * p + 6 * np.sqrt(bits * p * (1 - p))))


def spread_hash(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Independent 64-bit hashes of hashes."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def prefix_keys(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a sorted set, of which any two sets of ``similarity`` share one at least.

    Sets of n shingles share ceil(similarity * n) of them or more, so n - ceil(similarity * n) + 1 are enough in any order
    that is the same for all sets. Common shingles (hashes in order, counts) come last, which keeps buckets small.
    """
    n = len(hashes)
    if not n:
        return hashes
    known, counts = common
    weight = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        weight = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.argsort(weight, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def digest_and_set(text: bytes, words_each: int) -> tuple[int, int, np.ndarray]:
    """Digest of a text's words, and the hashes of its shingles, each once, in order."""
    hi, lo = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(text.lower().split())), ">i8").tolist()
    return hi, lo, np.unique(shingle_hashes(text, words_each))


def sketch(text: bytes, words_each: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple:
    """Digest of the words, size of the set of shingles, a SimHash and a parity sketch of it of CODE_WORDS words each, and
    its first shingles.

    A bit of the parity sketch tells whether an odd number of shingles fall on it, so two sketches differ in as many bits at
    most as the sets differ in shingles.
    """
    hi, lo, hashes = digest_and_set(text, words_each)
    n = len(hashes)
    code = []
    for word in range(CODE_WORDS):
        counts = np.zeros((8, 256))
        for at in range(0, n, 1 << 16):
            lanes = spread_hash(hashes[at : at + (1 << 16)], word + 1).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.bincount((lanes.astype(np.int64) + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)
        code.append(int.from_bytes(np.packbits(2 * (counts @ BYTE_BITS).ravel() > n).tobytes(), "big", signed=True))
    parity = np.packbits(np.bincount((hashes & np.uint64(CODE_WORDS * BITS - 1)).astype(np.int64), minlength=CODE_WORDS * BITS) & 1).view(np.int64).tolist()
    return (hi, lo, n, *code, *parity, prefix_keys(hashes, similarity, common).view(np.int64))


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed planes of their bytes."""
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    """The n numbers of ``pack``, unsigned."""
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def common_shingles(source: DataFrame, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the COMMON shingles that most of all texts (id, text) hold, COMMON_LEAST at least.

    Every text is counted. Tasks count their own shingles, in order of the hash, and send them to the segments that the
    first bits of the hash name, as steps from one to the next, packed: about 6 bytes for each shingle. A segment's counts are
    added up where it arrives.
    """
    bits = max(1, min(SEGMENT_BITS, (source.count() // SEGMENT_TEXTS).bit_length()))
    schema = arrow_schema(COUNTS)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        segment = (hashes >> np.uint64(BITS - bits)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(segment)) + 1
        rows = [(int(x[0]), len(h), pack(np.diff(h, prepend=np.uint64(0))), pack(c)) for x, h, c in zip(*(np.split(v, cuts) for v in (segment, hashes, counts)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                for text in raw(part.column(0)):
                    held.append(np.unique(shingle_hashes(text, words_each)))
                    n += len(held[-1])
                    if n >= COUNT_FLUSH:
                        yield counted(held)
                        held, n = [], 0
        if n:
            yield counted(held)
        tidy()

    def total(segment: pa.Table) -> pa.Table:
        rows = segment.to_pylist()
        hashes = np.concatenate([np.cumsum(unpack(r["steps"], r["n"]), dtype=np.uint64) for r in rows])
        counts = np.concatenate([unpack(r["counts"], r["n"]).view(np.int64) for r in rows])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        sums = np.add.reduceat(counts, first)
        enough = sums >= COMMON_LEAST
        return pa.table({"key": hashes[first][enough].view(np.int64), "count": sums[enough]})

    counts = source.select("text").mapInArrow(see, COUNTS).groupBy("segment").applyInArrow(total, "key long, count long")
    rows = counts.orderBy(F.desc("count"), "key").limit(COMMON).collect()
    known, counts = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(known)
    return known[order], counts[order]


def bucket_pairs(bucket: np.ndarray, codes: np.ndarray, parity: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, roots: np.ndarray, radius: int, similarity: float, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (member, earlier member) inside each run of equal buckets, of codes within the radius whose sizes and parity
    sketches do not rule the similarity out.

    Codes are in Gray order in each run. With ``nearest`` each member has one pair at most, with the nearest of the earlier
    ones; else all pairs of unlike roots.
    """
    index = GrayIndex(codes, bucket)
    if not nearest:
        index.mark(roots)
    for some in index.blocks(np.arange(len(nodes))):
        q, other, bits = index.pairs(some, radius, before=True, labels=None if nearest else roots)
        least, most = np.minimum(sizes[q], sizes[other]), np.maximum(sizes[q], sizes[other])
        fit = (least >= similarity * most - 1e-9) & (nodes[q] != nodes[other]) & (roots[q] != roots[other])
        # sets of this similarity differ in so many shingles at most
        fit &= differing(parity[q] ^ parity[other]) <= (1 - similarity) / (1 + similarity) * (sizes[q] + sizes[other]) + 1e-9
        q, other, bits = q[fit], other[fit], bits[fit]
        if nearest and len(q):
            order = np.lexsort([bits, q])
            first = order[np.concatenate([[True], q[order][1:] != q[order][:-1]])]
            q, other = q[first], other[first]
        if len(q):
            yield q, other


def gray_order(bucket: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The order of codes by bucket, then by Gray rank of their words."""
    ranks = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return np.lexsort([*ranks.T[::-1], bucket])


def _proposer(radius: int, similarity: float, nearest: bool):
    """Of rows (key, part, words of code and parity sketch, size, node, root) dealt and sorted by key and part: pairs."""
    schema = arrow_schema(LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * (2 * CODE_WORDS + 5)
        for batch in batches:
            cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
            key, part = cols[:2]
            if not len(key):
                continue
            # the last run may go on in the next batch
            cut = int(np.flatnonzero((key != key[-1]) | (part != part[-1])).max(initial=-1)) + 1
            rest = [c[cut:] for c in cols]
            if cut:
                yield from emit([c[:cut] for c in cols])
        if len(rest[0]):
            yield from emit(rest)
        tidy()

    def emit(cols):
        key, part, *words, sizes, node, root = cols
        bucket = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        codes, parity = (np.column_stack(w).view(np.uint64) for w in (words[:CODE_WORDS], words[CODE_WORDS:]))
        order = gray_order(bucket, codes)
        bucket, codes, parity, sizes, node, root = (x[order] for x in (bucket, codes, parity, sizes, node, root))
        for a, b in bucket_pairs(bucket, codes, parity, sizes, node, root, radius, similarity, nearest):
            yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], schema=schema)

    return run


def few_or_dealt(many: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """A join with a written table, which is broadcast if it has BROADCAST_ROWS rows at most."""
    if few.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), key, how)
    return skew_join(many, few, key, how)


def alike(pairs: DataFrame, source: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts' sets of shingles have a Jaccard similarity of ``similarity`` or more.

    Only the texts (id, text) of these ids are read again for their sets.
    """
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")

    def compute():
        def run(col: pa.Array) -> list:
            hi, lo, hashes = zip(*(digest_and_set(t, words_each) for t in raw(col)), strict=True) if len(col) else ((), (), ())
            return [list(hi), list(lo), [h.view(np.int64) for h in hashes]]

        return run

    sets = extend(few_or_dealt(source, wanted, "id", "left_semi"), "text", SHINGLES, compute, keep_text=False)
    sets = materialise(sets.dropDuplicates(["id", "hi", "lo"]).select("id", "hashes"), "sets")
    both = skew_join(pairs, sets.select(F.col("id").alias("a"), F.col("hashes").alias("of_a")), "a")
    both = skew_join(both, sets.select(F.col("id").alias("b"), F.col("hashes").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", shared.alias("s"), (F.size("of_a") + F.size("of_b") - shared).alias("u")).where(F.col("s") / F.col("u") >= similarity).select("a", "b")


def near_links(source: DataFrame, classes: DataFrame, words_each: int, similarity: float, bucket_limit: int = NEAR_LIMIT) -> DataFrame:
    """Links (a, b) that connect all classes (node, n, c0.., p0.., keys) of a Jaccard similarity of ``similarity`` or more, and no others.

    Classes that share a key meet in its bucket. A bucket of more than ``bucket_limit`` classes is cut into blocks, and all
    blocks meet one another in parts of it. The Gray-order index proposes pairs in buckets by their SimHashes, and the sets
    of their texts (id, text) confirm them: first each member's nearest, then all pairs that are not yet in one component.
    """
    code = [f"{x}{i}" for x in "cp" for i in range(CODE_WORDS)]
    keys = classes.select(F.explode("keys").alias("key"), "node")
    counts = materialise(keys.groupBy("key").count().where("count > 1"), "shared")
    blocks, own = F.ceil(F.col("count") / bucket_limit), F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = few_or_dealt(keys, counts, "key", "inner").select("key", "node", blocks.alias("blocks")).withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("own"))
    parts = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda j: F.least(j, "own") * F.col("blocks") + F.greatest(j, "own")))
    rows = materialise(met.join(classes.select("node", "n", *code), "node").select("key", F.explode(parts).alias("part"), *code, "n", "node"), "buckets")
    radius = similarity_radius(similarity)

    def confirmed(placed: DataFrame, nearest: bool) -> DataFrame:
        dealt = placed.select("key", "part", *code, "n", "node", "root").repartition("key", "part").sortWithinPartitions("key", "part")
        pairs = materialise(dealt.mapInArrow(_proposer(radius, similarity, nearest), LINK).distinct(), "pairs")
        return materialise(alike(pairs, source, words_each, similarity), "confirmed")

    # every root is unlike the others at first
    roots = materialise(components(confirmed(rows.withColumn("root", F.col("node")), True)), "roots")
    rest = confirmed(few_or_dealt(rows, roots, "node", "left").withColumn("root", F.coalesce("root", "node")), False)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS_EACH, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document: id and ``component_id``, the smallest id that it reaches by links of like texts.

    Texts of equal words (A-Z lower-cased) are one class. Classes link if the Jaccard similarity of their sets of shingles
    (64-bit hashes) is ``similarity`` or more. Texts are read once for their counts, once for their sketches and, where they
    are proposed, for their sets, so ``docs`` should be a table that was written.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    common = common_shingles(source, words_each)

    def compute():
        def run(col: pa.Array) -> list:
            return [list(x) for x in zip(*(sketch(t, words_each, similarity, common) for t in raw(col)), strict=True)]

        return run

    prints = materialise(extend(source, "text", SKETCH, compute, keep_text=False), "sketches")
    code = [f"{x}{i}" for x in "cp" for i in range(CODE_WORDS)]
    # of equal texts one stands for all: rows without their keys tell which
    first = prints.where("id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    copies = materialise(skew_join(prints.select("id", "hi", "lo").where("id IS NOT NULL"), first.where("rows > 1").withColumnRenamed("id", "node"), ["hi", "lo"]).where("id <> node").select("id", "hi", "lo").distinct(), "copies")
    drop = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    classes = prints.where("id IS NOT NULL").join(drop, ["id", "hi", "lo"], "left_anti").dropDuplicates(["id", "hi", "lo"])
    classes = materialise(classes.select("hi", "lo", F.col("id").alias("node"), *code, "n", "keys"), "classes")
    roots = components(near_links(source, classes, words_each, similarity))
    own = classes.select("hi", "lo", "node").join(roots, "node", "left").select(F.struct("hi", "lo").alias("digest"), F.coalesce("root", "node").alias("component_id"))
    return skew_join(prints.select("id", F.struct("hi", "lo").alias("digest")), own, "digest", "left").select(F.col("id").alias(id_col), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS_EACH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of like texts: the one of the smallest id (of rows of one id, all stay)."""
    return one_of_each(docs, near_groups(docs, id_col, text_col, words_each, similarity), id_col)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document: three-word shingles, three differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")
