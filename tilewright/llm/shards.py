"""Token ids as raw binary blocks with a minimal perfect hash index in each.

A folder of shards holds two Parquet tables, so that any store that Spark writes to will do and lost tasks are rerun by its
commit protocol. ``blocks`` has documents in ascending order of their keys; each row is a block of about ``BLOCK_TOKENS`` ids:

========== =====================================================================================================
part, seq  the task that wrote it and its number there; (part, seq) ascends with the keys
first_key, the smallest and largest key, so that a keyed read touches only row groups that can hold it
last_key
at         ids before the block in its part
n_nulls    how many of the first documents have no key
keys       the documents' keys, little-endian signed 64-bit
offsets    n + 1 little-endian unsigned 32-bit: where each document's ids start
seeds,     the index over the block's distinct keys: a key hashes to a bucket, the bucket's seed sends it to its own slot,
slots      which holds the key's 32-bit fingerprint, the number of its first document in the block, and how many it has
payload    the ids, little-endian unsigned 16-bit where the vocabulary allows it, else 32-bit
========== =====================================================================================================

``parts`` has a row for each part: ids of all parts before it, ids, documents. A key is found in constant time: one hash for
the bucket, one for the slot, one comparison of fingerprints; a key that is not there passes with odds of 2^-32.

Defined cases: null text counts as empty and has only the end id; null keys come first and are found by no key; documents
of one key stand beside each other in the order of hashes of their texts, and the index leads to all of them; a text of any length
stays in one block; an empty table gives empty tables; other columns are not stored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.bpe import byte_alphabet, read_spec, splitter
from tilewright.llm.common import arrow_schema, shared_path, slices
from tilewright.llm.pieces import WordCache, spans

BLOCK_TOKENS = 1 << 19
GROUP_WORDS = 1 << 12
WORD_LIMIT = 500_000
KEYS_PER_BUCKET = 4
SLOT = np.dtype([("fingerprint", "<u4"), ("row", "<u4"), ("n", "<u4")])

BLOCKS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("first_key", T.LongType()),
        T.StructField("last_key", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_docs", T.IntegerType()),
        T.StructField("n_nulls", T.IntegerType()),
        T.StructField("id_bytes", T.IntegerType()),
        *[T.StructField(x, T.BinaryType()) for x in ("keys", "offsets", "seeds", "slots", "payload")],
    ]
)
TOKENS = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def mix(x: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit finaliser of splitmix over keys and a seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


BUCKET_SEED, PRINT_SEED = 1 << 40, 1 << 41


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, PRINT_SEED) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct keys to 0 .. n - 1, one each. Seeds of buckets: d >= 0 hashes with seed d; -1 - s is slot s itself."""

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, -(-n // KEYS_PER_BUCKET))
        home = (mix(keys, BUCKET_SEED) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=buckets)
        ends = np.cumsum(sizes)
        taken = np.zeros(n, bool)
        seeds = np.zeros(buckets, np.int32)
        for b in np.argsort(-sizes, kind="stable"):
            size = sizes[b]
            if size == 0:
                break
            own = keys[order[ends[b] - size : ends[b]]]
            if size == 1:
                continue
            first, found = 0, None
            while found is None:
                trial = np.arange(first, first + 16)
                slots = (mix(own[None, :], trial[:, None]) % np.uint64(n)).astype(np.int64)
                ordered = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    found = int(np.argmax(good))
                    seeds[b] = first + found
                    taken[slots[found]] = True
                first += 16
        seeds[sizes == 1] = -1 - np.flatnonzero(~taken)[: int((sizes == 1).sum())]
        return cls(seeds, n)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        bucket = (mix(keys, BUCKET_SEED) % np.uint64(len(self.seeds))).astype(np.int64)
        seed = self.seeds[bucket].astype(np.int64)
        hashed = (mix(keys, np.maximum(seed, 0)) % np.uint64(max(1, self.n))).astype(np.int64)
        return np.where(seed < 0, -1 - seed, hashed)


class LibraryCodec:
    """Ids of texts by the tokenizers library; a word is encoded when it is new, not every time it occurs."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        alphabet = byte_alphabet()
        d = json.loads(spec)
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, np.int64)
        for token, i in d["model"]["vocab"].items():
            self.sizes[i] = sum(c in alphabet for c in token)
        for t in d["added_tokens"]:
            self.sizes[t["id"]] = len(t["content"].encode())
        self.cache = WordCache(splitter(spec), self._encode, WORD_LIMIT)

    def _whole(self, batch: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that start with a blank are encoded side by side, since no token crosses it; where ids meet the borders is
        told by the lengths of their bytes. Other words are encoded one by one."""
        beside = [i for i, w in enumerate(words) if w[0] == " " and not w[-1].isspace()]
        rest = np.ones(len(words), bool)
        rest[beside] = False
        alone = np.flatnonzero(rest).tolist()
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat, used = [np.zeros(0, np.int32)], 0
        groups = [beside[a : a + GROUP_WORDS] for a in range(0, len(beside), GROUP_WORDS)]
        texts = [[words[i] for i in g] for g in groups]
        joined = ["".join(t) for t in texts]
        for members, own, text, ids in zip(groups, texts, joined, self._whole(joined), strict=True):
            ends = np.cumsum(np.fromiter(map(len, own if text.isascii() else map(str.encode, own)), np.int64, len(own)))
            upto = np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(upto, ends)
            if len(upto) and cuts[-1] < len(upto) and np.array_equal(upto[cuts], ends):
                sizes[members] = np.diff(cuts + 1, prepend=0)
                starts[members] = used + cuts + 1 - sizes[members]
                flat.append(ids)
                used += len(ids)
            else:
                alone += members
        for i, ids in zip(alone, self._whole([words[i] for i in alone]), strict=True):
            starts[i], sizes[i] = used, len(ids)
            flat.append(ids)
            used += len(ids)
        return np.concatenate(flat)[spans(starts, sizes)], sizes

    def encode(self, batch: pa.Array) -> list[np.ndarray]:
        """An int32 array of ids for each text of a column."""
        return self.cache.ids(batch)


@lru_cache(maxsize=2)
def library_codec(spec: str) -> LibraryCodec:
    """The codec of a vocabulary, one for each worker."""
    return LibraryCodec(spec)


class _Block:
    """Documents gathered for a block."""

    def __init__(self):
        self.keys: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.n = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.ids.append(ids)
        self.n += len(ids)

    def row(self, part: int, seq: int, at: int, dtype: str) -> dict:
        n_nulls = sum(k is None for k in self.keys)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        distinct, first, n = np.unique(keys[n_nulls:], return_index=True, return_counts=True)
        index = PerfectHash.build(distinct)
        slots = np.zeros(len(distinct), SLOT)
        place = index.slot(distinct)
        slots["fingerprint"][place], slots["row"][place], slots["n"][place] = fingerprints(distinct), first + n_nulls, n
        return {
            "part": part, "seq": seq, "at": at, "n_tokens": self.n, "n_docs": len(keys), "n_nulls": n_nulls,
            "first_key": int(distinct[0]) if len(distinct) else None, "last_key": int(distinct[-1]) if len(distinct) else None,
            "id_bytes": np.dtype(dtype).itemsize, "keys": keys.tobytes(),
            "offsets": np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype("<u4").tobytes(),
            "seeds": index.seeds.astype("<i4").tobytes(), "slots": slots.tobytes(), "payload": np.concatenate(self.ids).astype(dtype).tobytes(),
        }


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, key_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all texts, each with ``end_id`` behind it, in ascending order of keys. Returns ``path``."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))
    schema = arrow_schema(BLOCKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_codec(spec.value)
        dtype = "<u2" if max(len(codec.sizes), end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], np.int32)
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        block = _Block()
        for batch in batches:
            for cut in slices(batch, 1):
                for key, ids in zip(cut.column(0).to_pylist(), codec.encode(cut.column(1)), strict=True):
                    block.add(key, np.concatenate([ids, end]))
                    if block.n >= BLOCK_TOKENS:
                        yield pa.RecordBatch.from_pylist([block.row(part, seq, at, dtype)], schema)
                        seq, at, block = seq + 1, at + block.n, _Block()
        if block.n:
            yield pa.RecordBatch.from_pylist([block.row(part, seq, at, dtype)], schema)

    source = docs.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text"))
    # a key of very many rows goes to many tasks, by the hash of its texts and their place
    order = ["key", "hash", "place"]
    placed = source.select("key", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    blocks = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text").mapInArrow(pack, BLOCKS)
    # the payload is packed already and token ids hardly shrink; the row group of each block tells its first and last key
    sizes = {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    blocks.write.options(compression="zstd", **sizes).parquet(f"{path}/blocks")
    # a row for each task that wrote, so no more than there are partitions
    parts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs")).orderBy("part").collect()
    starts = [0, *accumulate(r.n_tokens for r in parts)]
    rows = [(r.part, starts[i], r.n_tokens, r.n_docs) for i, r in enumerate(parts)]
    spark.createDataFrame(rows, "part int, start long, n_tokens long, n_docs long").coalesce(1).write.parquet(f"{path}/parts")
    return path


def _entries(row: dict, wanted: np.ndarray | None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Key, place in the part and ids of the documents of a block that the index finds for ``wanted`` (None: all of its own)."""
    offsets = np.frombuffer(row["offsets"], "<u4").astype(np.int64)
    payload = np.frombuffer(row["payload"], "<u2" if row["id_bytes"] == 2 else "<u4")
    slots = np.frombuffer(row["slots"], SLOT)
    if wanted is None:
        wanted = np.unique(np.frombuffer(row["keys"], "<i8")[row["n_nulls"] :])
        for i in range(row["n_nulls"]):
            yield None, row["at"] + int(offsets[i]), payload[offsets[i] : offsets[i + 1]]
    if not len(slots) or not len(wanted):
        return
    found = slots[PerfectHash(np.frombuffer(row["seeds"], "<i4"), len(slots)).slot(wanted)]
    there = found["fingerprint"] == fingerprints(wanted)
    for key, slot in zip(wanted[there].tolist(), found[there], strict=True):
        for i in range(int(slot["row"]), int(slot["row"]) + int(slot["n"])):
            yield key, row["at"] + int(offsets[i]), payload[offsets[i] : offsets[i + 1]]


def read_tokens(spark: SparkSession, path: str, keys: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids as BINARY of little-endian unsigned 32-bit) of all documents, or of ``keys``.

    Without ids, only what is told of them comes back from Python. Every document is reached through its block's index. With keys, blocks that cannot hold one are not read.
    """
    starts = {r.part: r.start for r in spark.read.parquet(f"{path}/parts").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    wanted = None
    if keys is not None:
        wanted = np.unique(np.array(keys, np.int64))
        near = F.lit(False)
        for k in wanted.tolist():
            near = near | ((F.col("first_key") <= k) & (F.col("last_key") >= k))
        blocks = blocks.where(near)
    out = TOKENS if with_ids else T.StructType(TOKENS.fields[:-1])
    schema = arrow_schema(out)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(BLOCKS.names)}
                own = wanted
                if wanted is not None:
                    if row["first_key"] is None:
                        continue
                    own = wanted[(wanted >= row["first_key"]) & (wanted <= row["last_key"])]
                found = list(_entries(row, own))
                base = starts[row["part"]]
                data = [x.astype("<u4").tobytes() for _, _, x in found]
                cols = [[k for k, _, _ in found], [base + a for _, a, _ in found], [len(x) for _, _, x in found], [zlib.crc32(x) for x in data], data]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)], schema=schema)

    return blocks.mapInArrow(unpack, out)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the shards."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_tokens(docs, shared_path(spark, "shards"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path, with_ids=False).withColumnRenamed("key", "doc_id")
