"""Line dedup with two Bloom filters: lines found in many documents stay in one of them.

A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of ``min_chars`` code points or more that are
found in ``min_docs`` documents or more lose all their lines, except in the document of the largest id that holds them.

1. Each task hashes its documents' keys (once per document), combines equal ones, and sends hashes (never texts) to the
   segments of 8 KB that both filters are cut into. A hash decides the segment and its bits in there.
2. The task that holds a segment's hashes fills the *once-seen* and the *twice-seen* filter:
   ``twice |= t | (once & o); once |= o``. A key that any two documents hold is certain to be in the latter. It then asks the
   twice-seen filter for each hash. One segment is at hand at a time, whatever the size of the whole filter, and none is
   broadcast or sent to the driver.
3. Only hashes found in the twice-seen filter shuffle on, to be counted exactly, with the largest id that holds them. False
   positives cost a row here and nothing else. Hashes have 128 bits, so they stand for the keys.
4. The confirmed keys go to the tasks that rewrite the texts: as a table while there are no more than ``broadcast_keys``, else
   by a join of all keys' hashes with the confirmed ones, gathered for each document.

Defined cases: null and empty texts are one empty line and stay as they are; a null id counts as a document and as the
smallest id; rows of the same id are documents of their own that keep or lose a key together; repeated lines within a
document count once and stay or go together; an empty table gives an empty table; columns of the names ``n_lines`` and
``n_dropped`` are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import arrow_schema, materialise, raw, slices, tidy
from tilewright.llm.simhash import skew_join

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SEGMENT_BITS = 1 << 16
PROBES = 4
BITS_PER_KEY = 16
KEYS_PER_DOC = 16
LEAST_BITS = 1 << 20
FLUSH_KEYS = 1 << 20
BROADCAST_KEYS = 1_000_000
SMALLEST = -(1 << 63)

SIGHTING = T.StructType(
    [
        T.StructField("segment", T.IntegerType()),
        T.StructField("hi", T.LongType()),
        T.StructField("lo", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
COUNTS = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None where it is too short to count."""
    key = line.strip(BLANKS).lower()
    n = len(key)
    if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def document_keys(text: bytes, min_chars: int) -> set[bytes]:
    """The keys of a document, each once."""
    found = {line_key(x, min_chars) for x in text.split(b"\n")}
    found.discard(None)
    return found


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as pairs of unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def probe_bits(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash and its bits in there, from different parts of the hash."""
    segment = (hashes[:, 0] % np.uint64(segments)).astype(np.int64)
    low = np.ascontiguousarray(hashes[:, 1]).view(np.uint16).reshape(-1, PROBES)
    return segment, low.astype(np.int64)


def filter_bits(n_docs: int) -> int:
    """Bits of each filter: a power of two for the expected keys."""
    want = max(1, n_docs) * KEYS_PER_DOC * BITS_PER_KEY
    return max(LEAST_BITS, 1 << (want - 1).bit_length())


def _sightings(hashes: np.ndarray, ids: np.ndarray, segments: int) -> list[np.ndarray]:
    """Columns of one row for each hash: its segment, halves, largest id and number of documents."""
    order = np.lexsort((ids, hashes[:, 1], hashes[:, 0]))
    hashes, ids = hashes[order], ids[order]
    last = np.append((hashes[1:] != hashes[:-1]).any(axis=1), True).nonzero()[0]
    segment, _ = probe_bits(hashes[last], segments)
    return [segment.astype(np.int32), *(hashes[last, c].view(np.int64) for c in (0, 1)), ids[last], np.diff(last, prepend=-1)]


def _slice_keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the documents' keys and the documents' ids, for each slice of (text, id) that has any."""
    for batch in batches:
        for part in slices(batch, 0):
            keys, owners = [], []
            for text, i in zip(raw(part.column(0)), part.column(1).to_pylist(), strict=True):
                found = document_keys(text, min_chars)
                keys += found
                owners += [i] * len(found)
            if keys:
                yield hash_keys(keys), np.array(owners, np.int64)


def held_keys(source: DataFrame, min_chars: int) -> DataFrame:
    """A row (hi, lo, id) for each key of each document of a ``source`` (text, id)."""
    held = T.StructType([SIGHTING[c] for c in ("hi", "lo", "id")])
    schema = arrow_schema(held)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, owners in _slice_keys(batches, min_chars):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*hashes.view(np.int64).T, owners)], schema=schema)

    return source.mapInArrow(read, held)


def segment_suspects(source: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """Rows (hi, lo, id, n) of the keys that the twice-seen filter holds, of a ``source`` (text, id).

    Filters are made and asked segment by segment by the tasks that hold the segments' hashes in order, so a task has no more
    than one segment at hand, whatever the size of the whole filter.
    """
    segments = max(1, bits // SEGMENT_BITS)
    sighting_schema = arrow_schema(SIGHTING)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            columns = _sightings(*map(np.concatenate, zip(*held, strict=True)), segments)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=sighting_schema)

        for hashes, owners in _slice_keys(batches, min_chars):
            held.append((hashes, owners))
            n += len(owners)
            if n >= FLUSH_KEYS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()
        tidy()

    found = T.StructType(SIGHTING.fields[1:])
    found_schema = arrow_schema(found)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)

        def suspects():
            for rows in held:
                _, at = probe_bits(np.ascontiguousarray(rows[:, :2]).view(np.uint64), segments)
                chosen = rows[twice[at].all(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in chosen.T], schema=found_schema)

        for batch in batches:
            segment = batch.column(0).to_numpy()
            rows = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            for run in np.split(np.arange(len(segment)), np.flatnonzero(np.diff(segment)) + 1):
                if not len(run):
                    continue
                if segment[run[0]] != current:
                    yield from suspects()
                    current, held = segment[run[0]], []
                    once[:], twice[:] = False, False
                part = rows[run]
                _, at = probe_bits(np.ascontiguousarray(part[:, :2]).view(np.uint64), segments)
                seen = np.bincount(at.ravel(), np.repeat(part[:, 3], PROBES), SEGMENT_BITS)
                twice |= (seen > 1) | once & (seen > 0)
                once |= seen > 0
                held.append(part)
        yield from suspects()

    sightings = source.mapInArrow(see, SIGHTING)
    return sightings.repartition("segment").sortWithinPartitions("segment").mapInArrow(ask, found)


def _rewrite(batches, schema, min_chars, dropped):
    """Drop the lines whose (hash, id) ``dropped`` tells, in slices of whole batches."""
    for batch in batches:
        for part in slices(batch, 0):
            whole = raw(part.column(0))
            ids = [SMALLEST if x is None else x for x in part.column(1).to_pylist()]
            keys, places, counts = [], [], []
            for d, text in enumerate(whole):
                lines = text.split(b"\n")
                counts.append(len(lines))
                for i, line in enumerate(lines):
                    if (k := line_key(line, min_chars)) is not None:
                        keys.append(k)
                        places.append((d, i))
            gone: dict[int, set[int]] = {}
            if keys:
                owner = np.array([d for d, _ in places])
                for j in np.flatnonzero(dropped(part, hash_keys(keys), owner, np.array(ids, np.int64))):
                    gone.setdefault(places[j][0], set()).add(places[j][1])
            texts = part.column(0).to_pylist()
            for d, lost in gone.items():
                texts[d] = b"\n".join(x for i, x in enumerate(whole[d].split(b"\n")) if i not in lost).decode("utf-8", "replace")
            n_dropped = [len(gone.get(d, ())) for d in range(len(whole))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *part.columns[2 : 2 + len(schema) - 3], pa.array(counts, pa.int64()), pa.array(n_dropped, pa.int64())], schema=schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, broadcast_keys: int = BROADCAST_KEYS, bits: int | None = None) -> DataFrame:
    """``docs`` with shared lines left in one document only, and the counts ``n_lines`` (before) and ``n_dropped``."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more: keys of one document are not looked for")
    spark = docs.sparkSession
    sc = spark.sparkContext
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    others = [c for c in names if c != text_col]
    as_id: Column = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(SMALLEST))
    source = docs.select(F.col(f"`{text_col}`").alias("text"), as_id.alias("id"))
    suspects = segment_suspects(source, min_chars, bits or filter_bits(docs.count()))
    counted = suspects.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("id").alias("keep"))
    confirmed = materialise(counted.where(F.col("n") >= min_docs).select("hi", "lo", "keep"), "line-keys")

    out = T.StructType([T.StructField(text_col, T.StringType()), *[docs.schema[c] for c in others], *COUNTS])
    schema = arrow_schema(out)
    body = docs.select(F.col(f"`{text_col}`").alias("__tw_text"), as_id.alias("__tw_id"), *[F.col(f"`{c}`") for c in others])
    if confirmed.count() <= broadcast_keys:
        rows = confirmed.select("hi", "lo", "keep").toArrow()
        hi, lo, keep = (rows.column(c).to_numpy() for c in ("hi", "lo", "keep"))
        order = np.argsort(hi, kind="stable")
        # keys of equal first halves are told apart by the second: their run is searched up to its longest
        longest = int(np.unique(hi, return_counts=True)[1].max()) if len(hi) else 0
        table = sc.broadcast((hi[order], lo[order], keep[order], longest))

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hi, lo, keep, longest = table.value

            def dropped(_, hashes, owner, ids):
                h, l = hashes[:, 0].view(np.int64), hashes[:, 1].view(np.int64)
                at, gone = np.searchsorted(hi, h), np.zeros(len(h), bool)
                for step in range(longest):
                    j = np.minimum(at + step, len(hi) - 1)
                    gone |= (hi[j] == h) & (lo[j] == l) & (keep[j] != ids[owner])
                return gone

            yield from _rewrite(batches, schema, min_chars, dropped)

        result = body.mapInArrow(rewrite, out)
    else:
        # all keys meet the confirmed ones; each document gets the hashes of the keys that it loses
        lost = skew_join(held_keys(source, min_chars), confirmed, ["hi", "lo"]).where(F.col("id") != F.col("keep"))
        lost = lost.groupBy(F.col("id").alias("__tw_loser")).agg(F.collect_set(F.struct("hi", "lo")).alias("__tw_lost"))
        body = body.join(lost, F.col("__tw_id") == F.col("__tw_loser"), "left").drop("__tw_loser")

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def dropped(part, hashes, owner, _):
                sets = [{(x["hi"], x["lo"]) for x in lost or ()} for lost in part.column(part.num_columns - 1).to_pylist()]
                return np.array([(int(h), int(l)) in sets[d] for (h, l), d in zip(hashes.view(np.int64), owner, strict=True)])

            yield from _rewrite(batches, schema, min_chars, dropped)

        result = body.mapInArrow(rewrite, out)
    return result.select(*[F.col(f"`{c}`") for c in names], "n_lines", "n_dropped")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what line dedup leaves of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND c.keep <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
