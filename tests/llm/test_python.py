"""Line dedup, SimHash, BPE, shards, media, quality and the pipeline against plain versions."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tilewright.llm import bpe, lines, media, pieces, quality, shards, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(text):
    return text.translate(str.maketrans(UPPER, LOWER))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


# -- lines


def plain_lines(rows, min_chars=20, min_docs=3):
    held = defaultdict(list)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    for n, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append((i if i is not None else -(1 << 63), n))
    gone = {k: max(i for i, _ in v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if gone.get(key(x), i if i is not None else -(1 << 63)) == (i if i is not None else -(1 << 63))]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept) if len(kept) < len(own) else text))
    return out


def line_rows():
    rnd = random.Random(1)
    pool = ["a line that many texts share", "A LINE that many texts share \t", "é" * 20, "é" * 19, "short", "", "  ", "x" * 5000, "one that few texts share with others", "\x0bsome line within odd blanks\r"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(6)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (7, "a line that many texts share\nown"), (None, "a line that many texts share"), (None, None)]


@pytest.mark.parametrize(("broadcast_keys", "bits"), [(1000, 1 << 20), (0, 1 << 20), (1000, None), (1000, 1)])
def test_line_dedup(spark, broadcast_keys, bits):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("old"), "id": F.lit("own"), "key": F.lit("own")}).repartition(3)
    got = lines.dedup_lines(df, broadcast_keys=broadcast_keys, bits=bits)
    assert got.columns == ["doc_id", "text", "id", "key", "n_lines", "n_dropped"] and got.where("id <> 'own' OR key <> 'own'").count() == 0
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr)
    assert found == sorted(plain_lines(rows), key=repr)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_segments_send_on_repeats_only(spark, monkeypatch):
    monkeypatch.setattr(lines, "FLUSH_KEYS", 7)  # a hash comes to its segment in many rows
    texts = [f"shared line of number {i % 50} in here\nown line of number {i} in here" for i in range(200)]
    monkeypatch.setattr(lines, "slices", lambda batch, column: (batch.slice(i, 3) for i in range(0, batch.num_rows, 3)))
    source = frame(spark, texts).selectExpr("text", "doc_id AS id")
    rows = lines.segment_suspects(source, 20, 1 << 20).collect()
    n, largest = Counter(), {}
    for r in rows:
        n[r.hi, r.lo] += r.n
        largest[r.hi, r.lo] = max(r.id, largest.get((r.hi, r.lo), -1))
    hashes = lines.hash_keys([f"shared line of number {i} in here".encode() for i in range(50)]).view(np.int64)
    for i, (hi, lo) in enumerate(hashes.tolist()):
        assert n.pop((hi, lo)) == 4 and largest[hi, lo] == 150 + i
    assert len(n) < 10  # own lines that the filter takes for repeats
    assert lines.segment_suspects(source.limit(0), 20, 1 << 20).count() == 0


def test_lines_of_one_document_cannot_be_asked_for(spark):
    with pytest.raises(ValueError, match="min_docs"):
        lines.dedup_lines(frame(spark, ["x"]), min_docs=1)


# -- simhash


def plain_print(text, k=3):
    words = WORD.findall(low(text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rnd = random.Random(3)
    texts = ["", " ", "a", "A b", "a b c", "é É x\x1cy", "a\xa0b c d", "x " * 300] + [" ".join(rnd.choice(["a", "B", "cc", "ü"]) for _ in range(rnd.randrange(40))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_print(t), t


def plain_groups(codes, nodes, radius):
    parent = list(range(len(codes)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i in range(len(codes)):
        least[top(i)] = min(least.get(top(i), 1 << 62), nodes[i])
    return {nodes[i]: least[top(i)] for i in range(len(codes))}


def clustered_codes(n, seed):
    rnd = random.Random(seed)
    codes = set()
    while len(codes) < n:
        centre = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 40)):
            code = centre
            for _ in range(rnd.randrange(7)):
                code ^= 1 << rnd.randrange(64)
            codes.add(code)
    return sorted(codes)[:n]


@pytest.mark.parametrize("limit", [1 << 14, 16])
def test_links_and_components_equal_all_pairs(spark, limit):
    codes = clustered_codes(700, 5)
    nodes = random.Random(6).sample(range(10000), len(codes))
    rows = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, n) for c, n in zip(codes, nodes, strict=True)], "code long, node long").repartition(5)
    found = {r.node: r.root for r in simhash.components(simhash.links(rows, 3, limit)).collect()}
    want = plain_groups(codes, nodes, 3)
    assert {n: found.get(n, n) for n in nodes} == want
    assert all(found[n] != n for n in found)


def test_gray_index_finds_all_pairs():
    rnd = np.random.default_rng(1)
    for width in (1, 2):
        centre = rnd.integers(0, 1 << 63, (1, width), dtype=np.uint64)
        flips = np.uint64(1) << rnd.integers(0, 63, (400, width, 3), dtype=np.uint64)
        codes = np.unique(centre ^ np.bitwise_or.reduce(flips, axis=2), axis=0)
        codes = codes[np.lexsort([codes[:, 0]])]
        bucket = np.sort(rnd.integers(0, 5, len(codes)))
        for runs in (None, bucket):
            index = simhash.GrayIndex(codes, runs)
            q, other, bits = index.pairs(np.arange(len(codes)), 4, before=True)
            away = simhash.differing((codes[:, None] ^ codes[None]).reshape(-1, width)).reshape(len(codes), -1)
            near = (away <= 4) & (True if runs is None else runs[:, None] == runs[None])
            assert {(a, b) for a, b in zip(q.tolist(), other.tolist(), strict=True)} == {(a, b) for a, b in zip(*np.nonzero(near), strict=True) if b < a}
            assert (bits == away[q, other]).all()
            parts = [p for p in index.blocks(np.arange(len(codes)))]
            assert np.array_equal(np.concatenate(parts), np.arange(len(codes)))


def test_index_leaves_out_groups_of_the_searchers_part():
    codes = np.arange(256, dtype=np.uint64)[:, None]
    index = simhash.GrayIndex(codes)
    labels = np.arange(256) // 64
    index.mark(labels)
    q, other, _ = index.pairs(np.array([3]), 64, before=False, labels=labels)
    assert set(other.tolist()) == set(range(64, 256))


def test_op2_equals_all_pairs(spark):
    """The query on a whole table against a plain comparison of each fingerprint with each."""
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_print(r.text) for r in rows}
    least = {}
    for i, code in sorted(prints.items()):
        least.setdefault(code, i)
    codes = list(least)
    groups = plain_groups(codes, [least[c] for c in codes], 3)
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, code in prints.items():
        assert (got[i].fingerprint, got[i].component_id) == (f"{code:016x}", groups[least[code]]), i


def test_all_links_come_from_the_index(spark, monkeypatch):
    """On 10,000 documents each link is a pair that a search of the trees found, and no component lacks one."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    least = {}
    for code, i in sorted((simhash.fingerprint((r.text or "").encode()), r.doc_id) for r in rows):
        least.setdefault(code, i)
    table, nodes = np.array(list(least), np.uint64), np.array(list(least.values()))
    found = []
    search = simhash.GrayIndex.pairs

    def noted(self, *args, **kind):
        q, other, bits = search(self, *args, **kind)
        found.extend(zip(self.codes[q, 0].tolist(), self.codes[other, 0].tolist(), strict=True))
        return q, other, bits

    monkeypatch.setattr(simhash.GrayIndex, "pairs", noted)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for mask in simhash.first_masks(3):
        key = table & np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
        order = simhash.gray_order(key, table[:, None])
        more = simhash.bucket_links(key[order], table[order][:, None], nodes[order], 3)
        a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
    near = {(x, y) for at in range(0, len(table), 500) for x, y in zip(*np.nonzero(np.bitwise_count(table[at : at + 500, None] ^ table[None]) <= 3), strict=True) if x + at != y for x, y in [(int(table[x + at]), int(table[y]))]}
    assert found and set(found) <= near

    def parts(pairs):
        top = {int(n): int(n) for n in nodes}
        for x, y in pairs:
            p, q = top[x], top[y]
            if p != q:
                top = {n: min(p, q) if t in (p, q) else t for n, t in top.items()}
        return top

    want = parts((least[x], least[y]) for x, y in near)
    assert parts((least[x], least[y]) for x, y in found) == want
    assert parts(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_long_chain_is_one_component(spark):
    """A component whose members are far more than 60 links apart."""
    links = spark.createDataFrame([((i * 37) % 401, ((i + 1) * 37) % 401) for i in range(400)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert roots == dict.fromkeys(range(1, 401), 0)


def test_simhash_groups_with_nulls_copies_and_empty_tables(spark):
    rows = [(5, "a b c d"), (3, "A b  c\td"), (9, None), (8, ""), (8, ""), (None, "a b c d"), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("old"))
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()]
    assert sorted(got, key=repr) == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (8, 8), (None, 3), (None, None)], key=repr)
    assert simhash.simhash_groups(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.simhash_dedup(df.where("doc_id IS NOT NULL")).collect()) == [3, 8, 8]


def shingle_set(text):
    words = WORD.findall(low(text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_groups_find_like_texts(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rnd.choice([8, 30, 200, 1500]))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            copy = list(base)
            for _ in range(rnd.randrange(1 + len(base) // 100)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper())
    got = {r.doc_id: r.component_id for r in simhash.near_groups(frame(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s >= 0.8:
                assert got[i] == got[j], (i, j, s)
            if s < 0.3:
                assert got[i] != got[j], (i, j, s)
    assert simhash.near_groups(frame(spark, ["a"]).limit(0)).count() == 0
    kept = simhash.near_dedup(frame(spark, [None, "", "a b", "A  b", "c"]).withColumn("extra", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


def test_crowded_parts_are_divided(spark):
    texts = [f"the same words open every text of this kind and go on for a while {i} {i * 7} {i * 13} {i * 17} {i * 19}" for i in range(80)]
    df = frame(spark, [*texts, texts[3].upper(), texts[5]])
    full = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert full[80] == 3 and full[81] == 5
    limit, simhash.near_links.__defaults__ = simhash.near_links.__defaults__, (8,)
    try:
        divided = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    finally:
        simhash.near_links.__defaults__ = limit
    assert divided[80] == 3 and divided[81] == 5


def test_very_long_texts_are_read_whole(spark):
    rnd = random.Random(9)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(300_000))
    df = frame(spark, [long, long + " end", " ".join(reversed(long.split())), "x" * 3_000_000])
    got = {r.doc_id: r for r in simhash.simhash_groups(df).collect()}
    assert got[0].component_id == got[1].component_id == 0 and got[2].component_id == 2 and got[3].component_id == 3
    near = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert near == {0: 0, 1: 0, 2: 2, 3: 3}


def test_common_shingles_are_counted_in_all_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNT_FLUSH", 2_000, raising=False)
    texts = [f"words that each text holds {i % 3000} {i}" + " then some that few of them hold" * (i % 4000 == 7) for i in range(24_000)]
    want = Counter()
    for text in [*texts, None, ""]:
        want.update(xxhash.xxh64_intdigest(x.encode(), 42) for x in shingle_set(text))
    known, counts = simhash.common_shingles(frame(spark, [*texts, None, ""]).withColumnRenamed("doc_id", "id"), 5)
    assert dict(zip(known.tolist(), counts.tolist(), strict=True)) == {x: n for x, n in want.items() if n >= 5}
    assert max(counts) == 24_000 and sorted(known) == known.tolist() and len(known) > 3000
    assert not len(simhash.common_shingles(frame(spark, [None, ""]).withColumnRenamed("doc_id", "id"), 5)[0])


def near_texts(seed):
    """Texts of many lengths with copies near a similarity of 0.8, on both sides of it, and templated short texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9)))
    texts = []
    for _ in range(90):
        base = [word() for _ in range(rnd.choice([4, 8, 9, 12, 20, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(3):
            more = rnd.uniform(0.1, 0.4) * max(1, len(base) - 4)
            texts.append(" ".join([*base, *(word() for _ in range(max(1, round(more))))]))
    opening = [word() for _ in range(30)]
    texts += [" ".join([*opening, *(word() for _ in range(rnd.randrange(3, 10)))]) for _ in range(60)]
    return texts


def like_groups(texts):
    """Components of all pairs of an exact similarity of 0.8 or more, by comparing each with each."""
    sets, group = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low_one, high_one = sorted((group[i], group[j]))
                group = [low_one if g == high_one else g for g in group]
    return dict(enumerate(group))


def test_near_groups_equal_exact_similarities(spark):
    texts = near_texts(3)
    want = like_groups(texts)
    assert 150 < len(set(want.values())) < len(texts) - 50
    assert {r.doc_id: r.component_id for r in simhash.near_groups(frame(spark, texts)).collect()} == want


def test_divided_buckets_lose_no_pair(spark):
    texts = near_texts(4)
    want = like_groups(texts)
    limit, simhash.near_links.__defaults__ = simhash.near_links.__defaults__, (8,)
    try:
        divided = {r.doc_id: r.component_id for r in simhash.near_groups(frame(spark, texts)).collect()}
    finally:
        simhash.near_links.__defaults__ = limit
    assert divided == want


def test_like_sets_share_a_key():
    rnd = np.random.default_rng(5)
    for n in (4, 5, 8, 9, 12, 40, 300):
        for _ in range(200):
            whole = rnd.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
            common = np.sort(whole[: n // 2]), rnd.integers(5, 50, n // 2)
            a, b = np.sort(whole[:n]), np.sort(whole)
            keys = [simhash.prefix_keys(x, 0.8, common) for x in (a, b)]
            assert len(np.intersect1d(*keys)), n


# -- bpe


def odd_texts():
    rnd = random.Random(1)
    alphabet = " \n\tabcdefgh ijklétüß.,;!?0123456789'\"#$%　日本\U0001f600ղऄ"
    own = [
        "<|endoftext|>a <|endoftext|> b  <|endoftext|>\n", "  a  b \t\n c", " x", " ", "", "é" * 700, "a" * 2000, "ab" * 900 + " x",
        "日本語テスト 한국어 ܐܒܓ \U0001f600", "don't I'll 's 's " + "9" * 1500, "\x00a \x00b", "line\r\nnext\r\n\r\n  end  ",
        " !!!???" + "#" * 600 + "\n" * 700 + "x" + " " * 800, "a\n", "\na", "a\n b", "word. word, word.. Word", "a.b, c", "×a ÷ ª",
    ]
    return own + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(1500)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("make", [bpe.Codec, shards.LibraryCodec])
def test_ids_equal_the_library(make, library, monkeypatch):
    for module in (pieces, shards):  # words are forgotten again and again
        monkeypatch.setattr(module, "WORD_LIMIT", 300)
    codec, texts = make(bpe.read_spec(VOCABULARY)), odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 100):
        got = codec.encode(pa.array(texts[at : at + 100], pa.string()))
        assert [x.tolist() for x in got] == want[at : at + 100]


def test_long_words_and_words_in_step_agree(library):
    v = bpe.Vocabulary(bpe.read_spec(VOCABULARY))
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé ") for _ in range(n)).encode() for n in (1, 5, 40, 300)]
    flat, sizes = v.encode_words(words)
    assert flat.tolist() == [i for w in words for i in v._long(w).tolist()] and len(sizes) == 4
    assert v.sound.all()


def test_encode_and_decode_frames(spark, library):
    texts = [*odd_texts()[:60], None]
    df = frame(spark, texts).withColumn("ids", F.lit(1))
    for r in bpe.bpe_encode(df, VOCABULARY, decoded=True).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False) == (r.text or "")
    back = bpe.bpe_decode(bpe.bpe_encode(df, VOCABULARY), VOCABULARY)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert bpe.bpe_encode(df.limit(0), VOCABULARY).count() == 0
    broken = spark.createDataFrame([(bytearray(struct.pack("<2I", 94, 50256)),), (None,)], "ids binary")
    assert [r.decoded for r in bpe.bpe_decode(broken, VOCABULARY).collect()] == [library.decode([94, 50256], skip_special_tokens=False), ""]


def test_op4(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op4_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# -- shards


def test_perfect_hash():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 100, 3000):
        keys = np.unique(rnd.integers(-(1 << 62), 1 << 62, n))
        index = shards.PerfectHash.build(keys)
        assert sorted(index.slot(keys).tolist()) == list(range(len(keys)))


def test_shards_round_trip_and_keyed_reads(spark, library, tmp_path, monkeypatch):
    rows = [(i * 3 - 50, t) for i, t in enumerate(odd_texts()[:80])] + [(1, "again"), (1, "again"), (None, "no key"), (None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = shards.write_tokens(df, str(tmp_path / "shards"), VOCABULARY, end_id=2)
    digest = lambda t: 42 if t is None else struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    want, at = [], 0
    for key, text in ordered:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    got = sorted(((r.key, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in shards.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    some = shards.read_tokens(spark, path, keys=[1, 7, 4, 999999]).collect()
    assert sorted((r.key, r.start) for r in some) == sorted((k, s) for k, s, *_ in want if k in (1, 7, 4))
    empty = shards.write_tokens(df.limit(0), str(tmp_path / "none"), VOCABULARY, end_id=2)
    assert shards.read_tokens(spark, empty).count() == 0


def test_op6(spark, sf, library):
    at = 0
    rows = {r.doc_id: r for r in shards.op6_shards(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(rows[r.doc_id])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# -- media


def bmp(img, bits=24):
    h, w = img.shape[:2]
    rows = b""
    for y in range(h - 1, -1, -1):
        if bits == 8:
            row = bytes(img[y, :, 0])
        else:
            row = img[y, :, ::-1].tobytes() if bits == 24 else np.concatenate([img[y, :, ::-1], np.zeros((w, 1), np.uint8)], axis=1).tobytes()
        rows += row + bytes(-len(row) % 4)
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256)) if bits == 8 else b""
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(palette) + len(rows), 0, 0, 54 + len(palette), 40, w, h, 1, bits, 0, len(rows), 0, 0, 256 if bits == 8 else 0, 0)
    return head + palette + rows


def plain_resize(img, height, width):
    grey = img[:, :, :3].astype(float).mean(axis=2) if img.shape[2] > 1 else img[:, :, 0].astype(float)
    ys, xs = (np.linspace(0, n, k + 1) for n, k in zip(grey.shape, (height, width), strict=True))
    share = lambda cuts, n: np.array([[max(0, min(b, i + 1) - max(a, i)) for i in range(n)] for a, b in zip(cuts, cuts[1:], strict=False)])
    return share(ys, grey.shape[0]) @ grey @ share(xs, grey.shape[1]).T / ((grey.shape[0] / height) * (grey.shape[1] / width))


def test_pictures_decode():
    rnd = np.random.default_rng(0)
    img = rnd.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    grey = img[:, :, :1]
    assert np.array_equal(media.decode(bmp(img)), img) and np.array_equal(media.decode(bmp(img, 32)), img)
    assert np.array_equal(media.decode(bmp(grey, 8))[:, :, 0], grey[:, :, 0])
    assert np.array_equal(media.decode(b"P6 #x\n7 5 # y\n255\n" + img.tobytes()), img)
    assert np.array_equal(media.decode(b"P5\n7 5\n255\n" + grey.tobytes()), grey)
    assert np.array_equal(media.decode(b"P3\n7 5\n255\n" + " ".join(map(str, img.ravel())).encode()), img)
    assert np.array_equal(media.decode(b"P2\n7 5\n65535\n" + " ".join(map(str, grey.ravel())).encode())[:, :, 0], grey[:, :, 0])
    wide = rnd.integers(0, 65536, (3, 4), dtype=np.uint16)
    assert np.array_equal(media.decode(b"P5 4 3 65535 " + wide.astype(">u2").tobytes())[:, :, 0], wide)
    bits = rnd.integers(0, 2, (3, 11), dtype=np.uint8)
    assert np.array_equal(media.decode(b"P4 11 3\n" + np.packbits(bits, axis=1).tobytes())[:, :, 0], (1 - bits) * 255)
    assert np.array_equal(media.decode(b"P1 11 3\n" + "".join(map(str, bits.ravel())).encode())[:, :, 0], (1 - bits) * 255)
    for broken in (b"", b"P5", b"P5 2 2 255\nab", b"BM123", b"P7\n", b"P5 0 1 255 ", bmp(img)[:-5], b"P2 1 1 9 x"):
        with pytest.raises(media.MediaError):
            media.decode(broken)


@pytest.mark.parametrize("size", [(8, 9), (1, 1), (3, 4), (17, 64), (9000, 3)])
def test_area_resize(size):
    img = np.random.default_rng(2).integers(0, 256, (*size, 1), dtype=np.uint8)
    assert np.allclose(media.area_resize(img), plain_resize(img, 8, 9), atol=1e-6)


def test_tiles(spark):
    img = np.random.default_rng(4).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, bytearray(bmp(img)), "old"), (2, bytearray(b"no picture"), "old"), (3, None, "old")], "k int, media binary, dhash string")
    got = {r.k: r for r in media.media_tiles(df).collect()}
    tile = np.load(io.BytesIO(got[1].tile_npy))
    want = np.rint(plain_resize(img, 8, 9) * 256)
    assert np.abs(tile - want).max() <= 1 and tile.shape == (8, 9)
    assert got[1].dhash == np.packbits((tile[:, 1:] > tile[:, :-1]).ravel()).tobytes().hex()
    assert (got[1].media_width, got[1].media_height, got[1].media_channels) == (40, 30, 3)
    assert got[2].dhash is None and got[3].tile_npy is None
    assert media.media_tiles(df.limit(0)).count() == 0


def test_op10(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op10_media(spark, sf).collect():
        b = texts[r.doc_id].encode()
        payload = b + bytes(-len(b) % 64 if b else 64)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(b), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    empty = media.text_media(frame(spark, ["", None]))
    assert [(r.n_bytes, len(r.media)) for r in empty.collect()] == [(0, 64 + len(b"P5\n64 1\n255\n"))] * 2


# -- quality


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality.op1_quality(spark, folder).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) > 0.98 * len(held) > 500


def test_quality_without_labels_with_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (3, "")], "doc_id long, text string").withColumn("score", F.lit("old"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(df, none)
    assert [r.score for r in quality.score_quality(df, model).collect()] == [0.5] * 4
    one = spark.createDataFrame([(3, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert all(r.score > 0.99 and r.predicted == 1 for r in quality.score_quality(df, quality.fit_quality(df, one)).collect())
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_trees_and_tables():
    g, h, n = np.array([1.0, 1, -1, -1]), np.ones(4), np.full(4, 20)
    step = quality.shallow_tree(g, h, n, leaves=2)
    assert step[0] == step[1] == pytest.approx(2 / 3) and step[2] == pytest.approx(-2 / 3)
    rnd = np.random.default_rng(0)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.9


# -- pipeline


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], folder).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    kept = Counter((labels[i], i in ids[1]) for i in labels)
    assert kept[1, True] > 0.98 * (kept[1, True] + kept[1, False]) and kept[0, False] > 0.9 * (kept[0, True] + kept[0, False])
    want = {i: t for i, _, _, t in plain_lines([(r.doc_id, r.text) for r in seen[1].collect()])}
    assert {r.doc_id: r.text for r in seen[2].collect()} == want
    sets = {r.doc_id: shingle_set(r.text) for r in seen[3].collect()}
    held = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            held[x].add(i)
    for i, s in sets.items():
        for j, shared in Counter(j for x in s for j in held[x] if j < i).items():
            assert shared / len(s | sets[j]) < 0.8
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], folder).collect()
    assert {r.doc_id for r in last} == ids[-1] and all(r.round_trip for r in last)
    assert all(len(r.ids) == 4 * r.n_tokens for r in last)


def test_pipeline_on_an_empty_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
