"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can end its encoding. It is found among the tokens that are
suffixes of the prefix, longest first: an automaton over all tokens (states are prefixes of tokens, with links to the longest
suffix that is a state) tells the longest such token, and a table the next shorter one. A candidate is right if it is what
its own bytes encode to and if it is *compatible* with the last token of the prefix before it: undoing the merges of both
from the latest to the earliest, no pair across the border may have a merge of an earlier rank. The stored tokens are
back-pointers; following them from the end gives the ids, equal to those of merging pair by pair.

Many distinct words go through the table in step, as numpy arrays; words over ``LONG_WORD`` bytes take the same steps one at
a time. Vocabularies are read from a ``tokenizers`` JSON file whose path is a parameter; its content is broadcast.

Defined cases: null counts as an empty text, which has no ids and decodes to an empty text; strings of added tokens in a
text become their ids, as the tokenizers library does; texts of any length are encoded whole; repeated rows give repeated
results; an empty table gives an empty table; columns of the names of results are replaced, others pass through.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import extend
from tilewright.llm.pieces import PATTERN, WordCache

LONG_WORD = 512
CHUNK_BYTES = 1 << 20
END = -1

#: Characters whose classes in the pattern are known to be the same in every Unicode version in use; texts with others are
#: cut by the library's own splitter.
UNSETTLED = re.compile("[^\u0000-՗Ḁ-ỿ‐- ₠-₿℀-↋←-⏿─-➿ぁ-ゖァ-ヿ一-龥가-힣]")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class IntMap:
    """A fixed map from non-negative 64-bit keys to 32-bit values, read for whole arrays; missing keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        place, rest = self._place(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[place[rest]] == -1
            take, first = np.unique(place[rest[free]], return_index=True)
            chosen = rest[free][first]
            self.keys[take], self.values[take] = keys[chosen], values[chosen]
            rest = rest[~np.isin(rest, chosen)]
            place[rest] = (place[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.values[place], -1)
        rest = np.flatnonzero((there != keys) & (there != -1))
        while len(rest):
            place[rest] = (place[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[place[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[place[rest[hit]]]
            rest = rest[~hit & (there != -1)]
        return out


class Vocabulary:
    """Tokens numbered by rank (bytes first, then merges in order), their automaton and the compatibility test."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, alphabet = d["model"], byte_alphabet()
        if model["type"] != "BPE" or d["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": d["pre_tokenizer"].get("trim_offsets"), "use_regex": True} or d["normalizer"]:
            raise ValueError("only plain byte-level BPE files are read")
        self.spec = spec
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        outer = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rank = {c: b for c, b in alphabet.items()}
        self.left, self.right = list(range(256)), list(range(256))
        self.bytes = [bytes([b]) for b in range(256)]
        to_id = [outer[c] for c in sorted(alphabet, key=alphabet.get)]
        pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in rank:
                raise ValueError("two merges of one token")
            left, right = rank[a], rank[b]
            pairs[left, right] = rank[a + b] = len(self.left)
            self.left.append(left)
            self.right.append(right)
            self.bytes.append(self.bytes[left] + self.bytes[right])
            to_id.append(outer[a + b])
        self.to_id = np.array(to_id, np.int32)
        self.from_id = {i: b for i, b in zip(to_id, self.bytes, strict=True)} | {i: s.encode() for s, i in self.added.items()}
        self.pairs = pairs
        self.pair_map = IntMap(np.array([a << 32 | b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int32))
        self.left, self.right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self._mark_sound()
        self._build_automaton()

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether token b may follow token a: no merge across the border comes before the merges that made them."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40) if limit is None else limit.copy()
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            joined = self.pair_map.get(x << 32 | y)
            bad = (joined >= 0) & (joined < limit[open_])
            good[open_[bad]] = False
            # undo the later of the two merges; bytes have none
            undo_left = x > y
            last = np.maximum(x, y)
            going = ~bad & (last >= 256)
            left_going, right_going = going & undo_left, going & ~undo_left
            # a merge on the right of equal rank to one across is made first only if it is earlier
            limit[open_[left_going]] = x[left_going]
            limit[open_[right_going]] = y[right_going] + 1
            a[open_[left_going]] = self.right[x[left_going]]
            b[open_[right_going]] = self.left[y[right_going]]
            open_ = open_[going]
        return good

    def _mark_sound(self) -> None:
        """Which tokens are what their own bytes encode to."""
        n = len(self.left)
        made = np.arange(256, n)
        fits = np.ones(n, bool)
        fits[256:] = self.compatible(self.left[made], self.right[made], made)
        sound = fits.tolist()
        for t in range(256, n):
            sound[t] = sound[t] and sound[self.left[t]] and sound[self.right[t]]
        self.sound = np.array(sound)

    def _build_automaton(self) -> None:
        """States in order of depth: edges, links to the longest proper suffix that is a state, longest token at each."""
        edges: dict[int, int] = {}
        depth, end, parent, byte = [0], [END], [0], [0]
        for t, word in enumerate(self.bytes):
            at = 0
            for c in word:
                key = at << 8 | c
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(depth)
                    depth.append(depth[at] + 1)
                    end.append(END)
                    parent.append(at)
                    byte.append(c)
                at = nxt
            end[at] = t
        link, longest = [0] * len(depth), list(end)
        shorter = [END] * len(self.bytes)
        for s in sorted(range(1, len(depth)), key=depth.__getitem__):
            f = 0
            if depth[s] > 1:
                f, c = link[parent[s]], byte[s]
                while f and (f << 8 | c) not in edges:
                    f = link[f]
                f = edges.get(f << 8 | c, 0)
            link[s] = f
            if end[s] != END:
                shorter[end[s]] = longest[f]
            else:
                longest[s] = longest[f]
        self.edge_map = IntMap(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.link, self.longest, self.shorter = (np.array(x, np.int64) for x in (link, longest, shorter))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's next states."""
        state = state.copy()
        nxt = self.edge_map.get(state << 8 | byte).astype(np.int64)
        rest = np.flatnonzero(nxt < 0)
        while len(rest):
            state[rest] = self.link[state[rest]]
            found = self.edge_map.get(state[rest] << 8 | byte[rest])
            nxt[rest] = found
            rest = rest[found < 0]
        return nxt

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        counts, found = np.zeros(len(words), np.int64), [None] * len(words)
        at = 0
        while at < len(order) and sizes[order[at]] > LONG_WORD:
            found[order[at]] = self._long(words[order[at]])
            counts[order[at]] = len(found[order[at]])
            at += 1
        while at < len(order):
            upto = at + int(np.searchsorted(np.cumsum(sizes[order[at:]]), CHUNK_BYTES)) + 1
            chosen = order[at:upto]
            flat, n = self._together([words[i] for i in chosen], sizes[chosen])
            counts[chosen] = n
            for i, ids in zip(chosen.tolist(), np.split(flat, np.cumsum(n)[:-1]), strict=True):
                found[i] = ids
            at = upto
        return np.concatenate(found), counts

    def _together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in step, longest first."""
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        # entry first[w] + w + i is for the prefix of i bytes
        base = first + np.arange(len(words))
        last = np.full(len(text) + len(words), END, np.int64)
        count = np.zeros(len(last), np.int64)
        state = np.zeros(len(words), np.int64)
        for i in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -i, "right"))
            state[:k] = self.step(state[:k], text[first[:k] + i - 1])
            open_, token = np.arange(k), self.longest[state[:k]]
            while len(open_):
                before = base[open_] + i - self.length[token]
                previous = last[before]
                good = self.sound[token]
                test = np.flatnonzero(good & (previous != END))
                good[test] = self.compatible(previous[test], token[test])
                done = open_[good]
                last[base[done] + i] = token[good]
                count[base[done] + i] = count[before[good]] + 1
                open_, token = open_[~good], self.shorter[token[~good]]
        n = count[base + sizes]
        out = np.zeros(int(n.sum()), np.int32)
        write, left, w = np.cumsum(n) - 1, sizes.copy(), np.arange(len(words))
        while len(w := w[left[w] > 0]):
            token = last[base[w] + left[w]]
            out[write[w]] = self.to_id[token]
            write[w] -= 1
            left[w] -= self.length[token]
        return out, n

    def _long(self, word: bytes) -> np.ndarray:
        """One word, the same steps with plain lookups."""
        edges, link, longest, shorter, length, sound = self._plain()
        last, state = [END], 0
        for i, c in enumerate(word, 1):
            while state and (state << 8 | c) not in edges:
                state = link[state]
            state = edges.get(state << 8 | c, 0)
            token = longest[state]
            while not (sound[token] and (i == length[token] or self._fits(last[i - length[token]], token))):
                token = shorter[token]
            last.append(token)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= length[last[i]]
        return self.to_id[np.array(out[::-1], np.int64)]

    @lru_cache(maxsize=1 << 16)  # noqa: B019  one vocabulary lives as long as its worker
    def _fits(self, a: int, b: int) -> bool:
        return bool(self.compatible(np.array([a]), np.array([b]))[0])

    @lru_cache(maxsize=1)  # noqa: B019
    def _plain(self):
        there = self.edge_map.keys >= 0
        edges = dict(zip(self.edge_map.keys[there].tolist(), self.edge_map.values[there].tolist(), strict=True))
        return edges, self.link.tolist(), self.longest.tolist(), self.shorter.tolist(), self.length.tolist(), self.sound.tolist()


class Splitter:
    """Words of a text as the library's pattern and added tokens cut it; an added token is a word of its own."""

    def __init__(self, spec: str):
        self.spec = spec
        added = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(PATTERN).findall
        self.library = None

    def __call__(self, text: str) -> list[str]:
        if self.added is None or self.added.search(text) is None:
            return self._run(text)
        # runs and added tokens in turn
        return [w for i, run in enumerate(self.added.split(text)) for w in ([run] if i % 2 else self._run(run))]

    def _run(self, text: str) -> list[str]:
        if UNSETTLED.search(text) is None:
            return self.split(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]


@lru_cache(maxsize=2)
def splitter(spec: str) -> Splitter:
    return Splitter(spec)


class Codec:
    """Texts to ids and back with one vocabulary, words remembered."""

    def __init__(self, spec: str):
        self.vocabulary = Vocabulary(spec)
        self.cache = WordCache(splitter(spec), self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words; the pattern never makes a word of an added token's string, so such a word is the token."""
        added = self.vocabulary.added
        plain = [w.encode() for w in words if w not in added]
        ids, sizes = self.vocabulary.encode_words(plain)
        if len(plain) == len(words):
            return ids, sizes
        lists = iter(np.split(ids, np.cumsum(sizes)[:-1])) if plain else iter(())
        found = [np.array([added[w]], np.int32) if w in added else next(lists) for w in words]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def encode(self, batch: pa.Array) -> list[np.ndarray]:
        """An int32 array of ids for each text of a column."""
        return self.cache.ids(batch)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD. Unknown ids are left out."""
        known = self.vocabulary.from_id
        return b"".join([known.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    """The codec of a vocabulary, one for each worker."""
    return Codec(spec)


def read_spec(path: str) -> str:
    """The content of a vocabulary file on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", decoded: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` (its text only if asked) with ``ids`` (BINARY: little-endian unsigned 32-bit numbers) and, if asked, ``decoded``, their text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def compute():
        c = codec(spec.value)

        def run(col: pa.Array) -> list:
            found = c.encode(col)
            ids = [x.astype("<u4").tobytes() for x in found]
            return [ids, [c.decode(x) for x in found]] if decoded else [ids]

        return run

    fields = [T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.StringType())] * decoded]
    return extend(docs, text_col, T.StructType(fields), compute, keep_text)


def bpe_decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of ``ids_col``; null ids give an empty text."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def compute():
        c = codec(spec.value)
        return lambda col: [[c.decode(np.frombuffer(x or b"", "<u4")) for x in col.to_pylist()]]

    return extend(df, ids_col, T.StructType([T.StructField("decoded", T.StringType())]), compute)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their text, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True, keep_text=False)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
