"""Cutting texts where byte-level BPE cannot merge, and remembering the ids of words.

The pattern that comes before the merges never lets a token cross a single blank between two other characters. Texts are
therefore split at blanks first, and only distinct pieces are cut into words by the pattern; a text with a piece for which
that does not hold (blanks side by side, blanks beside line feeds, other white space) is cut by the pattern as a whole.
Ids of distinct words are kept for the life of a Python worker, up to a bound, in one flat array.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_LIMIT = 200_000

#: Fixed value: the public byte-level BPE pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Letters that every Unicode version in use knows as such, then a full stop or a comma at most.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[.,]?$"

_other_space = re.compile(r"[^\S\n]")


class _Numbered(dict):
    """Numbers for keys in the order of their first use; new keys are listed."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs side by side: starts[0], starts[0] + 1, ... for sizes[0] places, and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def splits_at_blanks(piece: str) -> bool:
    """Whether a piece between blanks is cut as if it stood alone behind one."""
    return bool(piece) and piece[0] != "\n" and piece[-1] != "\n" and _other_space.search(piece) is None


class WordCache:
    """Ids of texts from ids of their words.

    ``cut(text)`` gives the words of a text; ``encode(words)`` gives their flat ids and the number of ids of each. Beyond
    ``limit`` words those used once only are forgotten, or all if that is not enough.
    """

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int | None = None):
        self.cut, self.encode, self.limit = cut, encode, limit or WORD_LIMIT
        self.clear()

    def clear(self) -> None:
        self.words = _Numbered()
        self.pool = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = 0

    def shrink(self) -> None:
        """Forget words used once."""
        often = np.flatnonzero(self.hits[: len(self.words)] > 1)
        if len(often) > self.limit // 2:
            self.clear()
            return
        words = list(self.words)
        sizes = self.sizes[often]
        flat = self.pool[spans(self.starts[often], sizes)]
        self.clear()
        for i in often.tolist():
            self.words[words[i]]
        self.words.fresh = []
        self._store(flat, sizes)

    def _grown(self, own: np.ndarray, used: int, more: int) -> np.ndarray:
        return own if used + more <= len(own) else np.concatenate([own[:used], np.zeros(more + used // 2 + 1024, own.dtype)])

    def _store(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the words numbered last."""
        n, more = len(self.words), len(sizes)
        self.pool = self._grown(self.pool, self.used, len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts, self.sizes, self.hits = (self._grown(x, n - more, more) for x in (self.starts, self.sizes, self.hits))
        self.starts[n - more : n], self.sizes[n - more : n], self.hits[n - more : n] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.used += len(flat)

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def _learn(self) -> None:
        """Encode the words that are new."""
        if fresh := self.words.fresh:
            self.words.fresh = []
            self._store(*self.encode(fresh))

    def _of_words(self, uses: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of pieces given by their words, and how many each has."""
        self._learn()
        self.hits[: len(self.words)] += np.bincount(uses, minlength=len(self.words))
        sizes = self.sizes[uses]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return self.pool[spans(self.starts[uses], sizes)], np.diff(ends)

    def _cut_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of texts side by side, and how many each has."""
        lists = [self.cut(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return self._numbers([w for x in lists for w in x]), counts

    def _behind_blanks(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of distinct pieces behind a blank, how many each has, and which do not split there.

        Most pieces are letters with a full stop or a comma at most: two words that need no pattern.
        """
        plain = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False)
        letters = pieces.filter(pa.array(plain))
        stems = pc.utf8_rtrim(letters, ".,")
        marked = (pc.utf8_length(letters).to_numpy() - pc.utf8_length(stems).to_numpy()) > 0
        own = self._numbers(pc.binary_join_element_wise("", stems, " ").to_numpy(zero_copy_only=False).tolist())
        marks = self._numbers(pc.utf8_slice_codeunits(letters.filter(pa.array(marked)), -1).to_numpy(zero_copy_only=False).tolist())
        counts, odd = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool)
        counts[plain] = 1 + marked
        rest = np.flatnonzero(~plain)
        texts = pieces.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()
        fits = np.fromiter(map(splits_at_blanks, texts), bool, len(texts))
        odd[rest[~fits]] = True
        more, sizes = self._cut_each([" " + t for t, ok in zip(texts, fits.tolist(), strict=True) if ok])
        counts[rest[fits]] = sizes
        starts = np.cumsum(counts) - counts
        uses = np.zeros(int(counts.sum()), np.int64)
        at = starts[plain]
        uses[at] = own
        uses[at[marked] + 1] = marks
        uses[spans(starts[rest[fits]], sizes)] = more
        return uses, counts, odd

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """An int32 array of ids for each text of a string column; null counts as empty."""
        if len(self.words) > self.limit:
            self.shrink()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        which, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        n = len(pieces)
        uses, words, odd = self._behind_blanks(pieces)
        # the first piece of a text has no blank before it; an empty one is nothing
        first = np.cumsum(counts) - counts
        heads, place = np.unique(which[first], return_inverse=True)
        head_texts = pieces.take(pa.array(heads)).to_numpy(zero_copy_only=False).tolist()
        ok = np.fromiter((not t or splits_at_blanks("x" + t) for t in head_texts), bool, len(head_texts))
        more, more_words = self._cut_each([t if fits else "" for t, fits in zip(head_texts, ok.tolist(), strict=True)])
        which[first] = n + place
        odd = np.concatenate([odd, ~ok])
        uses, words = np.concatenate([uses, more]), np.concatenate([words, more_words])
        if odd.any():  # texts with a piece that does not split there are cut whole, as pieces of their own
            bad = np.add.reduceat(odd[which].astype(np.int64), first) > 0
            whole = np.flatnonzero(bad)
            more, more_words = self._cut_each(texts.take(pa.array(whole)).to_numpy(zero_copy_only=False).tolist())
            kept = which[np.repeat(~bad, counts)]
            numbers = len(words) + np.arange(len(whole))
            uses, words = np.concatenate([uses, more]), np.concatenate([words, more_words])
            kept_counts = np.where(bad, 1, counts)
            counts = kept_counts
            which = np.zeros(int(counts.sum()), np.int64)
            which[(np.cumsum(counts) - counts)[bad]] = numbers
            which[np.repeat(~bad, counts)] = kept
        flat, sizes = self._of_words(uses, words)
        own = sizes[which]
        out = flat[spans((np.cumsum(sizes) - sizes)[which], own)]
        cuts = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(counts)])]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
