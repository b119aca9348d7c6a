"""Removes word windows that an earlier document has, by FM-indexes of shards.

Each shard's fragments (see repeats) are joined into one text of word numbers, and its Burrows-Wheeler transform is
kept as a wavelet matrix of packed bits, with the fragment that each suffix is from; places of suffixes are not kept.
Fragments are streamed through it: backward search narrows the interval of
suffixes that begin with the words read so far, and where it has read a window, the matching statistics have reached
the threshold. The least document of the interval says if the window stands in an earlier one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm import anchors
from wordloom.llm.anchors import BYTE_BASE, WORD_BASE, Texts
from wordloom.llm.repeats import Kind, Limits, judged

#: Words of a window and of the grams that may be its anchor.
WINDOW, GRAM = 13, 4
#: Windows that are searched at once.
AT_ONCE = 1 << 18

OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
REPORT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
)


class Bits:
    """A bit vector in 64-bit words with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(n_symbols)
        self.begin = np.zeros(n_symbols, np.int64)
        self.begin = self._down(every, self.begin)

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbols, at) - self.begin[symbols]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text in order of the `depth` symbols from there on, by doubling."""
    rank, known = text.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        if known < len(rank):
            after[:-known] = rank[known:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        known *= 2
        key = key[order]
        new = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if known >= depth or new[-1] == len(key) - 1:
            return order
        rank = np.empty(len(key), np.int64)
        rank[order] = new


class FmIndex:
    """Of a text of small numbers, each of an owner; answers for patterns of up to `depth` symbols."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        places = suffix_array(text, depth)
        n = int(text.max()) + 1
        self.wavelet = WaveletMatrix(text[places - 1], n)
        self.owner = owner[places]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])

    def intervals(self, text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For the pattern of `size` symbols at each start, from and to of the suffixes that begin with it."""
        c = text[starts + size - 1]
        low, high = self.first[c], self.first[c + 1]
        for back in range(size - 2, -1, -1):
            c = text[starts + back]
            low, high = self.first[c] + self.wavelet.rank(c, low), self.first[c] + self.wavelet.rank(c, high)
        return low, high


def search_words(fragments: pa.Array, did: np.ndarray, n: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each window of each fragment, whether a fragment of an earlier document has it. Fragments come in order of did."""
    texts = Texts(fragments)
    starts, ends, bounds = texts.words()
    data = texts.data.tobytes()
    numbers: dict[bytes, int] = {}
    symbols = np.fromiter((numbers.setdefault(data[a:b], len(numbers) + 1) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
    owner = np.repeat(np.arange(len(did)), np.diff(bounds))
    text = np.zeros(len(symbols) + len(did) + 1, np.int64)  # a zero ends each fragment
    place = np.arange(len(symbols)) + owner + 1
    text[place] = symbols
    own = np.full(len(text), len(did), np.int32)
    own[place] = owner
    index = FmIndex(text, own, size)
    window_owner = np.repeat(np.arange(len(did)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (bounds[:-1] + np.arange(len(did)) + 1)[window_owner]
    out = np.zeros(len(window), bool)
    for k in range(0, len(window), AT_ONCE):
        low, high = index.intervals(text, window[k : k + AT_ONCE], size)
        unique, which = np.unique(low, return_inverse=True)
        upper = np.empty(len(unique), np.int64)
        upper[which] = high
        pairs = np.stack([unique, upper], 1).ravel()
        least = np.minimum.reduceat(np.append(index.owner, len(did)), pairs)[::2]
        out[k : k + AT_ONCE] = did[least[which]] < did[window_owner[k : k + AT_ONCE]]
    return out


def _hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    sums = anchors.prefix_sums(texts.data.astype(np.uint64) + np.uint64(1), BYTE_BASE)
    sums = anchors.prefix_sums(anchors.spans_hash(sums, starts, ends, BYTE_BASE), WORD_BASE)
    return sums, WORD_BASE, anchors.grams(sums, GRAM, WORD_BASE) >> np.uint64(64 - anchors.GRAM_BITS)


WORDS = Kind(WINDOW, GRAM, Texts.words, _hashes, search_words, False)


def _cleaned(batch: pa.RecordBatch, gone: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    begin = Texts(batch.column("text")).bounds
    out, removed = [], []
    for k, text in enumerate(batch.column("text").to_pylist()):
        mine = gone[bounds[k] : bounds[k + 1]]
        removed.append(int(mine.sum()))
        if removed[-1]:
            data, at = text.encode("utf-8"), starts[bounds[k] : bounds[k + 1]] - begin[k]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
            keep = [0, *[int(at[e]) if e < len(at) else len(data) for e in edge.tolist()], len(data)]
            text = b"".join(data[a:b] for a, b in zip(keep[::2], keep[1::2], strict=True)).decode("utf-8")
        out.append(text)
    return [batch.column("doc_id"), pa.array(out, pa.string()), pa.array(np.diff(bounds)), pa.array(removed, pa.int64())]


def _reported(batch: pa.RecordBatch, gone: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    digests, removed = [], []
    for k, text in enumerate(batch.column("text").to_pylist()):
        mine = gone[bounds[k] : bounds[k + 1]]
        removed.append(int(mine.sum()))
        words = text.encode("utf-8").split() if text else []
        digests.append(hashlib.sha256(b" ".join(compress(words, (~mine).tolist()) if removed[-1] else words)).hexdigest())
    return [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(digests)]


def dedup(docs: DataFrame, carry: Sequence[str] = (), limits: Limits = Limits()) -> DataFrame:
    """doc_id, text without the removed words and the white space after them, n_words and n_removed of every row of docs.

    A word goes if a window of WINDOW words that covers it also starts in a document with a smaller doc_id. A null id
    is smaller than all others; rows with equal ids do not count as earlier for each other. Null text stays null and
    has no words; an empty table gives no rows. Further columns are ignored, but those named in `carry` follow the
    others, or take the place of one of the same name. Texts are taken whole.
    """
    found = judged(docs, WORDS, _cleaned, OUT, carry, limits)
    return found.select(*[n for n in OUT.names if n not in carry], *[F.col("rest")[c].alias(c) for c in carry])


def report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words with one space between them) of every row; see dedup()."""
    return judged(docs, WORDS, _reported, REPORT, limits=limits).select(*REPORT.names)


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS k, w FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT doc_id, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS g FROM p),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(k, k + {WINDOW})) AS k FROM r),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) FILTER (WHERE x.k IS NULL) AS kept, count(x.k) AS n FROM u LEFT JOIN x ON u.doc_id = x.doc_id AND u.k = x.k GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
