"""Removes byte strings that stand earlier in the corpus, by run-length indexes of shards.

Each shard's fragments (see repeats) are joined into one text. Of its Burrows-Wheeler transform only the text places
sampled at both ends of each run are kept, as the index only answers for its own text. A suffix and the one before it in sorted
order match the longest; where a run goes on, that match is the one of the symbol before, shortened by one, so the
samples at run ends give the matching statistics of every place as the text streams by. Copies make long runs, and
few samples. Places whose matches are long enough are chained together, and the leftmost of a chain stays.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wordloom.llm import anchors
from wordloom.llm.anchors import BYTE_BASE, Texts
from wordloom.llm.repeats import Kind, Limits, judged

#: Bytes of a string and of the grams that may be its anchor.
WINDOW, GRAM = 100, 32

OUT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]
)
REPORT = T.StructType([*[f for f in OUT if f.name != "kept"], T.StructField("kept_sha256", T.StringType())])


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, as if zeros followed the text."""
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def sorted_suffixes(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in order of their suffixes. words: eight_bytes(); left: bytes up to the end of the fragment, its separator included.

    Separators come after all other symbols, and among each other in text order, so nothing behind one is compared.
    """
    n = len(words)
    short = np.flatnonzero(left < 8)
    words = words.copy()
    words[short] &= ~((np.uint64(1) << (64 - 8 * left[short]).astype(np.uint64)) - np.uint64(1))
    order = np.argsort(words)
    key = words[order]
    new = np.ones(n + 1, bool)
    new[1:n] = key[1:] != key[:-1]
    rank, known, every = np.empty(n, np.int64), 8, np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new[:n], every, 0))
    while len(tied := np.flatnonzero(~(new[:n] & new[1:]))):
        at = order[tied]
        second = np.where(left[at] > known, rank[np.minimum(at + known, n - 1)], at)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        new[tied[1:]] = key[1:] != key[:-1]
        new[tied[0]] = True
        start = np.where(new[tied], tied, 0)
        rank[at] = np.maximum.accumulate(start)
        known *= 2
    return order


class RunIndex:
    """The runs of a Burrows-Wheeler transform by the text places sampled at their ends."""

    def __init__(self, text: np.ndarray, separators: np.ndarray, left: np.ndarray):
        words = eight_bytes(text)
        order = sorted_suffixes(words, left)
        before = text[order - 1].astype(np.int64)
        alone = np.zeros(len(text) + 1, bool)
        alone[separators + 1] = True
        alone[0] = True
        head = np.ones(len(text), bool)  # separators differ from each other, so what follows one begins a run
        head[1:] = (before[1:] != before[:-1]) | alone[order[1:]] | alone[order[:-1]]
        starts = np.flatnonzero(head)
        self.first, self.last = order[starts], order[np.append(starts[1:], len(text)) - 1]
        self.n = len(text)
        #: At the place sampled first in a run: the suffix before it in order, and how far they match.
        self.matches = np.zeros(len(starts), np.int64)
        self.matches[1:] = self._common(words, left, self.first[1:], self.last[:-1])

    @staticmethod
    def _common(words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(left[a], left[b]) - 1
        size = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            x, y = a[live] + size[live], b[live] + size[live]
            differ = words[x] ^ words[y]
            same = np.full(len(live), 8)
            odd = differ != 0
            same[odd] = sum((differ[odd] < np.uint64(1) << np.uint64(56 - 8 * k)).astype(np.int64) for k in range(7))
            size[live] += same
            live = live[~odd & (size[live] < most[live])]
        return np.minimum(size, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the text: another place, and how many symbols match from both on."""
        at, match, length = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        at[self.first] = self.first
        match[self.first[1:]] = self.last[:-1]
        length[self.first] = self.matches
        sample = np.maximum.accumulate(at)
        passed = np.arange(self.n) - sample
        return match[sample] + passed, length[sample] - passed


def leftmost(match: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that match another over `size` symbols or are so matched, and for each the leftmost such place."""
    linked = np.flatnonzero(length >= size)
    to = match[linked]
    places = np.union1d(linked, to)
    root = np.arange(len(places))
    root[np.searchsorted(places, linked)] = np.searchsorted(places, to)
    while not np.array_equal(up := root[root], root):
        root = up
    least = np.full(len(places), np.iinfo(np.int64).max)
    np.minimum.at(least, root, places)
    return places, least[root]


def search_bytes(fragments: pa.Array, did: np.ndarray, n: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each window of each fragment, whether it stands further left: in a fragment before, or before in its own."""
    texts = Texts(fragments)
    sizes = np.diff(texts.bounds)
    ends = np.cumsum(sizes + 1)
    text = np.full(int(ends[-1]), 0xFF, np.uint8)  # no byte of UTF-8
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(owner)) + owner] = texts.data
    left = np.repeat(ends, sizes + 1) - np.arange(len(text))
    places, least = leftmost(*RunIndex(text, ends - 1, left).statistics(), size)
    later = np.zeros(len(text), bool)
    later[places] = least < places
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - sizes - 1, n)
    return later[window]


def _places(texts: Texts) -> tuple[None, None, np.ndarray]:
    return None, None, texts.bounds


def _hashes(texts: Texts, starts: None, ends: None) -> tuple[np.ndarray, int, np.ndarray]:
    sums = anchors.prefix_sums(texts.data.astype(np.uint64) + np.uint64(1), BYTE_BASE)
    return sums, BYTE_BASE, anchors.grams(sums, GRAM, BYTE_BASE) >> np.uint64(64 - anchors.GRAM_BITS)


BYTES = Kind(WINDOW, GRAM, _places, _hashes, search_bytes, True)


def _judged(batch: pa.RecordBatch, gone: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], list[pa.Array]]:
    """What is kept of each text, and the columns doc_id, n_bytes, n_removed and n_spans."""
    data = Texts(batch.column("text")).data
    kept, removed, spans = [], [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = gone[a:b]
        removed.append(int(mine.sum()))
        spans.append(int((mine[1:] & ~mine[:-1]).sum() + mine[:1].sum()))
        kept.append((data[a:b][~mine] if removed[-1] else data[a:b]).tobytes())
    return kept, [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]


def _cleaned(batch: pa.RecordBatch, gone: np.ndarray, bounds: np.ndarray, starts: None) -> list[pa.Array]:
    kept, (doc_id, *counts) = _judged(batch, gone, bounds)
    return [doc_id, pa.array(kept, pa.binary()), *counts]


def _reported(batch: pa.RecordBatch, gone: np.ndarray, bounds: np.ndarray, starts: None) -> list[pa.Array]:
    kept, columns = _judged(batch, gone, bounds)
    return [*columns, pa.array([hashlib.sha256(x).hexdigest() for x in kept])]


def dedup(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, kept (the bytes that remain), n_bytes, n_removed and n_spans of every row of docs.

    A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller doc_id, or earlier
    in the same one. A null id is smaller than all others; rows with equal ids are one document to this rule, and
    what stands at the same place in them stays. Null text is empty; an empty table gives no rows; further columns
    are ignored. Texts are taken whole.
    """
    return judged(docs, BYTES, _cleaned, OUT, limits=limits).select(*OUT.names)


def report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; see dedup()."""
    return judged(docs, BYTES, _reported, REPORT, limits=limits).select(*REPORT.names)
