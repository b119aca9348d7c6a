"""Deletion variants of words as 64-bit marks, made by the batch, and a bitmap that tells which marks are asked for in vain."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that are made at once; bits of the largest bitmap.
CHUNK, MOST_BITS = 1 << 19, 1 << 28
#: The base of the marks and its inverse modulo 2**64; multipliers that mix letters and marks.
BASE, LETTER, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
INVERSE = pow(BASE, -1, 1 << 64)
#: What keeps apart marks that meet for different reasons.
SHORTER, LONGER, OPENED = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _kinds(letters: np.ndarray) -> list[np.ndarray]:
    """Marks of words of one length: of the word, of what is left after one deletion and after two; of the word with one place open and with two, and of what is left after one deletion with one place open."""
    n, size = letters.shape
    mixed = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(LETTER)
    mixed ^= mixed >> np.uint64(29)
    powers = np.array([pow(BASE, k, 1 << 64) for k in range(size)], np.uint64)
    sums = np.zeros((n, size + 1), np.uint64)
    np.cumsum(mixed * powers, axis=1, out=sums[:, 1:])
    one, two = np.uint64(INVERSE), np.uint64(INVERSE * INVERSE % (1 << 64))
    k = np.arange(size)
    i, j = np.triu_indices(size, 1)
    whole = sums[:, -1:]
    less_one = sums[:, k] + (whole - sums[:, k + 1]) * one
    less_two = sums[:, i] + (sums[:, j] - sums[:, i + 1]) * one + (whole - sums[:, j + 1]) * two
    terms, tag = mixed * powers, np.uint64(OPENED)
    open_one = whole - terms + (k + 1).astype(np.uint64) * tag
    open_two = whole - terms[:, i] - terms[:, j] + (i * size + j + size + 1).astype(np.uint64) * tag
    gone, place = (x.ravel() for x in np.mgrid[:size, : max(0, size - 1)])
    shut = np.where(place < gone, terms[:, place], terms[:, np.minimum(place + 1, size - 1)] * one) if size else terms
    less_open = less_one[:, gone] - shut + (place + 1).astype(np.uint64) * tag
    return [whole, less_one, less_two, open_one, open_two, less_open]


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(parts, axis=1)
    out ^= out >> np.uint64(32)
    out *= np.uint64(MIX)
    return out ^ (out >> np.uint64(29))


def marks(letters: np.ndarray) -> np.ndarray:
    """A row for each word of the matrix (code points of words of one length): the marks of the word and of what is left after one or two deletions.

    Equal strings have equal marks. Different ones may have, too, so pairs that share a mark have to be confirmed.
    """
    return _mixed(_kinds(letters)[:3])


def close_marks(letters: np.ndarray) -> np.ndarray:
    """The marks of each word and of what is left after one deletion. Words at distance 1 share one, and words of which one letter is left out and another one put in."""
    return _mixed(_kinds(letters)[:2])


def _far_marks(letters: np.ndarray, more: int, fewer: int) -> np.ndarray:
    whole, _, less_two, open_one, open_two, less_open = _kinds(letters)
    more, fewer = np.uint64(more), np.uint64(fewer)
    return _mixed([less_two + more, less_open + more, whole + fewer, open_one + fewer, open_two])


def far_marks(letters: np.ndarray) -> np.ndarray:
    """Marks by which words meet far_heads(): by two letters less on one side, by one less and one exchanged in place, or by two exchanged.

    But for different strings of one mark, who meets is at distance 2 at most; and who is at distance 2 meets here or shares one of close_marks().
    """
    return _far_marks(letters, SHORTER, LONGER)


def far_heads(letters: np.ndarray) -> np.ndarray:
    """The other side of far_marks()."""
    return _far_marks(letters, LONGER, SHORTER)


def marker(bits: Callable[[], np.ndarray] | None = None, of: Callable[[np.ndarray], np.ndarray] = marks) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: word, and each of its marks (of) once; with a bitmap() those only that it may hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else bits()
        for batch in batches:
            words = batch.column(0)
            listed = words.to_pylist()
            sizes = np.array([len(w) for w in listed], np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                step = max(1, CHUNK // (1 + size + 2 * size * size))
                for a in range(0, len(rows), step):
                    some = rows[a : a + step]
                    letters = np.frombuffer("".join([listed[r] for r in some.tolist()]).encode("utf-32-le"), "<u4").reshape(len(some), size)
                    found = of(letters)
                    found.sort(axis=1)
                    wanted = np.ones(found.shape, bool)
                    wanted[:, 1:] = found[:, 1:] != found[:, :-1]
                    if known is not None:
                        at = found & np.uint64(8 * len(known) - 1)
                        wanted &= (known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    row, place = np.nonzero(wanted)
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(some[row])), pa.array(found[row, place].view(np.int64))], names=["word", "mark"])

    return run


def bitmap(marked: DataFrame) -> np.ndarray:
    """Bits for the marks of a table: some 16 a mark, and never more than MOST_BITS."""
    bits = min(MOST_BITS, 1 << max(15, (16 * marked.count()).bit_length()))
    at = F.col("mark").bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    parts = marked.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():  # 4 KB each, as many as MOST_BITS allow
        part = np.frombuffer(r.bits, np.uint8)[: len(out)]
        out[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    return out
