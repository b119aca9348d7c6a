"""Texts as arrays of symbols, and anchors: what makes equal windows meet without comparing all with all.

A window of `size` symbols has as its anchor the least hash of the grams of `gram` symbols in it. Equal windows have
equal anchors, so a window that stands elsewhere too has an anchor that does. Windows side by side mostly share
theirs; a run is such a stretch with the same last place of that gram, so of at most size - gram + 1 windows, and
equal windows are never in one run. Hashes only bring windows together; whoever
uses runs compares the symbols themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wordloom.llm.common import SLICE_BYTES

#: Odd multipliers of the rolling hashes of bytes and of words, and a mixer's.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SEPARATOR = np.ones(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: The longest table of powers that a Python worker keeps; longer ones live as long as the text they are for.
KEPT_POWERS = SLICE_BYTES + 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        known = np.full(max(n + 1, 1 << 16), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if len(known) <= KEPT_POWERS:
            _powers[base] = known
    return known[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The hash of each span, the same wherever it stands."""
    inverse = pow(base, -1, 1 << 64)
    return mixed((sums[ends] - sums[starts]) * powers(inverse, len(sums))[starts] + (ends - starts).astype(np.uint64))


#: Bits of a gram's hash. Few enough to shuffle cheaply, and so many that what is found once rarely looks repeated.
GRAM_BITS = 48


def grams(sums: np.ndarray, size: int, base: int) -> np.ndarray:
    """The hash of the `size` symbols from each place on."""
    n = max(0, len(sums) - size)
    return mixed((sums[size : size + n] - sums[:n]) * powers(pow(base, -1, 1 << 64), n)[:n])


class Texts:
    """The bytes of a column's texts one after the other; text k lies from bounds[k] to bounds[k + 1]. Null counts as empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        if lower:
            self.data = LOWER[self.data]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the bounds of each text's words among them."""
        inside = SEPARATOR[self.data]
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        before[self.bounds] = False
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        after[self.bounds] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    width, out = 1, values
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchor_runs(gram_hash: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run; bounds part the symbols into texts, and no window crosses one."""
    most = size - gram + 1
    if len(gram_hash) < most:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding_min(gram_hash, most)
    valid = np.zeros(len(least) + 1, np.int8)
    first, last = bounds[:-1], bounds[1:] - size + 1
    keep = last > first
    np.add.at(valid, first[keep], 1)
    np.add.at(valid, last[keep], -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (gram_hash[most : most + len(least) - 1] == least[1:])  # the last least gram is another
    new[first[keep]] = True
    new[1:] |= ~valid[:-1]
    at = np.flatnonzero(new & valid)
    end = np.append(at[1:], len(least))
    # A run also ends with the last window of its text.
    end = np.minimum(end, last[keep][np.searchsorted(first[keep], at, "right") - 1])
    return least[at], at, end - at
