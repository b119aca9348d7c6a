"""A byte-level BPE vocabulary as both of its operators need it: a trie of tokens, and which tokens may be neighbours.

Two tokens stand side by side in an encoding if no merge joins bytes across their boundary first. While BPE builds
the left token, what touches the boundary on its left side runs up the left token's right spine; on the other side
it runs up the right token's left spine. A merge across happens if its rank comes before the next step of either
spine; at equal ranks the leftmost merge is first.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from collections.abc import Callable
from functools import lru_cache

import regex

NEVER = 1 << 60


class Vocabulary:
    def __init__(self, tokens: dict[int, bytes], pair_rank: Callable[[int, int], int | None], parts: Callable[[int], tuple[int, int] | None]):
        self.bytes, self.pair_rank, self.parts = tokens, pair_rank, parts
        #: child[node << 8 | byte] is a node; token_at[node] the token that ends there, or -1. The root is node 0.
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, data in tokens.items():
            node = 0
            for b in data:
                found = self.child.get(node << 8 | b)
                if found is None:
                    found = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                node = found
            self.token_at[node] = token
        self.longest = max(map(len, tokens.values()))
        self.grows = {key >> 8 for key in self.child}
        self._spines: tuple[dict, dict] = {}, {}
        self.known_fits: dict[int, bool] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost byte up to the token: each with the rank of the merge that takes it up. side 0: left, 1: right."""
        known = self._spines[side].get(token)
        if known is None:
            up, at, rank = [], token, NEVER
            while True:
                up.append((at, rank))
                parts = self.parts(at)
                if parts is None:
                    break
                rank, at = self.pair_rank(*parts), parts[side]
            known = self._spines[side][token] = up[::-1]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` can follow `left` in an encoding; left is -1 at the start."""
        key = (left + 1) << 32 | right
        known = self.known_fits.get(key)
        if known is None:
            if len(self.known_fits) > 1_000_000:
                self.known_fits.clear()
            known = self.known_fits[key] = left < 0 or self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = a[i], b[j]
            rank = self.pair_rank(x, y)
            if rank is not None and rank < x_goes and rank <= y_goes:
                return False
            if x_goes == y_goes == NEVER:
                return True
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def from_json(path: str) -> tuple[Vocabulary, list[str]]:
    """The vocabulary of a tokenizers file, and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, ids = byte_letters(), spec["model"]["vocab"]
    merges: dict[tuple[int, int], int] = {}
    made: dict[int, tuple[int, int]] = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[ids[a], ids[b]] = rank
        made.setdefault(ids[a + b], (ids[a], ids[b]))
    tokens = {k: bytes(letters[c] for c in text) for text, k in ids.items()}
    usable = {k: t for k, t in tokens.items() if len(t) == 1 or k in made}
    return Vocabulary(usable, lambda a, b: merges.get((a, b)), made.get), [x["content"] for x in spec["added_tokens"] if x["special"]]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def from_ranks(path: str) -> Vocabulary:
    """The vocabulary of a rank file: any two neighbours whose bytes together are a token merge, lowest rank first."""
    ranks = load_ranks(path)
    tokens = {k: t for t, k in ranks.items()}
    known: dict[int, tuple[int, int] | None] = {}

    def parts(token: int) -> tuple[int, int] | None:
        if token not in known:
            pieces = [tokens[token][k : k + 1] for k in range(len(tokens[token]))]
            while len(pieces) > 2:
                at = min(range(len(pieces) - 1), key=lambda k: (ranks.get(pieces[k] + pieces[k + 1], NEVER), k))
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            known[token] = (ranks[pieces[0]], ranks[pieces[1]]) if len(pieces) == 2 else None
        return known[token]

    return Vocabulary(tokens, lambda a, b: ranks.get(tokens[a] + tokens[b]), parts)


@lru_cache(maxsize=4)
def piece_finder(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern. Texts without odd characters take an equal pattern of the standard library, which is twice as fast.

    There, letters are word characters without digits and underscores; that differs from \\p{L} for numbers that are
    not decimal digits, and \\s differs for four controls. Those characters are the odd ones.
    """
    exact = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if "\\p" in plain:
        return exact
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    odd = set()
    for a, b in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        odd |= set(regex.findall(a, every)) ^ set(re.findall(b, every))
    quick = re.compile(plain).findall
    return lambda text: quick(text) if odd.isdisjoint(set(text)) else exact(text)
