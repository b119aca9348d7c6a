"""Token counts of every prefix of a text by dynamic programming over the vocabulary of a byte-level BPE.

The encoding of a prefix of a piece ends in exactly one token, and what stands before that token is the
encoding of a shorter prefix. So last[i], the last token of the encoding of the first i bytes, follows from
earlier entries: it is the token t that ends at i for which last[i - len(t)] and t may be neighbours.
count[i] = count[i - len(t)] + 1 then answers every question about truncation and budgets without encoding
anything again.
"""

from __future__ import annotations

import re as stdlib_re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wordloom.llm.bpe_vocabulary import Vocabulary, from_json, piece_finder
from wordloom.llm.common import slices

#: How many distinct pieces a task remembers (twice over), and the longest that it does, in bytes.
CACHE_PIECES, CACHE_PIECE_BYTES = 100_000, 64

OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("bytes_within_limit", T.LongType()),
    ]
)


class PrefixCounts(dict):
    """Piece to its counts: entry i is the number of tokens of the first i bytes of the piece. Those remembered are bytes, as no count exceeds CACHE_PIECE_BYTES."""

    def __init__(self, vocabulary: Vocabulary, special: list[str], pattern: str):
        super().__init__()
        self.vocabulary, self.pieces, self.older = vocabulary, piece_finder(pattern), {}
        self.special = stdlib_re.compile("(" + "|".join(map(stdlib_re.escape, special)) + ")") if special else None
        self.special_strings = set(special)

    def __missing__(self, piece: str) -> Sequence[int]:
        found = self.older.get(piece)
        if found is None:
            found = self.prefix_counts(piece.encode("utf-8"))
        if len(found) <= CACHE_PIECE_BYTES + 1:
            found = bytes(found)
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def prefix_counts(self, data: bytes) -> list[int]:
        child, token_at, fits = self.vocabulary.child.get, self.vocabulary.token_at, self.vocabulary.fits
        known = self.vocabulary.known_fits.get
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for start in range(len(data)):
            node, end, before, size = 0, start, (last[start] + 1) << 32, count[start] + 1
            for byte in data[start : start + self.vocabulary.longest]:
                node = child(node << 8 | byte)
                if node is None:
                    break
                end += 1
                if count[end]:  # only one token can end here, and a longer one does
                    continue
                token = token_at[node]
                if token >= 0:
                    fit = known(before | token)
                    if fit or fit is None and fits(last[start], token):
                        last[end], count[end] = token, size
        return count

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and those strings."""
        for part in self.special.split(text) if self.special else [text]:
            if part:
                yield part, part in self.special_strings

    def of_text(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the whole text, and how many bytes of its tokenised text fit into `limit` tokens."""
        total = within = 0
        for part, special in self.parts(text):
            if special:
                total += 1
                within += len(part.encode()) if total <= limit else 0
                continue
            each = [self[piece] for piece in self.pieces(part)]
            size = sum([x[-1] for x in each])
            if total + size <= limit:
                within += sum([len(x) - 1 for x in each])
            elif total < limit:
                room = limit - total
                for x in each:
                    if x[-1] > room:
                        within += max(k for k, n in enumerate(x) if n <= room)  # counts of prefixes may fall again
                        break
                    room -= x[-1]
                    within += len(x) - 1
            total += size
        return total, within

    def every_prefix(self, text: str) -> list[int]:
        """The count at each byte of the text, along the pieces of the whole text."""
        out = [0]
        for part, special in self.parts(text):
            if special:
                out += [out[-1] + 1] * len(part.encode())
                continue
            for piece in self.pieces(part):
                base = out[-1]
                out += [base + k for k in self[piece][1:]]
        return out


@lru_cache(maxsize=2)
def counts_of(vocabulary: str, pattern: str) -> PrefixCounts:
    """One instance for all tasks of a Python worker, so its tables are made once."""
    return PrefixCounts(*from_json(vocabulary), pattern)


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 1024) -> DataFrame:
    """n_bytes, n_tokens and bytes_within_limit of every row's whole text; `vocabulary` is a tokenizers file that executors can read.

    bytes_within_limit says where to cut the text as tokenised so that at most `limit` tokens are left.
    One output row for each input row, repeated rows and null ids included. A null or empty text has 0 bytes and
    0 tokens. An empty table gives no rows. Further columns of docs are ignored. Texts of any length are read in
    whole; memory follows one text and a bounded cache of pieces. A special string inside a text is one token.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(vocabulary, pattern)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            rows = [counts.of_text(t, limit) if t else (0, 0) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                ],
                names=OUT.names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, OUT)
