"""Benchmark passages in documents, found by a generalised suffix automaton of the items' words.

The automaton accepts every run of words inside an item. A document's words are streamed through it, and at each
word its state tells how long a run that ends there some item has. Where that reaches the window, the words of the
window are hit; an item shorter than the window must occur whole. Spans of hit words are removed.

Words outside the items, and neighbours that no item has side by side, cut every run; only stretches between such
cuts that are long enough for a window enter the automaton.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import rest, slices, written

#: Words of a window; words of items that one pass over the documents holds; share of hit words that condemns a document.
WINDOW, PASS_WORDS, MOST = 10, 200_000, 0.5

#: A-Z become small letters; bytes outside words become spaces.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("hit", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(NORMAL).split() if text else []


class Automaton:
    """next, link and length of each state of the suffix automaton of all items; state 0 is the start."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        texts = [(k, words_of(t)) for k, t in items]
        texts = [(k, w) for k, w in texts if w]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for _, ws in texts for w in ws))}
        runs = [(k, [self.vocabulary[w] for w in ws]) for k, ws in texts]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, run in runs:
            last = 0
            for word in run:
                last = self._append(last, word)
        n = len(self.length)
        order = sorted(range(1, n), key=self.length.__getitem__)
        #: The state of the last `window` words of what a state stands for; the nearest state on the links that is a whole short item.
        self.top, self.short = list(range(n)), [-1] * n
        self.items: dict[int, set[str]] = {}
        whole: dict[int, tuple[int, set[str]]] = {}
        for v in order:
            if self.length[self.link[v]] >= window:
                self.top[v] = self.top[self.link[v]]
        for item, run in runs:
            names = {item} if item is not None else set()
            state = 0
            for k, word in enumerate(run):
                state = self.next[state][word]
                if k + 1 >= window:
                    self.items.setdefault(self._of_length(state, window), set()).update(names)
            if len(run) < window:
                whole.setdefault(self._of_length(state, len(run)), (len(run), set()))[1].update(names)
        self.whole = whole
        for v in order:
            self.short[v] = v if v in whole else self.short[self.link[v]]
        self.least = min([window, *(size for size, _ in whole.values())])
        pairs = {a * len(self.vocabulary) + b for _, run in runs for a, b in zip(run, run[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _of_length(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _append(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, known, word)
        new = self._state({}, -1, self.length[last] + 1)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Starts and ends of the stretches of known words in which all neighbours are some item's, long enough for a window."""
        if not len(self.vocabulary) or not len(ids):
            return []
        known = ids >= 0
        tied = np.zeros(len(ids), bool)  # to the word before
        at = np.flatnonzero(known[1:] & known[:-1]) + 1
        code = ids[at - 1].astype(np.int64) * len(self.vocabulary) + ids[at]
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            tied[at[self.pairs[place] == code]] = True
        starts = np.flatnonzero(known & ~tied)
        ends = np.append(np.flatnonzero(~tied[1:]) + 1, len(ids))
        ends = ends[known[ends - 1]]
        keep = ends - starts >= self.least
        return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs (start, end) of word places, and the items whose windows occur."""
        state = size = 0
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        following, link, length = self.next, self.link, self.length
        for k, word in enumerate(ids):
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            if word not in following[state]:
                state = size = 0
                continue
            state = following[state][word]
            size += 1
            longest = 0
            if size >= self.window:
                longest = self.window
                items |= self.items.get(self.top[state], set())
            v = self.short[state]
            while v > 0:
                need, names = self.whole[v]
                if size >= need:
                    longest = max(longest, need)
                    items |= names
                v = self.short[self.link[v]]
            if longest:
                start = k + 1 - longest
                while hits and hits[-1][1] >= start:
                    start = min(start, hits.pop()[0])
                hits.append((start, k + 1))
        return hits, items


@lru_cache(maxsize=1)
def automaton_of(items: tuple, window: int) -> Automaton:
    """One automaton for all tasks of a Python worker."""
    return Automaton(list(items), window)


def without(text: str, hit: list[tuple[int, int]]) -> str:
    """The text less the bytes from the first to the last word of each hit run."""
    data, spans = text.encode("utf-8"), [(m.start(), m.end()) for m in WORD.finditer(text.encode("utf-8"))]
    out, at = [], 0
    for a, b in hit:
        out.append(data[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8")


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, items: tuple, window: int, clean: bool) -> DataFrame:
    """Adds one pass's hits and items to those of docs (doc_id, text, hit, items)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # of PASS_WORDS words or so

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value, window)
        find = automaton.vocabulary.get
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            before = batch.column("hit").to_pylist()
            names = [set(x or ()) for x in batch.column("items").to_pylist()]
            ids: list[int] = []
            first = []
            for t in texts:
                first.append(len(ids))
                ids += map(find, words_of(t), itertools.repeat(-1))
                ids.append(-1)
            every = np.array(ids, np.int64)
            counts = np.diff([*first, len(ids)]) - 1
            hit: list[list[tuple[int, int]]] = [[tuple(x) for x in h or ()] for h in before]
            for a, b in automaton.stretches(every):
                runs, found = automaton.stream(ids[a:b])
                if runs:
                    row = int(np.searchsorted(first, a, "right")) - 1
                    hit[row] += [(a - first[row] + x, a - first[row] + y) for x, y in runs]
                    names[row] |= found
            hit = [_merge(h) for h in hit]
            if clean:
                texts = [without(t, h) if h else t for t, h in zip(texts, hit, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(hit, pa.list_(pa.list_(pa.int32()))),
                    pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                    pa.array(texts, pa.string()),
                    batch.column("rest"),
                ],
                names=[*OUT.names, "rest"],
            )

    return docs.mapInArrow(run, T.StructType([*OUT.fields, docs.schema["rest"]]))


def unpacked(found: DataFrame, names: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The columns `names` of found, and those in its `rest`; a carried column takes the place of one of the same name."""
    return found.select(*[n for n in names if n not in carry], *[F.col("rest")[c].alias(c) for c in carry])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False, pass_words: int = PASS_WORDS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, hit (runs of word places, from and to), items (ids as sorted strings), text for every row of docs.

    With `clean`, text is returned without the hit runs. Null and empty texts have no words and no hits; a null text
    stays null. Rows with equal ids are each judged by themselves. Items without words match nothing; an item with a
    null id marks words but is not listed; equal ids are listed once. Empty tables give no rows, or rows without hits.
    Further columns are ignored, but those named in `carry` follow the others, or take the place of one of the same name. The benchmark is taken in passes of about `pass_words` words, and what is sent to
    the executors is one pass; between passes the documents are written.
    """
    return unpacked(_passes(docs, benchmark, window, clean, pass_words, carry), OUT.names, carry)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, clean: bool, pass_words: int, carry: Sequence[str]) -> DataFrame:
    sized = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    sized = sized.withColumn("size", F.coalesce(F.length("text"), F.lit(0)) / 2 + 1)
    passes = max(1, math.ceil((sized.agg(F.sum("size")).first()[0] or 0) / (3 * pass_words)))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("array<array<int>>").alias("hit"), F.lit(None).cast("array<string>").alias("items"), rest(carry))
    for k in range(passes):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        items = tuple(sorted(((r.item_id, r.text) for r in part.select("item_id", "text").toLocalIterator()), key=repr))
        if k:
            out = written(out, "decontaminated")
        out = _pass(out.select("doc_id", "text", "hit", "items", "rest"), items, window, clean and k == passes - 1)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text without the hit spans, and `carry`, of the rows of which at most MOST of the words are hit; see find()."""
    found = _passes(docs, benchmark, WINDOW, True, PASS_WORDS, carry).where(n_hit() <= MOST * F.col("n_words"))
    return unpacked(found, ["doc_id", "text"], carry)


def n_hit() -> F.Column:
    return F.aggregate("hit", F.lit(0).cast("long"), lambda n, x: n + (x[1] - x[0]).cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs; see find()."""
    found = find(docs, benchmark, window).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
j AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM i WHERE len(w) > 0),
k AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM j),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM k),
s AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN s WHERE len(w) >= n),
q AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM p),
m AS (SELECT q.doc_id, q.n, q.k, g.item_id FROM q JOIN g ON q.n = g.n AND q.g = g.g),
x AS (SELECT DISTINCT doc_id, k, n FROM m),
y AS (SELECT doc_id, unnest(range(k, k + n)) AS k FROM x),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM y GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
