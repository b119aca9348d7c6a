"""Ranked lexical search, score at a time over impact-ordered postings.

One pass over the documents keeps for each its length and how often it holds each term of the queries; that table is
what the statistics and the search read. The search deals it into shards of a bounded number of postings. In a shard a
term's postings lie in descending order of impact, those of one impact together. A query takes the groups of all its
terms from the highest impact down and adds them to its documents' scores. What lies ahead bounds what a document can
still gain; as soon as that is less than the k-th best score, no document without a score can enter, and only those
that can still reach that score are completed from their own terms. Each shard's best meet in one ranking.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import slices, written
from wordloom.llm.decontaminate import words_of

#: Documents reported for a query; terms of queries in one pass over the documents; postings of a shard.
TOP, PASS_TERMS, SHARD_POSTINGS = 10, 200_000, 2_000_000

#: Fixed values of the score: what a term's weight and a document's share are counted in, and how much length and repetition weigh.
WEIGHT, SHARE, SATURATION, LENGTH, LEVEL = 1000, 1_000_000_000, 8, 90, 100


@dataclass(frozen=True)
class Query:
    """A row of the queries: its id and the numbers of its terms, each once."""

    item: object
    terms: tuple[int, ...]


def impacts(weight: np.ndarray, count: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of `weight`, standing `count` times in a document of `length` terms, adds to its score. All are 64-bit integers."""
    level = LEVEL - LENGTH + (LENGTH * length * n_docs) // n_terms
    return weight * ((SHARE * count) // (WEIGHT * count + SATURATION * level))


class Shard:
    """Postings of some documents, by document and, impact-ordered, by term."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.bounds, self.terms, self.impact = ids, bounds, terms, impact
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(bounds))
        order = np.lexsort((docs, -impact, terms))
        self.docs, self.below = docs[order], -impact[order]  # ascending below zero
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def best(self, wanted: Sequence[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that can be among the k best, all of `floor` or more; scores of 0 are left out."""
        lists = [(int(self.first[t]), int(self.first[t + 1])) for t in wanted]
        at, end = [a for a, b in lists if a < b], [b for a, b in lists if a < b]
        scores = np.zeros(len(self.ids), np.int64)
        ahead = [-int(self.below[a]) for a in at]  # the impact that each list goes on with
        least = max(floor, 1)
        while sum(ahead) >= least:
            level = max(ahead) // 2  # groups above this come next
            for n, impact in enumerate(ahead):
                if impact > level:
                    to = at[n] + int(np.searchsorted(self.below[at[n] : end[n]], -level, "left"))
                    scores[self.docs[at[n] : to]] -= self.below[at[n] : to]  # a document once in each list
                    at[n], ahead[n] = to, -int(self.below[to]) if to < end[n] else 0
            if len(scores) >= k:
                least = max(floor, 1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        open_ = np.flatnonzero(scores + sum(ahead) >= least)
        if any(ahead):
            mine = np.zeros(len(self.first) - 1, bool)
            mine[list(wanted)] = True
            sizes = self.bounds[open_ + 1] - self.bounds[open_]
            places = np.repeat(self.bounds[open_] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            sums = np.zeros(len(places) + 1, np.int64)
            np.cumsum(np.where(mine[self.terms[places]], self.impact[places], 0), out=sums[1:])
            ends = np.cumsum(sizes)
            whole = sums[ends] - sums[ends - sizes]
        else:
            whole = scores[open_]
        keep = whole >= max(floor, 1)
        return open_[keep], whole[keep]


def counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, length, terms (numbers of the vocabulary) and counts of every row of docs that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of PASS_TERMS terms at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in slices(batches, "text"):
            ids, lengths, terms, found = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    held = Counter(map(number, words))
                    held.pop(None, None)
                    ids.append(doc_id)
                    lengths.append(len(words))
                    terms.append(list(held))
                    found.append(list(held.values()))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, kind), pa.array(found, kind)], names=["doc_id", "length", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, length long, terms array<int>, counts array<int>")


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """How many rows of counts() hold each term: added up inside tasks, then by term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in counted.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        kept.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= most:
            yield pa.Table.from_batches(kept)
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def found(counted: DataFrame, queries: Sequence[Query], weights: np.ndarray, n_docs: int, n_all: int, k: int, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """query (its number), doc_id and score of each shard's k best documents of every query."""
    shared = counted.sparkSession.sparkContext.broadcast((queries, weights))  # of one pass

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        floors = [0] * len(queries)  # the k-th best score that one of this task's shards had
        for some in _shards(batches, shard_postings):
            rows = some.combine_chunks()
            ids, lists = rows.column("doc_id").combine_chunks(), rows.column("terms").combine_chunks()
            terms, count = np.asarray(lists.flatten()).astype(np.int64), np.asarray(rows.column("counts").combine_chunks().flatten()).astype(np.int64)
            bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
            length = np.repeat(np.asarray(rows.column("length")), np.diff(bounds))
            keys = np.asarray(ids.fill_null(np.iinfo(np.int64).max))
            shard = Shard(keys, bounds, terms, impacts(weights[terms], count, length, n_docs, n_all), len(weights))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for q, query in enumerate(queries):
                at, score = shard.best(query.terms, k, floors[q])
                order = np.lexsort((keys[at], -score))[:k]
                if len(order) == k:
                    floors[q] = max(floors[q], int(score[order[-1]]))
                out.append((np.full(len(order), q, np.int32), at[order], score[order]))
            if out:
                q, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q), ids.take(pa.array(at)), pa.array(score)], names=["query", "doc_id", "score"])

    return counted.mapInArrow(run, "query int, doc_id long, score long")


def _pass(docs: DataFrame, items: list[tuple[object, str | None]], item_type: str, k: int, shard_postings: int) -> DataFrame:
    words = [sorted(set(words_of(text))) for _, text in items]
    vocabulary = {w: n for n, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(words)))}
    queries = [Query(item, tuple(vocabulary[w] for w in some)) for (item, _), some in zip(items, words, strict=True)]
    counted = written(counts(docs, vocabulary), "terms")
    whole = counted.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_all")).first()
    frequency = document_frequencies(counted, len(vocabulary))
    weights = np.array([math.floor(WEIGHT * math.log((2 * whole.n_docs + 2) / (2 * n + 1))) for n in frequency.tolist()], np.int64)
    rows = found(counted, queries, weights, whole.n_docs, whole.n_all, k, shard_postings)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(n, q.item) for n, q in enumerate(queries)], f"query int, item_id {item_type}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # the queries of one pass


def search(docs: DataFrame, items: DataFrame, k: int = TOP, pass_terms: int = PASS_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank (1 the best), doc_id and score of the k documents that score highest for each row of items (item_id, text).

    All documents are ranked and all their terms are counted. Scores of 0 are left out, so an item may have fewer rows
    or none. Equal scores rank by ascending doc_id, null ids last; rows that share a doc_id are each ranked. Items that
    share an id, or are equal, are each answered. Null and empty texts have no terms: such documents are found by
    nothing and do not count, such items have no rows; nor have any where there are no documents. Further columns are
    ignored. The items are taken in passes of about `pass_terms` terms, which bounds what executors are sent, and each
    pass reads the documents once.
    """
    sized = items.select("item_id", "text").withColumn("size", F.coalesce(F.length("text"), F.lit(0)) / 6 + 1)
    passes = max(1, math.ceil((sized.agg(F.sum("size")).first()[0] or 0) / pass_terms))
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for n in range(passes):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        rows = sorted(((r.item_id, r.text) for r in part.toLocalIterator()), key=repr)
        one = _pass(docs, rows, kind, k, shard_postings)
        out = one if out is None else out.unionAll(one)
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents), e AS (SELECT row, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM e), i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT DISTINCT item, item_id, unnest(w) AS term FROM i), v AS (SELECT DISTINCT term FROM q),
t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM e) SEMI JOIN v USING (term) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), w AS (SELECT term, CAST(floor({WEIGHT} * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
p AS (SELECT row, doc_id, term, w * (({SHARE} * tf) // ({WEIGHT} * tf + {SATURATION} * ({LEVEL} - {LENGTH} + ({LENGTH} * n * n_docs) // n_all))) AS impact FROM t JOIN w USING (term), s),
r AS (SELECT item, item_id, row, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(impact) > 0),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r)
SELECT * FROM o WHERE rank <= {TOP}
"""
