"""Phrases whose words stand together more often than their parts would by chance.

Equal pieces of text become one row with a multiplicity, so copies are read once. Runs of one to MOST_WORDS words are
added up inside a task, by slices of bounded size, and go to hash buckets, where duckdb counts them within a memory
limit and spills beyond it. What is frequent then asks for the counts of its parts: requests and counts meet by key in
a shuffle.

No phrase is more frequent than a part of it, which saves most of the counting: words are counted first, then pairs of
frequent words, then longer runs in which all pairs are frequent. Each round tells the next one what was frequent by a
bitmap of bounded size. A bit that two phrases share lets something be counted in vain and changes no count.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.anchors import mixed
from wordloom.llm.common import SLICE_BYTES, slices, written

#: Least count and most words of a phrase; phrases reported for a language; words of a phrase after which it has nothing to report.
LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Where pieces end, and what a text without a language is said to be in.
BREAKS, NO_LANGUAGE = r"[.,;:!?\x0a-\x0d]", "und"
#: Languages that are broadcast with their words; more are joined by a shuffle.
MOST_LANGUAGES = 10_000
#: Bytes of pieces that a task adds up at once; duckdb's memory in a task; bits of the largest bitmap.
PIECE_BYTES, DUCKDB_MEMORY, MOST_BITS = 4 << 20, "256MB", 1 << 29

GRAM = "lang string, phrase string, size int, n long"
PLACE_BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (its words joined by one space) and n, how often it stands in docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 * SLICE_BYTES):
            split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), BREAKS)
            lang = batch.column("lang").take(pc.list_parent_indices(split))
            piece = pc.ascii_trim(pc.replace_substring_regex(pc.list_flatten(split), "[ \t]+", " "), " ")
            found = pa.table({"lang": lang, "piece": piece}).filter(pc.not_equal(piece, ""))
            yield from found.group_by(["lang", "piece"]).aggregate([([], "count_all")]).rename_columns(["lang", "piece", "n"]).to_batches(max_chunksize=10_000)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return rows.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _word_keys(lang: str, words: Iterable[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def run_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A key for the `size` words from each place on, of the words' keys."""
    n = max(0, len(words) - size + 1)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = mixed(key * PLACE_BASE + words[k : n + k])
    return key


class Bitmap:
    """What was frequent, by the low bits of a phrase's key. All bits are set where there is none yet."""

    def __init__(self, bits: np.ndarray | None):
        self.bits, self.mask = bits, np.uint64(0 if bits is None else 8 * len(bits) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(keys), bool)
        at = keys & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _batches_of(rows: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of `most` bytes of pieces or a little more."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for part in slices(rows, "piece", most):
        kept.append(part)
        size += pc.sum(pc.binary_length(part.column("piece"))).as_py() or 0
        if size >= most:
            yield pa.Table.from_batches(kept)
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _runs_of(lang: str, rows: pa.Table, sizes: tuple[int, ...], parts: int, known: Bitmap) -> Iterator[pa.RecordBatch]:
    """The distinct runs of each of the sizes with their weights; all runs of `parts` words inside them are known."""
    split = pc.split_pattern(rows.column("piece").combine_chunks(), " ")
    ends = np.asarray(split.offsets).astype(np.int64)[1:] - int(split.offsets[0].as_py())
    words = pc.list_flatten(split).dictionary_encode()
    ids, weight = np.asarray(words.indices).astype(np.int64), np.repeat(np.asarray(rows.column("n")), np.diff(ends, prepend=0))
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(ids))  # words to the end of the piece
    keys = _word_keys(lang, words.dictionary.to_pylist())[ids]
    good = known.holds(run_keys(keys, parts)) if parts else np.ones(len(ids), bool)
    for size in sizes:
        count = max(0, len(ids) - size + 1)
        fits = left[:count] >= size
        for k in range(size - parts + 1 if parts else 0):
            fits &= good[k : count + k]
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        code = np.zeros(len(at), np.int64)
        for k in range(size):  # codes of runs: the word's id for the first, then numbers of distinct pairs of code and id
            code = code * len(words.dictionary) + ids[at + k]
            if k < size - 1 and k:
                code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, which, weight[at])
        shown = [words.dictionary.take(pa.array(ids[at[first] + k])) for k in range(size)]
        phrase = pc.binary_join_element_wise(*shown, " ") if size > 1 else shown[0]
        out = pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), phrase, pa.array(np.full(len(first), size, np.int32)), pa.array(total)], names=["lang", "phrase", "size", "n"])
        for k in range(0, len(first), 10_000):
            yield out.slice(k, 10_000)


def runs(rows: DataFrame, sizes: tuple[int, ...], parts: int = 0, known: np.ndarray | None = None) -> DataFrame:
    """GRAM rows with the weights that slices of the pieces (lang, piece, n) add up to; a run has a row for each slice at most."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # of MOST_BITS bits at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = Bitmap(shared.value)
        for some in _batches_of(batches, PIECE_BYTES):
            for lang in pc.unique(some.column("lang")).to_pylist():
                yield from _runs_of(lang, some.filter(pc.equal(some.column("lang"), lang)), sizes, parts, bitmap)

    return rows.select("lang", "piece", "n").mapInArrow(run, GRAM)


def counted(grams: DataFrame, least: int = LEAST) -> DataFrame:
    """GRAM rows, and a key, of the runs that weigh `least` or more. Each bucket of runs is counted by duckdb within its memory limit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = iter(batches)
        first = next(rows, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "temp_directory": spill, "threads": 1, "preserve_insertion_order": False}) as con:
            con.register("grams", pa.RecordBatchReader.from_batches(first.schema, (b for some in ((first,), rows) for b in some)))
            found = con.sql(f"SELECT lang, phrase, size, CAST(sum(n) AS BIGINT) AS n FROM grams GROUP BY ALL HAVING sum(n) >= {int(least)}")
            for batch in found.to_arrow_reader(10_000):
                lang, phrase = batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()
                keys = [run_keys(_word_keys(a, w), len(w))[0] for a, w in ((a, p.split(" ")) for a, p in zip(lang, phrase, strict=True))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "phrase", "size", "n")), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["lang", "phrase", "size", "n", "key"])

    return grams.repartition("lang", "phrase").mapInArrow(run, GRAM + ", key long")


def bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits for the keys of frequent phrases: some 16 a phrase, and never more than MOST_BITS."""
    n = frequent.count()
    bits = min(MOST_BITS, 1 << max(15, (16 * n).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    parts = frequent.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        start = (r.bucket - 1) * (1 << 12)
        part = np.frombuffer(r.bits, np.uint8)
        out[start : start + len(part)] = part[: len(out) - start]
    return out


def frequent_phrases(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """GRAM rows and keys of all runs of up to MOST_WORDS words of the pieces `rows`, a written table, that weigh `least` or more."""
    words = written(counted(runs(rows, (1,)), least), "frequent-words")
    pairs = written(counted(runs(rows, (2,), 1, bitmap(words)), least), "frequent-pairs")
    longer = counted(runs(rows, tuple(range(3, MOST_WORDS + 1)), 2, bitmap(pairs)), least)
    return written(words.unionAll(pairs).unionAll(longer), "frequent-phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` phrases by score, then a, both descending, then phrase.

    Phrases are runs of 2 to MOST_WORDS words of one piece that stand `least` times or more (a). Cut after its first
    words, l and r count the two parts; score is floor(1000 * a * n / (l * r)), n counting the language's words, of the
    cut that scores lowest, the first of equals. A phrase inside a longer one that is as frequent goes. If a longer one
    is as frequent, so is all between, so one word more is all that has to be looked at. Products are decimals.

    Null and empty texts have no words. A null language counts as `und`. Rows are counted whatever their ids, so
    repeated rows count repeatedly. Further columns are ignored. Without words, or an empty table, there are no rows.
    """
    return of_pieces(written(pieces(docs), "pieces"), least, top)


def of_pieces(rows: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """What collocations() gives, of the pieces (lang, piece, n) `rows`, a written table."""
    counts = frequent_phrases(rows, least)
    words = F.length("piece") - F.length(F.replace(F.col("piece"), F.lit(" "), F.lit(""))) + 1
    n_words = written(rows.groupBy("lang").agg(F.sum(F.col("n") * words).alias("total")), "languages")
    if n_words.count() <= MOST_LANGUAGES:
        n_words = F.broadcast(n_words)
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    parts = F.split("phrase", " ")
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), parts.alias("w"))

    join = lambda x: F.array_join(x, " ")
    inner = phrases.where("size > 2").select("lang", F.explode(F.array(join(F.slice("w", F.lit(1), F.col("size") - 1)), join(F.slice("w", F.lit(2), F.col("size") - 1)))).alias("phrase"), "a")
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(covered, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")

    cuts = kept.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    asked = cuts.select("lang", "phrase", "a", "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("first"), join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k"))).alias("last"))
    for side, name in (("first", "l"), ("last", "r")):
        asked = asked.join(known.withColumnsRenamed({"part": side, "m": name}), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    asked = asked.join(n_words, "lang").withColumn("score", F.call_function("div", (big("a") * big("total") * F.lit(1000).cast("decimal(4,0)")), big("l") * big("r")))
    lowest = asked.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    out = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH d AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '{BREAKS}')), '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
s AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, range(1, {MOST_WORDS + 1}) s(size) WHERE len(w) >= size),
c AS MATERIALIZED (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= {LEAST}),
x AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE size > 1),
sub AS (SELECT lang, size, f, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM x))),
keep AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = x.lang AND sub.phrase = x.phrase AND 100 * sub.f >= 100 * x.f)),
cut AS (SELECT *, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, size)) AS k FROM keep)),
sc AS (SELECT cut.lang, cut.phrase, cut.f AS a, k, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * cut.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN c l ON l.lang = cut.lang AND l.phrase = p1 JOIN c r ON r.lang = cut.lang AND r.phrase = p2 JOIN t ON t.lang = cut.lang),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM sc) WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one) WHERE rank <= {TOP}
"""
