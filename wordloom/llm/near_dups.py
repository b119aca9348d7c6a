"""Near-duplicate documents by SetSketch registers, with every link confirmed on the full shingle sets.

A document's sketch has REGISTERS numbers, each the exponentially spaced and truncated minimum of one hash over its
shingles; the sketch of a union is the greater number of each. Documents that share a band of registers are candidates.
Of each candidate pair, which registers are greater on which side and which are equal gives, with the two set sizes,
the likelihood of every similarity; pairs that are too unlikely to reach the threshold go, and the rest is compared
shingle by shingle.

Equal sets are one class from the start. In a bucket every class is first compared with the bucket's least one. What
that links is one component; then only classes of different components that share a bucket are compared, in blocks
of registers; texts follow for those in likely pairs. A block reports as many links as join its components, not every pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.anchors import BYTE_BASE, WORD_BASE, Texts, grams, mixed, prefix_sums, spans_hash
from wordloom.llm.common import slices, written

#: Words of a shingle; least intersection of 100 parts of the union, unless a caller asks for another.
SHINGLE, PERCENT = 5, 80
#: Registers, those of a band, and the sketch's base and rate; at most LIMIT + 1.
REGISTERS, BAND, BASE, RATE, LIMIT = 96, 4, 1.001, 20.0, (1 << 16) - 2
#: Log-likelihood by which a similarity at the threshold may stay behind the likeliest; members of a bucket in a block (two blocks meet);
#: pairs from which on a block counts common shingles by products of matrices, and columns of those.
MARGIN, BLOCK, MANY, COLUMNS = 16.0, 128, 64, 8192
#: Shingles in a block, about, whatever its members; a text has some six bytes for each.
BLOCK_SHINGLES = 1 << 20

SKETCH = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("registers", T.BinaryType()), T.StructField("text_digest", T.BinaryType())]
)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of five words each, or of all words if there are fewer."""
    texts = Texts(column, lower=True)
    starts, ends, bounds = texts.words()
    words = spans_hash(prefix_sums(texts.data.astype(np.uint64) + np.uint64(1), BYTE_BASE), starts, ends, BYTE_BASE)
    sums = prefix_sums(words, WORD_BASE)
    every = grams(sums, SHINGLE, WORD_BASE)
    few = spans_hash(sums, bounds[:-1], bounds[1:], WORD_BASE)
    return [np.unique(every[a : b - SHINGLE + 1]) if b - a >= SHINGLE else few[k : k + (b > a)] for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]


@lru_cache(maxsize=1)
def multipliers() -> np.ndarray:
    return mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(WORD_BASE)) | np.uint64(1)


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set that is not empty."""
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    least = np.empty((len(sets), REGISTERS), np.uint64)
    y = np.empty_like(x)
    for k, factor in enumerate(multipliers()):
        np.multiply(x, factor, out=y)
        y ^= y >> np.uint64(32)
        y *= factor
        least[:, k] = np.minimum.reduceat(y, starts)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def text_digest() -> F.Column:
    """Tells rows of one id apart; that of null is its own."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")).cast("binary")))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set and registers (without shingles both are null) and digest of the text of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            some = [k for k, s in enumerate(sets) if len(s)]
            digests, registers = [None] * len(sets), [None] * len(sets)
            if some:
                for k, r in zip(some, registers_of([sets[k] for k in some]), strict=True):
                    digests[k], registers[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), r.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary()), batch.column("text_digest")], names=SKETCH.names)

    return docs.select("doc_id", "text", text_digest().alias("text_digest")).mapInArrow(run, SKETCH)


def as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(registers).view(f"<u{2 * BAND}")
    return mixed(packed + np.arange(packed.shape[1], dtype=np.uint64) * np.uint64(BYTE_BASE))


def bands(nodes: DataFrame) -> DataFrame:
    """key, node and n_shingles: a row for each band of each node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(as_registers(batch.column("registers")))
                node, n = (np.repeat(batch.column(c).to_numpy(), keys.shape[1]) for c in ("node", "n_shingles"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node), pa.array(n)], names=["key", "node", "n_shingles"])

    return nodes.select("node", "n_shingles", "registers").mapInArrow(run, "key long, node long, n_shingles long")


def may_reach(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may be as similar as asked: by their sizes, and by the joint likelihood of their registers.

    more, less: how many registers are greater in a, and in b.
    """
    least = percent / 100
    ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    equal = REGISTERS - more - less
    best, best_above = np.full(len(u), -np.inf), np.full(len(u), -np.inf)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    for step in range(81):
        j = np.minimum(step / 80, most)
        p, q = np.clip(chance(u - v * j), 1e-12, 1), np.clip(chance(v - u * j), 1e-12, 1)
        value = more * np.log(p) + less * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-12, 1))
        best = np.maximum(best, value)
        best_above = np.where(j >= least, np.maximum(best_above, value), best_above)
    return ok & (best_above >= best - MARGIN)


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = as_registers(batch.column("r_a")), as_registers(batch.column("r_b"))
                keep = may_reach(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), (x > y).sum(1), (x < y).sum(1), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar as asked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "t_a"):
                left, right = shingle_sets(batch.column("t_a")), []
                for part in slices([batch], "t_b"):
                    right += shingle_sets(part.column("t_b"))
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
                total = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64)
                yield batch.select(["a", "b"]).filter(pa.array(100 * common >= percent * (total - common)))

    side = lambda k: docs.select(F.col("doc_id").alias(k), F.col("text").alias(f"t_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node that can be reached, for the nodes of links (a, b). Labels spread and are looked up in themselves."""
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        step = written(step.join(jump, "label").select("node", "old", F.least("label", "beyond").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("old != label").isEmpty():
            return labels


def common_shingles(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The size of the intersection of sets a[k] and b[k]."""
    if len(a) < MANY:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[low:high], column[low:high] - start] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


def joining(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> list[int]:
    """Which of the links a[k], b[k] join components that no earlier one has joined; equal labels are joined already."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        if (x := root(x)) != (y := root(y)):
            up[max(x, y)] = min(x, y)
            out.append(k)
    return out


def likely_in_block(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block's rows that are of different components, meet in this bucket first, and may reach the threshold."""
    node, label, block, n = (group.column(x).to_numpy() for x in ("node", "label", "i", "n_shingles"))
    registers = as_registers(group.column("registers"))
    keys = band_keys(registers).view(np.int64)
    a, b = np.nonzero((label[:, None] != label[None, :]) & (node[:, None] < node[None, :]))
    if group.column("low")[0].as_py() != group.column("high")[0].as_py():
        a, b = a[block[a] != block[b]], b[block[a] != block[b]]
    if len(a):  # pairs count in their first bucket only
        same = np.zeros(len(a), np.int64)
        for k in range(keys.shape[1] - 1, -1, -1):
            same[keys[a, k] == keys[b, k]] = k
        first = keys[a, same] == group.column("key")[0].as_py()
        a, b = a[first], b[first]
    if len(a):
        more, less = (np.concatenate([f(registers[a[k : k + 4096]], registers[b[k : k + 4096]]).sum(1) for k in range(0, len(a), 4096)]) for f in (np.greater, np.less))
        keep = may_reach(n[a], n[b], more, less, percent)
        a, b = a[keep], b[keep]
    return a, b


def by_block(rows: DataFrame, compare: Callable[[pa.Table], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """What compare() gives for the rows of each block (key, low, high), in order of node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            place = np.stack([batch.column(x).to_numpy() for x in ("key", "low", "high")], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and at != tuple(place[a]):
                        yield compare(pa.Table.from_batches(held).combine_chunks())
                        held = []
                    at = tuple(place[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node").mapInArrow(run, schema)


def across(members: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of different components that share a bucket (key, node; n and weight: its members and their shingles), as many as join those that are linked.

    Registers go through the blocks first; texts are fetched only for the rows of a block that are in some likely pair there.
    """
    known = members.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_keys = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    rows = known.join(mixed_keys, "key").join(nodes, "node").withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "node", "label", "n_shingles", "registers")

    def in_pairs(group: pa.Table) -> pa.RecordBatch:
        found = np.unique(np.concatenate(likely_in_block(group, percent)))
        return group.take(pa.array(found, pa.int64())).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if len(found) else group.slice(0, 1).to_batches()[0].slice(0, 0)

    def compare(group: pa.Table) -> pa.RecordBatch:
        node, label = group.column("node").to_numpy(), group.column("label").to_numpy()
        a, b = likely_in_block(group, percent)
        if len(a):
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            sets = shingle_sets(group.column("text").combine_chunks().take(pa.array(used)))
            common = common_shingles(sets, place[: len(a)], place[len(a) :])
            sizes = np.array([len(x) for x in sets])
            linked = 100 * common >= percent * (sizes[place[: len(a)]] + sizes[place[len(a) :]] - common)
            a, b = a[linked], b[linked]
            some = joining(a, b, label)
            a, b = a[some], b[some]
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    wanted = written(by_block(rows, in_pairs, rows.schema), "in-pairs")
    texts = wanted.join(docs.select(F.col("doc_id").alias("node"), "text"), "node").select(*rows.columns, "text")
    return by_block(texts, compare, "a long, b long").distinct()


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """What near_duplicates() says, and text_digest(), of every row."""
    docs = docs.select("doc_id", "text")
    sketches = written(sketch(docs), "sketches")
    named = sketches.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("c")).select("digest", F.col("c.doc_id").alias("node"), "c.n_shingles", "c.registers")
    classes = written(classes, "classes")
    nodes = classes.select("node", "n_shingles", "registers")
    rows = bands(nodes)
    buckets = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).where("n > 1")
    members = written(rows.select("key", "node").join(buckets, "key"), "members")
    pairs = members.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = written(confirmed(written(likely(pairs, nodes, percent), "likely"), docs, percent), "hubs")
    labels = components(links)
    more = written(across(members.select("key", "node", "n", "weight"), nodes, labels, docs, percent), "across")
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    classed = sketches.join(classes.select("digest", "node"), "digest", "left")
    out = classed.join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_digest")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id linked with it over any number of links) and kept, for every row of docs.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. A null, empty or white text has no
    shingles, is linked with nothing and kept. Rows with equal ids are each judged by their text; what one is linked with, it is linked with under that id. A row with a
    null id is linked with nothing; its component is null, and it is kept. An empty table gives no rows; further
    columns are ignored. Texts are taken whole.
    """
    return _judged(docs, percent).drop("text_digest")


def without_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns. Rows of one id are each judged by their text."""
    gone = _judged(docs, percent).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_digest").alias("_digest")).distinct()
    return docs.alias("d").join(gone.alias("g"), (F.col("d.doc_id") == F.col("g._id")) & (text_digest() == F.col("g._digest")), "left_anti")


def sql(percent: int = PERCENT) -> str:
    """The rows of near_duplicates() over the table documents, from all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
s AS (SELECT DISTINCT doc_id, g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= {percent} * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a AS doc_id, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON c.doc_id = e.a),
m AS (SELECT doc_id, min(r) AS r FROM c GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(r, d.doc_id) AS component_id, coalesce(r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
