"""Windows that stand more than once in a corpus, by routing their runs to small indexes.

0. Texts are dealt to blocks of bounded size by a hash of id and text. Of equal texts only those of the least id go
   through the steps below; the others are copies as a whole.
1. Each block cuts its texts into runs (see anchors) and sends its distinct anchors with their counts, sorted and delta
   coded, one row for each range of anchors. A range adds the counts up and tells each block which of its anchors are
   found more than once in all, and which very often.
2. Runs of the others are done. A block merges its equal runs and sends each to a shard by its anchor; runs of very
   frequent anchors part into windows, which go to shards by their own hash. So equal windows are in one shard, and an
   index of the shard's fragments says which windows of a fragment stand earlier.
3. What was found goes back to the blocks.

Nothing is sent for each document, so no row of a shuffle depends on how often a block has a run, and no hot anchor,
id or passage gathers more rows than there are blocks. Texts are shuffled once: all steps over blocks read the same
shuffle. An index holds a bounded number of symbols: a shard's fragments come sorted by route, and an index ends
between two routes.

Fragments of different blocks are merged if their bytes are equal. Inside a block they are if their 64-bit hashes are,
which two different ones of n are with odds of n * n to 2**65 (n: some 10**5).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.anchors import GRAM_BITS, Texts, anchor_runs, spans_hash
from wordloom.llm.common import rest, slices, written

#: The least id, for null. Copies' rows are joined in so many parts. Bytes of text in a block: at least, at most; the blocks to aim at between the two.
NULL_ID, SALTS, BLOCK_BYTES, BLOCKS = -(1 << 63), 16, (8 << 20, 64 << 20), 4096
#: Bytes of text that are made into arrays at once. Anchors of a range, about, and bytes of text that have one run, about.
UNIT_BYTES, RANGE_ANCHORS, RUN_BYTES = 1 << 18, 500_000, 32
#: Bits by which keys of anchors exceed what tells all runs apart: one run in 2**SPARE_BITS looks repeated by chance.
SPARE_BITS = 8

COPY, ANCHORS, FOUND = 0, 1, 2
SIDE = "block int, kind int, key long, did long, place long, data binary, more binary"


@dataclass(frozen=True)
class Limits:
    """Runs of an anchor from which on its windows are routed one by one; bytes of one index."""

    split: int = 4096
    index_bytes: int = 2 << 20


@dataclass(frozen=True)
class Kind:
    """How texts become symbols, and what counts as earlier."""

    size: int
    gram: int
    #: Texts to: byte starts and ends of the symbols (None where each byte is one) and bounds of the texts among them.
    places: Callable
    #: (Texts, starts, ends) to: prefix sums of the symbols' hash, their base, and the hash of each gram.
    hashes: Callable
    #: Fragments, their ids and numbers of windows, in order of first occurrence, to whether each window stands earlier.
    search: Callable
    #: Whether an earlier place in the same document counts.
    within: bool


def _array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers below 2**63 as differences, seven bits to a byte, the last byte of each below 128."""
    delta = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    sizes = np.ones(len(delta), np.int64)
    for k in range(1, 9):
        sizes += delta >= np.uint64(1) << np.uint64(7 * k)
    out = np.zeros(int(sizes.sum()), np.uint8)
    at = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        out[at[some] + k] = (delta[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | ((sizes[some] > k + 1) << 7).astype(np.uint8)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), starts), dtype=np.uint64)


def units(kind: Kind, column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The texts of a column, about UNIT_BYTES at once: texts, their rows, and the place of their first symbol.

    A longer text comes in parts that overlap by all symbols of a window but one, so each window is in one part.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    start = total = 0
    for row, size in enumerate([*sizes.tolist(), None]):
        if row > start and (size is None or total + size > UNIT_BYTES):
            yield column.slice(start, row - start), np.arange(start, row), np.zeros(row - start, np.int64)
            start, total = row, 0
        if size is not None and size > UNIT_BYTES:
            texts = Texts(column.slice(row, 1))
            starts, ends, bounds = kind.places(texts)
            n = int(bounds[-1])
            step = UNIT_BYTES if starts is None else UNIT_BYTES // 8
            for a in range(0, max(1, n - kind.size + 1), step):
                b = min(n, a + step + kind.size - 1)
                if b > a:
                    low, high = (a, b) if starts is None else (int(starts[a]), int(ends[b - 1]))
                    yield pa.array([texts.data[low:high].tobytes()], pa.binary()), np.array([row]), np.array([a])
            start = row + 1
        elif size is not None:
            total += size


class Known:
    """What a block has been told: its copies, repeated and frequent anchors, and marks that were found."""

    def __init__(self, side: pa.Table, shift: int):
        kind = _array(side.column("kind"))
        pick = lambda k: side.filter(pa.array(kind == k))
        copies, anchors, found = pick(COPY), pick(ANCHORS).sort_by("key"), pick(FOUND).sort_by("key")
        self.shift = shift
        self.copies = set(zip(copies.column("did").to_pylist(), copies.column("data").to_pylist(), strict=True))
        self.repeated, self.frequent = (np.concatenate([np.zeros(0, np.uint64), *map(unpacked, anchors.column(c).to_pylist())]) for c in ("data", "more"))
        self.marks, self.did, self.place = (_array(found.column(c)) for c in ("key", "did", "place"))
        self.earlier = found.column("data").combine_chunks()
        self.partly = _array(found.column("data").is_valid())

    def is_copy(self, rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        if not self.copies:
            return np.zeros(rows.num_rows, bool)
        return np.fromiter((x in self.copies for x in zip(rows.column("did").to_pylist(), rows.column("digest").to_pylist(), strict=True)), bool, rows.num_rows)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def pieces(kind: Kind, known: Known, column: pa.Array) -> Iterator[dict]:
    """The fragments of texts that no copy holds: row, place and windows of each, its hash, route, and bytes from and to in `data`."""
    for texts, rows, base in units(kind, column):
        texts = Texts(texts)
        starts, ends, bounds = kind.places(texts)
        sums, radix, grams = kind.hashes(texts, starts, ends)
        anchor, at, n = anchor_runs(grams, bounds, kind.size, kind.gram)
        key = anchor >> np.uint64(known.shift)
        some = _in(key, known.repeated)
        anchor, at, n, key = anchor[some], at[some], n[some], key[some]
        often = _in(key, known.frequent)
        parts = np.where(often, n, 1)
        at = np.repeat(at, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        anchor, often, n = np.repeat(anchor, parts), np.repeat(often, parts), np.repeat(np.where(often, 1, n), parts)
        last = at + n + kind.size - 1
        mark = spans_hash(sums, at, last, radix)
        row = np.searchsorted(bounds, at, "right") - 1
        low, high = (at, last) if starts is None else (starts[at], ends[last - 1])
        yield {"row": rows[row], "place": base[row] + at - bounds[row], "n": n, "mark": mark.view(np.int64), "route": np.where(often, mark, anchor).view(np.int64), "low": low, "high": high, "data": texts.data}


def _block(rows: pa.Table) -> int:
    return rows.column("block")[0].as_py()


def _own(rows: pa.Table, known: Known) -> pa.Table:
    """The rows that are no copies."""
    return rows.filter(pa.array(~known.is_copy(rows))).combine_chunks()


def _text(rows: pa.Table) -> pa.Array:
    column = rows.column("text").combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays([column.chunk(k) for k in range(column.num_chunks)] or [pa.array([], pa.string())])


def send_anchors(kind: Kind, shift: int, bits: int, ranges: int) -> Callable:
    """A block's distinct keys of anchors, a row for each range: packed keys, and where several runs have one, packed places among them and how many."""

    def make(rows: pa.Table, side: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for texts, _, _ in units(kind, _text(_own(rows, Known(side, shift)))):
            texts = Texts(texts)
            starts, ends, bounds = kind.places(texts)
            anchor, at, _ = anchor_runs(kind.hashes(texts, starts, ends)[2], bounds, kind.size, kind.gram)
            key = anchor >> np.uint64(shift)
            if not kind.within:  # a document counts once
                row = np.searchsorted(bounds, at, "right")
                order = np.lexsort((row, key))
                key, row = key[order], row[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key = key[new]
            found = np.unique(key, return_counts=True)
            keys.append(found[0])
            counts.append(found[1])
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)
        cuts = np.searchsorted(every, np.array([-(-(k << bits) // ranges) for k in range(ranges + 1)], np.uint64))
        out = []
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                many = np.flatnonzero(total[a:b] > 1)
                out.append((k, _block(rows), packed(every[a:b]), packed(many), total[a:b][many].astype("<i8").tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["range", "block", "keys", "many", "counts"])

    return make


def count_anchors(split: int) -> Callable:
    """Of a range: to each block, its keys that have two runs or more in all, and those that have `split` or more."""

    def make(rows: pa.Table) -> pa.Table:
        each = [unpacked(x) for x in rows.column("keys").to_pylist()]
        sizes = np.array([len(x) for x in each])
        keys, counts = np.concatenate(each), np.ones(sizes.sum(), np.int64)
        for at, many, n in zip((np.cumsum(sizes) - sizes).tolist(), rows.column("many").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            counts[at + unpacked(many).astype(np.int64)] = np.frombuffer(n, "<i8")
        _, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, counts)[place]
        blocks, number, out = rows.column("block").to_pylist(), rows.column("range")[0].as_py(), []
        for block, a, b in zip(blocks, (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), strict=True):
            repeated = keys[a:b][total[a:b] > 1]
            if len(repeated):
                out.append((block, ANCHORS, number, None, None, packed(repeated), packed(keys[a:b][total[a:b] >= split])))
        return _side(out)

    return make


def _side(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SIDE.split(", ")])


FRAGMENTS = "route long, mark long, block int, did long, place long, n int, many boolean, fragment binary"


def send_fragments(kind: Kind, shift: int) -> Callable:
    """A block's distinct fragments: where the first of each stands, and whether others follow in the block."""

    def make(rows: pa.Table, side: pa.Table) -> pa.Table:
        known = Known(side, shift)
        own = _own(rows, known)
        dids = _array(own.column("did"))
        parts: dict[str, list] = {c: [] for c in ("route", "mark", "did", "place", "n")}
        fragments: list[bytes] = []
        for p in pieces(kind, known, _text(own)):
            data = p["data"].tobytes()
            fragments += [data[a:b] for a, b in zip(p["low"].tolist(), p["high"].tolist(), strict=True)]
            for c, column in parts.items():
                column.append(dids[p["row"]] if c == "did" else p[c])
        route, mark, did, place, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in parts.values())
        order = np.lexsort((place, did, mark, route))
        route, mark = route[order], mark[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (route[1:] != route[:-1]) | (mark[1:] != mark[:-1])
        first = np.flatnonzero(new[:-1])
        many = ~new[1:][first]
        order = order[first]
        columns = [pa.array(route[first]), pa.array(mark[first]), pa.array(np.full(len(first), _block(rows), np.int32)), pa.array(did[order]), pa.array(place[order]), pa.array(n[order].astype(np.int32)), pa.array(many)]
        return pa.table([*columns, pa.array([fragments[k] for k in order.tolist()], pa.binary())], names=[f.split()[0] for f in FRAGMENTS.split(", ")])

    return make


def search(fragments: DataFrame, kind: Kind, index_bytes: int) -> DataFrame:
    """To each block, for its fragments that stand elsewhere too or have windows that do: where the first one stands, and as bits which of its windows stand earlier (null: none)."""

    def index(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        new = np.ones(rows.num_rows, bool)
        same = np.ones(rows.num_rows - 1, bool)
        for c in ("route", "mark"):
            same &= _array(rows.column(c))[1:] == _array(rows.column(c))[:-1]
        near = np.flatnonzero(same)  # equal hashes are not enough
        if len(near):
            data = rows.column("fragment").combine_chunks()
            new[near + 1] = ~_array(pc.equal(data.take(pa.array(near + 1)), data.take(pa.array(near))))
        of = np.cumsum(new) - 1
        firsts = rows.filter(pa.array(new))
        did, place, n = (_array(firsts.column(c)) for c in ("did", "place", "n"))
        order = np.lexsort((place, did))
        bits = np.zeros((len(n), 8 * -(-int(n.max()) // 8)), bool)
        listed = bits[order]
        listed[np.arange(bits.shape[1]) < n[order][:, None]] = kind.search(firsts.column("fragment").combine_chunks().take(pa.array(order)), did[order], n[order].astype(np.int64))
        bits[order] = listed
        some = bits.any(1)
        tell = some[of] | _array(rows.column("many")) | (np.bincount(of)[of] > 1)
        at = of[tell]
        data = np.packbits(bits, axis=1)
        wide = data.shape[1]
        earlier = pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(at), [None, pa.py_buffer(data[at].tobytes())]).cast(pa.binary())
        earlier = pc.if_else(pa.array(some[at]), earlier, pa.scalar(None, pa.binary()))
        told = rows.filter(pa.array(tell))
        block = told.column("block").combine_chunks()
        columns = [block, pa.array(np.full(len(at), FOUND, np.int32)), told.column("mark").combine_chunks(), pa.array(did[at]), pa.array(place[at]), earlier, pa.nulls(len(at), pa.binary())]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[f.split()[0] for f in SIDE.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, route, mark = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            routes, marks = _array(batch.column("route")), _array(batch.column("mark"))
            new = np.ones(len(marks), bool)  # equal fragments count once
            new[1:] = marks[1:] != marks[:-1]
            new[0] = marks[0] != mark
            sizes = np.cumsum(np.where(new, _array(pc.binary_length(batch.column("fragment"))).astype(np.int64), 0))
            start = base = 0
            for cut in [*([0] if routes[0] != route else []), *(np.flatnonzero(routes[1:] != routes[:-1]) + 1).tolist()]:
                here = int(sizes[cut - 1]) if cut else 0
                if size + here - base >= index_bytes:
                    if cut > start:
                        held.append(batch.slice(start, cut - start))
                    yield index(pa.Table.from_batches(held))
                    held, size, start, base = [], 0, cut, here
            held.append(batch.slice(start))
            size += int(sizes[-1]) - base
            route, mark = routes[-1], marks[-1]
        if held:
            yield index(pa.Table.from_batches(held))

    return fragments.repartition("route").sortWithinPartitions("route", "mark", "did", "place").mapInArrow(run, SIDE)


def covered(kind: Kind, known: Known, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Which symbols of the batch's texts go; bounds of the texts among the symbols; byte starts of the symbols."""
    starts, _, bounds = kind.places(Texts(batch.column("text")))
    total = int(bounds[-1])
    change = np.zeros(total + 1, np.int32)
    copy = known.is_copy(batch)
    dids = _array(batch.column("did"))
    own = np.flatnonzero(~copy)
    single = np.zeros(total, bool)  # windows that go though their fragment is the first of its kind
    for p in pieces(kind, known, batch.column("text").take(pa.array(own))) if len(known.marks) else ():
        row = own[p["row"]]
        at = np.minimum(np.searchsorted(known.marks, p["mark"]), len(known.marks) - 1)
        there = known.marks[at] == p["mark"]
        row, place, n, at = row[there], p["place"][there], p["n"][there], at[there]
        first = bounds[row] + place
        same = dids[row] == known.did[at]
        if kind.within:
            same &= place == known.place[at]
        np.add.at(change, first[~same], 1)
        np.add.at(change, first[~same] + n[~same], -1)
        part = np.flatnonzero(same & known.partly[at])
        if len(part):
            bits = known.earlier.take(pa.array(at[part])).to_pylist()
            wide = max(map(len, bits))
            window = np.unpackbits(np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in bits), np.uint8).reshape(-1, wide), axis=1)
            which, k = np.nonzero(window)
            single[first[part][which] + k] = True
    window = np.flatnonzero((np.cumsum(change[:-1]) > 0) | single)
    change[:] = 0
    np.add.at(change, window, 1)
    np.add.at(change, window + kind.size, -1)
    whole = np.flatnonzero(copy & (np.diff(bounds) >= kind.size))
    np.add.at(change, bounds[whole], 1)
    np.add.at(change, bounds[whole + 1], -1)
    return np.cumsum(change[:-1]) > 0, bounds, starts


def judged(docs: DataFrame, kind: Kind, make: Callable, schema: T.StructType, carry: Sequence[str] = (), limits: Limits = Limits()) -> DataFrame:
    """What make(batch, gone, bounds, starts) gives for all rows of docs (doc_id, text): arrays in the schema's order, then a struct `rest` of the columns `carry`.

    Rows with one id are one document: none of them is earlier for another, and at one place in them the same fragment
    is the same one. Null ids are one id, less than all others.
    """
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), did, F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text", rest(carry))
    sizes = written(texts.where("text IS NOT NULL").select("did", "digest", F.octet_length("text").cast("long").alias("size")), "digests")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    tasks = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // UNIT_BYTES))  # small tables keep all tasks busy
    blocks = max(1, tasks, -(-total // min(BLOCK_BYTES[1], max(BLOCK_BYTES[0], total // BLOCKS))))
    runs = total // RUN_BYTES + 1
    ranges, bits = -(-runs // RANGE_ANCHORS), min(GRAM_BITS, runs.bit_length() + SPARE_BITS)
    shift = GRAM_BITS - bits
    block = F.pmod(F.xxhash64("did", "digest"), F.lit(blocks)).cast("int").alias("block")

    groups = sizes.groupBy("digest").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last")
    groups = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = sizes.withColumn("salt", F.pmod(F.xxhash64("did"), F.lit(SALTS)).cast("int")).join(groups, ["digest", "salt"]).where("did > first")
    nothing = F.lit(None)
    copies = written(copies.select(block, F.lit(COPY).alias("kind"), nothing.cast("long").alias("key"), "did", nothing.cast("long").alias("place"), F.col("digest").alias("data"), nothing.cast("binary").alias("more")), "copies")

    texts = texts.select("*", block)
    on_blocks = lambda side, make, schema: texts.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(make, schema)
    sent = on_blocks(copies, send_anchors(kind, shift, bits, ranges), "range int, block int, keys binary, many binary, counts binary")
    told = copies.unionAll(sent.groupBy("range").applyInArrow(count_anchors(limits.split), SIDE))
    found = search(on_blocks(told, send_fragments(kind, shift), FRAGMENTS), kind, limits.index_bytes)

    def finish(rows: pa.Table, side: pa.Table) -> pa.Table:
        known = Known(side, shift)
        parts = []
        for batch in slices(rows.to_batches(), "text"):
            arrays = make(batch, *covered(kind, known, batch))
            parts.append(pa.RecordBatch.from_arrays([*arrays, batch.column("rest")], names=[*schema.names, "rest"]))
        return pa.Table.from_batches(parts)

    return on_blocks(told.unionAll(found), finish, T.StructType([*schema.fields, texts.schema["rest"]]))
