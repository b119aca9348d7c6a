"""JSON arrays in files of any size, read by all tasks at once.

Spark cuts a file into splits at a separator that any element has: the brace that closes an object, or the comma after
a string. A split alone cannot tell whether it starts inside a string, or how deep. So each is summed up for both
cases; a file's sums, one row a split, then say in turn where each split really starts; and with that each split gives
its elements. An element that crosses splits is put together from their ends. A task holds one element at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.sources.shared import written

TOKEN = re.compile(r'\\.|["\[\]{}]', re.S)
#: Splits whose starts the driver sends to the executors; some 100 bytes each.
MOST_SPLITS = 1_000_000


@dataclass(frozen=True)
class Layout:
    """Where the array is: at the root, or under the key `root` of the object that the file is; and whether it holds strings or objects."""

    root: str | None
    strings: bool

    def __post_init__(self):
        if self.root is not None and self.separator in self.root:
            raise ValueError(f"the key {self.root!r} holds {self.separator!r}, at which files are split")

    @property
    def separator(self) -> str:
        return "," if self.strings else "}"

    @property
    def base(self) -> int:
        """Open brackets around the array."""
        return 0 if self.root is None else 1

    def opens_here(self, before: str) -> bool:
        """Whether a bracket after this text is the array's, if the depth fits."""
        return self.root is None or re.search(re.escape(json.dumps(self.root, ensure_ascii=False)) + r"\s*:\s*\Z", before) is not None


def summed(pieces: Iterable[str], how: Layout) -> dict:
    """What a split does, for a start outside a string (0) and inside one (1): its quotes, the change of depth, the least depth, and arrays by the depth they open at, with whether they close."""
    quotes, depth, low, arrays = 0, [0, 0], [0, 0], ({}, {})
    for piece in pieces:
        text = piece + how.separator
        for m in TOKEN.finditer(text):
            t = m.group()
            if t == '"':
                quotes += 1
            elif t[0] != "\\":
                h = quotes & 1
                if t in "[{":
                    if t == "[" and how.opens_here(text[: m.start()]):
                        arrays[h].setdefault(str(depth[h]), False)
                    depth[h] += 1
                else:
                    depth[h] -= 1
                    low[h] = min(low[h], depth[h])
                    if str(depth[h]) in arrays[h]:
                        arrays[h][str(depth[h])] = True
    return {"quotes": quotes, "depth": depth, "low": low, "arrays": arrays}


@dataclass
class Start:
    """Where a split starts; phase: before, inside or after the array; owner: the split in which the element that is open began."""

    in_string: bool = False
    depth: int = 0
    phase: str = "before"
    owner: int = -1


def starts(sums: Iterable[tuple[int, dict]], how: Layout) -> list[tuple[int, Start]]:
    """The start of each split of a file, of their places and sums in order. An array that is missing or does not end is an error."""
    now, out, level = Start(), [], how.base + 1
    for place, s in sums:
        out.append((place, now))
        h = int(now.in_string)
        within = now.phase == "inside" and (now.depth > level or now.in_string)
        turned = not within or (s["quotes"] > 1 if how.strings else now.depth + s["low"][h] <= level)
        phase = now.phase
        if phase == "before" and (closed := s["arrays"][h].get(str(how.base - now.depth))) is not None:
            phase = "after" if closed else "inside"
        elif phase == "inside" and now.depth + s["low"][h] <= how.base:
            phase = "after"
        now = Start(now.in_string ^ bool(s["quotes"] & 1), now.depth + s["depth"][h], phase, place if turned else now.owner)
    if now.phase != "after":
        raise ValueError("the array does not end" if now.phase == "inside" else "there is no array" + (f" under the key {how.root!r}" if how.root is not None else ""))
    return out


def elements(pieces: Iterable[str], how: Layout, start: Start, place: int) -> Iterator[tuple[int, str]]:
    """-1 and the JSON of each whole element of a split; the owner and a part for those that cross its ends."""
    level, opener = how.base + 1, '"' if how.strings else "{"
    in_string, depth, phase, owner = start.in_string, start.depth, start.phase, start.owner
    held: list[str] | None = [] if phase == "inside" and (depth > level or in_string) else None

    def gap(text: str, allowed: str = " \t\r\n,") -> None:
        if other := text.strip(allowed):
            raise ValueError(f"the array holds an element that opens with {other[0]!r}; only {opener!r} may")

    for piece in pieces:
        text, at = piece + how.separator, 0
        for m in TOKEN.finditer(text):
            t = m.group()
            if phase == "after":
                return
            if t[0] == "\\" or t != '"' and in_string:
                continue
            if t == '"':
                in_string = not in_string
            opening = t in "[{" or t == '"' and in_string
            depth += t in "[{"
            depth -= t in "]}"
            if phase == "before":
                if t == "[" and depth == how.base + 1 and how.opens_here(text[: m.start()]):
                    phase, at = "inside", m.end()
                if how.root is None:
                    if phase == "before":
                        raise ValueError(f"the file begins with {t!r}, not with an array")
                    gap(text[: m.start()], " \t\r\n")
            elif held is None and opening:
                gap(text[at : m.start()])
                gap("" if t == opener else t)
                held, at, owner = [], m.start(), place
            elif held is None:  # the array's end
                gap(text[at : m.start()])
                gap("" if t == "]" else t)
                phase = "after"
            elif depth == level and not in_string and (t == '"') == how.strings and not opening:
                whole, held = "".join([*held, text[at : m.end()]]), None
                yield (-1 if owner == place else owner), whole
                at, owner = m.end(), place
        if phase == "after":
            return
        if held is not None:
            held.append(text[at:])
        elif phase == "inside":
            gap(text[at:])
    if held is not None:
        yield owner, "".join(held)


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    rows = (row for b in batches for row in zip(b.column("path").to_pylist(), b.column("place").to_pylist(), b.column("value").to_pylist(), strict=True))
    for key, some in groupby(rows, key=lambda row: row[:2]):
        yield key, (value for _, _, value in some)


def read(spark: SparkSession, path: str, element: T.DataType, root: str | None = None) -> DataFrame:
    """element: the members of the array that each file is, or that its key `root` holds, in no order.

    Elements are objects or strings. Other kinds among them, text before an array at the root, a missing or unterminated
    array, and members that are no JSON are errors. What follows the array is not looked at. Splits are those of
    spark.sql.files.maxPartitionBytes; results do not depend on them.
    """
    if not isinstance(element, (T.StructType, T.StringType)):
        raise ValueError("elements are objects or strings")
    how = Layout(root, isinstance(element, T.StringType))
    text = spark.read.option("lineSep", how.separator).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("place"), "value")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, place), some in _splits(batches):
            yield pa.RecordBatch.from_pydict({"path": [name], "place": [place], "sums": [json.dumps(summed(some, how))]})

    def of_file(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        found = starts(zip(rows["place"].tolist(), map(json.loads, rows["sums"]), strict=True), how)
        return pd.DataFrame([(name, place, s.in_string, s.depth, s.phase, s.owner) for name, (place, s) in zip(rows["path"], found, strict=True)], columns=["path", "place", "in_string", "depth", "phase", "owner"])

    known = pieces.mapInArrow(sums, "path string, place long, sums string").groupBy("path").applyInPandas(of_file, "path string, place long, in_string boolean, depth int, phase string, owner long")
    found = {(r.path, r.place): Start(r.in_string, r.depth, r.phase, r.owner) for r in known.limit(MOST_SPLITS + 1).collect()}
    if len(found) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    shared = spark.sparkContext.broadcast(found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, place), some in _splits(batches):
            for owner, one in elements(some, how, shared.value[name, place], place):
                yield pa.RecordBatch.from_pydict({"path": [name], "place": pa.array([place], pa.int64()), "owner": pa.array([owner], pa.int64()), "json": pa.array([one], pa.string())})

    out = written(pieces.mapInArrow(run, "path string, place long, owner long, json string"), "elements")
    crossing = out.where("owner >= 0").groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("place", "json"))).alias("parts"))
    whole = out.where("owner < 0").select("json").unionAll(crossing.select(F.array_join(F.col("parts")["json"], "").alias("json")))
    parsed = F.from_json(F.concat(F.lit('{"element":'), "json", F.lit("}")), T.StructType([T.StructField("element", element)]), {"mode": "FAILFAST"})
    return whole.select(parsed["element"].alias("element"))
