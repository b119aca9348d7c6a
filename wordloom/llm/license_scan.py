"""License notices in documents: an exact set-similarity join of text blocks with license templates.

A paragraph is a block; one of more than BLOCK words is cut into windows of that many, each beginning half a window
after the one before. Blocks and templates are sets of words. A template meets a block that holds at least the share
THRESHOLD of its words. Words are ordered by the number of documents that hold them, rarest first, ties by the word:

- prefix: of a template with n words of which `need` must be met, each block that meets it holds one of its first n - need + 1;
- length: such a block holds `need` words of the templates at all;
- position: a word met at place i of a template and place j of a block leaves min(n - i, m - j) - 1 further words to meet.

What passes is confirmed on the whole sets, so the filters decide how much is looked at and never what is found.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import rest, slices
from wordloom.llm.decontaminate import NORMAL, unpacked

#: Share of a template's words that a block must hold; words of a block, twice the longest template's at least; words of templates that one pass holds.
THRESHOLD, BLOCK, PASS_WORDS = 0.8, 256, 200_000
PARAGRAPH = re.compile(rb"\n[\t\r ]*\n")

#: Phrases that name a license, and its label. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Labels and public license notices, the usual words with which a work is put under a license.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("found", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("matches", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("template", "first_word", "end_word", "met", "size")]))),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(NORMAL).split() if text else []


def blocks(text: str, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """The place of the first word, and the words, of each block of a text."""
    at = 0
    for paragraph in PARAGRAPH.split(text.encode("utf-8")):
        words = paragraph.translate(NORMAL).split()
        if len(words) <= size:
            if words:
                yield at, words
        else:
            for k in range(0, len(words) - size // 2, size // 2):
                yield at + k, words[k : k + size]
        at += len(words)


class Templates:
    """Templates as sorted ranks of words, and for each rank the templates that have it in their prefix."""

    def __init__(self, texts: Sequence[tuple[str | None, str | None]], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.labels = [label for label, _ in texts]
        sets = [frozenset(words_of(text)) for _, text in texts]
        order = sorted(set().union(*sets), key=lambda w: (frequency.get(w, 0), w)) if sets else []
        self.rank = {w: k for k, w in enumerate(order)}
        self.sets = [frozenset(self.rank[w] for w in s) for s in sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, members in enumerate(self.sets):
            ordered = sorted(members)
            for i, r in enumerate(ordered[: len(ordered) - self.need[t] + 1] if ordered else []):
                self.prefix[r].append((t, i))
        self.probes = frozenset(order[r] for r in self.prefix)
        self.least = min((n for n, s in zip(self.need, self.sets, strict=True) if s), default=0)

    def met(self, words: Iterable[bytes]) -> list[tuple[int, int]]:
        """Templates that a block of these words meets, and how many of their words it holds."""
        ranks = sorted(self.rank[w] for w in self.rank.keys() & set(words))
        if len(ranks) < self.least:
            return []
        shared: dict[int, int] = {}
        out: set[int] = set()
        for j, r in enumerate(ranks):
            for t, i in self.prefix.get(r, ()):
                shared[t] = shared.get(t, 0) + 1
                if shared[t] + min(len(self.sets[t]) - i, len(ranks) - j) - 1 < self.need[t]:
                    out.add(t)
        held = frozenset(ranks)
        sizes = ((t, len(self.sets[t] & held)) for t in sorted(shared.keys() - out))
        return [(t, n) for t, n in sizes if n >= self.need[t]]


@lru_cache(maxsize=1)
def _templates_of(texts: tuple, frequency: tuple, threshold: float) -> Templates:
    """One index for all tasks of a Python worker."""
    return Templates(texts, dict(frequency), threshold)


def phrase_places(words: list[bytes]) -> list[tuple[int, int]]:
    """The place and the number of the phrase for all places of PHRASES among the words."""
    if b"license" not in words and b"cc" not in words:
        return []
    out = []
    for p, phrase in enumerate(PHRASES):
        parts = [w.encode() for w in phrase.split()]
        at = -1
        for _ in range(words.count(parts[0])):
            at = words.index(parts[0], at + 1)
            if words[at : at + len(parts)] == parts:
                out.append((at, p))
    return sorted(out)


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands. The vocabulary is that of one pass of templates, so bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(shared.value.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in rows.toLocalIterator()}


def scan(docs: DataFrame, templates: Sequence[tuple[str | None, str | None]] = TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, places (of PHRASES: word and phrase), found (labels), score and matches for every row of docs.

    A match is (template, first_word, end_word, met, size): the block from first_word up to end_word holds `met` of the
    template's `size` words. found has the sorted labels of the templates met, score the largest share met, 0.0 without
    a match. All blocks of whole texts are looked at, and a template that meets several is reported for each.

    Null and empty texts have no words, no matches and score 0.0. Rows with equal ids are each judged by themselves;
    repeated templates match repeatedly and give one label. Templates without words meet nothing; a null label is not
    listed. An empty table gives no rows. Columns named in `carry` follow, or take the place of one of the same name.

    `templates` are at most PASS_WORDS words, which bounds what executors are sent; more are an error, and wanted in
    several calls.
    """
    vocabulary = frozenset(w for _, text in templates for w in words_of(text))
    if sum(len(words_of(text)) for _, text in templates) > PASS_WORDS:
        raise ValueError(f"more than {PASS_WORDS} words of templates in one pass")
    if block < 2 * max((len(words_of(text)) for _, text in templates), default=1):
        raise ValueError("a block has twice the words of the longest template at least")
    frequency = frequencies(docs, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tuple(templates), tuple(sorted(frequency.items()))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _templates_of(*shared.value, threshold)
        for batch in slices(batches, "text"):
            sizes, places, found, scores, matches = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                places.append([list(x) for x in phrase_places(words)])
                hits = []
                if not index.probes.isdisjoint(words):
                    for at, part in blocks(text, block):
                        hits += [(t, at, at + len(part), n, len(index.sets[t])) for t, n in index.met(part)]
                matches.append([dict(zip(("template", "first_word", "end_word", "met", "size"), h, strict=True)) for h in hits])
                found.append(sorted({index.labels[h[0]] for h in hits} - {None}))
                scores.append(max((h[3] / h[4] for h in hits), default=0.0))
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string())), pa.array(scores, pa.float64())]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("template", "first_word", "end_word", "met", "size")]))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(matches, kind), batch.column("rest")], names=[*OUT.names, "rest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest(carry))
    return unpacked(rows.mapInArrow(run, T.StructType([*OUT.fields, rows.schema["rest"]])), OUT.names, carry)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of docs; see scan()."""
    names = F.array(*map(F.lit, PHRASES.values()))
    starts = F.transform("places", lambda x: x[0])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: F.get(names, x[1].cast("int")))))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, "found"))), ",").alias("labels"),
        "score",
    )


def _values(rows: Iterable[Sequence]) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
#: The same by comparing all blocks with all templates.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_LOW} AS t FROM documents), w AS (SELECT row, doc_id, t, regexp_extract_all(t, {_WORDS}) AS w FROM d),
p(phrase, label) AS (VALUES {_values(PHRASES.items())}), q AS (SELECT string_split(phrase, ' ') AS q, label FROM p),
s AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM w), h AS (SELECT row, i - 1 AS i, label FROM s JOIN q ON w[i] = q[1] AND w[i:i + len(q) - 1] = q),
b AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM h GROUP BY 1),
tp(k, label, text) AS (VALUES {_values((k, *x) for k, x in enumerate(TEMPLATES))}), tw AS (SELECT k, label, list_distinct(regexp_extract_all({_LOW}, {_WORDS})) AS s FROM tp),
g AS (SELECT row, regexp_extract_all(unnest(regexp_split_to_array(t, '\n[\t\r ]*\n')), {_WORDS}) AS g FROM w),
k AS (SELECT row, CASE WHEN len(g) <= {BLOCK} THEN g ELSE g[1 + {BLOCK // 2} * c:{BLOCK} + {BLOCK // 2} * c] END AS g FROM (SELECT row, g, unnest(CASE WHEN len(g) <= {BLOCK} THEN range(1) ELSE range(CAST(ceil(len(g) / {BLOCK // 2}) - 1 AS BIGINT)) END) AS c FROM g)),
m AS (SELECT row, label, len(list_intersect(s, g)) / len(s) AS share FROM k JOIN tw ON len(list_intersect(s, g)) >= {THRESHOLD} * len(s) - 1e-9),
a AS (SELECT row, max(share) AS score FROM m GROUP BY 1),
l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY 1), f AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM h UNION SELECT row, label FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b ON w.row = b.row LEFT JOIN a ON w.row = a.row LEFT JOIN l ON w.row = l.row LEFT JOIN f ON w.row = f.row
"""
