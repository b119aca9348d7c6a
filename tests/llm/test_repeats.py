"""Blocks, ranges and routes of op5 and op7 at sizes that small tables reach, against brute force."""

import hashlib
import random

import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from wordloom.llm import repeats, substring_dedup, suffix_dedup
from wordloom.llm.repeats import Limits, packed, unpacked


def brute_words(rows, size=13):
    """(id, words, removed, kept) of rows (id, text); a null id comes first."""
    key = lambda i: -1 if i is None else i
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key(i):
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, size=100):
    """(id, bytes, removed, spans) of rows (id, text) with ids of their own."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - size + 1):
            if data[k : k + size] in seen:
                gone[k : k + size] = [True] * size
            seen.add(data[k : k + size])
        out.append((i, len(data), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))))
    return sorted(out, key=repr)


def check(spark, rows, limits=Limits()):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(docs, limits).collect()), key=repr)
    assert found == brute_words(rows)
    if all(i is not None for i, _ in rows):
        found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.report(docs, limits).collect()), key=repr)
        assert found == brute_bytes(rows)


def shared_passages(n, words=60, seed=1):
    """Texts of which most share a passage, in many cuts and with words changed."""
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(words)]
    rows = []
    for i in range(n):
        own = lambda m: [f"w{r.randrange(10**6)}" for _ in range(m)]
        a = r.randrange(words - 14)
        part = passage[a : a + r.randrange(13, words)]
        if r.random() < 0.3:
            part[r.randrange(len(part))] = f"x{r.randrange(5)}"
        rows.append((i, " ".join([*own(r.randrange(20)), *part, *own(r.randrange(20)), *(part if r.random() < 0.2 else [])])))
    return rows


def test_packed_numbers():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        for high in (10, 1 << 20, (1 << 48) - 1):
            numbers = np.unique(r.integers(0, high, n).astype(np.uint64))
            assert unpacked(packed(numbers)).tolist() == numbers.tolist()


@pytest.mark.parametrize("limits", [Limits(), Limits(4, 3000), Limits(1, 1)])
def test_small_limits(spark, monkeypatch, limits):
    """Frequent anchors by windows, an index for every few routes, many blocks and ranges: the rows stay the same."""
    if limits != Limits():
        monkeypatch.setattr(repeats, "BLOCK_BYTES", (4000, 4000))
        monkeypatch.setattr(repeats, "RANGE_ANCHORS", 50)
    check(spark, shared_passages(150), limits)


def test_given_documents_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", (20_000, 20_000))
    monkeypatch.setattr(repeats, "RANGE_ANCHORS", 500)
    rows = [tuple(r.values()) for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    check(spark, rows, Limits(8, 20_000))


def test_more_runs_than_the_split(spark):
    """One passage in 5,000 texts, each with words of its own around it."""
    passage = " ".join(f"p{k}" for k in range(20))
    check(spark, [(i, f"a{i} b{i} c{i} {passage} d{i} e{i}") for i in range(5000)])


def test_null_ids_take_no_longer_than_others(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    check(spark, [(None if i % 2 else i, f"a{i} {passage} d{i}") for i in range(10_000)])


def test_texts_longer_than_a_slice(spark):
    """Repeats inside and across the parts that a long text is read in."""
    r = random.Random(2)
    words = [f"word{r.randrange(10**7)}" for _ in range(250_000)]
    for at in (5, 32_760, 65_536, 100_000, 131_060, 131_072, 200_000):
        words[at + 30 : at + 60] = words[at : at + 30]
    step = repeats.UNIT_BYTES // 8
    check(spark, [(1, " ".join(words)), (2, "x " + " ".join(words[step - 20 : step + 20]) + " y"), (3, " ".join(words[1000:40_000]))])
