"""License scans, collocations and ranked search against brute force, at small limits and on awkward rows."""

import math
import random
import re
from collections import Counter

import pytest

from wordloom.llm import collocations, license_scan, ranked_search
from wordloom.llm.license_scan import Templates, blocks, words_of

CLASH = "n_words string, rest string, matches int, score string, n string, key int, query int, terms string"
PAD = ("w", "r", 1, "s", "n", 2, 3, "t")


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, lang, *PAD) for k, t, lang in rows], "doc_id long, text string, lang string, " + CLASH)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# License scans


def test_filters_lose_nothing():
    rng = random.Random(5)
    letters = [f"t{k}" for k in range(30)]
    for threshold in (0.5, 0.8, 1.0):
        texts = [(str(k), " ".join(rng.sample(letters, rng.randint(1, 12)))) for k in range(40)]
        index = Templates(texts, {w.encode(): rng.randint(0, 9) for w in letters}, threshold)
        for _ in range(200):
            block = rng.choices(letters, k=rng.randint(0, 25))
            held = {w.encode() for w in block}
            want = [(k, n) for k, (_, t) in enumerate(texts) for s in [set(words_of(t))] for n in [len(s & held)] if n >= threshold * len(s) - 1e-9]
            assert index.met([w.encode() for w in block]) == want


def test_blocks_cover_every_stretch_of_half_a_block():
    for n in (0, 1, 7, 8, 9, 12, 13, 40, 41):
        words = [f"w{k}".encode() for k in range(n)]
        found = list(blocks(" ".join(w.decode() for w in words), 8))
        assert all(part == words[at : at + len(part)] and len(part) <= 8 for at, part in found)
        for k in range(max(0, n - 3)):
            assert any(at <= k and k + 4 <= at + len(part) for at, part in found)
    assert [at for at, _ in blocks("a b\n \t\nc\n\n\n\nd\n", 8)] == [0, 2, 3]


def test_scan(spark):
    mit = license_scan.TEMPLATES[10][1]
    rows = [
        (1, "Some words. Released under the MIT License, mit license.", "en"),
        (2, mit.upper().replace(", ", ",\n"), "en"),
        (3, "x " * 5000 + "\n" + mit + "\n" + "y " * 5000, "en"),
        (3, "x " * 5000 + "\n" + mit + "\n" + "y " * 5000, "en"),
        (4, None, None),
        (5, "", "en"),
        (6, "CC BY, then the Apache License; and GNU general\npublic license", "en"),
        (None, "Permission to use nothing is granted by any person", "en"),
        (7, "gnu general public licenses, mit licence, cc bye", "en"),
    ]
    found = {}
    for r in license_scan.report(docs_of(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert len(found[3]) == 2 and found[3][0] == found[3][1]
    assert (found[1][0].n_base, found[1][0].first_word, found[1][0].last_word, found[1][0].labels, found[1][0].score) == (2, 5, 7, "mit", 1.0)
    assert (found[2][0].base_labels, found[2][0].labels, found[2][0].n_base) == ("", "mit", 0) and found[3][0].labels == "mit" and found[3][0].n_words == 10_000 + len(words_of(mit))
    for k in (4, 5):
        assert tuple(found[k][0])[1:] == (0, 0, None, None, "", "", 0.0)
    assert (found[6][0].n_base, found[6][0].base_labels, found[6][0].first_word, found[6][0].last_word) == (3, "apache,cc-by,gpl", 0, 7)
    assert found[None][0].labels == "" and found[7][0].n_base == 0
    full = license_scan.scan(docs_of(spark, rows[:2]), carry=["rest", "n_words"]).collect()
    assert full[0].rest == "r" and full[0].n_words == "w" and [(m.template, m.met, m.size) for m in full[0].matches] == [(11, 5, 5)]
    assert license_scan.report(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs_of(spark, []), block=20)


# Collocations


def brute_collocations(rows, least, top, weight=lambda k: 1):
    counts, total = Counter(), Counter()
    for k, text, lang in rows:
        name = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", low(text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[name] += weight(k) * len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[name, tuple(words[i : i + size])] += weight(k)
    frequent = {k: v for k, v in counts.items() if v >= least}
    out = {}
    for (lang, w), a in frequent.items():
        if len(w) == 1 or any(100 * f >= 100 * a for (x, v), f in frequent.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))):
            continue
        cuts = [(1000 * a * total[lang] // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k, frequent[lang, w[:k]], frequent[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, n + 1, p.decode(), -a, x, y, total[lang], -s) for lang, some in out.items() for n, (s, a, p, x, y) in enumerate(sorted(some)[:top]))


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "B", "c", "é", " ", "d\x00", "'x'", "\U0001f600", "z"]
    rows = [(k % 40, "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", " ", ". ", "\n"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "", None, "und"])) for k in range(120)]
    rows += [(200, "one two three four five six. " * 9, "fr"), (None, "one two three four five six. " * 2, "fr"), (201, None, "fr"), (202, "", "de"), (203, "...,, \n", "de"), (204, "a " * 3000, "de")]
    for least, top in ((4, 5), (7, 1000)):
        found = [tuple(r) for r in collocations.collocations(docs_of(spark, rows), least, top).collect()]
        assert sorted(found) == brute_collocations(rows, least, top) and found
    assert collocations.collocations(docs_of(spark, [])).count() == 0 == collocations.collocations(docs_of(spark, rows[-3:-1])).count()


def test_collocations_beyond_64_bits(spark):
    rows = [("en", "big deal", 9 * 10**14), ("en", "big", 10**14), ("en", "deal", 3 * 10**13)]
    found = collocations.of_pieces(spark.createDataFrame(rows, "lang string, piece string, n long")).collect()
    weights = [n for _, _, n in rows]
    assert [tuple(r) for r in found] == brute_collocations([(k, p, lang) for k, (lang, p, _) in enumerate(rows)], 100, 9, weights.__getitem__)


def test_duckdb_counts_beyond_its_memory(spark, monkeypatch):
    monkeypatch.setattr(collocations, "DUCKDB_MEMORY", "24MB")
    grams = spark.range(0, 1_200_000, 1, 4).selectExpr("'en' AS lang", "concat('word ', md5(cast(id % 600000 AS string)), ' ', repeat('x', 40)) AS phrase", "3 AS size", "1L AS n").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    found = collocations.counted(grams, 2)
    assert found.count() == 600_000
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# Ranked search


def brute_search(docs, items, k=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low(t or ""))
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t, _ in docs]
    held = [h for h in held if h[2]]
    n_docs, n_all = len(held), sum(h[2] for h in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, n + 1, d, -s) for n, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("postings", [40, 2_000_000])
@pytest.mark.parametrize("pass_terms", [20, 200_000])
def test_search(spark, postings, pass_terms):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["É", "Zz"]
    spread = [1 / (k + 1) for k in range(len(words))]
    docs = [(rng.randint(0, 90), " ".join(rng.choices(words, spread, k=rng.choice([1, 3, 20, 60]))), "en") for _ in range(150)]
    docs += [(7, None, "en"), (8, "", "en"), (9, "-- ''", None), (None, "w30 w31", "en"), (5, "w30 w31", "en"), (3, "w30 w31", "en"), (3, "w30 w31", "en"), (400, "w2 " * 4000 + "w39", "en")]
    items = [(k, " ".join(rng.sample(words, rng.randint(1, 12))) + " W1,w1") for k in range(12)] + [(12, None), (13, ""), (14, "nowhere"), (15, "w30 W31"), (15, "w0"), (15, "w0"), (None, "w5")]
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, score string, doc_id int")
    found = [tuple(r) for r in ranked_search.search(docs_of(spark, docs), asked, 10, pass_terms, postings).collect()]
    assert sorted(found, key=repr) == brute_search(docs, items)
    assert ranked_search.search(docs_of(spark, []), asked).count() == 0 == ranked_search.search(docs_of(spark, docs), asked.limit(0)).count()


def test_search_stops_early():
    import numpy as np

    rng = np.random.default_rng(1)
    n = 5000
    terms = np.tile(np.arange(8), n)
    impact = np.repeat(1000 >> np.arange(8), n).reshape(8, n).T.ravel() + rng.integers(0, 3, 8 * n)
    impact[:8] *= 50
    shard = ranked_search.Shard(np.arange(n), np.arange(0, 8 * n + 1, 8), terms, impact, 8)
    at, score = shard.best(range(8), 1, 0)
    assert at.tolist() == [0] and score[0] == impact[:8].sum()
    whole = impact.reshape(n, 8).sum(1)
    at, score = shard.best(range(8), 50, 0)
    want = np.sort(whole)[::-1][:50]
    assert np.sort(score)[::-1][:50].tolist() == want.tolist()
