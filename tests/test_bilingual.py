"""Runs over the borders of ranges, and a dictionary's facts, against brute force."""

import random
from itertools import groupby

import pytest

from wordloom.operators import bilingual


@pytest.mark.parametrize("range_rows", [1, 3, 7, 1000])
def test_runs_over_borders(spark, range_rows):
    rng = random.Random(range_rows)
    heads = [h for h, n in [("a", 9), (None, 4), ("b", 1), ("a", 1), (None, 1), ("a", 12)] for _ in range(n)] + [rng.choice("ab") for _ in range(20)]
    rows = list(enumerate(heads))
    rng.shuffle(rows)
    found = sorted((r.place, r.run) for r in bilingual.runs(spark.createDataFrame(rows, "place int, head string"), ["place"], "head", range_rows).collect())
    want = [[p for p, _ in some] for _, some in groupby(enumerate(heads), key=lambda x: x[1])]
    assert [[p for p, _ in some] for _, some in groupby(found, key=lambda x: x[1])] == want
    assert len({run for _, run in found}) == len(want)


ENTRIES = [
    ("lamp", "n. விளக்கு, (பழைய) தீபம்."),
    ("lamp", "v. ஒளிர்"),
    (None, "n. எதுவுமில்லை"),
    ("lamp", "n. சுடர்,, விளக்கு ."),
    ("lamp", "(see torch) தீவட்டி, பந்தம் (சிறிய"),
    ("hill", "-2 n. மலை"),
    ("hill", None),
    ("hill", "n. குன்று (உயர்ந்த) , "),
    ("hill", "only ascii"),
    ("lamp", "n. அகல்"),
]


def test_facts(spark):
    rows = [(k, h, t) for k, (h, t) in enumerate(ENTRIES)]
    for range_rows in (2, 100):
        found = [tuple(r) for r in bilingual.facts(spark.createDataFrame(rows, "place int, head string, text string"), ["place"], range_rows).collect()]
        peers = sorted((w, v, n) for w, attr, v, n in found if attr == "glossPeer")
        nouns, none, hills = sorted(["விளக்கு", "தீபம்", "சுடர்"]), sorted(["தீவட்டி", "பந்தம் (சிறிய"]), sorted(["மலை", "குன்று"])
        assert peers == sorted((w, v, n) for some in (nouns, none, hills) for w in some for n, v in enumerate(x for x in some if x != w))
        assert sorted(w for w, attr, _, _ in found if attr == "headword").count("விளக்கு") == 2
        assert ("மலை", "pos", "noun", 0) in found and ("ஒளிர்", "pos", "verb", 0) in found and ("தீவட்டி", "translation", "lamp", 0) in found
        assert not any(w == "தீவட்டி" and attr == "pos" for w, attr, _, _ in found) and not any("எது" in w for w, *_ in found)
    assert bilingual.facts(spark.createDataFrame([], "place int, head string, text string"), ["place"]).count() == 0
