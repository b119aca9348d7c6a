"""Word functions against plain Python."""

import random

from pyspark.sql import functions as F

from wordloom.functions import texts as X


def _one(spark, schema, data, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_units_rejoin_to_the_word(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abக்ாொௌஅஃ 1") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    found = _one(spark, "w string", [(w,) for w in words], X.units(F.col("w")))
    assert ["".join(u) for u in found] == words
    assert all(len(u) == 1 or not set(u[1:]) - set(map(chr, [0xB82, 0xBD7, *range(0xBBE, 0xBCE)])) for us in found for u in us)


def test_deletions(spark):
    def cut(w):
        return {w[:i] + w[i + 1 :] for i in range(len(w))}

    words = ["", "a", "ab", "hello", "aaa"]
    want = [{w} | cut(w) | {y for x in cut(w) for y in cut(x)} for w in words]
    found = _one(spark, "w string", [(w,) for w in words], X.deletions(F.col("w")))
    assert [set(f) for f in found] == want and all(len(set(f)) == len(f) for f in found)


def test_fnv1a(spark):
    def hashed(text):
        h = 2166136261
        for k in range(0, len(data := text.encode("utf-16-be")), 2):
            h = (h ^ int.from_bytes(data[k : k + 2], "big")) * 16777619 % 2**32
        return h

    words = ["", "a", "2024-01-01:daily", "தமிழ்", "😀"]
    assert _one(spark, "w string", [(w,) for w in words], X.fnv1a(F.col("w"))) == [hashed(w) for w in words]


def test_marks_use_each_letter_once(spark):
    def two_passes(guess, answer):
        left, out = list(answer), ["absent"] * len(guess)
        for k, (g, a) in enumerate(zip(guess, answer)):
            if g == a:
                out[k] = "correct"
                left.remove(g)
        for k, g in enumerate(guess):
            if out[k] == "absent" and g in left:
                out[k] = "present"
                left.remove(g)
        return out

    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("abc") for _ in range(5)) for _ in "ga") for _ in range(200)]
    assert _one(spark, "g string, a string", pairs, X.marks(F.col("g"), F.col("a"))) == [two_passes(*p) for p in pairs]


def test_distance_over_the_limit(spark):
    assert _one(spark, "a string, b string", [("abc", "abd"), ("abc", "xyz"), ("", "")], X.bounded_distance(F.col("a"), F.col("b"), 2)) == [1, 3, 0]
