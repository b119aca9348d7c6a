"""Work that grows with rows has tasks that grow with rows, and no table is broadcast whole."""

import random

import numpy as np
from pyspark.sql import functions as F

from wordloom.functions import deletion_marks as marks_module
from wordloom.functions import texts as X
from wordloom.functions.deletion_marks import bitmap, marker, marks
from wordloom.operators import corpus


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marks_are_equal_where_variants_are(spark):
    draw = random.Random(3)
    words = sorted({"".join(draw.choices("abc\U0001f600", k=draw.randrange(7))) for _ in range(300)})
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    variants = {r.w: set(r.v) for r in rows.select("w", X.deletions(F.col("w")).alias("v")).collect()}
    found = {}
    for r in rows.mapInArrow(marker(), "word string, mark long").collect():
        found.setdefault(r.word, set()).add(r.mark)
    assert {w: len(v) for w, v in variants.items()} == {w: len(m) for w, m in found.items()}
    assert all(bool(variants[a] & variants[b]) == bool(found[a] & found[b]) for a in words for b in words)
    assert marks(np.zeros((2, 0), np.uint32)).shape == (2, 1)


def test_bitmap_holds_all_marks(spark):
    words = spark.createDataFrame([(f"word{k}",) for k in range(500)], "w string").mapInArrow(marker(), "word string, mark long").cache()
    bits = bitmap(words)
    assert words.select("word").mapInArrow(marker(lambda: bits), "word string, mark long").distinct().count() == words.count()
    few = bitmap(words.limit(1))
    assert words.select("word").distinct().mapInArrow(marker(lambda: few), "word string, mark long").count() < words.count() / 10


def test_neighbours_broadcast_no_dictionary(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("kitten",), ("", ), ("sitting" * 9,)], "surface string")
        out = corpus.neighbours(asked, spark.createDataFrame([("mitten",), ("smitten",), ("i",)], "surface string"))
        assert "BroadcastHashJoin" not in _plan(out)
        assert sorted(map(tuple, out.collect())) == [("", 1, 1.0), ("kitten", 1, 1.0), ("sitting" * 9, 3, 0.0)]
        assert [tuple(r) for r in corpus.neighbours(asked.limit(1), asked.limit(0)).collect()] == [("kitten", 3, 0.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_are_spelled_once_each_and_by_many_tasks(spark, monkeypatch):
    from conftest import SMALL

    from wordloom.operators import classes

    monkeypatch.setattr(classes, "JUDGED_ROWS", 1000)
    words = classes.spellings(spark, SMALL)
    assert words.rdd.getNumPartitions() == -(-words.count() // 1000) > 1
    signals = classes.word_shapes(spark, SMALL)
    assert signals.rdd.getNumPartitions() == words.rdd.getNumPartitions()


def test_entries_are_judged_by_many_tasks(spark, monkeypatch):
    from conftest import SMALL

    from wordloom.operators import derive

    monkeypatch.setattr(derive, "JUDGED_ROWS", 1000)
    rows = derive.entries(spark, SMALL)
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 1000) > 1


def test_parts_are_parsed_by_many_tasks(spark, monkeypatch):
    from conftest import SMALL

    from wordloom.operators import bilingual

    monkeypatch.setattr(bilingual, "PARSED_ROWS", 50)
    assert len(bilingual.part_entries(spark, SMALL).inputFiles()) == 4


def test_pages_are_parsed_once_and_by_many_tasks(spark, monkeypatch):
    from conftest import SMALL

    from wordloom.operators import wiki

    monkeypatch.setattr(wiki, "PARSED_PAGES", 5)
    facts = wiki.wiki_page_facts(spark, SMALL)
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("posexplode(split(") == 1
    assert facts.rdd.getNumPartitions() == -(-wiki.conversation_pages(spark, SMALL).count() // 5) > 1


def test_near_words_share_close_marks_or_far_ones(spark):
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("abc\U0001f600", k=draw.randrange(7))) for _ in range(400)})
    rows = spark.createDataFrame([(w,) for w in words], "w string")

    def shared(of, meeting):
        left, right = rows.mapInArrow(marker(of=of), "a string, mark long"), rows.mapInArrow(marker(of=meeting), "b string, mark long")
        return {(r.a, r.b) for r in left.join(right, "mark").select("a", "b").distinct().collect()}

    near = {(r.a, r.b): r.d for r in rows.toDF("a").crossJoin(rows.toDF("b")).withColumn("d", F.levenshtein("a", "b")).where("d <= 2").collect()}
    close, far = shared(marks_module.close_marks, marks_module.close_marks), shared(marks_module.far_marks, marks_module.far_heads)
    assert {p for p, d in near.items() if d <= 1} <= close <= set(near)
    assert set(near) <= close | far
    assert close | far == set(near)  # who meets is near, so that one word may stand for all of a mark
