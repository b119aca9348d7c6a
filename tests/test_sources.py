"""Readers and the store on small files."""

import random

import pytest
from pyspark.sql import types as T

from wordloom.sources import readers
from wordloom.sources.snapshots import Store, digest, write_partitions


def test_delimited_keeps_short_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b"one\t1\n\n  two\t2 \nthree\nbad\xff\t3\n")
    found = sorted((r.fields, r.broken) for r in readers.read(spark, "delimited", str(tmp_path)).collect())
    assert [f for f, _ in found][1:] == [["one", "1"], ["three"], ["two", "2"]] and found[0][1] and found[0][0][1] == "3"


def test_quoted_records_span_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;"x ""y""\nz"\n;\nb;c\n')
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
    assert sorted(map(tuple, readers.read(spark, "delimited-quoted", str(tmp_path), schema=schema, delimiter=";").collect())) == [("a", 'x "y"\nz'), ("b", "c")]


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"w": "a"}\n{"w": "b"}\n')
    (tmp_path / "b.json").write_text('{"root": ["x", "y"]}')
    schema = T.StructType([T.StructField("w", T.StringType())])
    assert {r.w for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()} == {"a", "b"}
    assert {r.element for r in readers.json_array(spark, str(tmp_path / "b.json"), T.StringType(), "root").collect()} == {"x", "y"}
    with pytest.raises(ValueError):
        readers.json_array(spark, str(tmp_path / "b.json"), T.LongType())
    (tmp_path / "a.jsonl").write_text('{"w": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()


def test_xml_pages_of_a_namespace(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<m><page><title>A_b  c</title><ns>0</ns><revision><text>t</text></revision></page><page><title>T</title><ns>10</ns><revision><text>u</text></revision></page></m>")
    assert [tuple(r) for r in readers.read(spark, "mediawiki-xml", str(tmp_path)).collect()] == [("A b c", "t")]
    with pytest.raises(ValueError):
        readers.read(spark, "none", "x")


def test_store_is_the_same_in_any_order(spark, tmp_path):
    def source(k):
        rows = [(f"w{j % 3}", j + k) for j in range(5)]
        return spark.createDataFrame(rows, "surface string, count long"), spark.createDataFrame([("w", "pos", "n", 0)] * 2, "word string, attr string, value string, ordinal int")

    made = []
    for seed in range(2):
        store, order = Store(spark, f"file://{tmp_path}/{seed}"), list(range(3))
        random.Random(seed).shuffle(order)
        assert all(store.replace(f"s{k}", *source(k + 7), "old") for k in order[:2])
        assert all(store.replace(f"s{k}", *source(k), "new") for k in order)
        assert not store.replace("s0", *source(0), "new")
        store.replace("gone", *source(1), "x")
        store.remove("gone")
        with pytest.raises(KeyError):
            store.remove("gone")
        made.append((digest(store.observations()).first(), digest(store.facts()).first(), store.facts().count()))
    assert made[0] == made[1] and made[0][2] == 6


def test_partitions(spark, tmp_path):
    df = spark.createDataFrame([("x", "b", None), ("x", "a", 1), ("y", "c", 2)], "class string, word string, n int")
    listed = write_partitions(df, f"file://{tmp_path}/out", ["class"], "word").collect()
    assert len(listed) == 2 and all(len(r.sha256) == 64 for r in listed)
    text = next(p for p in (tmp_path / "out" / "class=x").glob("*.json")).read_text()
    assert text == '{"word":"a","n":1}\n{"word":"b"}\n'


def test_kept_tables_follow_their_input(spark, tmp_path):
    import os
    import shutil

    from wordloom.sources.shared import kept

    made = []

    def table(n):
        spark.range(n).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))

    def make():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "t.parquet"))

    ask = lambda: kept(spark, "x", str(tmp_path), ("t", "absent"), make)
    table(3)
    assert [ask().count() for _ in range(3)] == [3, 3, 3] and len(made) == 1
    table(5)
    assert [ask().count() for _ in range(2)] == [5, 5] and len(made) == 2
    path = ask().inputFiles()[0].removeprefix("file://").removeprefix("file:")
    shutil.rmtree(os.path.dirname(path))
    assert ask().count() == 5 and len(made) == 3
