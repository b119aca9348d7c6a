"""Files under their ceiling, their index, and days that are written once."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from wordloom.sources import publish


@pytest.mark.parametrize("ceiling", [120, 400, 1 << 20])
def test_no_file_over_the_ceiling(spark, tmp_path, ceiling):
    words = [("headword", f"க{chr(0x0B95 + k % 20)}{'ல' * (k % 7)}{k}", k) for k in range(300)] + [("loanword", "ஜா", 1), ("headword", "அ", None)]
    rows = spark.createDataFrame(words, "word_class string, word string, n int").repartition(7)
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # the second publication takes the place of the first
        found = publish.publish(rows, folder, ceiling).collect()
        on_disk = sorted(str(p) for p in (tmp_path / "out").rglob("*.json"))
        assert sorted(r.path.removeprefix("file:").replace("//", "/") for r in found) == on_disk and all(r.bytes <= ceiling for r in found)
    kept = []
    for r in sorted(found, key=lambda r: (r.word_class, r.base, r.part)):
        lines = [json.loads(x) for x in open(r.path.removeprefix("file:")).read().splitlines()]
        kept += [(r.word_class, x["word"], x.get("n")) for x in lines]
        assert {format(ord(x["word"][0]), "04x") for x in lines} == {r.base}
    assert kept == sorted(words, key=lambda w: (w[0], w[1].encode()))
    assert len(found) > 20 if ceiling == 120 else len(found) >= 3
    index = {r.base: (r.letter, r.roman, r.kind) for r in publish.letter_index(spark.createDataFrame([(r.base,) for r in found], "base string")).collect()}
    assert index == {"0b95": ("க", "ka", "uyirmei"), "0b9c": ("ஜ", "ja", "uyirmei"), "0b85": ("அ", "a", "uyir")}


def test_what_cannot_be_published(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "word_class string, word string")
    with pytest.raises(ValueError, match="too long"):
        publish.publish(rows(("a", "க" * 50)), f"file://{tmp_path}/a", 100)
    for bad in (("a", None), (None, "க"), ("a", "")):
        with pytest.raises(ValueError, match="without"):
            publish.publish(rows(bad), f"file://{tmp_path}/b")
    with pytest.raises(Exception, match="no letter"):
        publish.letter_index(spark.createDataFrame([("0061",)], "base string")).collect()


def test_days_are_written_once(spark, tmp_path):
    folder = f"file://{tmp_path}/bank"
    rows = spark.range(40).select(F.format_string("2024-01-%02d", F.col("id") % 8 + 1).alias("day"), "id")
    assert publish.days_of(spark, folder).count() == 0
    assert publish.bank_days(rows.where("day <= '2024-01-05'"), folder) == 5
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "bank").rglob("*.json")}
    assert publish.bank_days(rows, folder) == 3 and publish.bank_days(rows, folder) == 0
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    shutil.rmtree(tmp_path / "bank" / "day=2024-01-02")
    assert sorted(r.day for r in publish.days_of(spark, folder).collect()) == [f"2024-01-0{k}" for k in (1, 3, 4, 5, 6, 7, 8)]
    assert publish.bank_days(rows, folder) == 1
    assert spark.read.json(folder).groupBy("day").count().where("count = 5").count() == 8
