"""JSON arrays cut at every place, and through Spark's splits."""

import json
import random

import pytest
from pyspark.sql import types as T

from wordloom.sources import json_arrays
from wordloom.sources.json_arrays import Layout, elements, starts, summed

OBJECTS = [{"a": 'x}y\\"{', "b": [1, {"c": "],["}]}, {}, {"root": [{"z": 1}]}, {"t": "\\\\"}, {"u": {"root": []}}]
STRINGS = ["a", "b,c", "", '"\\],[', '}"{', "é,\\\\"]
FILES = [
    (None, OBJECTS, json.dumps(OBJECTS)),
    (None, OBJECTS, json.dumps(OBJECTS, indent=2)),
    ("root", OBJECTS, json.dumps({"x": [{"a": 1}], "s": '"root": [', "root": OBJECTS})),
    (None, [], "[]"),
    ("root", [], '{"root" :[ ]}'),
    (None, STRINGS, json.dumps(STRINGS)),
    ("root", STRINGS, json.dumps({"a": ["root"], "b": "root", "root": STRINGS}, ensure_ascii=False)),
]


def members(text, how, cuts):
    """What the splits that start at or after each cut give together."""
    pieces = text.split(how.separator)
    pieces = pieces[:-1] if not pieces[-1] else pieces
    splits, at = {}, 0
    for piece in pieces:
        splits.setdefault(max(c for c in (0, *cuts) if c <= at), []).append(piece)
        at += len(piece) + 1
    out, parts = [], {}
    for place, start in starts([(p, json.loads(json.dumps(summed(some, how)))) for p, some in sorted(splits.items())], how):
        for owner, part in elements(splits[place], how, start, place):
            parts.setdefault(owner, []).append(part) if owner >= 0 else out.append(part)
    return sorted(json.dumps(json.loads(x)) for x in out + ["".join(p) for p in parts.values()])


@pytest.mark.parametrize("root, want, text", FILES)
def test_any_cuts(root, want, text):
    how, rng = Layout(root, isinstance((want or [{}])[0], str)), random.Random(4)
    want = sorted(map(json.dumps, want))
    for cuts in [[k] for k in range(len(text))] + [range(len(text))] + [rng.sample(range(len(text)), min(len(text), 5)) for _ in range(100)]:
        assert members(text, how, cuts) == want
    for end in range(text.rindex("]") + 1):
        for cuts in ([], range(end)):
            with pytest.raises(ValueError):
                members(text[:end], how, cuts)


BAD = [(None, "[1]", 0), (None, '[{"a":1}, 2]', 0), (None, "[true,{}]", 0), (None, "[null]", 1), (None, '["a",{}]', 1), (None, '[{},"a"]', 0), (None, '{"a":[]}', 0), (None, "x[]", 0), ("r", "[{}]", 0), ("r", '{"x":{"r":[{}]}}', 0), (None, "[[{}]]", 0), (None, '["a" 3]', 1), (None, "", 0)]


@pytest.mark.parametrize("root, text, strings", BAD)
def test_what_is_no_array(root, text, strings):
    for cuts in ([], range(len(text))):
        with pytest.raises(ValueError):
            members(text, Layout(root, bool(strings)), cuts)


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_read(spark, tmp_path, size):
    rows = [{"k": k, "s": random.Random(k).choice(["}", "{[", 'a"b', "é" * 50, ""]), "l": list(range(k % 5))} for k in range(20)]
    (tmp_path / "a.json").write_text(json.dumps({"more": [1], "root": rows[:9]}))
    (tmp_path / "b.json").write_text(json.dumps({"root": rows[9:], "after": [3]}, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    kind = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()), T.StructField("l", T.ArrayType(T.LongType()))])
    try:
        found = [r.element.asDict() for r in json_arrays.read(spark, str(tmp_path), kind, "root").collect()]
        assert sorted(found, key=lambda r: r["k"]) == rows
        (tmp_path / "b.json").unlink()
        (tmp_path / "a.json").write_text(json.dumps(["x,y", "", "é"]))
        assert sorted(r.element for r in json_arrays.read(spark, str(tmp_path), T.StringType()).collect()) == ["", "x,y", "é"]
        (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}')
        with pytest.raises(Exception, match="does not end"):
            json_arrays.read(spark, str(tmp_path), kind)
        (tmp_path / "a.json").write_text('[{"k": 1}, {"k": tru}]')
        with pytest.raises(Exception, match="(?i)malformed"):
            json_arrays.read(spark, str(tmp_path), kind).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError):
        Layout("a,b", True)
