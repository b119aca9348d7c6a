"""Extracts are whole or not there, and a reader notices what went missing."""

import pytest

from wordloom.sources import extract_files as X

HEADER, LEDGER = {"sourceId": "s", "sha256": "abc", "role": "authority"}, {"rowsIn": 5, "rowsOut": 3, "parseRejects": 2}


def tables(spark, n=3):
    observations = spark.createDataFrame([(f"அ{k}", k) for k in range(n)], "surface string, count long")
    return observations, spark.createDataFrame([("அ0", "pos", "noun", 0), ("அ0", "pos", "noun", 0), ("அ1", "definition", 'a "b"\n', 1)], "word string, attr string, value string, ordinal int")


def test_roundtrip(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert not X.is_current(spark, folder, "abc")
    assert X.write_extract(folder, HEADER, *tables(spark), LEDGER) == {"record": "summary", **LEDGER, "observations": 3, "facts": 3}
    header, observations, facts = X.read_extract(spark, folder)
    assert header["role"] == "authority" and sorted(map(tuple, observations.collect())) == [("அ0", 0), ("அ1", 1), ("அ2", 2)]
    assert sorted(map(tuple, facts.collect())) == [("அ0", "pos", "noun", 0), ("அ0", "pos", "noun", 0), ("அ1", "definition", 'a "b"\n', 1)]
    assert X.is_current(spark, folder, "abc") and not X.is_current(spark, folder, "abd")
    X.write_extract(folder, HEADER | {"sha256": "abd"}, *tables(spark, 1), LEDGER)
    assert X.is_current(spark, folder, "abd") and X.read_extract(spark, folder)[1].count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["s"]


@pytest.mark.parametrize("ledger", [{**LEDGER, "rowsIn": 6}, {**LEDGER, "parseRejects": -2, "rowsIn": 1}, {"rowsIn": 3, "rowsOut": 3}])
def test_broken_ledgers_leave_nothing(spark, tmp_path, ledger):
    with pytest.raises(ValueError):
        X.write_extract(f"file://{tmp_path}/s", HEADER, *tables(spark), ledger)
    assert list(tmp_path.iterdir()) == []


def test_readers_notice(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    X.write_extract(folder, HEADER, *tables(spark), LEDGER)
    part = next(p for p in (tmp_path / "s" / "records").glob("part-*.txt") if p.stat().st_size)
    whole = part.read_text()
    for p in part.parent.glob(".*.crc"):
        p.unlink()
    for broken in ("", whole + '{"record":"fact","word":"x"}\n', whole.replace("observation", "other").replace('"fact"', '"other"')):
        part.write_text(broken)
        with pytest.raises(ValueError):
            X.read_extract(spark, folder)
    part.write_text(whole + "{nonsense\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        X.read_extract(spark, folder)
    part.write_text(whole)
    assert X.read_extract(spark, folder)[2].count() == 3
