"""A board that keeps all rules, and one broken rule at a time."""

import pytest

from wordloom.operators import boards

GOOD = [(0, "கடல", "across", 0, 0, 1, "நீர்", ["கபல"]), (1, "கல்", "down", 0, 0, 1, "பாறை", None), (2, "லவு", "down", 0, 2, 2, "x", None)]
CASES = [
    ({}, set()),
    ({0: {"col": 1}}, {(0, "onBoard"), (1, "interlock"), (0, "interlock"), (2, "interlock"), (2, "number"), (0, "number"), (1, "maximal")}),
    ({1: {"word": "க"}}, {(1, "letters")}),
    ({1: {"word": "கx"}}, {(1, "letters")}),
    ({2: {"word": "ல1"}}, {(2, "letters")}),
    ({1: {"word": "சல்"}}, {(0, "interlock"), (1, "interlock")}),
    ({2: {"row": 1, "word": "வுய"}}, {(2, "connected"), (2, "maximal")}),
    ({2: {"number": 3}}, {(2, "number")}),
    ({2: {"word": "கல்", "row": 0, "col": 0, "number": 1}}, {(1, "start"), (2, "start"), (1, "unique"), (2, "unique")}),
    ({1: {"clue": "ஒரு கல் தான்"}}, {(1, "clue")}),
    ({0: {"also": ["கபல", "கபல"]}}, {(0, "also")}),
    ({0: {"also": ["கல்"]}}, {(0, "also")}),
    ({0: {"also": ["கபய"]}}, {(0, "also")}),
    ({0: {"also": ["கப"]}}, {(0, "also")}),
    ({1: {"also": ["கட்"]}}, set()),
]
NAMES = "place word way row col number clue also".split()


def test_rules(spark):
    rows = []
    for board, (change, _) in enumerate(CASES):
        for entry in GOOD:
            made = dict(zip(NAMES, entry, strict=True)) | change.get(entry[0], {})
            rows.append((board, *made.values()))
    entries = spark.createDataFrame(rows, "board int, place int, word string, way string, row int, col int, number int, clue string, also array<string>")
    sizes = spark.createDataFrame([(b, 3, 3) for b in range(len(CASES))], "board int, rows int, cols int")
    found = {}
    for r in boards.crossword_violations(sizes, entries).collect():
        found.setdefault(r.board, set()).add((r.place, r.rule))
    for board, (change, want) in enumerate(CASES):
        got = found.get(board, set())
        assert got == want or board == 1 and {(0, "onBoard"), (0, "interlock")} <= got, (change, got)
    assert boards.crossword_violations(sizes, entries.limit(0)).count() == 0
    with pytest.raises(Exception):
        boards.crossword_violations(sizes.drop("rows"), entries).collect()
