"""Contracts: what keeps them, and one broken rule at a time."""

from wordloom.operators import contracts as C
from wordloom.operators.derive import GATES


def test_entries(spark):
    good = {"k": 0, "word": "கடல்", "length": 3, "attestations": 2, "tier_one": 2, "pos": ["noun", "verb"], "synonyms": ["ஆழி"], "categories": None, "senses": ["b", "a"]}
    cases = [({}, set()), ({"length": 4}, {"length"}), ({"tier_one": 3}, {"tierOne"}), ({"pos": ["verb", "noun"]}, {"pos"}), ({"pos": []}, {"pos"}), ({"synonyms": ["ஆழி", "ஆழி"]}, {"synonyms"}), ({"synonyms": ["கடல்"]}, {"synonyms"}), ({"categories": ["b", "a"]}, {"categories"}), ({"senses": ["a", "a"]}, {"senses"}), ({"senses": [" "]}, {"senses"}), ({"senses": None, "pos": None}, set()), ({"length": None}, {"length"})]
    rows = [tuple((good | change | {"k": k}).values()) for k, (change, _) in enumerate(cases)]
    table = spark.createDataFrame(rows, "k int, word string, length int, attestations int, tier_one int, pos array<string>, synonyms array<string>, categories array<string>, senses array<string>")
    found = [(r.k, r.rule) for r in C.entry_violations(table, "k").collect()]
    assert sorted(found) == sorted((k, rule) for k, (_, rules) in enumerate(cases) for rule in rules)


def test_wordlists(spark):
    words = [("l", "கல்", 9, 1, 1), ("l", "பல்", 9, 1, 1), ("l", "கடல", 7, 2, 2), ("l", "டகல", 5, 3, 2), ("l", "வா", 1, 4, 1), ("m", "கல்", 1, 1, 1)]
    words = [(a, b, c, d, e) for a, b, c, d, e in words]
    schema = "list string, word string, frequency long, stratum int, fan_out int"
    ledger = lambda name, rows, kept: (name, rows, *[kept if g == "kept" else 2 for g in GATES])
    ledgers = spark.createDataFrame([ledger("l", 2 * (len(GATES) - 1) + 5, 5), ledger("m", 4, 2), ledger("n", 2 * (len(GATES) - 1), 0)], "list string, rows long, " + ", ".join(f"{g} long" for g in GATES))
    assert sorted(map(tuple, C.wordlist_violations(spark.createDataFrame(words, schema), ledgers).collect()), key=repr) == [("m", None, "kept"), ("m", None, "ledger")]
    words[1], words[2] = ("l", "பல்", 9, 2, 1), ("l", "கடல", 7, 2, 1)
    found = C.wordlist_violations(spark.createDataFrame(words, schema), ledgers.where("list = 'l'")).collect()
    assert sorted(map(tuple, found)) == [("l", "கடல", "fanOut"), ("l", "பல்", "stratum")]


def test_ladders(spark):
    good = (["கல", "கடல", "கடலம"], "டமய", [[], ["லகட"], ["கலடய"]])
    cases = [
        (good, set()),
        ((good[0][:1], "", [[]]), {"rungs"}),
        ((["கல", "கடம"], "டம", None), {"grows"}),
        ((["கல", "கடலம"], "டம", None), {"grows"}),
        ((good[0], "டய", None), {"bank"}),
        ((["கல", "கடல", "கடலட"], "டம", None), {"bank"}),
        ((good[0], "டமய", [[], [], ["கடலம"]]), {"also"}),
        ((good[0], "டமய", [[], ["கலன"], []]), {"also"}),
        ((good[0], "டமய", [["லக"], [], []]), {"also"}),
        ((good[0], "டமய", [[], []]), {"also"}),
        ((["கல", "கல"], "டம", None), {"grows", "repeats"}),
    ]
    table = spark.createDataFrame([(k, *case) for k, (case, _) in enumerate(cases)], "ladder int, rungs array<string>, bank string, also array<array<string>>")
    found = [(r.ladder, r.rule) for r in C.ladder_violations(table).collect()]
    assert sorted(found) == sorted((k, rule) for k, (_, rules) in enumerate(cases) for rule in rules)
