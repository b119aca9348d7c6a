"""Finished crossword boards against the rules that a board keeps, as the rules that are broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import letters as L
from wordloom.functions.texts import units
from wordloom.operators.checks import violations
from wordloom.operators.graphs import _RUNS, MASK, masks, open_runs
from wordloom.sources.tables import table

#: Letters that cells of the drawn boards hold, by a digit of a hash.
LETTERS = "கசடதபறயரலவழளஅஇஉஎ"


def _cell(row: Column, col: Column) -> Column:
    return row.cast("long") * 65536 + col


def crossword_violations(boards: DataFrame, entries: DataFrame) -> DataFrame:
    """board, place and rule for each rule that an entry breaks.

    boards has board, rows and cols; entries has board, place (its number in the board's list), word, way (across or
    down), row, col, number, clue and also (other words that are taken for it, or null). A board's entries are compared
    with each other as one array, which is as large as a board.

    onBoard: no cell is outside. letters: two units or more, all of them letters. interlock: no cell is to hold another
    letter for a crossing word. maximal: the cells before and after are covered by no entry. connected: crossings lead
    to the board's first entry. number: by reading order of the cells where entries begin. start: no other entry begins
    there the same way. unique: no other entry has the word. clue: it does not say the word. also: each once, no answer of the
    board, as long as the word, and with its letters where others cross.
    """
    one = ["place", "word", "way", "row", "col", "number", "clue", "also"]
    listed = entries.groupBy("board").agg(F.array_sort(F.collect_list(F.struct(*one))).alias("l")).join(boards.select("board", "rows", "cols"), "board")
    down = lambda e: F.when(e["way"] == "down", 1).otherwise(0)
    at = lambda e: F.transform(units(e["word"]), lambda u, k: _cell(e["row"] + k * down(e), e["col"] + k * (1 - down(e))))
    told = listed.withColumn("e", F.transform("l", lambda e: F.struct(*[e[c].alias(c) for c in one], units(e["word"]).alias("units"), at(e).alias("at"), _cell(e["row"], e["col"]).alias("begin"))))
    held = F.flatten(F.transform("e", lambda e: F.arrays_zip(e["at"].alias("at"), e["units"].alias("unit"))))
    told = told.withColumn("held", F.sort_array(held)).withColumn("begins", F.array_sort(F.array_distinct(F.col("e")["begin"])))
    count = F.size("held")
    pairs = F.arrays_zip(F.slice("held", F.lit(1), count - 1).alias("a"), F.slice("held", F.lit(2), count - 1).alias("b"))
    told = told.withColumn("shared", F.filter(pairs, lambda p: p["a"]["at"] == p["b"]["at"]))  # equal cells are side by side
    clashes = F.filter("shared", lambda p: p["a"]["unit"] != p["b"]["unit"])["a"]["at"]
    unplaced = F.when(F.exists("held", lambda h: h["at"].isNull() | h["unit"].isNull()), F.col("held"))
    told = told.withColumns({"crossings": F.array_distinct(F.col("shared")["a"]["at"]), "clashes": clashes, "unplaced": unplaced})
    grown = lambda seen, _: F.array_union(seen, F.flatten(F.transform(F.filter("e", lambda e: F.arrays_overlap(e["at"], seen)), lambda e: e["at"])))
    told = told.withColumn("reached", F.aggregate("e", F.get(F.col("e"), F.lit(0))["at"], grown))
    whole = ["board", "rows", "cols", "open_cells", "crossings", "clashes", "unplaced", "begins", "reached"]
    told = told.withColumn("open_cells", F.col("held")["at"])
    rows = told.select(*whole, F.col("e").alias("every"), F.explode("e").alias("e")).select(*whole, "every", "e.*")
    step = F.when(F.col("way") == "down", 65536).otherwise(1)
    size = F.size("units")
    clash = F.when(F.col("unplaced").isNull(), F.arrays_overlap("at", "clashes")).otherwise(~F.forall(F.arrays_zip("at", "units"), lambda x: ~F.exists("unplaced", lambda y: (y["at"] == x["at"]) & (y["unit"] != x["units"]))))
    other = lambda keeps: F.size(F.filter("every", keeps)) == 1
    beside = lambda w: F.arrays_zip(F.col("at"), F.col("units"), units(w).alias("w"))
    fits = lambda w: (size > 0) & (F.size(units(w)) == size) & F.forall(beside(w), lambda x: ~F.array_contains("crossings", x["at"]) | (x["w"] == x["units"]))
    also = F.coalesce("also", F.array().cast("array<string>"))
    rules = {
        "onBoard": (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") + F.when(F.col("way") == "down", size).otherwise(1) <= F.col("rows")) & (F.col("col") + F.when(F.col("way") == "down", 1).otherwise(size) <= F.col("cols")),
        "letters": (size >= 2) & F.forall("units", lambda u: L.letter_defect(u).isNull()),
        "interlock": ~clash,
        "maximal": ~F.array_contains("open_cells", F.col("begin") - step) & ~F.array_contains("open_cells", F.col("begin") + step * size),
        "connected": F.arrays_overlap("at", "reached"),
        "number": F.col("number") == F.array_position("begins", F.col("begin")),
        "start": other(lambda e: (e["begin"] == F.col("begin")) & (e["way"] == F.col("way"))),
        "unique": other(lambda e: e["word"] == F.col("word")),
        "clue": ~F.contains("clue", F.col("word")),
        "also": (F.size(F.array_distinct(also)) == F.size(also)) & F.forall(also, lambda w: ~F.array_contains(F.col("every")["word"], w) & fits(w)),
    }
    return violations(rows, ["board", "place"], rules)


def drawn_boards(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Boards and entries of the masks of parts, with letters by a hash of the cell. Every few boards something is wrong with them."""
    key = F.col("board")
    letters = F.translate(F.md5(key.cast("string")), "0123456789abcdef", LETTERS)
    begins = F.sort_array(F.collect_set(_cell(F.col("row"), F.col("col"))).over(Window.partitionBy("board")))
    runs = open_runs(masks(spark, d)).withColumn("begins", begins)
    down = F.col("way") == "down"
    start, size = F.col("row") * MASK + F.col("col") + 1, F.col("size").cast("int")
    below = F.regexp_replace(F.substr(letters, start, (size - 1) * MASK + 1), f"(.).{{0,{MASK - 1}}}", "$1")  # each MASK-th letter
    word = F.when(down, below).otherwise(F.substr(letters, start, size))
    place = F.col("row") * 100 + F.col("col") * 10 + F.when(down, 1).otherwise(0)
    entries = runs.select("board", place.alias("place"), word.alias("word"), "way", "row", "col", "begins")
    entries = entries.withColumn("word", F.when((key % 7 == 0) & down, F.concat(F.lit("கா"), F.substr("word", F.lit(2)))).when((key % 13 == 0) & down, F.concat("word", F.lit("ு"))).otherwise(F.col("word")))
    number = F.array_position("begins", _cell(F.col("row"), F.col("col"))) + F.when((key % 11 == 0) & down, 1).otherwise(0)
    also = F.when(key % 3 == 0, F.array(F.reverse("word"), F.concat("word", F.lit("க"))))
    entries = entries.select("board", "place", "word", "way", "row", "col", number.alias("number"), F.when(key % 5 == 0, F.concat(F.lit("= "), "word")).otherwise("?").alias("clue"), also.alias("also"))
    boards = table(spark, d, "part").select(F.col("p_partkey").alias("board"), F.when(F.col("p_partkey") % 17 == 0, MASK - 1).otherwise(MASK).alias("rows"), F.lit(MASK).alias("cols"))
    return boards, entries


def board_violations(spark: SparkSession, d: str) -> DataFrame:
    return crossword_violations(*drawn_boards(spark, d))


_DRAWN = f"""{_RUNS}, en AS (SELECT board, CAST(row * 100 + col * 10 + CASE way WHEN 'down' THEN 1 ELSE 0 END AS INTEGER) AS place, way, row, col, array_to_string(list_transform(range(size), lambda k: substr('{LETTERS}', CAST('0x' || substr(md5(CAST(board AS VARCHAR)), CAST((row + CASE way WHEN 'down' THEN k ELSE 0 END) * {MASK} + col + CASE way WHEN 'down' THEN 0 ELSE k END + 1 AS BIGINT), 1) AS BIGINT) + 1, 1)), '') AS w FROM r),
ew AS (SELECT board, place, way, row, col, CASE WHEN board % 7 = 0 AND way = 'down' THEN 'கா' || substr(w, 2) WHEN board % 13 = 0 AND way = 'down' THEN w || 'ு' ELSE w END AS word FROM en),
ee AS (SELECT *, regexp_extract_all(word, '(?s).[{L.SIGNS}]*') AS u, dense_rank() OVER (PARTITION BY board ORDER BY row, col) AS reading FROM ew),
ef AS (SELECT *, reading + CASE WHEN board % 11 = 0 AND way = 'down' THEN 1 ELSE 0 END AS number, CASE WHEN board % 5 = 0 THEN '= ' || word ELSE '?' END AS clue, CASE WHEN board % 17 = 0 THEN {MASK - 1} ELSE {MASK} END AS rows FROM ee),
ce AS (SELECT board, place, word, way, unnest(range(len(u))) AS k, row + CASE way WHEN 'down' THEN unnest(range(len(u))) ELSE 0 END AS r, col + CASE way WHEN 'down' THEN 0 ELSE unnest(range(len(u))) END AS c, unnest(u) AS unit FROM ef),
cx AS (SELECT board, r, c, count(DISTINCT unit) AS kinds, count(*) AS n FROM ce GROUP BY 1, 2, 3),
nb AS (SELECT DISTINCT a.board AS board, a.place AS p, b.place AS q FROM ce a JOIN ce b ON a.board = b.board AND a.r = b.r AND a.c = b.c), re AS (SELECT board, min(place) AS p FROM ef GROUP BY 1 UNION SELECT nb.board, q FROM re JOIN nb ON nb.board = re.board AND nb.p = re.p)"""
_REVERSED = "array_to_string(list_reverse(string_split(word, '')), '')"


def _broken(rule: str, where: str) -> str:
    return f"SELECT board, place, '{rule}' AS rule FROM ef e WHERE {where}"


QUERIES = {"board_violations": board_violations}
ORACLES = {
    "board_violations": f"WITH RECURSIVE {_DRAWN}, al AS (SELECT board, place, word, u, w, regexp_extract_all(w, '(?s).[{L.SIGNS}]*') AS v FROM (SELECT board, place, word, u, unnest([{_REVERSED}, word || 'க']) AS w FROM ef WHERE board % 3 = 0)) "
    + " UNION ALL ".join(
        [
            _broken("onBoard", "EXISTS (SELECT 1 FROM ce WHERE ce.board = e.board AND ce.place = e.place AND (r >= rows OR c >= 5))"),
            _broken("interlock", "EXISTS (SELECT 1 FROM ce JOIN cx ON cx.board = ce.board AND cx.r = ce.r AND cx.c = ce.c WHERE ce.board = e.board AND ce.place = e.place AND kinds > 1)"),
            _broken("letters", "board % 13 = 0 AND board % 7 <> 0 AND way = 'down' AND NOT contains('கசடதபறயரலவழள', u[-1][1])"),
            _broken("connected", "NOT EXISTS (SELECT 1 FROM re WHERE re.board = e.board AND re.p = e.place)"),
            _broken("number", "number <> reading"),
            _broken("unique", "(SELECT count(*) FROM ef x WHERE x.board = e.board AND x.word = e.word) > 1"),
            _broken("clue", "contains(clue, word)"),
            _broken(
                "also",
                f"board % 3 = 0 AND ({_REVERSED} = word || 'க' OR EXISTS (SELECT 1 FROM al JOIN ef x ON x.board = al.board AND x.word = w WHERE al.board = e.board AND al.place = e.place) OR EXISTS (SELECT 1 FROM al WHERE al.board = e.board AND al.place = e.place AND len(v) <> len(al.u))"
                " OR EXISTS (SELECT 1 FROM al JOIN ce ON ce.board = al.board AND ce.place = al.place JOIN cx ON cx.board = ce.board AND cx.r = ce.r AND cx.c = ce.c WHERE al.board = e.board AND al.place = e.place AND n > 1 AND v[k + 1] IS DISTINCT FROM unit))",
            ),
        ]
    ),
}
