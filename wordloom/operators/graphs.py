"""Words as a graph of letter multisets, rivals under masks, letters at places, and boards as relations of cells."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import texts as X
from wordloom.operators.corpus import observations, totals
from wordloom.sources.shared import spread, written
from wordloom.sources.tables import table

#: Longest word of the ladder, least total of its words; most differing places of rivals.
LONGEST, LEAST, DIFFER = 6, 5, 2
#: Priorities that are on at a time; what a mark is worth, best first.
PLAYED, MARKS = 3, ("correct", "present", "absent")
#: Parts whose masks a task draws.
MASKED_ROWS = 20_000
#: Rows and columns of a part's mask and of its grid; least and most letters of the words looked for in grids.
MASK, GRID, SHORT, LONG = 5, 4, 3, 4


def ladder_nodes(seen: DataFrame) -> DataFrame:
    """key (sorted letters), length and frequency, the greatest total of its words."""
    words = totals(seen).where(f"length(surface) BETWEEN 2 AND {LONGEST} AND total >= {LEAST}")
    keyed = words.withColumn("key", F.array_join(F.array_sort(F.split("surface", "")), ""))
    return keyed.groupBy("key").agg(F.max("total").alias("frequency"), F.first(F.length("key")).alias("length"))


def ladder_up(nodes: DataFrame) -> DataFrame:
    """low and high: keys of which high has one letter more. Found by taking letters away, one join on equal keys."""
    places = F.sequence(F.lit(1), F.length("key"))
    less = F.array_distinct(F.transform(places, lambda i: F.concat(F.substr("key", F.lit(1), i - 1), F.substr("key", i + 1))))
    removed = nodes.select(F.col("key").alias("high"), F.explode(less).alias("low"))
    return removed.join(nodes.select(F.col("key").alias("low")), "low").select("low", "high")


def climbs(nodes: DataFrame, edges: DataFrame, rungs: int = LONGEST - 1) -> DataFrame:
    """key, rungs and promise: for each number of rungs that a climb from the key can have, its own included, the greatest least frequency of the rungs above it; null for one rung.

    The graph is levelled by length, so there are no more than LONGEST - 1 rungs. nodes and edges are read once a rung.
    """
    level = nodes.select("key", F.lit(1).cast("long").alias("rungs"), F.lit(None).cast("long").alias("promise"))
    out = level
    for k in range(2, rungs + 1):
        above = nodes.select("key", "frequency").join(level.select("key", "promise"), "key").select(F.col("key").alias("high"), F.least("frequency", F.coalesce("promise", "frequency")).alias("least"))
        level = edges.join(above, "high").groupBy(F.col("low").alias("key")).agg(F.max("least").alias("promise")).select("key", F.lit(k).cast("long").alias("rungs"), "promise")
        out = out.unionAll(level)
    return out


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return ladder_nodes(observations(table(spark, d, "documents")))


def ladder_edges(spark: SparkSession, d: str) -> DataFrame:
    return ladder_up(written(_nodes(spark, d), "nodes"))


def _climbs(spark: SparkSession, d: str) -> DataFrame:
    nodes = written(_nodes(spark, d), "nodes")
    return climbs(nodes, written(ladder_up(nodes), "edges"))


def ladder_reach(spark: SparkSession, d: str) -> DataFrame:
    """key and reach, the rungs of the longest climb."""
    return _climbs(spark, d).groupBy("key").agg(F.max("rungs").alias("reach"))


def ladder_promise(spark: SparkSession, d: str) -> DataFrame:
    return _climbs(spark, d).where("rungs > 1")


def mask_rivals(spark: SparkSession, d: str) -> DataFrame:
    """For each part name the names of its length that differ in at most DIFFER places, as a bit mask of the places.

    Two names that differ in DIFFER places agree on one of DIFFER + 1 stretches; candidates meet there, not all with all.
    """
    names = table(spark, d, "part").select("p_name").distinct()
    size = F.ceil(F.length("p_name") / (DIFFER + 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(DIFFER)), lambda k: F.struct(k.alias("k"), F.substr("p_name", k * size + 1, size).alias("part")))
    keyed = names.select("p_name", F.length("p_name").alias("n"), F.inline(parts))
    left, right = keyed.alias("l"), keyed.alias("r")
    same = (F.col("l.n") == F.col("r.n")) & (F.col("l.k") == F.col("r.k")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.p_name") != F.col("r.p_name"))
    pairs = left.join(right, same).select(F.col("l.p_name").alias("name"), F.col("r.p_name").alias("rival")).distinct()
    bits = F.zip_with(F.split("name", ""), F.split("rival", ""), lambda a, b: (a != b).cast("long"))
    mask = F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s * 2 + b)
    return pairs.withColumn("mask", mask).where(F.bit_count("mask") <= DIFFER)


def inverted_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Five-letter surfaces with t in the first and e in the fifth place, by the index of letters and places."""
    words = observations(table(spark, d, "documents")).where("length(surface) = 5").select("surface").distinct()
    index = words.select("surface", F.posexplode(F.split("surface", "")).alias("place", "letter"))
    pins = (F.col("place") == 0) & (F.col("letter") == "t") | (F.col("place") == 4) & (F.col("letter") == "e")
    return index.where(pins).groupBy("surface").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("surface")


def grids(spark: SparkSession, d: str) -> DataFrame:
    """board, row, col and letter: each part's name and brand, letters only and repeated, as a grid of GRID rows."""
    letters = F.regexp_replace(F.lower(F.concat("p_name", "p_brand")), "[^a-z]", "")
    filled = table(spark, d, "part").select(F.col("p_partkey").alias("board"), F.substr(F.repeat(letters, GRID * GRID), F.lit(1), F.lit(GRID * GRID)).alias("filled"))
    cells = filled.select("board", F.posexplode(F.split("filled", "")).alias("place", "letter"))
    return cells.select("board", F.floor(F.col("place") / GRID).cast("int").alias("row"), (F.col("place") % GRID).alias("col"), "letter")


def served_words(spark: SparkSession, d: str) -> DataFrame:
    """The distinct short words of the benchmark."""
    words = table(spark, d, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.where(F.length("word").between(SHORT, LONG))


def unintended_words(spark: SparkSession, d: str) -> DataFrame:
    """board, word, row, col, direction: where served words stand in the grids along any of eight rays.

    Each grid is one array of letters; the letters along each ray from each cell are read off it, and what they spell is
    looked up among the served words.
    """
    boards = grids(spark, d).groupBy("board").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", "col", "letter"))).getField("letter"), "").alias("filled"))
    ways = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    rays = [(r, c, a, b, n) for r in range(GRID) for c in range(GRID) for a, b in ways for n in range(SHORT, LONG + 1) if 0 <= r + a * (n - 1) < GRID and 0 <= c + b * (n - 1) < GRID]
    known = json.dumps([{"row": r, "col": c, "direction": f"{a},{b}", "places": [(r + a * k) * GRID + c + b * k + 1 for k in range(n)]} for r, c, a, b, n in rays])
    each = F.inline(F.from_json(F.lit(known), "array<struct<row int, col int, direction string, places array<int>>>"))  # the rays of one grid
    spelled = boards.select("board", "filled", each).select("board", "row", "col", "direction", F.array_join(F.transform("places", lambda k: F.substr("filled", k, F.lit(1))), "").alias("word"))
    return spelled.join(served_words(spark, d), "word").select("board", "word", "row", "col", "direction")


def masks(spark: SparkSession, d: str) -> DataFrame:
    """board, row, col and cell (. open, # closed): the bits of a hash of each part's key, MASK to a row; three bits of a cell must be 0 to close it."""
    key = F.md5(F.col("p_partkey").cast("string"))
    places = F.sequence(F.lit(0), F.lit(MASK * MASK - 1))
    parts = written(spread(table(spark, d, "part").select("p_partkey"), MASKED_ROWS), "parts")
    cells = parts.select(F.col("p_partkey").alias("board"), F.posexplode(F.transform(places, lambda k: F.when(F.substr(key, k + 1, F.lit(1)).isin("0", "1", "2", "3"), "#").otherwise("."))).alias("place", "cell"))
    return cells.select("board", F.floor(F.col("place") / MASK).cast("int").alias("row"), (F.col("place") % MASK).alias("col"), "cell")


def open_runs(cells: DataFrame) -> DataFrame:
    """board, way, row, col and size of the longest open stretches of more than one cell of rows and columns."""
    both = cells.select("board", F.lit("across").alias("way"), F.col("row").alias("line"), F.col("col").alias("place"), "cell").unionAll(cells.select("board", F.lit("down"), F.col("col"), F.col("row"), F.col("cell")))
    island = F.col("place") - F.row_number().over(Window.partitionBy("board", "way", "line").orderBy("place"))
    runs = both.where("cell = '.'").withColumn("island", island).groupBy("board", "way", "line", "island").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("size")).where("size > 1")
    across = F.col("way") == "across"
    return runs.select("board", "way", F.when(across, F.col("line")).otherwise(F.col("start")).alias("row"), F.when(across, F.col("start")).otherwise(F.col("line")).alias("col"), "size")


def mask_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries of each part's mask."""
    return open_runs(masks(spark, d))


def canonical_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each board numbered by their first cells in reading order; those that share a cell share the number."""
    number = F.dense_rank().over(Window.partitionBy("board").orderBy("row", "col")).cast("long")
    return open_runs(masks(spark, d)).select("board", "way", "row", "col", number.alias("number"))


def playlist_window(spark: SparkSession, d: str) -> DataFrame:
    """For every day from the first order to the last, the priorities that are on: a window of PLAYED over the ring of all priorities. Each day goes on where the last ended, and shifts once a round."""
    orders = table(spark, d, "orders").where("o_orderdate IS NOT NULL")
    span = orders.agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    ring = orders.where("o_orderpriority IS NOT NULL").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("ring"))  # a closed vocabulary
    days = span.where("first IS NOT NULL").select(F.explode(F.sequence("first", "last")).alias("date")).join(F.broadcast(ring))  # one row
    size = F.size("ring")
    walked = (F.unix_date("date") + 719163) * PLAYED
    start = (walked + F.floor(walked / size)) % size
    on = F.transform(F.sequence(F.lit(0), F.lit(PLAYED - 1)), lambda k: F.get("ring", ((start + k) % size).cast("int")))
    return days.select(F.date_format("date", "yyyy-MM-dd").alias("day"), F.posexplode(on).alias("place", "priority"))


def deletion_variants(spark: SparkSession, d: str) -> DataFrame:
    """The deletion variants of the benchmark's distinct words."""
    words = table(spark, d, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.explode(X.deletions(F.col("word"))).alias("variant"))


def fnv1a_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.fnv1a(F.concat(F.col("lang"), F.lit(":"), F.col("doc_id").cast("string"))).alias("hash"))


def mulberry_float(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.mulberry(F.col("doc_id") * 7919).alias("value"), X.mulberry(F.col("doc_id") * 7919, 3).alias("third"))


def seeded_indexes(spark: SparkSession, d: str) -> DataFrame:
    """A place among ten for each document, from the text of its language and id."""
    return table(spark, d, "documents").select("doc_id", X.seeded_index(F.lit(10), F.concat(F.col("lang"), F.lit(":"), F.col("doc_id").cast("string"))).cast("long").alias("index"))


def letter_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of guesses against answers, each letter of the answer serving once: five-letter words that follow each other among a benchmark item's."""
    words = F.filter(X.tokens(F.col("text")), lambda w: F.length(w) == 5)
    listed = table(spark, d, "benchmark").select(words.alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("guess"), b.alias("answer")))
    rows = listed.select(F.inline(pairs)).where("answer IS NOT NULL").distinct()
    return rows.select("guess", "answer", F.array_join(X.marks(F.col("guess"), F.col("answer")), ",").alias("marks"))


def best_marks(spark: SparkSession, d: str) -> DataFrame:
    """answer, letter and mark: the best mark that any guess at an answer got for a letter, as the keys of a keyboard show it."""
    rows = letter_marks(spark, d)
    each = rows.select("answer", F.explode(F.arrays_zip(F.split("guess", "").alias("letter"), F.split("marks", ",").alias("mark"))).alias("x")).select("answer", "x.letter", "x.mark")
    rank = F.array_position(F.array(*map(F.lit, MARKS)), F.col("mark"))
    return each.groupBy("answer", "letter").agg(F.min_by("mark", rank).alias("mark"))


_LADDER = f"""o AS (SELECT surface, count(*) AS total FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS surface FROM documents) GROUP BY 1 HAVING len(surface) BETWEEN 2 AND {LONGEST} AND count(*) >= {LEAST}),
n AS (SELECT array_to_string(list_sort(string_split(surface, '')), '') AS key, max(total) AS frequency FROM o GROUP BY 1),
e AS (SELECT DISTINCT substr(h.key, 1, i - 1) || substr(h.key, i + 1) AS low, h.key AS high FROM (SELECT key, unnest(range(1, len(key) + 1)) AS i FROM n) h), u AS (SELECT low, high FROM e JOIN n ON low = key)"""


_FOLD = f"""f AS (SELECT key, CAST(1 AS BIGINT) AS rungs, frequency AS promise FROM n UNION ALL
  SELECT low, rungs + 1, max(least(n.frequency, promise)) FROM f JOIN u ON u.high = f.key JOIN n ON n.key = f.key WHERE rungs < {LONGEST - 1} GROUP BY 1, 2)"""
_RUNS = f"""c AS (SELECT p_partkey AS board, CAST(k // {MASK} AS INTEGER) AS row, CAST(k % {MASK} AS INTEGER) AS col, CASE WHEN substr(md5(CAST(p_partkey AS VARCHAR)), CAST(k AS BIGINT) + 1, 1) IN ('0', '1', '2', '3') THEN '#' ELSE '.' END AS cell FROM part, range({MASK * MASK}) t(k)),
x AS (SELECT board, 'across' AS way, row AS line, col AS place, cell FROM c UNION ALL SELECT board, 'down', col, row, cell FROM c),
i AS (SELECT *, place - row_number() OVER (PARTITION BY board, way, line ORDER BY place) AS g FROM x WHERE cell = '.'), j AS (SELECT board, way, line, min(place) AS start, count(*) AS size FROM i GROUP BY board, way, line, g HAVING count(*) > 1),
r AS (SELECT board, way, CASE way WHEN 'across' THEN line ELSE start END AS row, CASE way WHEN 'across' THEN start ELSE line END AS col, size FROM j)"""
_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM benchmark"
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(s, ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda h, u: (xor(CAST(h AS BIGINT), CAST(u AS BIGINT))::HUGEINT * 16777619) % 4294967296)"
_MUL = "((({a})::HUGEINT * ({b})::HUGEINT) % 4294967296)::BIGINT"


def _draw(rows: str, draw: int) -> str:
    """doc_id and the draw-th float of the rows' seeds."""
    return f"""WITH z AS ({rows}), a AS (SELECT doc_id, (seed + {0x6D2B79F5 * draw}) & 4294967295 AS a FROM z), t AS (SELECT doc_id, {_MUL.format(a='xor(a, a >> 15)', b='a | 1')} AS t FROM a),
u AS (SELECT doc_id, xor(t, (t + {_MUL.format(a='xor(t, t >> 7)', b='t | 61')}) & 4294967295) AS u FROM t) SELECT doc_id, xor(u, u >> 14) / 4294967296.0::DOUBLE AS value FROM u"""


_MARKED = """WITH w AS (SELECT list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x: len(x) = 5) AS w FROM benchmark), g AS (SELECT DISTINCT w[i] AS guess, w[i + 1] AS answer FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))
SELECT guess, answer, array_to_string(list_transform(range(1, len(guess) + 1), lambda i: CASE WHEN guess[i] = answer[i] THEN 'correct' WHEN len(list_filter(range(1, len(answer) + 1), lambda k: answer[k] = guess[i] AND guess[k] <> answer[k])) > len(list_filter(range(1, i), lambda k: guess[k] = guess[i] AND guess[k] <> answer[k])) THEN 'present' ELSE 'absent' END), ',') AS marks FROM g"""
_NAMES = (ladder_edges, ladder_reach, ladder_promise, mask_rivals, inverted_index_lookup, unintended_words, mask_entries, canonical_numbers, playlist_window, deletion_variants, fnv1a_hash, mulberry_float, seeded_indexes, letter_marks, best_marks)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLES = {
    "ladder_edges": f"WITH {_LADDER} SELECT low, high FROM u",
    "ladder_reach": f"WITH RECURSIVE {_LADDER}, {_FOLD} SELECT key, max(rungs) AS reach FROM f GROUP BY 1",
    "ladder_promise": f"WITH RECURSIVE {_LADDER}, {_FOLD} SELECT key, rungs, promise FROM f WHERE rungs > 1",
    "mask_rivals": f"WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS name, b.p_name AS rival FROM n a JOIN n b ON len(a.p_name) = len(b.p_name) AND a.p_name <> b.p_name), q AS (SELECT *, list_transform(range(1, len(name) + 1), lambda i: CASE WHEN name[i] <> rival[i] THEN 1::BIGINT ELSE 0 END) AS d FROM p) SELECT name, rival, list_reduce(d, lambda s, b: s * 2 + b) AS mask FROM q WHERE list_sum(d) <= {DIFFER}",
    "inverted_index_lookup": "SELECT DISTINCT surface FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS surface FROM documents) WHERE surface LIKE 't___e'",
    "unintended_words": f"""WITH w AS (SELECT word FROM ({_WORDS}) WHERE len(word) BETWEEN {SHORT} AND {LONG}),
b AS (SELECT p_partkey AS board, repeat(regexp_replace(lower(p_name || p_brand), '[^a-z]', '', 'g'), {GRID * GRID}) AS s FROM part),
v AS (SELECT CAST(r.r AS INTEGER) AS row, CAST(c.c AS INTEGER) AS col, y.y AS dr, x.x AS dc, n.n AS n FROM range({GRID}) r(r), range({GRID}) c(c), range(-1, 2) y(y), range(-1, 2) x(x), range({SHORT}, {LONG + 1}) n(n)
  WHERE (y.y <> 0 OR x.x <> 0) AND r.r + y.y * (n.n - 1) BETWEEN 0 AND {GRID - 1} AND c.c + x.x * (n.n - 1) BETWEEN 0 AND {GRID - 1}),
m AS (SELECT board, row, col, dr || ',' || dc AS direction, array_to_string(list_transform(range(n), lambda k: substr(s, (row + dr * k) * {GRID} + col + dc * k + 1, 1)), '') AS word FROM b, v)
SELECT board, word, row, col, direction FROM m WHERE word IN (SELECT word FROM w)""",
    "mask_entries": f"WITH {_RUNS} SELECT * FROM r",
    "canonical_numbers": f"WITH {_RUNS} SELECT board, way, row, col, dense_rank() OVER (PARTITION BY board ORDER BY row, col) AS number FROM r",
    "playlist_window": f"""WITH x AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS ring FROM orders), d AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day, ring FROM x),
w AS (SELECT day, ring, (date_diff('day', DATE '1970-01-01', day) + 719163) * {PLAYED} AS w FROM d), k AS (SELECT day, ring, (w + w // len(ring)) % len(ring) AS s, unnest(range({PLAYED})) AS place FROM w) SELECT strftime(day, '%Y-%m-%d') AS day, CAST(place AS INTEGER) AS place, ring[(s + place) % len(ring) + 1] AS priority FROM k""",
    "deletion_variants": f"WITH w AS ({_WORDS}), a AS (SELECT word, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM w)), b AS (SELECT word, substr(v, 1, i - 1) || substr(v, i + 1) AS v FROM (SELECT word, v, unnest(range(1, len(v) + 1)) AS i FROM a)) SELECT word, word AS variant FROM w UNION SELECT * FROM a UNION SELECT * FROM b",
    "fnv1a_hash": f"WITH s AS (SELECT doc_id, lang || ':' || doc_id AS s FROM documents) SELECT doc_id, CAST({_FNV} AS BIGINT) AS hash FROM s",
    "mulberry_float": f"SELECT a.doc_id, a.value, b.value AS third FROM ({_draw('SELECT doc_id, doc_id * 7919 AS seed FROM documents', 1)}) a JOIN ({_draw('SELECT doc_id, doc_id * 7919 AS seed FROM documents', 3)}) b ON a.doc_id = b.doc_id",
    "seeded_indexes": f"WITH s AS (SELECT doc_id, lang || ':' || doc_id AS s FROM documents), h AS (SELECT doc_id, CAST({_FNV} AS BIGINT) AS seed FROM s) SELECT doc_id, CAST(least(floor(value * 10), 9) AS BIGINT) AS index FROM ({_draw('SELECT * FROM h', 1)})",
    "letter_marks": _MARKED,
    "best_marks": f"WITH m AS ({_MARKED}), k AS (SELECT answer, unnest(string_split(guess, '')) AS letter, unnest(string_split(marks, ',')) AS mark FROM m) SELECT answer, letter, arg_min(mark, list_position({list(MARKS)}, mark)) AS mark FROM k GROUP BY 1, 2",
}
