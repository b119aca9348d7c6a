"""Seeded puzzles from words, picks from what was seen, and walks through sessions; each row by itself or by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import texts as X
from wordloom.operators.graphs import _FNV, _MUL, _WORDS, _draw
from wordloom.sources.shared import written
from wordloom.sources.tables import table

#: Letters of a word with blanks, and the least uses of one; what may be dealt next, in order; the day that nothing later is played on.
LETTERS, LEAST, POOL, TODAY = 5, 3, ("click", "view", "signup", "purchase", "error", "refund"), "1997-06-30"


def with_scramble(rows: DataFrame, word: str, out: str) -> DataFrame:
    """rows with `out`: the word's letters in the order of a Fisher-Yates seeded by the word, turned by as few places as make it differ; null if no turn does.

    From the last place down, each letter swaps with a drawn one up to itself. Seed, draws and order are columns of
    their own, as functions with lambdas work out their arguments anew wherever they are named.
    """
    n = F.length(word)
    drawn = lambda i: F.struct(i.alias("i"), F.floor(X.mulberry(F.col("_seed"), (n - i).cast("long")) * (i + 1)).cast("int").alias("j"))
    swap = lambda a, x: F.transform(a, lambda y, k: F.when(k == x["i"], F.get(a, x["j"])).when(k == x["j"], F.get(a, x["i"])).otherwise(y))
    rows = rows.withColumn("_parts", F.split(word, "")).withColumn("_seed", X.fnv1a(F.col(word)))
    places = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_drawn", F.transform(places, drawn)).withColumn("_mixed", F.array_join(F.aggregate("_drawn", F.col("_parts"), swap), ""))
    turns = F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.concat(F.substr("_mixed", r + 1), F.substr("_mixed", F.lit(1), r)))
    return rows.withColumn(out, F.when(n > 0, F.get(F.filter(turns, lambda x: x != F.col(word)), F.lit(0)))).drop("_parts", "_seed", "_drawn", "_mixed")


def scrambles(spark: SparkSession, d: str) -> DataFrame:
    """word and scramble of the benchmark's distinct words."""
    words = table(spark, d, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return with_scramble(words, "word", "scramble")


def blanked_words(spark: SparkSession, d: str) -> DataFrame:
    """word, pattern, a and b (the blanked letters) of the words of LETTERS letters that are used often enough, for each pair of blanks."""
    words = table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).where(f"length(word) = {LETTERS}").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {LEAST}").select("word")
    pairs = [(i, j) for i in range(1, LETTERS) for j in range(i + 1, LETTERS + 1)]
    one = lambda i, j: F.struct(F.overlay(F.overlay("word", F.lit("_"), F.lit(i), F.lit(1)), F.lit("_"), F.lit(j), F.lit(1)).alias("pattern"), F.substring("word", i, 1).alias("a"), F.substring("word", j, 1).alias("b"))
    return words.select("word", F.inline(F.array(*[one(i, j) for i, j in pairs])))


def letter_masks(spark: SparkSession, d: str) -> DataFrame:
    """word, pattern, rivals (other words that fit it) and decoys: the pattern with the fewest rivals, a seeded one of equals, and the letters that rivals have in its blanks and the word has not.

    Words meet by pattern; of a pattern its count and sets of letters travel, not its pairs.
    """
    rows = written(blanked_words(spark, d), "blanked")
    fits = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.concat(F.collect_set("a"), F.collect_set("b"))).alias("letters"))  # sets of letters
    rated = rows.join(fits, "pattern").select("word", "pattern", (F.col("n") - 1).alias("rivals"), "letters")
    each = rated.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rivals", "pattern", "letters"))).alias("l"))  # one for each pair of places
    each = each.withColumn("ties", F.filter("l", lambda x: x["rivals"] == F.get(F.col("l"), F.lit(0))["rivals"]))
    each = each.withColumn("place", X.seeded_index(F.size("ties"), F.col("word")).cast("int"))
    best = F.get(F.col("ties"), F.col("place"))
    decoys = F.array_sort(F.array_except(best["letters"], F.split("word", "")))
    return each.select("word", best["pattern"].alias("pattern"), best["rivals"].alias("rivals"), F.array_join(decoys, "").alias("decoys"))


def next_picks(spark: SparkSession, d: str) -> DataFrame:
    """user_id and next: the first of the pool that the user has not seen, or the one not seen for longest."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    pool = F.array(*map(F.lit, POOL))
    seen = last.groupBy("user_id").agg(F.collect_set("event_type").alias("seen"), F.min_by("event_type", "at").alias("oldest"))
    return seen.select("user_id", F.coalesce(F.get(F.array_except(pool, F.col("seen")), F.lit(0)), "oldest").alias("next"))


def playable_days(spark: SparkSession, d: str) -> DataFrame:
    """Per priority the last day with orders that is not after TODAY, and the milliseconds from there to its end, 0 at least and a week at most."""
    days = table(spark, d, "orders").where(F.to_date("o_orderdate") <= F.lit(TODAY).cast("date")).groupBy("o_orderpriority").agg(F.max(F.to_date("o_orderdate")).alias("day"))
    left = F.datediff(F.lit(TODAY).cast("date"), "day").cast("long") * 86_400_000
    return days.select("o_orderpriority", F.date_format("day", "yyyy-MM-dd").alias("day"), F.greatest(F.lit(0), F.least(left, F.lit(7 * 86_400_000))).cast("long").alias("remaining_ms"))


def session_walk(spark: SparkSession, d: str) -> DataFrame:
    """Per user and day: items completed (each k once), attempts that completed nothing, the last item, and whether the day ended with a completion.

    What was played on another day than the user's last counts for nothing, as a session ends with its day.
    """
    events = table(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"]).withColumn("day", F.to_date("ts"))
    last = events.groupBy(F.col("user_id").alias("u")).agg(F.max("day").alias("last"))
    today = events.join(last, (F.col("user_id") == F.col("u")) & (F.col("day") == F.col("last")))
    done = F.col("event_type") == "purchase"
    rows = today.groupBy("user_id", "day").agg(
        F.countDistinct(F.when(done, F.col("k"))).alias("completed"), F.count_if(F.col("event_type") == "error").alias("attempts"), F.max_by("k", F.struct("ts", "event_id")).alias("last_item"), F.max_by(done, F.struct("ts", "event_id")).alias("ended")
    )
    return rows.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "completed", "attempts", "last_item", "ended")


_BLANKED = f"""w AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents) WHERE len(word) = {LETTERS} GROUP BY 1 HAVING count(*) >= {LEAST}),
p AS (SELECT word, substr(word, 1, i - 1) || '_' || substr(word, i + 1, j - i - 1) || '_' || substr(word, j + 1) AS pattern, word[i] AS a, word[j] AS b FROM w, (SELECT i, j FROM range(1, {LETTERS + 1}) x(i), range(1, {LETTERS + 1}) y(j) WHERE i < j)),
r AS (SELECT word, p.pattern AS pattern, n - 1 AS rivals, rank() OVER (PARTITION BY word ORDER BY n) AS k FROM p JOIN (SELECT pattern, count(*) AS n FROM p GROUP BY 1) c ON c.pattern = p.pattern),
t AS (SELECT word, pattern, rivals, row_number() OVER (PARTITION BY word ORDER BY pattern) - 1 AS place, count(*) OVER (PARTITION BY word) AS ties FROM r WHERE k = 1),
h AS (SELECT word AS doc_id, CAST({_FNV} AS BIGINT) AS seed FROM (SELECT word, word AS s FROM w)), v AS ({_draw("SELECT * FROM h", 1)}),
c AS (SELECT word, pattern, rivals FROM t JOIN v ON v.doc_id = word WHERE place = least(floor(value * ties), ties - 1))"""
_SWAP = "lambda s, x: CASE WHEN split_part(x, ':', 1) = split_part(x, ':', 2) THEN s ELSE substr(s, 1, split_part(x, ':', 2)::BIGINT) || substr(s, split_part(x, ':', 1)::BIGINT + 1, 1) || substr(s, split_part(x, ':', 2)::BIGINT + 2, split_part(x, ':', 1)::BIGINT - split_part(x, ':', 2)::BIGINT - 1) || substr(s, split_part(x, ':', 2)::BIGINT + 1, 1) || substr(s, split_part(x, ':', 1)::BIGINT + 2) END"
_SCRAMBLED = f"""w AS ({_WORDS}), h AS (SELECT s AS word, CAST({_FNV} AS BIGINT) AS seed FROM (SELECT word AS s FROM w)), i AS (SELECT word, seed, unnest(range(1, len(word))) AS i FROM h),
a AS (SELECT word, i, (seed + {0x6D2B79F5} * (len(word) - i)) & 4294967295 AS a FROM i), t AS (SELECT word, i, {_MUL.format(a='xor(a, a >> 15)', b='a | 1')} AS t FROM a),
u AS (SELECT word, i, xor(t, (t + {_MUL.format(a='xor(t, t >> 7)', b='t | 61')}) & 4294967295) AS u FROM t), j AS (SELECT word, i, CAST(floor(xor(u, u >> 14) / 4294967296.0::DOUBLE * (i + 1)) AS BIGINT) AS j FROM u),
l AS (SELECT word, list(i || ':' || j ORDER BY i DESC) AS steps FROM j GROUP BY 1), m AS (SELECT w.word AS word, list_reduce(list_prepend(w.word, coalesce(steps, [])), {_SWAP}) AS m FROM w LEFT JOIN l ON l.word = w.word)"""
_NAMES = (scrambles, letter_masks, next_picks, playable_days, session_walk)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLES = {
    "scrambles": f"WITH {_SCRAMBLED} SELECT word, list_filter(list_transform(range(len(word)), lambda r: substr(m, r + 1) || substr(m, 1, r)), lambda x: x <> word)[1] AS scramble FROM m",
    "letter_masks": f"WITH {_BLANKED}, l AS (SELECT pattern, unnest([a, b]) AS x FROM p), z AS (SELECT c.word AS word, string_agg(DISTINCT x, '' ORDER BY x) AS decoys FROM c JOIN l ON l.pattern = c.pattern WHERE NOT contains(c.word, x) GROUP BY 1) SELECT c.word AS word, pattern, rivals, coalesce(decoys, '') AS decoys FROM c LEFT JOIN z ON z.word = c.word",
    "next_picks": f"WITH l AS (SELECT user_id, event_type, max(row(ts, event_id)) AS w FROM events GROUP BY 1, 2), p AS (SELECT unnest({list(POOL)}) AS e, unnest(range({len(POOL)})) AS k), u AS (SELECT user_id, arg_min(event_type, w) AS oldest FROM l GROUP BY 1) SELECT user_id, coalesce((SELECT arg_min(e, k) FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = u.user_id AND event_type = e)), oldest) AS next FROM u",
    "playable_days": f"SELECT o_orderpriority, strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS day, CAST(greatest(0, least(date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '{TODAY}') * 86400000, 604800000)) AS BIGINT) AS remaining_ms FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{TODAY}' GROUP BY 1",
    "session_walk": "WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS last FROM events) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(DISTINCT CASE WHEN event_type = 'purchase' THEN k END) AS completed, count(*) FILTER (WHERE event_type = 'error') AS attempts, max_by(k, row(ts, event_id)) AS last_item, max_by(event_type = 'purchase', row(ts, event_id)) AS ended FROM e WHERE day = last GROUP BY user_id, day",
}
