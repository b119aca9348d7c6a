"""Ladders: climbs from word to word by one more letter, with the letters on offer and what else they spell.

All starts climb at once, one join a rung. A step goes to the neighbour that leaves the rarest rung of the whole climb
as frequent as can be; a neighbour whose word was served already is taken only where no other one gets to the top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import texts as X
from wordloom.operators import graphs as G
from wordloom.operators.corpus import observations, totals
from wordloom.operators.graphs import _FNV, _FOLD, _LADDER, _MUL
from wordloom.sources.shared import written
from wordloom.sources.tables import table

#: Rungs of a climb, and letters on offer.
RUNGS, BANK = 4, 6


def shuffled(rows: DataFrame, items: str, seed: Column, out: str) -> DataFrame:
    """rows with `out`: the array `items` in the order of a Fisher-Yates seeded by a text. The same text and array give the same order."""
    n = F.size(items)
    rows = rows.withColumn("_seed", X.fnv1a(seed))
    drawn = lambda i: F.struct(i.alias("i"), F.floor(X.mulberry(F.col("_seed"), (n - i).cast("long")) * (i + 1)).cast("int").alias("j"))
    swap = lambda a, x: F.transform(a, lambda y, k: F.when(k == x["i"], F.get(a, x["j"])).when(k == x["j"], F.get(a, x["i"])).otherwise(y))
    places = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_drawn", F.transform(places, drawn))
    return rows.withColumn(out, F.aggregate("_drawn", F.col(items), swap)).drop("_seed", "_drawn")


def spellings(seen: DataFrame) -> DataFrame:
    """surface, key and frequency of the words of a ladder's lengths."""
    words = totals(seen).where(f"length(surface) BETWEEN 2 AND {G.LONGEST} AND total >= {G.LEAST}")
    return words.select("surface", F.array_join(F.array_sort(F.split("surface", "")), "").alias("key"), F.col("total").alias("frequency"))


def added(low: Column, high: Column) -> Column:
    """The letter that the key `high` has more than `low`: where they part, or the last one."""
    places = F.sequence(F.lit(1), F.length(high))
    return F.substr(high, F.get(F.filter(places, lambda i: F.substr(high, i, F.lit(1)) != F.substr(low, i, F.lit(1))), F.lit(0)), F.lit(1))


def climb(words: DataFrame, served: DataFrame, rungs: int = RUNGS, bank: int = BANK) -> DataFrame:
    """start, rung (1 the start), key, word, bank and also, for every key from which a climb of `rungs` rungs begins.

    words has surface, key and frequency; a key stands for its most frequent word, the least of equals. served has the
    surfaces that a step avoids if another one can finish. Ties between steps, and the order of the bank, are drawn by
    the start's key. The bank, the same for all rungs of a climb, has the letters that are added and, up to `bank`,
    others that some step of this climb could add, then any that a word has. also lists what else the bank spells at
    the rung, from the rung below; the start has none.
    """
    best = written(words.groupBy("key").agg(F.max("frequency").alias("frequency"), F.min_by("surface", F.struct(-F.col("frequency"), "surface")).alias("word")), "keys")
    nodes = best.select("key", "frequency", F.length("key").alias("length"))
    edges = written(G.ladder_up(nodes).withColumn("letter", added(F.col("low"), F.col("high"))), "edges")
    able = written(G.climbs(nodes, edges, rungs), "able")
    stale = served.select("surface").distinct().select(F.col("surface").alias("word"), F.lit(True).alias("stale"))
    ahead = best.join(stale, "word", "left").join(able, "key").select(F.col("key").alias("high"), "rungs", F.coalesce("stale", F.lit(False)).alias("stale"), F.least("frequency", F.coalesce("promise", "frequency")).alias("score"))
    ahead = written(ahead, "ahead")
    at = able.where(F.col("rungs") == rungs).select(F.col("key").alias("start"), "key", F.array("key").alias("chain"))
    for k in range(1, rungs):
        options = edges.join(ahead.where(F.col("rungs") == rungs - k), "high").select("low", F.struct("letter", "high", "stale", "score").alias("o"))
        each = at.join(options, F.col("key") == F.col("low")).groupBy("start", "chain").agg(F.array_sort(F.collect_list("o")).alias("all"))  # a letter once
        fresh = F.filter("all", lambda o: ~o["stale"])
        each = shuffled(each.withColumn("open", F.when(F.size(fresh) > 0, fresh).otherwise(F.col("all"))), "open", F.concat("start", F.lit(f"|rung{k}")), "order")
        taken = F.get(F.filter("order", lambda o: o["score"] == F.array_max(F.col("open")["score"])), F.lit(0))["high"]
        at = written(each.select("start", taken.alias("key"), F.concat("chain", F.array(taken)).alias("chain")), f"rung{k}")
    return _with_bank(at.select("start", "chain"), words, best, edges, bank)


def _with_bank(climbs: DataFrame, words: DataFrame, best: DataFrame, edges: DataFrame, bank: int) -> DataFrame:
    n = F.size("chain")
    needed = F.transform(F.sequence(F.lit(1), n - 1), lambda k: added(F.get("chain", k - 1), F.get("chain", k)))
    below = climbs.select("start", F.explode(F.slice("chain", F.lit(1), n - 1)).alias("low"))
    near = below.join(edges.select("low", "letter"), "low").groupBy("start").agg(F.array_sort(F.collect_set("letter")).alias("near"))
    letters = words.select(F.explode(F.split("key", "")).alias("letter")).distinct().agg(F.array_sort(F.collect_set("letter")).alias("letters"))  # one row
    rows = climbs.withColumn("needed", needed).join(near, "start").join(F.broadcast(letters))
    rows = shuffled(rows.withColumn("plausible", F.array_except("near", "needed")), "plausible", F.concat("start", F.lit("|decoy")), "pool")
    rows = shuffled(rows.withColumn("others", F.array_except(F.array_except("letters", "needed"), "pool")), "others", F.concat("start", F.lit("|spare")), "spare")
    rows = rows.withColumn("bank", F.concat("needed", F.slice(F.concat("pool", "spare"), F.lit(1), F.greatest(F.lit(bank) - F.size("needed"), F.lit(0)))))
    rows = written(shuffled(rows, "bank", F.concat("start", F.lit("|bank")), "offer").select("start", "chain", "offer"), "banks")
    each = rows.select("start", "offer", F.posexplode("chain").alias("k", "key"), "chain").withColumn("below", F.when(F.col("k") > 0, F.get("chain", F.col("k") - 1)))
    each = each.join(best.select("key", "word"), "key")
    tried = each.where("k > 0").select("start", "k", "word", F.explode(F.array_distinct("offer")).alias("letter"), "below")
    tried = tried.withColumn("key", F.array_join(F.array_sort(F.concat(F.split("below", ""), F.array("letter"))), "")).join(words.select("key", "surface"), "key").where("surface <> word")
    also = tried.groupBy("start", "k").agg(F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("also"))
    out = each.join(also, ["start", "k"], "left")
    return out.select("start", (F.col("k") + 1).alias("rung"), "key", "word", F.array_join("offer", "").alias("bank"), F.coalesce("also", F.lit("")).alias("also"))


def ladder_climbs(spark: SparkSession, d: str) -> DataFrame:
    """Climbs over the words of documents; the benchmark's words are those already served."""
    words = written(spellings(observations(table(spark, d, "documents"))), "spellings")
    served = table(spark, d, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("surface"))
    return climb(words, served)


def _mixed(name: str, source: str) -> str:
    """CTEs, the last of them `name` (id, m): the letters s of each row of the source (id, s, seed text t) in seeded order."""
    swap = "lambda s, x: list_transform(range(1, len(s) + 1), lambda k: CASE WHEN k = x // 1000 + 1 THEN s[x % 1000 + 1] WHEN k = x % 1000 + 1 THEN s[x // 1000 + 1] ELSE s[k] END)"
    p = f"{name}_"
    return f"""{p}s AS ({source}), {p}h AS (SELECT id, l, CAST({_FNV} AS BIGINT) AS seed FROM (SELECT id, s AS l, t AS s FROM {p}s)), {p}i AS (SELECT id, len(l) AS n, seed, unnest(range(1, len(l))) AS i FROM {p}h),
{p}a AS (SELECT id, i, (seed + {0x6D2B79F5} * (n - i)) & 4294967295 AS a FROM {p}i), {p}t AS (SELECT id, i, {_MUL.format(a='xor(a, a >> 15)', b='a | 1')} AS t FROM {p}a),
{p}u AS (SELECT id, i, xor(t, (t + {_MUL.format(a='xor(t, t >> 7)', b='t | 61')}) & 4294967295) AS u FROM {p}t), {p}j AS (SELECT id, i, CAST(floor(xor(u, u >> 14) / 4294967296.0::DOUBLE * (i + 1)) AS BIGINT) AS j FROM {p}u),
{p}l AS (SELECT id, list(i * 1000 + j ORDER BY i DESC) AS steps FROM {p}j GROUP BY 1), {name} AS (SELECT h.id AS id, list_reduce(coalesce(steps, []), {swap}, l) AS m FROM {p}h h LEFT JOIN {p}l l ON l.id = h.id)"""


def _step(k: int) -> str:
    return f"""o{k} AS (SELECT start, chain, letter, high, stale, score FROM c{k} JOIN el ON low = chain[-1] JOIN ah ON ah.key = high AND rungs = {RUNGS - k}),
q{k} AS (SELECT * FROM o{k} WHERE NOT stale OR start NOT IN (SELECT start FROM o{k} WHERE NOT stale)), {_mixed(f"m{k}", f"SELECT start AS id, list(letter ORDER BY letter) AS s, start || '|rung{k}' AS t FROM q{k} GROUP BY 1")},
c{k + 1} AS (SELECT start, list_append(any_value(chain), arg_min(high, list_position(m, letter))) AS chain FROM (SELECT *, max(score) OVER (PARTITION BY start) AS top FROM q{k}) JOIN m{k} ON m{k}.id = start WHERE score = top GROUP BY 1)"""


_KEY = "array_to_string(list_sort(string_split({}, '')), '')"
QUERIES = {"ladder_climbs": ladder_climbs}
ORACLES = {
    "ladder_climbs": f"""WITH RECURSIVE {_LADDER}, {_FOLD}, w AS (SELECT surface, {_KEY.format("surface")} AS key, total FROM o), b AS (SELECT key, arg_min(surface, row(-total, surface)) AS word FROM w GROUP BY 1),
sv AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS s FROM benchmark), el AS (SELECT low, high, list_filter(range(1, len(high) + 1), lambda i: substr(high, i, 1) <> substr(low, i, 1))[1] AS i, substr(high, i, 1) AS letter FROM u),
ah AS (SELECT n.key AS key, rungs, word IN (SELECT s FROM sv) AS stale, least(n.frequency, promise) AS score FROM n JOIN (SELECT key, rungs, max(promise) AS promise FROM f GROUP BY 1, 2) f ON f.key = n.key JOIN b ON b.key = n.key),
c1 AS (SELECT DISTINCT key AS start, [key] AS chain FROM f WHERE rungs = {RUNGS}), {", ".join(_step(k) for k in range(1, RUNGS))},
nd AS (SELECT start, chain, list_transform(range(1, {RUNGS}), lambda k: list_filter(range(1, len(chain[k + 1]) + 1), lambda i: substr(chain[k + 1], i, 1) <> substr(chain[k], i, 1))[1]) AS pl FROM c{RUNGS}),
ne AS (SELECT start, chain, list_transform(range(1, {RUNGS}), lambda k: substr(chain[k + 1], pl[k], 1)) AS needed FROM nd),
nr AS (SELECT start, list(DISTINCT letter ORDER BY letter) AS near FROM (SELECT start, unnest(chain[:{RUNGS - 1}]) AS low FROM ne) JOIN el USING (low) GROUP BY 1), al AS (SELECT list(DISTINCT x ORDER BY x) AS letters FROM (SELECT unnest(string_split(key, '')) AS x FROM w)),
{_mixed("po", "SELECT start AS id, list_filter(near, lambda x: NOT list_contains(needed, x)) AS s, start || '|decoy' AS t FROM ne JOIN nr USING (start)")},
{_mixed("sp", "SELECT start AS id, list_filter(letters, lambda x: NOT list_contains(needed, x) AND NOT list_contains(po.m, x)) AS s, start || '|spare' AS t FROM ne JOIN po ON po.id = start, al")},
{_mixed("of", f"SELECT start AS id, needed || (po.m || sp.m)[:{BANK - RUNGS + 1}] AS s, start || '|bank' AS t FROM ne JOIN po ON po.id = start JOIN sp ON sp.id = start")},
r AS (SELECT start, of.m AS offer, chain, unnest(range(1, {RUNGS + 1})) AS rung FROM ne JOIN of ON of.id = start), s AS (SELECT start, CAST(rung AS INTEGER) AS rung, chain[rung] AS key, CASE WHEN rung > 1 THEN chain[rung - 1] END AS below, offer, word FROM r JOIN b ON b.key = chain[rung]),
ty AS (SELECT DISTINCT start, rung, surface FROM (SELECT start, rung, word, {_KEY.format("below || x")} AS k FROM (SELECT start, rung, word, below, unnest(offer) AS x FROM s WHERE rung > 1)) JOIN w ON w.key = k WHERE surface <> word), al2 AS (SELECT start, rung, string_agg(surface, ',' ORDER BY surface) AS also FROM ty GROUP BY 1, 2)
SELECT s.start, s.rung, key, word, array_to_string(offer, '') AS bank, coalesce(also, '') AS also FROM s LEFT JOIN al2 ON al2.start = s.start AND al2.rung = s.rung"""
}
