"""Signals of surfaces (words) over a corpus of observations: totals, breadth, rank, Zipf residual, n-grams, neighbours."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.deletion_marks import bitmap, close_marks, far_heads, far_marks, marker
from wordloom.functions.texts import SIGNS, bounded_distance, tokens, units
from wordloom.sources.shared import spread, written
from wordloom.sources.tables import table

#: Words whose variants a task makes; variants that it joins.
MARKED_ROWS, JOINED_ROWS = 40_000, 400_000
#: Private characters that stand for a script's units, one each; the first is for units that no dictionary word has.
FOREIGN, FIRST_CODE, LAST_CODE = 0xE000, 0xE001, 0xF8FF
#: Smoothing of the n-gram model, its order; edit distance; frequency of a dictionary word; breadth that needs no neighbour.
SMOOTHING, ORDER, DISTANCE, DICTIONARY, BREADTH = 0.1, 3, 2, 20, 3


def observations(docs: DataFrame) -> DataFrame:
    """source, surface and count: equal surfaces of a source are summed."""
    return docs.select("source", F.explode(tokens(F.col("text"))).alias("surface")).groupBy("source", "surface").agg(F.count(F.lit(1)).alias("count"))


def breadth(seen: DataFrame) -> DataFrame:
    return seen.groupBy("surface").agg(F.countDistinct("source").alias("breadth"))


def totals(seen: DataFrame) -> DataFrame:
    return seen.groupBy("surface").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("breadth"))


def zipf(seen: DataFrame) -> DataFrame:
    """surface, total, breadth, rank (ties share, then skip) and residual of log10 total on log10 rank. seen is read twice.

    Ranks are made over the distinct totals, of which there are at most about the square root of twice the tokens, and
    so is the line: a total weighs as many times as it has surfaces. Without spread all residuals are 0.
    """
    each = written(totals(seen), "totals")
    groups = each.where("total > 0").groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("rank", 1 + F.coalesce(F.sum("n").over(above), F.lit(0)))
    x, y, n = F.log10(F.col("rank")), F.log10(F.col("total")), F.col("n")
    sums = ranked.agg(F.sum(n).alias("w"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * x * y).alias("sxy"))
    spread = F.col("w") * F.col("sxx") - F.col("sx") * F.col("sx")
    line = sums.select(F.when(F.abs(spread) > 1e-12, (F.col("w") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).alias("slope"), "w", "sx", "sy")
    line = line.withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("w"))
    rated = ranked.join(F.broadcast(line)).select("total", "rank", F.round(F.coalesce(y - F.col("intercept") - F.col("slope") * x, F.lit(0.0)), 6).alias("residual"))  # one row
    return each.join(rated, "total").select("surface", "total", "breadth", "rank", "residual")


def trigrams(words: DataFrame) -> DataFrame:
    """context (two units), unit and count over the padded distinct words."""
    padded = F.concat(F.lit("^" * (ORDER - 1)), "surface", F.lit("$"))
    starts = F.sequence(F.lit(1), F.length(padded) - ORDER + 1)
    grams = words.select(F.explode(F.transform(starts, lambda i: F.substr(padded, i, F.lit(ORDER)))).alias("gram"))
    return grams.groupBy(F.substring("gram", 1, ORDER - 1).alias("context"), F.substring("gram", ORDER, 1).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def ngram_scores(words: DataFrame, training: DataFrame) -> DataFrame:
    """surface and the geometric mean of its units' probabilities under an add-k model of the training words.

    Besides the training words' units the vocabulary holds the end and one unit for all others. A unit that never
    followed its context has what smoothing leaves it there; after a context that was never seen all are equally
    likely. Logs are added up in order of place. Model tables are as large as the script allows, not as the corpus.
    """
    grams = written(trigrams(training), "trigrams")
    contexts = grams.groupBy("context").agg(F.sum("n").alias("total"))
    alphabet = sorted(r.unit for r in grams.where("unit <> '$'").select("unit").distinct().collect())  # the script's letters
    mass = SMOOTHING * (len(alphabet) + 2)
    seen = written(grams.join(contexts, "context").select(F.concat("context", "unit").alias("gram"), F.log10((F.col("n") + SMOOTHING) / (F.col("total") + mass)).alias("logp")), "model")
    heads = written(contexts.select("context", F.log10(SMOOTHING / (F.col("total") + mass)).alias("unseen")), "contexts")
    known = F.regexp_replace("surface", f"[^{re.escape(''.join(alphabet))}]", "\ue000") if alphabet else F.regexp_replace("surface", ".", "\ue000")
    padded = F.concat(F.lit("^" * (ORDER - 1)), known, F.lit("$"))
    starts = F.sequence(F.lit(1), F.length(padded) - ORDER + 1)
    places = words.select("surface", F.posexplode(F.transform(starts, lambda i: F.substr(padded, i, F.lit(ORDER)))).alias("place", "gram"))
    places = places.join(seen, "gram", "left").join(heads, F.substring("gram", 1, ORDER - 1) == F.col("context"), "left")
    logp = F.coalesce("logp", "unseen", F.lit(-math.log10(len(alphabet) + 2)))
    logs = places.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("place", logp.alias("logp")))).alias("logs"))
    mean = F.aggregate("logs", F.lit(0.0), lambda s, x: s + x["logp"]) / F.size("logs")
    return logs.select("surface", F.round(F.pow(F.lit(10.0), mean), 6).alias("score"))


def neighbours(asked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """surface, distance (DISTANCE + 1: none) and closeness of the nearest dictionary word, by shared deletion variants, verified.

    Variants go as marks of 64 bits; those of asked words that no dictionary word has stay where they are made, as a
    bitmap of the dictionary's tells. First come those after one deletion; whatever they find is the nearest, and only
    words without a find are asked for what is farther. There who meets is near, so one dictionary word stands for all
    of a mark, and the rest is asked only where it proves not to be near. What is longer than all of the dictionary by
    more than DISTANCE has no neighbour.
    """
    asked, heads = written(asked, "asked"), written(dictionary, "heads")
    longest = heads.agg(F.max(F.length("surface"))).first()[0]
    left = written(asked.where(F.length("surface") <= (-1 if longest is None else longest + DISTANCE)).select("surface").distinct(), "near")
    close = written(_nearest(*_marked(left, heads, close_marks, close_marks)).where(F.col("distance") <= DISTANCE), "close")
    marked, variants = _marked(written(left.join(close, "surface", "left_anti"), "left"), heads, far_marks, far_heads)
    far = written(_nearest(marked, variants, lambda v: v.groupBy("mark").agg(F.min("headword").alias("headword"))), "far")
    missed = far.where(F.col("distance") > DISTANCE)  # different strings of one mark
    if not missed.isEmpty():
        far = far.unionAll(_nearest(marked.join(missed, "surface", "left_semi"), variants))
    found = close.unionAll(far.where(F.col("distance") <= DISTANCE))
    out = asked.join(found, "surface", "left").withColumn("distance", F.coalesce("distance", F.lit(DISTANCE + 1)).cast("long"))
    closeness = F.when(F.col("distance") > DISTANCE, 0.0).otherwise(1.0 / F.greatest("distance", F.lit(1)))
    return out.select("surface", "distance", closeness.alias("closeness"))


def _marked(asked: DataFrame, heads: DataFrame, of: Callable, meeting: Callable) -> tuple[DataFrame, DataFrame]:
    """surface and mark (of) of the asked words, as far as the dictionary may have it; headword and mark (meeting) of the dictionary."""
    right = written(spread(heads.select("surface"), MARKED_ROWS).mapInArrow(marker(of=meeting), "headword string, mark long"), "variants")
    bits = asked.sparkSession.sparkContext.broadcast(bitmap(right))  # MOST_BITS bits at most
    left = spread(asked, MARKED_ROWS).mapInArrow(marker(lambda: bits.value, of), "surface string, mark long")
    return written(left, "marks"), right


def _nearest(marked: DataFrame, variants: DataFrame, meeting: Callable[[DataFrame], DataFrame] = lambda v: v) -> DataFrame:
    """surface and distance (DISTANCE + 1: farther) of the nearest of the headwords that share a mark, of those that meeting() leaves for it."""
    tasks = max(1, -(-max(marked.count(), variants.count()) // JOINED_ROWS))  # of both, or Spark takes as many as its default and deals again
    pairs = marked.repartition(tasks, "mark").join(meeting(variants.repartition(tasks, "mark")), "mark")
    return pairs.groupBy("surface").agg(F.min(bounded_distance(F.col("surface"), F.col("headword"), DISTANCE)).alias("distance"))


def alphabet(words: DataFrame) -> dict[str, str]:
    """The distinct units of the words in order, each with a character of its own. More than there are characters is an error."""
    rows = words.select(F.explode(units(F.col("word"))).alias("unit")).distinct()
    found = sorted(r.unit for r in rows.limit(LAST_CODE - FIRST_CODE + 2).collect())  # a script's letters
    if len(found) > LAST_CODE - FIRST_CODE + 1:
        raise ValueError(f"more than {LAST_CODE - FIRST_CODE + 1} distinct units")
    return {u: chr(FIRST_CODE + k) for k, u in enumerate(found)}


def encoded(words: DataFrame, codes: dict[str, str]) -> DataFrame:
    """word and code: its units as one character each, FOREIGN for those that codes, an alphabet(), does not have. Empty words are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, foreign = re.compile(f"(?s).[{SIGNS}]*").findall, chr(FOREIGN)
        for batch in batches:
            listed = [("".join([codes.get(u, foreign) for u in split(w)])) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed, pa.string())], names=["word", "code"])

    return words.where("word <> ''").select("word").distinct().mapInArrow(run, "word string, code string")


def letter_neighbours(asked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, distance and closeness of the nearest dictionary word, counted in units of the script; both have the column word.

    A sign that changes one letter is one edit, as a letter is, however many characters they are. Units that the
    dictionary does not have differ from all of its own. Repeated words count once, empty ones are left out.
    """
    heads = written(dictionary.select("word").distinct(), "dictionary")
    codes = alphabet(heads)
    words = written(encoded(asked, codes), "encoded")
    found = neighbours(words.select(F.col("code").alias("surface")).distinct(), encoded(heads, codes).select(F.col("code").alias("surface")).distinct())
    return words.join(found, words["code"] == found["surface"]).select("word", "distance", "closeness")


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return observations(table(spark, d, "documents"))


def corpus_zipf_residual(spark: SparkSession, d: str) -> DataFrame:
    return zipf(_seen(spark, d))


def surface_breadth(spark: SparkSession, d: str) -> DataFrame:
    return breadth(_seen(spark, d))


def observation_merge_sum(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d)


def attested_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Whether each surface is attested by the benchmark, as 0.0 or 1.0."""
    attested = table(spark, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("surface")).distinct().withColumn("there", F.lit(1.0))
    population = _seen(spark, d).select("surface").distinct()
    return population.join(attested, "surface", "left").select("surface", F.coalesce("there", F.lit(0.0)).alias("attested"))


def denial_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Labels that no source of good quality backs: toxic rows whose source has no clean row of the same language."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    clean = rows.where("quality = 1 AND toxic = 0").select("lang", "source").distinct()
    evidence = rows.where("toxic = 1").join(clean, ["lang", "source"], "left_anti")
    return evidence.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


def correlated_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each order's line total, and how many orders have as many lines: an aggregate that feeds a lookup."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    sizes = lines.groupBy("n_lines").agg(F.count(F.lit(1)).alias("orders_like_it"))
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").join(sizes, "n_lines", "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("orders_like_it", F.lit(0)).alias("orders_like_it"))


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return trigrams(_seen(spark, d).select("surface").distinct())


def ngram_score(spark: SparkSession, d: str) -> DataFrame:
    """All surfaces under the model of the frequent ones."""
    known = written(totals(_seen(spark, d)), "totals")
    return ngram_scores(known.select("surface"), known.where(f"total >= {DICTIONARY}").select("surface"))


def pruned(known: DataFrame, attested: DataFrame) -> DataFrame:
    """The surfaces that are worth a search for neighbours: neither attested nor of wide breadth."""
    return known.where(f"breadth < {BREADTH}").join(attested, "surface", "left_anti").select("surface")


def neighbour_distance(spark: SparkSession, d: str) -> DataFrame:
    """All surfaces of narrow breadth that the benchmark does not attest, against all frequent surfaces."""
    known = written(totals(_seen(spark, d)), "totals")
    attested = table(spark, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("surface")).distinct()
    return neighbours(pruned(known, attested), known.where(f"total >= {DICTIONARY}").select("surface"))


_OBS = "obs AS (SELECT source, surface, count(*) AS count FROM (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS surface FROM documents) GROUP BY 1, 2)"
_PAD = f"pad AS (SELECT DISTINCT surface, repeat('^', {ORDER - 1}) || surface || '$' AS p FROM obs), pos AS (SELECT surface, p, unnest(range(1, len(p) - {ORDER} + 2)) AS i FROM pad), gr AS (SELECT surface, i, substr(p, i, {ORDER - 1}) AS context, substr(p, i + {ORDER - 1}, 1) AS unit FROM pos), gc AS (SELECT context, unit, count(*) AS n FROM gr GROUP BY 1, 2)"
#: Scores of the surfaces t under the model of the surfaces tr.
_SCORES = f"""pt AS (SELECT surface, '^^' || surface || '$' AS p FROM tr), gt AS (SELECT substr(p, i, 2) AS context, substr(p, i + 2, 1) AS unit FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM pt)),
cn AS (SELECT context, unit, count(*) AS n FROM gt GROUP BY 1, 2), cc AS (SELECT context, count(*) AS total FROM gt GROUP BY 1), al AS (SELECT count(DISTINCT unit) + 1 AS v FROM gt), lt AS (SELECT string_agg(DISTINCT unit, '') AS letters FROM gt WHERE unit <> '$'),
ps AS (SELECT surface, '^^' || array_to_string(list_transform(string_split(surface, ''), lambda c: CASE WHEN contains(letters, c) THEN c ELSE '?' END), '') || '$' AS p FROM t, lt),
gs AS (SELECT surface, substr(p, i, 2) AS context, substr(p, i + 2, 1) AS unit FROM (SELECT surface, p, unnest(range(1, len(p) - 1)) AS i FROM ps)),
ls AS (SELECT surface, CASE WHEN n IS NOT NULL THEN log10((n + {SMOOTHING}) / (total + {SMOOTHING} * v)) WHEN total IS NOT NULL THEN log10({SMOOTHING} / (total + {SMOOTHING} * v)) ELSE log10(1.0 / v) END AS logp
  FROM gs LEFT JOIN cn ON gs.context = cn.context AND gs.unit = cn.unit LEFT JOIN cc ON gs.context = cc.context CROSS JOIN al),
scored AS (SELECT surface, round(pow(10, avg(logp)), 6) AS score FROM ls GROUP BY 1)"""
QUERIES = {f.__name__: f for f in (corpus_zipf_residual, surface_breadth, observation_merge_sum, attested_semi_join, denial_anti_join, correlated_lookup, ngram_counts, ngram_score, neighbour_distance)}
ORACLES = {
    "corpus_zipf_residual": f"""WITH {_OBS}, t AS (SELECT surface, CAST(sum(count) AS BIGINT) AS total, count(DISTINCT source) AS breadth FROM obs GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY total DESC) AS rank FROM t), f AS (SELECT regr_slope(log10(total), log10(rank)) AS s, regr_intercept(log10(total), log10(rank)) AS i FROM r)
SELECT surface, total, breadth, rank, round(log10(total) - i - s * log10(rank), 6) + 0.0 AS residual FROM r, f""",
    "surface_breadth": f"WITH {_OBS} SELECT surface, count(DISTINCT source) AS breadth FROM obs GROUP BY 1",
    "observation_merge_sum": f"WITH {_OBS} SELECT * FROM obs",
    "attested_semi_join": f"WITH {_OBS}, b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS surface FROM benchmark) SELECT surface, CAST(surface IN (SELECT surface FROM b) AS DOUBLE) AS attested FROM (SELECT DISTINCT surface FROM obs)",
    "denial_anti_join": "WITH r AS (SELECT * FROM documents JOIN labels USING (doc_id)) SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM r WHERE toxic = 1 AND NOT EXISTS (SELECT 1 FROM r c WHERE c.quality = 1 AND c.toxic = 0 AND c.lang = r.lang AND c.source = r.source) GROUP BY 1",
    "correlated_lookup": "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(n, 0) AS n_lines, coalesce((SELECT count(*) FROM l x WHERE x.n = l.n), 0) AS orders_like_it FROM orders LEFT JOIN l ON o_orderkey = l_orderkey",
    "ngram_counts": f"WITH {_OBS}, {_PAD} SELECT * FROM gc",
    "ngram_score": f"""WITH {_OBS}, t AS (SELECT surface, sum(count) AS total FROM obs GROUP BY 1), tr AS (SELECT surface FROM t WHERE total >= {DICTIONARY}), {_SCORES}
SELECT surface, score FROM scored""",
    "neighbour_distance": f"""WITH {_OBS}, t AS (SELECT surface, sum(count) AS total, count(*) AS breadth FROM obs GROUP BY 1),
b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS surface FROM benchmark),
h AS (SELECT surface AS headword FROM t WHERE total >= {DICTIONARY}), q AS (SELECT surface FROM t WHERE breadth < {BREADTH} AND surface NOT IN (SELECT surface FROM b)),
n AS (SELECT surface, least(min(levenshtein(surface, headword)), {DISTANCE + 1}) AS distance FROM q LEFT JOIN h ON abs(len(surface) - len(headword)) <= {DISTANCE} GROUP BY 1)
SELECT surface, CAST(coalesce(distance, {DISTANCE + 1}) AS BIGINT) AS distance, CASE WHEN coalesce(distance, {DISTANCE + 1}) > {DISTANCE} THEN 0.0 ELSE 1.0 / greatest(distance, 1) END::DOUBLE AS closeness FROM n""",
}
