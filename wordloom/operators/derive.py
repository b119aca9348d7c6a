"""Served word lists: entries of the lexicon through thirteen ordered gates, and what is worked out over those that are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import letters as L
from wordloom.functions.texts import multiset_key, tokens, units
from wordloom.operators.classes import _POP, _SHAPES, JUDGED_ROWS, LEAST_DISTINCT, MOST_UNITS, refusal, spelled, uses
from wordloom.operators.resolution import first_match, ledger
from wordloom.sources.shared import kept, spread, written
from wordloom.sources.tables import table

#: What a list takes: languages and sources, least and most units, least attestations (of all and of good quality) and frequency, longest meaning, words.
LANGUAGES, SOURCES, LENGTHS, ATTESTED, FREQUENCY, MEANING, WORDS = ("en", "fr", "de"), tuple(f"src{k}" for k in range(15)), (3, 10), (2, 1), 3, 600, 300
#: Marks in a first meaning that refuse a word; endings that do: units of the tail, vowel sign before it, least units of the stem.
OBSCENE, SUFFIXES = ("thth", "###"), ((("ள்",), "ெ", 2), (("ட்",), "ெ", 1))
GATES = ["outsideClass", "outsideCategories", "outsidePos", "outsideLength", "belowAttestations", "belowFrequency", "withoutMeaning", "withoutClue", "obscene", "participial", "denylisted", "capped", "kept"]


def entries(spark: SparkSession, d: str) -> DataFrame:
    """surface, word (as spelled), categories, pos, attestations, tier_one, frequency and meaning (null if none).

    The meaning of a surface is the turn that follows the first one with it: least conversation, then least turn.
    """
    rows = uses(spark, d).groupBy("surface").agg(
        F.collect_set("lang").alias("categories"),
        F.collect_set("source").alias("pos"),
        F.size(F.collect_set(F.when(F.col("quality") == 1, F.col("source")))).cast("long").alias("tier_one"),
        F.sum("n").alias("frequency"),
    )
    rows = rows.withColumn("attestations", F.size("pos").cast("long"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    first = turns.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("surface"), "conv_id", "turn").groupBy("surface").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    asked = first.select("surface", F.col("at.conv_id").alias("conv_id"), (F.col("at.turn") + 1).alias("turn"))
    meanings = asked.join(turns.groupBy("conv_id", "turn").agg(F.min("text").alias("meaning")), ["conv_id", "turn"]).select("surface", "meaning")
    return spread(written(rows.join(meanings, "surface", "left"), "entries"), JUDGED_ROWS).withColumn("word", spelled(F.col("surface")))


def clueable(surface: Column, meaning: Column, most: int) -> Column:
    """Whether a meaning can stand as a clue: it is there, short, does not say the word and has no digits."""
    return F.coalesce(~F.contains(F.lower(meaning), surface) & (F.length(meaning) <= most) & ~meaning.rlike("[0-9]"), F.lit(False))


def gated(spark: SparkSession, d: str) -> DataFrame:
    """entries() with the first gate that stops each; worked out once for all queries over the same tables."""
    return kept(spark, "gates", d, ("documents", "labels", "benchmark", "conversations"), lambda: _gated(spark, d))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d)
    overlap = lambda c, wanted: F.coalesce(F.arrays_overlap(F.col(c), F.array(*map(F.lit, wanted))), F.lit(False))
    parts = units(F.col("word"))
    denied = table(spark, d, "benchmark").where("item_id % 5 = 0").select(F.explode(tokens(F.col("text"))).alias("surface")).distinct().withColumn("denied", F.lit(True))
    rows = spread(written(rows.join(denied, "surface", "left"), "spelled"), JUDGED_ROWS).withColumn("s", L.shape(F.col("word")))
    participial = F.lit(False)
    for tail, link, stem in SUFFIXES:
        participial = participial | L.ends_in_suffix(parts, tail, link, stem)
    obscene = F.lit(False)
    for mark in OBSCENE:
        obscene = obscene | F.contains(F.lower("meaning"), F.lit(mark))
    stops = [
        refusal(F.col("word"), F.col("s")).isNotNull(),
        ~overlap("categories", LANGUAGES),
        ~overlap("pos", SOURCES),
        ~F.size(parts).between(*LENGTHS),
        (F.col("attestations") < ATTESTED[0]) | (F.col("tier_one") < ATTESTED[1]),
        F.col("frequency") < FREQUENCY,
        F.col("meaning").isNull(),
        ~clueable(F.col("surface"), F.col("meaning"), MEANING),
        obscene,
        participial,
        F.coalesce("denied", F.lit(False)),
    ]
    rows = written(rows.withColumn("gate", first_match(list(zip(GATES, stops, strict=False)), "kept")).select("surface", "word", "frequency", "gate"), "gated")
    served = rows.where("gate = 'kept'").orderBy(F.desc("frequency"), "surface").limit(WORDS).select("surface", F.lit(True).alias("served"))  # a list has WORDS words
    return rows.join(served, "surface", "left").withColumn("gate", F.when((F.col("gate") == "kept") & F.col("served").isNull(), "capped").otherwise(F.col("gate"))).drop("served")


def list_ledger(spark: SparkSession, d: str) -> DataFrame:
    """gate and rows of all thirteen buckets; rows add up to the entries."""
    return ledger(gated(spark, d), GATES)


def served_list(spark: SparkSession, d: str) -> DataFrame:
    """surface, frequency, stratum and fan_out of the words that are served; both are worked out after the cap."""
    rows = gated(spark, d).where("gate = 'kept'")
    every = Window.partitionBy()  # WORDS rows at most
    stratum = ((F.row_number().over(every.orderBy(F.desc("frequency"), "surface")) - 1) * 4 / F.count(F.lit(1)).over(every)).cast("long") + 1
    fan_out = F.count(F.lit(1)).over(Window.partitionBy(multiset_key(units(F.col("word")))))
    return rows.select("surface", "frequency", stratum.alias("stratum"), fan_out.alias("fan_out"))


def _ends() -> str:
    one = "(len(u) >= {n} + 1 + {stem} AND u[len(u) - {n} + 1:] = {tail} AND substr(u[len(u) - {n}], 2) = '{link}')"
    return " OR ".join(one.format(n=len(tail), stem=stem, tail=list(tail), link=link) for tail, link, stem in SUFFIXES)


_GATED = f"""{_POP}, {_SHAPES}, us AS (SELECT lang, source, quality, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS surface FROM documents LEFT JOIN labels USING (doc_id)),
en AS (SELECT surface, list(DISTINCT lang) AS categories, list(DISTINCT source) AS pos, count(DISTINCT source) AS attestations, count(DISTINCT CASE WHEN quality = 1 THEN source END) AS tier_one, count(*) AS frequency FROM us GROUP BY 1),
tu AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS surface FROM conversations), fi AS (SELECT surface, min(row(conv_id, turn)) AS w FROM tu GROUP BY 1),
nx AS (SELECT conv_id, turn, min(text) AS meaning FROM conversations GROUP BY 1, 2), me AS (SELECT surface, meaning FROM fi JOIN nx ON nx.conv_id = struct_extract(w, 1) AND nx.turn = struct_extract(w, 2) + 1 WHERE meaning IS NOT NULL),
de AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS surface FROM benchmark WHERE item_id % 5 = 0),
ga AS (SELECT en.surface AS surface, pop.word AS word, frequency, CASE WHEN has_foreign OR NOT all_letters OR len(u) > {MOST_UNITS} OR len(u) > 1 AND len(list_distinct(u)) < {LEAST_DISTINCT} THEN 'outsideClass' WHEN NOT list_has_any(categories, {list(LANGUAGES)}) THEN 'outsideCategories' WHEN NOT list_has_any(pos, {list(SOURCES)}) THEN 'outsidePos'
  WHEN len(u) NOT BETWEEN {LENGTHS[0]} AND {LENGTHS[1]} THEN 'outsideLength' WHEN attestations < {ATTESTED[0]} OR tier_one < {ATTESTED[1]} THEN 'belowAttestations' WHEN frequency < {FREQUENCY} THEN 'belowFrequency' WHEN meaning IS NULL THEN 'withoutMeaning'
  WHEN contains(lower(meaning), en.surface) OR len(meaning) > {MEANING} OR regexp_matches(meaning, '[0-9]') THEN 'withoutClue' WHEN {" OR ".join(f"contains(lower(meaning), '{m}')" for m in OBSCENE)} THEN 'obscene' WHEN {_ends()} THEN 'participial'
  WHEN en.surface IN (SELECT surface FROM de) THEN 'denylisted' ELSE 'kept' END AS gate FROM en JOIN pop ON pop.surface = en.surface JOIN sh ON sh.word = pop.word LEFT JOIN me ON me.surface = en.surface),
gc AS (SELECT surface, word, frequency, CASE WHEN gate = 'kept' AND row_number() OVER (PARTITION BY gate ORDER BY frequency DESC, surface) > {WORDS} THEN 'capped' ELSE gate END AS gate FROM ga)"""
QUERIES = {f.__name__: f for f in (list_ledger, served_list)}
ORACLES = {
    "list_ledger": f"WITH {_GATED} SELECT gate, (SELECT count(*) FROM gc WHERE gc.gate = k.gate) AS rows FROM (SELECT unnest({GATES}) AS gate) k",
    "served_list": f"WITH {_GATED}, x AS (SELECT surface, frequency, list_sort(regexp_extract_all(word, '(?s).[{L.SIGNS}]*')) AS k FROM gc WHERE gate = 'kept') SELECT surface, frequency, CAST((row_number() OVER (ORDER BY frequency DESC, surface) - 1) * 4 // count(*) OVER () + 1 AS BIGINT) AS stratum, count(*) OVER (PARTITION BY k) AS fan_out FROM x",
}
