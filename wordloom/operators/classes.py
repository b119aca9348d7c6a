"""What kind of word a surface is: letters and shapes, a cascade over signals and evidence, and the reviews of its verdicts.

The tables hold words in Latin letters. spelled() writes each of them in Tamil letters, so that the rules of that script
have something to judge; different words may be spelled alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import letters as L
from wordloom.functions.texts import SIGNS, first_letter_hex, tokens, unit_kind, units
from wordloom.operators.corpus import _OBS, _SCORES, BREADTH, DICTIONARY, DISTANCE, letter_neighbours, ngram_scores, observations
from wordloom.sources.shared import kept, spread, written
from wordloom.sources.tables import table

#: What an illegal opening, an illegal ending, an illegal cluster and a borrowed letter cost.
WEIGHTS = (0.3, 0.3, 0.4, 0.0)
#: Units at most, and distinct ones at least, of a word; the least shape score of a headword.
MOST_UNITS, LEAST_DISTINCT, HEADWORD_SHAPE = 25, 2, 0.6
#: Least shape, breadth and n-gram score of a discovery; the n-gram score that a typo stays below, and the closeness it reaches.
DISCOVERY, TYPO = (0.6, 3, 0.05), (0.05, 1.0)
#: What a source may assert, strongest first; all verdicts; the sources whose word counts as an entry.
EVIDENCE = ("notAWord", "properNoun", "boundStem", "colloquial")
CLASSES = ("headword", "inflected", "loanword", "sandhiArtifact", "suspectedTypo", "unclassified", *EVIDENCE)
TIER_ONE = ("src0", "src1", "src2", "src3", "src4")

#: Words whose letters a task judges.
JUDGED_ROWS = 20_000
#: Labels that are broadcast, of some 20 bytes each; more are joined by a shuffle, which takes the texts along.
MOST_LABELS = 1_000_000

PLAIN, WRITTEN = "bcdfghjklmnpqrstvwxyaeiou", "பசடனஙயஜகலமணறஃரளதவழஷஞாெிொு"
OPEN, OPENED = "aeiou", "அஎஇஒஉ"


def spelled(token: Column) -> Column:
    """A word of a-z in Tamil letters: vowels as signs (at the start as letters), a pulli between consonants and at a closing one."""
    hard = "([bcdfghjklmnpqrstvwxy])"
    joined = F.regexp_replace(token, "([ae])[aeiou]", "$1")
    for _ in range(2):
        joined = F.regexp_replace(joined, hard + hard, f"$1{L.PULLI}$2")
    joined = F.regexp_replace(joined, hard + "$", f"$1{L.PULLI}")
    return F.concat(F.translate(F.translate(F.substring(joined, 1, 1), OPEN, OPENED), PLAIN, WRITTEN), F.translate(F.substr(joined, F.lit(2)), PLAIN, WRITTEN))


def uses(spark: SparkSession, d: str) -> DataFrame:
    """surface, source, lang, labelled, quality, toxic and n: how often documents with these hold the surface. All else is worked out from this, so texts are read once."""
    labels = table(spark, d, "labels").withColumn("labelled", F.lit(True))
    few = labels.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    docs = table(spark, d, "documents").join(F.broadcast(labels) if few else labels, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    by = ["source", "lang", "labelled", "quality", "toxic"]
    return docs.select(*by, F.explode(tokens(F.col("text"))).alias("surface")).groupBy("surface", *by).agg(F.count(F.lit(1)).alias("n"))


def population(spark: SparkSession, d: str, seen: DataFrame | None = None) -> DataFrame:
    """surface and word: the surfaces of documents and of the benchmark, each once, and how they are spelled. seen: the uses(), if they are there already."""
    seen = _words_of(table(spark, d, "documents")) if seen is None else seen.select("surface")
    return seen.unionAll(_words_of(table(spark, d, "benchmark"))).distinct().withColumn("word", spelled(F.col("surface")))


def spellings(spark: SparkSession, d: str) -> DataFrame:
    """word: the distinct words of the population; worked out once for all queries over the same tables.

    Surfaces are written before they are spelled: of two distinct() in a row Spark keeps the last, and would spell each
    place of a text.
    """

    def make() -> DataFrame:
        surfaces = _words_of(table(spark, d, "documents")).unionAll(_words_of(table(spark, d, "benchmark"))).distinct()
        return spread(written(surfaces, "surfaces"), JUDGED_ROWS).select(spelled(F.col("surface")).alias("word")).distinct()

    return spread(kept(spark, "words", d, ("documents", "benchmark"), make), JUDGED_ROWS)


def unit_segments(spark: SparkSession, d: str) -> DataFrame:
    """word, place, unit, kind and the base letter's hex of every word."""
    words = spellings(spark, d)
    rows = words.select("word", F.posexplode(units(F.col("word"))).alias("place", "unit"))
    return rows.select("word", F.col("place").cast("long"), "unit", unit_kind(F.col("unit")).alias("kind"), first_letter_hex(F.col("unit")).alias("hex"))


def letter_defects(spark: SparkSession, d: str) -> DataFrame:
    """unit, n (words with it), defect (null for letters) and label (null for others)."""
    words = spellings(spark, d)
    each = words.select(F.explode(F.array_distinct(units(F.col("word")))).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return each.select("unit", "n", L.letter_defect(F.col("unit")).alias("defect"), L.roman(F.col("unit")).alias("label"))


def word_shapes(spark: SparkSession, d: str) -> DataFrame:
    """word, what its shape keeps and breaks, and the score of that."""
    words = spellings(spark, d).withColumn("s", L.shape(F.col("word")))
    return words.select("word", "s.*", L.orthotactic(F.col("s"), *WEIGHTS).alias("score"))


def refusal(word: Column, shape: Column) -> Column:
    """The first clause for which a string is no word; null if it passes all."""
    parts = units(word)
    return (
        F.when(F.length(word) == 0, "empty")
        .when(shape["has_foreign"], "nonTamil")
        .when(~shape["all_letters"], "malformedEzhuthu")
        .when(F.size(parts) > MOST_UNITS, "tooLong")
        .when((F.size(parts) > 1) & (F.size(F.array_distinct(parts)) < LEAST_DISTINCT), "repeatedEzhuthu")
    )


def asserted(evidence: Column) -> Column:
    """The strongest of the asserted classes; null for none."""
    ranks = F.transform(evidence, lambda e: F.array_position(F.array(*map(F.lit, EVIDENCE)), e))
    return F.get(F.array(*map(F.lit, EVIDENCE)), (F.array_min(ranks) - 1).cast("int"))


def is_discovery() -> Column:
    shape, breadth, ngram = DISCOVERY
    return (F.col("attested") == 0) & (F.col("orthotactic") >= shape) & (F.col("breadth") >= breadth) & (F.col("ngram") >= ngram)


def word_class() -> Column:
    """The class by one expression: no word at all, what a source said, a headword, why not, and the rest."""
    s = F.col("s")
    headword = F.col("entry") & ~s["has_foreign"] & ~s["has_grantha"] & s["initial_legal"] & s["final_legal"] & s["clusters_legal"] & (F.col("orthotactic") >= HEADWORD_SHAPE)
    typo = (F.col("attested") == 0) & (F.col("listed") == 0) & (F.col("ngram") < TYPO[0]) & (F.coalesce("neighbour", F.lit(-1.0)) >= TYPO[1])
    return (
        F.when(F.col("refusal").isNotNull(), "notAWord")
        .when(F.col("said").isNotNull(), F.col("said"))
        .when(headword, "headword")
        .when(F.col("verb_form") > 0, "inflected")
        .when(s["has_foreign"], "suspectedTypo")
        .when(s["has_grantha"], "loanword")
        .when(~s["final_legal"], "sandhiArtifact")
        .when(~s["initial_legal"] | ~s["clusters_legal"], "loanword")
        .when(is_discovery(), "unclassified")
        .when(typo, "suspectedTypo")
        .otherwise("unclassified")
    )


def _flag(words: DataFrame, there: DataFrame, name: str) -> DataFrame:
    """words with 1 or 0 for whether `there` has the surface."""
    return words.join(there.select("surface", F.lit(1).alias(name)).distinct(), "surface", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def _words_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(tokens(F.col("text"))).alias("surface"))


def evidence_of(seen: DataFrame) -> DataFrame:
    """surface and evidence: what each source says of a surface, by its labelled documents that hold it.

    It is colloquial if all of them are toxic, a proper noun if all are of low quality and not English, and no word if
    some are of low quality and English. The last is dropped where the same source also uses it in a good one.
    """
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    bad, english = F.col("quality") == 0, F.col("lang") == "en"
    said = seen.where("labelled").groupBy("surface", "source").agg(F.sum("n").alias("all"), of(F.col("toxic") == 1).alias("toxic"), of(F.col("quality") == 1).alias("good"), of(bad & english).alias("denied"), of(bad & ~english).alias("named"))
    names = F.array_compact(F.array(F.when((F.col("denied") > 0) & (F.col("good") == 0), "notAWord"), F.when(F.col("named") == F.col("all"), "properNoun"), F.when(F.col("toxic") == F.col("all"), "colloquial")))
    return said.select("surface", F.explode(names).alias("said")).groupBy("surface").agg(F.collect_set("said").alias("evidence"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    """surface, word and its signals: attested, listed, verb_form (0 or 1), entry, breadth, ngram, orthotactic, neighbour (null where not asked) and evidence.

    neighbour is the closeness, in letters, of the nearest frequent word that is wholly Tamil.
    """
    seen = written(uses(spark, d), "uses")
    known = written(seen.groupBy("surface").agg(F.sum("n").alias("total"), F.size(F.collect_set("source")).alias("breadth"), F.bool_or(F.col("source").isin(*TIER_ONE) & (F.col("quality") == 1)).alias("entry")), "totals")
    turns = table(spark, d, "conversations")
    words = _flag(population(spark, d, known), _words_of(table(spark, d, "benchmark")), "attested")
    words = _flag(words, _words_of(turns.where("role = 'user'")), "listed")
    words = _flag(words, _words_of(turns.where("role = 'assistant'")).where("length(surface) >= 9"), "verb_form")
    words = words.join(known, "surface", "left").withColumns({"breadth": F.coalesce("breadth", F.lit(0)), "total": F.coalesce("total", F.lit(0)), "entry": F.coalesce("entry", F.lit(False))})
    scores = ngram_scores(known.select("surface"), known.where(f"total >= {DICTIONARY}").select("surface"))
    words = words.join(scores.withColumnRenamed("score", "ngram"), "surface", "left").withColumn("ngram", F.coalesce("ngram", F.lit(0.0)))
    words = words.join(evidence_of(seen), "surface", "left")
    asked = (F.col("attested") == 0) & (F.col("verb_form") == 0) & (F.col("breadth") < BREADTH)
    words = spread(written(words.withColumn("asked", asked), "population"), JUDGED_ROWS).withColumn("s", L.shape(F.col("word")))
    words = written(words.withColumns({"orthotactic": L.orthotactic(F.col("s"), *WEIGHTS), "refusal": refusal(F.col("word"), F.col("s")), "said": asserted(F.col("evidence"))}), "signals")
    heads = words.where((F.col("total") >= DICTIONARY) & ~F.col("s.has_foreign"))
    near = letter_neighbours(words.where("asked").select("word"), heads.select("word"))
    words = words.join(near.select("word", "closeness"), "word", "left")
    return words.withColumn("neighbour", F.when(F.col("asked"), F.coalesce("closeness", F.lit(0.0)))).drop("asked", "closeness")


def letter_distance(spark: SparkSession, d: str) -> DataFrame:
    """word, distance and closeness, in letters, of all words that no benchmark item uses, to the words of frequent surfaces."""
    known = written(_words_of(table(spark, d, "documents")).groupBy("surface").agg(F.count(F.lit(1)).alias("total")), "totals")
    attested = _words_of(table(spark, d, "benchmark")).distinct()
    word = spelled(F.col("surface")).alias("word")
    return letter_neighbours(known.join(attested, "surface", "left_anti").select(word), known.where(f"total >= {DICTIONARY}").select(word))


def classified(spark: SparkSession, d: str) -> DataFrame:
    """signals() with the class of each surface; worked out once for all queries over the same tables."""
    return kept(spark, "classified", d, ("documents", "labels", "benchmark", "conversations"), lambda: signals(spark, d).withColumn("class", word_class()))


def classify_cascade(spark: SparkSession, d: str) -> DataFrame:
    """surface and class of the whole population."""
    return classified(spark, d).select("surface", "class")


def class_census(spark: SparkSession, d: str) -> DataFrame:
    """class and n for all ten classes, and how many are discoveries."""
    every = spark.createDataFrame([(c,) for c in CLASSES], "class string")
    counts = classified(spark, d).withColumn("found", is_discovery()).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("discoveries"))
    return every.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("discoveries", F.lit(0)).alias("discoveries"))


def review_unclassified(spark: SparkSession, d: str) -> DataFrame:
    """The unclassified surfaces with their signals and number of units."""
    rows = classified(spark, d).where("class = 'unclassified'")
    return rows.select("surface", "attested", "listed", "verb_form", "breadth", "ngram", "orthotactic", "neighbour", F.size(units(F.col("word"))).cast("long").alias("length"))


def review_refused(spark: SparkSession, d: str) -> DataFrame:
    """The surfaces that are no words, and why: the clause they fail, or sourceDenied."""
    return classified(spark, d).where("class = 'notAWord'").select("surface", F.coalesce("refusal", F.lit("sourceDenied")).alias("reason"))


def review_meaningless(spark: SparkSession, d: str) -> DataFrame:
    """Headwords and loanwords that no benchmark item uses, with the sources that do use them."""
    rows = classified(spark, d).where(F.col("class").isin("headword", "loanword")).select("surface", "class")
    meant = _words_of(table(spark, d, "benchmark")).distinct()
    used = observations(table(spark, d, "documents")).groupBy("surface").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return rows.join(meant, "surface", "left_anti").join(used, "surface", "left").select("surface", "class", "sources")


_LEAD = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(surface, '([ae])[aeiou]', '\\1', 'g'), '([bcdfghjklmnpqrstvwxy])([bcdfghjklmnpqrstvwxy])', '\\1{L.PULLI}\\2', 'g'), '([bcdfghjklmnpqrstvwxy])([bcdfghjklmnpqrstvwxy])', '\\1{L.PULLI}\\2', 'g'), '([bcdfghjklmnpqrstvwxy])$', '\\1{L.PULLI}')"
_POP = f"""pop AS (SELECT surface, translate(translate(substr(j, 1, 1), '{OPEN}', '{OPENED}'), '{PLAIN}', '{WRITTEN}') || translate(substr(j, 2), '{PLAIN}', '{WRITTEN}') AS word FROM (SELECT surface, {_LEAD} AS j FROM (
  SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS surface FROM documents UNION SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) FROM benchmark)))"""


def _kind(x: str) -> str:
    consonant = f"{x}[1] BETWEEN 'க' AND 'ஹ'"
    return f"CASE WHEN {x}[1] BETWEEN 'அ' AND 'ஔ' THEN 'uyir' WHEN {x}[1] = '{L.AYTHAM}' THEN 'aytham' WHEN {consonant} AND contains({x}, '{L.PULLI}') AND NOT regexp_matches({x}, '[ா-ௌௗ]') THEN 'mei' WHEN {consonant} THEN 'uyirmei' ELSE 'other' END"


def _defect(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 'empty' WHEN NOT contains('{L.VOWELS}{L.CONSONANTS}{L.BORROWED}{L.AYTHAM}', {x}[1]) THEN 'base' WHEN contains('{L.VOWELS}{L.AYTHAM}', {x}[1]) AND len({x}) > 1 THEN 'standalone' WHEN len({x}) > 2 THEN 'signs' WHEN len({x}) = 2 AND NOT contains('{L.VOWEL_SIGNS}{L.PULLI}', {x}[2]) THEN 'sign' END"


def _row(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


_SPLIT = f"list_transform(regexp_extract_all(word, '(?s).[{SIGNS}]*'), lambda x: x)"
_LABEL = f"""CASE WHEN defect IS NULL THEN coalesce(element_at({_row(dict(zip(L.VOWELS, L.VOWEL_ROMAN, strict=True)) | {L.AYTHAM: L.AYTHAM_ROMAN})}, unit[1])[1],
  element_at({_row(L.CONSONANT_ROMAN)}, unit[1])[1] || CASE WHEN len(unit) = 1 THEN 'a' WHEN unit[2] = '{L.PULLI}' THEN '' ELSE element_at({_row(dict(zip(L.VOWEL_SIGNS, L.VOWEL_ROMAN[1:], strict=True)))}, unit[2])[1] END) END"""
#: Whether the consonant b may stand after the consonant a, which bears a pulli.
_MEET = f"""(contains('{L.BORROWED}', b) OR contains('{L.CONSONANTS}', b) AND CASE WHEN contains('{L.HARD}', a) THEN contains('{L.HARD}', b) WHEN contains('{L.SOFT}', a) THEN contains('{L.HARD}{L.AFTER_SOFT}', b) OR a = b ELSE NOT (contains('{L.SINGLE}', a) AND a = b) END)"""
_SHAPES = f"""uw AS (SELECT DISTINCT word, {_SPLIT} AS u FROM pop), ku AS (SELECT word, u, list_transform(u, lambda x: {_kind('x')}) AS k FROM uw),
bad AS (SELECT DISTINCT word FROM (SELECT word, u[i] AS m, u[i][1] AS a, u[i + 1][1] AS b FROM (SELECT word, u, unnest(range(1, len(u))) AS i FROM ku)) WHERE len(m) = 2 AND m[2] = '{L.PULLI}' AND contains('{L.CONSONANTS}', a) AND NOT {_MEET}),
sh AS (SELECT word, u, k[1] = 'uyir' OR k[1] = 'uyirmei' AND contains('{L.OPENING}', u[1][1]) AS initial_legal, k[-1] <> 'mei' OR len(u[-1]) = 2 AND contains('{L.CLOSING}', u[-1][1]) AS final_legal, word NOT IN (SELECT word FROM bad) AS clusters_legal,
  len(list_filter(u, lambda x: contains('{L.BORROWED}', x[1]))) > 0 AS has_grantha, list_contains(k, 'other') AS has_foreign, len(list_filter(u, lambda x: ({_defect('x')}) IS NOT NULL)) = 0 AS all_letters FROM ku),
sc AS (SELECT *, CASE WHEN has_foreign THEN 0.0 ELSE round(greatest(0.0, 1.0 - CASE WHEN initial_legal THEN 0.0 ELSE {WEIGHTS[0]} END - CASE WHEN final_legal THEN 0.0 ELSE {WEIGHTS[1]} END - CASE WHEN clusters_legal THEN 0.0 ELSE {WEIGHTS[2]} END - CASE WHEN has_grantha THEN {WEIGHTS[3]} ELSE 0.0 END), 6) END::DOUBLE AS score FROM sh)"""
#: Distances in units of the words {asked} to the words {heads}, of those that share what is left after up to two deletions.
_DROP = "list_transform(range(1, len({x}) + 1), lambda {i}: {x}[:{i} - 1] || {x}[{i} + 1:])"
_LEFT = f"list_distinct(list_transform([u] || {_DROP.format(x='u', i='i')} || flatten(list_transform({_DROP.format(x='u', i='i')}, lambda y: {_DROP.format(x='y', i='j')})), lambda z: array_to_string(z, '|')))"
_DIFFER = "len(list_filter(range(1, len(y) + 1), lambda k: {x}[k] <> y[k]))"
_NEAR = f"""qa AS ({{asked}}), ha AS ({{heads}}), qv AS (SELECT word, u, unnest({_LEFT}) AS v FROM qa), hv AS (SELECT u AS h, unnest({_LEFT}) AS v FROM ha), pr AS (SELECT DISTINCT word, u, h FROM qv JOIN hv ON qv.v = hv.v),
lo AS (SELECT word, u = h AS same, CASE WHEN len(u) >= len(h) THEN u ELSE h END AS x, CASE WHEN len(u) >= len(h) THEN h ELSE u END AS y FROM pr),
dd AS (SELECT word, CASE WHEN same THEN 0 WHEN len(x) = len(y) THEN least({_DIFFER.format(x='x')}, CASE WHEN list_has_any({_DROP.format(x='x', i='i')}, {_DROP.format(x='y', i='i')}) THEN 2 ELSE 3 END)
  WHEN len(x) = len(y) + 1 THEN 1 + least(list_min(list_transform({_DROP.format(x='x', i='i')}, lambda z: {_DIFFER.format(x='z')})), 2) ELSE 2 END AS d FROM lo),
nd AS (SELECT qa.word AS word, coalesce(least(min(d), {DISTANCE + 1}), {DISTANCE + 1})::BIGINT AS distance, CASE WHEN coalesce(min(d), 9) > {DISTANCE} THEN 0.0 ELSE 1.0 / greatest(min(d), 1) END::DOUBLE AS closeness FROM qa LEFT JOIN dd ON dd.word = qa.word GROUP BY 1)"""
_TOK = "unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'))"
_CLASSES = f"""{_OBS}, fx AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), t AS (SELECT surface, sum(count) AS total, count(*) AS breadth FROM obs GROUP BY 1), tr AS (SELECT surface FROM t WHERE total >= {DICTIONARY}), {_SCORES},
{_POP}, {_SHAPES}, att AS (SELECT DISTINCT {_TOK} AS s FROM benchmark), li AS (SELECT DISTINCT {_TOK} AS s FROM conversations WHERE role = 'user'), vf AS (SELECT DISTINCT s FROM (SELECT {_TOK} AS s FROM conversations WHERE role = 'assistant') WHERE len(s) >= 9),
en AS (SELECT DISTINCT {_TOK} AS s FROM fx WHERE source IN {TIER_ONE} AND quality = 1),
fa AS (SELECT s, source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS tox, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0 AND lang = 'en') AS den, count(*) FILTER (WHERE quality = 0 AND lang <> 'en') AS nam
  FROM (SELECT source, lang, quality, toxic, {_TOK} AS s FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2),
ev AS (SELECT s, min(CASE WHEN den > 0 AND good = 0 THEN {EVIDENCE.index("notAWord") + 1} WHEN nam = n THEN {EVIDENCE.index("properNoun") + 1} WHEN tox = n THEN {EVIDENCE.index("colloquial") + 1} END) AS best FROM fa GROUP BY 1),
{_NEAR.format(asked=f"SELECT word, u FROM sh WHERE word IN (SELECT pop.word FROM pop LEFT JOIN t ON t.surface = pop.surface WHERE coalesce(t.breadth, 0) < {BREADTH} AND pop.surface NOT IN (SELECT s FROM att) AND pop.surface NOT IN (SELECT s FROM vf))", heads="SELECT word, u FROM sh WHERE NOT has_foreign AND word IN (SELECT word FROM pop JOIN tr ON tr.surface = pop.surface)")},
si AS (SELECT p.surface, p.word, u, initial_legal, final_legal, clusters_legal, has_grantha, has_foreign, all_letters, sc.score AS orthotactic, CAST(p.surface IN (SELECT s FROM att) AS INTEGER) AS attested, CAST(p.surface IN (SELECT s FROM li) AS INTEGER) AS listed, CAST(p.surface IN (SELECT s FROM vf) AS INTEGER) AS verb_form,
  p.surface IN (SELECT s FROM en) AS entry, coalesce(t.breadth, 0) AS breadth, coalesce(scored.score, 0.0) AS ngram, {list(EVIDENCE)}[best] AS said, coalesce(nd.closeness, 0.0) AS near
  FROM pop p JOIN sc ON p.word = sc.word LEFT JOIN t ON t.surface = p.surface LEFT JOIN scored ON scored.surface = p.surface LEFT JOIN ev ON ev.s = p.surface LEFT JOIN nd ON nd.word = p.word),
sn AS (SELECT *, CASE WHEN attested = 0 AND verb_form = 0 AND breadth < {BREADTH} THEN near END::DOUBLE AS neighbour, attested = 0 AND orthotactic >= {DISCOVERY[0]} AND breadth >= {DISCOVERY[1]} AND ngram >= {DISCOVERY[2]} AS found,
  CASE WHEN has_foreign THEN 'nonTamil' WHEN NOT all_letters THEN 'malformedEzhuthu' WHEN len(u) > {MOST_UNITS} THEN 'tooLong' WHEN len(u) > 1 AND len(list_distinct(u)) < {LEAST_DISTINCT} THEN 'repeatedEzhuthu' END AS refusal FROM si),
cl AS MATERIALIZED (SELECT *, CASE WHEN refusal IS NOT NULL THEN 'notAWord' WHEN said IS NOT NULL THEN said WHEN entry AND NOT has_foreign AND NOT has_grantha AND initial_legal AND final_legal AND clusters_legal AND orthotactic >= {HEADWORD_SHAPE} THEN 'headword' WHEN verb_form > 0 THEN 'inflected' WHEN has_foreign THEN 'suspectedTypo'
  WHEN has_grantha THEN 'loanword' WHEN NOT final_legal THEN 'sandhiArtifact' WHEN NOT initial_legal OR NOT clusters_legal THEN 'loanword' WHEN found THEN 'unclassified' WHEN attested = 0 AND listed = 0 AND ngram < {TYPO[0]} AND coalesce(neighbour, -1) >= {TYPO[1]} THEN 'suspectedTypo' ELSE 'unclassified' END AS class FROM sn)"""

_NAMES = (unit_segments, letter_defects, word_shapes, letter_distance, classify_cascade, class_census, review_unclassified, review_refused, review_meaningless)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLES = {
    "unit_segments": f"WITH {_POP}, uw AS (SELECT DISTINCT word, {_SPLIT} AS u FROM pop), x AS (SELECT word, unnest(u) AS unit, unnest(range(len(u))) AS place FROM uw) SELECT word, place, unit, {_kind('unit')} AS kind, lpad(lower(to_hex(unicode(unit))), 4, '0') AS hex FROM x",
    "letter_defects": f"WITH {_POP}, uw AS (SELECT DISTINCT word, {_SPLIT} AS u FROM pop), x AS (SELECT unit, count(*) AS n FROM (SELECT DISTINCT word, unnest(u) AS unit FROM uw) GROUP BY 1), y AS (SELECT unit, n, {_defect('unit')} AS defect FROM x) SELECT unit, n, defect, {_LABEL} AS label FROM y",
    "word_shapes": f"WITH {_POP}, {_SHAPES} SELECT word, initial_legal, final_legal, clusters_legal, has_grantha, has_foreign, all_letters, score FROM sc",
    "letter_distance": f"WITH {_OBS}, {_POP}, t AS (SELECT surface, sum(count) AS total FROM obs GROUP BY 1), uw AS (SELECT surface, word, {_SPLIT} AS u FROM pop), "
    + _NEAR.format(
        asked="SELECT DISTINCT word, u FROM uw WHERE surface IN (SELECT surface FROM obs) AND surface NOT IN (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) FROM benchmark)",
        heads=f"SELECT DISTINCT word, u FROM uw WHERE surface IN (SELECT surface FROM t WHERE total >= {DICTIONARY})",
    )
    + " SELECT * FROM nd",
    "classify_cascade": f"WITH {_CLASSES} SELECT surface, class FROM cl",
    "class_census": f"WITH {_CLASSES}, e AS (SELECT unnest({list(CLASSES)}) AS class) SELECT e.class AS class, count(cl.class) AS n, count(*) FILTER (WHERE found) AS discoveries FROM e LEFT JOIN cl ON e.class = cl.class GROUP BY 1",
    "review_unclassified": f"WITH {_CLASSES} SELECT surface, attested, listed, verb_form, breadth, ngram, orthotactic, neighbour, len(u) AS length FROM cl WHERE class = 'unclassified'",
    "review_refused": f"WITH {_CLASSES} SELECT surface, coalesce(refusal, 'sourceDenied') AS reason FROM cl WHERE class = 'notAWord'",
    "review_meaningless": f"WITH {_CLASSES}, us AS (SELECT surface, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM obs GROUP BY 1) SELECT cl.surface AS surface, class, sources FROM cl LEFT JOIN us ON us.surface = cl.surface WHERE class IN ('headword', 'loanword') AND cl.surface NOT IN (SELECT s FROM att)",
}
