"""Conflicting facts into one row: precedence windows, ordered and unordered unions, censuses, and gates with a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.texts import multiset_key
from wordloom.sources.shared import written
from wordloom.sources.tables import table

#: The spoken sources; the languages and part types that may occur; rows that the capped ledger serves.
SPOKEN, LANGUAGES, ALLOWED_TYPES, CAP = ("src1", "src2", "src3"), ("de", "en", "es", "fr", "it", "pt"), ("ECONOMY", "STANDARD", "PROMO"), 500
#: Bands of the served parts: name, least and greatest size, greatest stratum.
BANDS = (("easy", 1, 15, 2), ("medium", 10, 30, 3), ("hard", 25, 50, 4))


def first_match(gates: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first gate that stops a row."""
    out = None
    for name, stops in gates:
        out = F.when(stops, name) if out is None else out.when(stops, name)
    return out.otherwise(otherwise)


def ledger(gated: DataFrame, names: list[str]) -> DataFrame:
    """gate and rows for every gate, those that stopped nothing included; rows add up to the input's."""
    known = gated.sparkSession.createDataFrame([(n,) for n in names], "gate string")
    return known.join(gated.groupBy("gate").agg(F.count(F.lit(1)).alias("n")), "gate", "left").select("gate", F.coalesce("n", F.lit(0)).alias("rows"))


def single_slot(facts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The fact of each key that comes first."""
    return facts.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def single_slot_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The document that each language and source is published with: labelled before unlabelled, then quality, size, id."""
    facts = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    best = single_slot(facts, ["lang", "source"], [F.col("quality").isNull(), F.desc("quality"), F.desc("n_chars"), F.col("doc_id")])
    return best.select("lang", "source", "doc_id", "n_chars")


def ordered_union_senses(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation the distinct texts of its turns, in the order of their first occurrence. A conversation's turns are one row's worth."""
    turns = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return listed.select("conv_id", F.array_join(F.col("l")["text"], "|").alias("senses"))


def set_union_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Per part type the sorted set of its brands less the least one; none if nothing is left."""
    sets = table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("all"))
    rest = F.array_remove("all", F.element_at("all", 1))
    return sets.select("p_type", F.when(F.size(rest) > 0, F.array_join(rest, ",")).alias("brands"))


def spoken_share(spark: SparkSession, d: str) -> DataFrame:
    """Per language the characters and the share of spoken sources, null without any; half-even rounding."""
    sums = table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("frequency"), F.sum(F.when(F.col("source").isin(*SPOKEN), F.col("n_chars")).otherwise(0)).alias("spoken"))
    return sums.select("lang", "frequency", F.when(F.col("frequency") > 0, F.bround(F.col("spoken") / F.col("frequency"), 6)).alias("spoken_ratio"))


def attestation_counts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return facts.groupBy("lang").agg(F.countDistinct("source").alias("attestations"), F.countDistinct(F.when(F.col("quality") == 1, F.col("source"))).alias("tier1"))


def class_census_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(x,) for x in LANGUAGES], "lang string")
    return known.join(table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))


def measured_positive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("measured"), F.count_if(F.col("value") > 50).alias("positive"))


def closed_vocabulary_breaches(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([(x,) for x in ALLOWED_TYPES], "p_type string")
    return table(spark, d, "part").join(F.broadcast(allowed), "p_type", "left_anti").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))  # a few rows


_GATES = ["tooShort", "unlabelled", "poor", "toxic", "otherLanguage", "kept"]


def gated_documents(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    stops = [F.col("n_chars") < 300, F.col("quality").isNull(), F.col("quality") == 0, F.col("toxic") == 1, ~F.col("lang").isin("en", "fr")]
    return facts.withColumn("gate", first_match(list(zip(_GATES, stops, strict=False)), "kept"))


def gate_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger(gated_documents(spark, d), _GATES)


def gate_ledger_capped(spark: SparkSession, d: str) -> DataFrame:
    """Parts by their first failing gate, the CAP most ordered of the rest served and the others charged to the cap."""
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("frequency"))
    parts = table(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    parts = parts.withColumn("gate", first_match([("length", ~F.col("p_size").between(5, 45)), ("frequency", F.col("frequency") < 20)], "passed"))
    served = parts.where("gate = 'passed'").orderBy(F.desc("frequency"), "p_partkey").limit(CAP).select("p_partkey", F.lit(True).alias("served"))
    out = parts.join(served, "p_partkey", "left")
    return ledger(out.withColumn("gate", F.when(F.col("served"), "kept").when(F.col("gate") == "passed", "capped").otherwise(F.col("gate"))), ["length", "frequency", "capped", "kept"])


def places(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with `place`, from 0, in the order within `by`, and `size`, the rows of the group. No task holds a whole group.

    Rows are dealt to ranges of the order and numbered inside each; a range's numbers begin where those of the ranges
    before it end. rows must not have two with the same `by` and order.
    """
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))  # as many rows as ranges and groups
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_{c}") for c in by], before.alias("_before"), F.sum("_n").over(group).alias("size"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    numbered = ranged.withColumn("_inside", inside).join(counts, same)
    return numbered.withColumn("place", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_p", "_before", *[f"_{c}" for c in by])


def strata(rows: DataFrame, by: str, frequency: str, key: str) -> DataFrame:
    """`stratum` 1 to 4: place * 4 div size, places by falling frequency and then key, within `by`."""
    return places(rows, [by], [F.desc(frequency), F.asc(key)]).withColumn("stratum", F.floor(F.col("place") * 4 / F.col("size")).cast("long") + 1).drop("place", "size")


def frequency_stratum(spark: SparkSession, d: str) -> DataFrame:
    return strata(table(spark, d, "documents"), "lang", "n_chars", "doc_id").select("doc_id", "lang", "stratum")


def anagram_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct part names have the same letters."""
    names = table(spark, d, "part").select("p_name").distinct().withColumn("key", multiset_key(F.split("p_name", "")))
    return names.withColumn("fan_out", F.count(F.lit(1)).over(Window.partitionBy("key"))).select("p_name", "fan_out")


def clueable_filter(spark: SparkSession, d: str) -> DataFrame:
    """Turns that may serve as a clue: not null, without the role's name, short, without digits."""
    text = F.col("text")
    return table(spark, d, "conversations").where(text.isNotNull() & ~F.contains(F.lower("text"), F.col("role")) & (F.length("text") <= 200) & ~text.rlike("[0-9]")).select("conv_id", "turn")


def difficulty_band(spark: SparkSession, d: str) -> DataFrame:
    """The first band that covers a part's size and the stratum of its price; null where none does."""
    rows = strata(table(spark, d, "part"), "p_type", "p_retailprice", "p_partkey")
    fits = [(name, F.col("p_size").between(low, high) & (F.col("stratum") <= most)) for name, low, high, most in BANDS]
    band = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, fit in fits:
        band = band.when(fit, name)
    return rows.select("p_partkey", "stratum", band.alias("band"))


def stratified_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Per part type an order in which every prefix draws evenly from the strata: the depth within the stratum, then the stratum."""
    rows = strata(table(spark, d, "part"), "p_type", "p_retailprice", "p_partkey")
    rows = rows.withColumn("mixed", F.md5(F.col("p_partkey").cast("string")))
    rows = places(rows, ["p_type", "stratum"], [F.asc("mixed")]).withColumnRenamed("place", "depth").drop("size")
    return places(rows, ["p_type"], [F.asc("depth"), F.asc("stratum")]).select("p_partkey", "p_type", (F.col("place") + 1).alias("place"))


def theme_division(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders of every priority: relational division."""
    orders = table(spark, d, "orders")
    every = orders.select("o_orderpriority").distinct().agg(F.count(F.lit(1)).alias("all"))
    each = orders.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"), F.count(F.lit(1)).alias("orders"))
    return each.join(F.broadcast(every), F.col("n") == F.col("all"), "left_semi").select("o_custkey", "orders")  # one row


def ledger_anti_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Customers of each day who order on no other day."""
    days = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date")).distinct()
    once = days.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("date")).where("n = 1")
    return once.select("o_custkey", F.date_format("date", "yyyy-MM-dd").alias("date"))


def best_run_per_length(spark: SparkSession, d: str) -> DataFrame:
    """Per user and event type the event of greatest value, the earliest of equals."""
    best = single_slot(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("value"), F.col("ts"), F.col("event_id")])
    return best.select("user_id", "event_type", "event_id", "value")


def hint_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Per turn the hints that can be given, in order, without those that give the role away; three at most."""
    rows = table(spark, d, "conversations")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    candidates = F.array(F.substring("text", 1, 3), F.element_at(words, 1), F.try_element_at(words, F.lit(2)), F.concat(F.lit("length "), F.size(words).cast("string")))
    usable = F.filter(candidates, lambda h: h.isNotNull() & (h != "") & ~F.contains(F.lower(h), F.col("role")))
    return rows.select("conv_id", "turn", F.array_join(F.slice(usable, 1, 3), "|").alias("hints"))


_FACTS = "f AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
_STRATA = "s AS (SELECT *, CAST((row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) - 1) * 4 // count(*) OVER (PARTITION BY p_type) + 1 AS BIGINT) AS stratum FROM part)"
_NAMES = (
    single_slot_precedence, ordered_union_senses, set_union_resolution, spoken_share, attestation_counts, class_census_zero_filled, measured_positive, closed_vocabulary_breaches, gate_ledger,
    gate_ledger_capped, frequency_stratum, anagram_fan_out, clueable_filter, difficulty_band, stratified_interleave, theme_division, ledger_anti_repeat, best_run_per_length, hint_ladder,
)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLES = {
    "single_slot_precedence": f"WITH {_FACTS} SELECT lang, source, doc_id, n_chars FROM f QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY quality IS NULL, quality DESC NULLS LAST, n_chars DESC, doc_id) = 1",
    "ordered_union_senses": "WITH t AS (SELECT conv_id, text, min(turn) AS turn FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2) SELECT conv_id, string_agg(text, '|' ORDER BY turn, text) AS senses FROM t GROUP BY 1",
    "set_union_resolution": "WITH b AS (SELECT DISTINCT p_type, p_brand FROM part), r AS (SELECT *, min(p_brand) OVER (PARTITION BY p_type) AS first FROM b) SELECT p_type, string_agg(p_brand, ',' ORDER BY p_brand) FILTER (WHERE p_brand <> first) AS brands FROM r GROUP BY 1",
    "spoken_share": f"SELECT lang, CAST(sum(n_chars) AS BIGINT) AS frequency, CASE WHEN sum(n_chars) > 0 THEN round_even(sum(CASE WHEN source IN {SPOKEN} THEN n_chars ELSE 0 END) / sum(n_chars), 6) END AS spoken_ratio FROM documents GROUP BY 1",
    "attestation_counts": f"WITH {_FACTS} SELECT lang, count(DISTINCT source) AS attestations, count(DISTINCT CASE WHEN quality = 1 THEN source END) AS tier1 FROM f GROUP BY 1",
    "class_census_zero_filled": f"SELECT lang, (SELECT count(*) FROM documents d WHERE d.lang = k.lang) AS n FROM (SELECT unnest({list(LANGUAGES)}) AS lang) k",
    "measured_positive": "SELECT event_type, count(value) AS measured, count(*) FILTER (WHERE value > 50) AS positive FROM events GROUP BY 1",
    "closed_vocabulary_breaches": f"SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN {ALLOWED_TYPES} GROUP BY 1",
    "gate_ledger": f"WITH {_FACTS}, g AS (SELECT CASE WHEN n_chars < 300 THEN 'tooShort' WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'poor' WHEN toxic = 1 THEN 'toxic' WHEN lang NOT IN ('en', 'fr') THEN 'otherLanguage' ELSE 'kept' END AS gate FROM f) SELECT gate, (SELECT count(*) FROM g WHERE g.gate = k.gate) AS rows FROM (SELECT unnest({_GATES}) AS gate) k",
    "gate_ledger_capped": f"WITH s AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT p_partkey, coalesce(n, 0) AS n, CASE WHEN p_size NOT BETWEEN 5 AND 45 THEN 'length' WHEN coalesce(n, 0) < 20 THEN 'frequency' ELSE 'passed' END AS g FROM part LEFT JOIN s ON p_partkey = l_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, p_partkey) AS k FROM p), o AS (SELECT CASE WHEN g <> 'passed' THEN g WHEN k <= {CAP} THEN 'kept' ELSE 'capped' END AS gate FROM r) SELECT gate, (SELECT count(*) FROM o WHERE o.gate = x.gate) AS rows FROM (SELECT unnest(['length', 'frequency', 'capped', 'kept']) AS gate) x",
    "frequency_stratum": "SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1) * 4 // count(*) OVER (PARTITION BY lang) + 1 AS BIGINT) AS stratum FROM documents",
    "anagram_fan_out": "WITH n AS (SELECT DISTINCT p_name, list_sort(string_split(p_name, '')) AS k FROM part) SELECT p_name, count(*) OVER (PARTITION BY k) AS fan_out FROM n",
    "clueable_filter": "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND NOT contains(lower(text), role) AND len(text) <= 200 AND NOT regexp_matches(text, '[0-9]')",
    "difficulty_band": f"WITH {_STRATA} SELECT p_partkey, stratum, CASE " + " ".join(f"WHEN p_size BETWEEN {a} AND {b} AND stratum <= {m} THEN '{n}'" for n, a, b, m in BANDS) + " END AS band FROM s",
    "stratified_interleave": f"WITH {_STRATA}, x AS (SELECT *, row_number() OVER (PARTITION BY p_type, stratum ORDER BY md5(CAST(p_partkey AS VARCHAR))) AS depth FROM s) SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY depth, stratum, p_partkey) AS place FROM x",
    "theme_division": "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)",
    "ledger_anti_repeat": "SELECT o_custkey, strftime(min(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS date FROM orders GROUP BY 1 HAVING count(DISTINCT CAST(o_orderdate AS DATE)) = 1",
    "best_run_per_length": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, ts, event_id) = 1",
    "hint_ladder": "WITH c AS (SELECT *, string_split(coalesce(text, ''), ' ') AS w FROM conversations), h AS (SELECT conv_id, turn, list_filter([substr(text, 1, 3), w[1], w[2], 'length ' || len(w)], lambda h: h IS NOT NULL AND h <> '' AND NOT contains(lower(h), role)) AS h FROM c) SELECT conv_id, turn, array_to_string(h[1:3], '|') AS hints FROM h",
}
