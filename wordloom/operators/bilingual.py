"""A bilingual dictionary in file order: entries of one head that follow each other file their terms together.

Runs are found in ranges of the order, each by its own task; what continues over a border is told by one row a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators.classes import _LEAD, OPEN, OPENED, PLAIN, WRITTEN, spelled
from wordloom.sources.shared import spread, written
from wordloom.sources.tables import table

#: Rows of a range; entries that a task parses.
RANGE_ROWS, PARSED_ROWS = 100_000, 20_000
#: Markers of a part of speech as an entry spells them, and what each stands for; the first that fits counts.
MARKERS = {"adj.": "adjective", "adv.": "adverb", "n.": "noun", "v.": "verb"}


def runs(rows: DataFrame, order: list[str], head: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with `run`, the same for rows of one head that follow each other in the order, and different for all others.

    Null heads are equal to each other. Rows that the order does not tell apart come in any order. A run may be as long
    as the table: it is numbered range by range.
    """
    ranges = max(1, math.ceil(rows.count() / range_rows))
    dealt = written(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range").orderBy(*order)
    new = ~F.col(head).eqNullSafe(F.lag(head).over(within)) | (F.row_number().over(within) == 1)
    local = written(dealt.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))), "runs")
    at = F.struct(*order)
    ends = local.groupBy("_range").agg(F.min_by(F.struct(head), at).alias("first"), F.max_by(F.struct(head), at).alias("last"), F.max("_run").alias("most"))
    across = Window.orderBy("_range")  # one row a range
    goes_on = F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(across)) & F.lag("last").over(across).isNotNull(), F.lit(False))
    ends = ends.withColumn("goes_on", goes_on)
    begun = F.when(~(F.col("goes_on") & (F.col("most") == 1)), F.struct("_range", "most"))  # a range of a single run that goes on begins none
    ends = ends.withColumn("begun", F.last(begun, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    owner = ends.withColumn("owner", F.when(F.col("goes_on"), F.lag("begun").over(across))).select("_range", F.col("owner._range").alias("r"), F.col("owner.most").alias("n"))
    known = local.join(F.broadcast(owner), "_range")  # one row a range
    own = (F.col("_run") == 1) & F.col("r").isNotNull()
    run = F.struct(F.when(own, F.col("r")).otherwise(F.col("_range")).alias("range"), F.when(own, F.col("n")).otherwise(F.col("_run")).alias("number"))
    return known.withColumn("run", run).select(*rows.columns, "run")


def entry(text: Column) -> Column:
    """tag (null without a known marker) and terms of an entry: an ASCII lead, then terms between commas, without bracketed parts and closing points."""
    lead = F.ltrim(F.regexp_extract(text, "^([\\x00-\\x7F]*)", 1))
    lead = F.regexp_replace(lead, "^-[0-9][-0-9]*\\s*", "")  # the number of a homograph
    tag = F.coalesce(*[F.when(lead.startswith(m), F.lit(t)) for m, t in MARKERS.items()])
    plain = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, "\\([^()]*\\)", " "), "\\s+", " "))
    terms = F.transform(F.split(F.regexp_replace(text, "^[\\x00-\\x7F]*", ""), ","), lambda x: plain(F.regexp_replace(F.btrim(x), "[.\\s]+$", "")))
    return F.struct(tag.alias("tag"), F.filter(terms, lambda x: x != "").alias("terms"))


def peers(entries: DataFrame) -> DataFrame:
    """word, value and ordinal: for each term filed under one run and tag with others, those others in order.

    entries has run, tag and terms. A term that is filed twice counts once.
    """
    each = entries.select("run", "tag", F.explode("terms").alias("term"))
    filed = each.groupBy("run", "tag").agg(F.array_sort(F.collect_set("term")).alias("all")).where(F.size("all") > 1)
    listed = filed.select("all", F.explode("all").alias("word"))
    return listed.select("word", F.posexplode(F.array_remove("all", F.col("word"))).alias("ordinal", "value"))


def facts(entries: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """word, attr, value and ordinal of a dictionary's entries (head, text and the order's columns), in the order of its file.

    Each term is a headword, translates to the head, and has the entry's part of speech if its marker is known. Terms
    of one run and tag are peers. Entries without a head, a text or a term are rejected, and do not end a run.
    """
    parsed = entries.where("head IS NOT NULL AND text IS NOT NULL").withColumn("e", entry(F.col("text"))).select(*order, "head", "e.tag", "e.terms")
    parsed = written(parsed, "parsed")  # runs() reads it three times
    filed = written(runs(parsed, order, "head", range_rows).where(F.size("terms") > 0), "entries")
    fact = lambda name, value: F.struct(F.lit(name).alias("attr"), value.alias("value"))
    said = F.array_compact(F.array(fact("headword", F.col("word")), fact("translation", F.col("head")), F.when(F.col("tag").isNotNull(), fact("pos", F.col("tag")))))
    own = filed.select("head", "tag", F.explode("terms").alias("word")).select("word", F.explode(said).alias("f")).select("word", "f.attr", "f.value", F.lit(0).alias("ordinal"))
    return own.unionAll(peers(filed).select("word", F.lit("glossPeer").alias("attr"), "value", "ordinal"))


def part_entries(spark: SparkSession, d: str) -> DataFrame:
    """p_partkey, head and text: parts as entries. Their type is the head; their name's words are terms, the last with a bracket before it."""
    marker = F.when(F.col("p_size") % 4 == 0, "n. ").when(F.col("p_size") % 4 == 1, "-2 v. ").when(F.col("p_size") % 4 == 2, "(of ")
    words = F.transform(F.split(F.lower("p_name"), " "), spelled)
    text = F.concat(F.coalesce(marker, F.lit("")), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), ", "), F.lit(", (rare) "), F.element_at(words, -1), F.lit(" ."))
    parts = written(spread(table(spark, d, "part").select("p_partkey", "p_type", "p_name", "p_size"), PARSED_ROWS), "parts")  # else filters on the text are pushed below, into few tasks
    return parts.select("p_partkey", F.split("p_type", " ")[0].alias("head"), F.when(F.col("p_size") % 11 != 0, text).otherwise("n. ").alias("text"))


def dictionary_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(part_entries(spark, d), ["p_partkey"])


_SPELL = f"translate(translate(substr(j, 1, 1), '{OPEN}', '{OPENED}'), '{PLAIN}', '{WRITTEN}') || translate(substr(j, 2), '{PLAIN}', '{WRITTEN}')"
QUERIES = {"dictionary_facts": dictionary_facts}
ORACLES = {
    "dictionary_facts": f"""WITH w AS (SELECT p_partkey, string_split(p_type, ' ')[1] AS head, p_size, unnest(string_split(lower(p_name), ' ')) AS surface FROM part), j AS (SELECT p_partkey, head, p_size, {_LEAD} AS j FROM w),
e AS (SELECT p_partkey, head, CASE p_size % 4 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' END AS tag, p_size % 11 = 0 AS empty, {_SPELL} AS term FROM j),
r AS (SELECT p_partkey, sum(x) OVER (ORDER BY p_partkey) AS run FROM (SELECT p_partkey, CASE WHEN lag(head) OVER (ORDER BY p_partkey) = head THEN 0 ELSE 1 END AS x FROM (SELECT DISTINCT p_partkey, head FROM e))),
f AS (SELECT e.*, run FROM e JOIN r USING (p_partkey) WHERE NOT empty), g AS (SELECT run, tag, list_sort(list(DISTINCT term)) AS t FROM f GROUP BY 1, 2), p AS (SELECT t, unnest(t) AS word FROM g WHERE len(t) > 1),
o AS (SELECT word, list_filter(t, lambda x: x <> word) AS others FROM p)
SELECT term AS word, 'headword' AS attr, term AS value, 0 AS ordinal FROM f UNION ALL SELECT term, 'translation', head, 0 FROM f UNION ALL SELECT term, 'pos', tag, 0 FROM f WHERE tag IS NOT NULL
UNION ALL SELECT word, 'glossPeer', unnest(others), unnest(range(len(others)))::INTEGER FROM o"""
}
