"""Records of sources into observations and facts, with a ledger that loses no row, and the routing of their tags."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators.checks import repeated, violations
from wordloom.sources.tables import table

#: What a tag of a part asserts: parts of speech, evidence of a class, or a reason to reject it; and categories. A tag has one destination.
POS_ALIASES = {"ECONOMY": ("noun",), "STANDARD": ("adjective", "noun"), "MEDIUM": ("verb",)}
EVIDENCE_ALIASES, REJECT_ALIASES, CATEGORY_ALIASES = {"PROMO": "properNoun"}, {"SMALL": "notAWord"}, {"LARGE": "size"}
#: Brands by role (number of the brand modulo ROLES): 0 is an authority, 1 authored, the others only attest.
ROLES = 5

FACT = "struct<attr string, value string, ordinal int>"


def _literal(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def routed(tag: Column) -> Column:
    """The facts of a tag: pos, evidence, category; an unknown tag is an error, a null one gives none."""
    pos = F.transform(F.split(F.coalesce(F.element_at(_literal({k: ",".join(v) for k, v in POS_ALIASES.items()}), tag), F.lit("")), ","), lambda v: F.struct(F.lit("pos").alias("attr"), v.alias("value"), F.lit(0).alias("ordinal")))
    one = lambda name, aliases: F.array(F.struct(F.lit(name).alias("attr"), F.element_at(_literal(aliases), tag).alias("value"), F.lit(0).alias("ordinal")))
    return (
        F.when(tag.isNull(), F.array().cast(f"array<{FACT}>"))
        .when(tag.isin(*POS_ALIASES), pos)
        .when(tag.isin(*EVIDENCE_ALIASES), one("evidence", EVIDENCE_ALIASES))
        .when(tag.isin(*REJECT_ALIASES), one("evidence", REJECT_ALIASES))
        .when(tag.isin(*CATEGORY_ALIASES), one("category", CATEGORY_ALIASES))
        .otherwise(F.raise_error(F.concat(F.lit("unknown tag "), tag)).cast(f"array<{FACT}>"))
    )


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a record: source, surface (lower case, one space between words; null if there is none) and count (0 where the size is odd), with its tag and role."""
    surface = F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z]+", " "))
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("source"), F.when(F.length(surface) > 5, surface).alias("surface"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(0).cast("long").alias("count"), F.col("p_type").alias("tag"), (number % ROLES).alias("role")
    )


def extract_observations(spark: SparkSession, d: str) -> DataFrame:
    """source, surface, count of the records that have a surface; equal ones of a source are summed."""
    return parsed(spark, d).where("surface IS NOT NULL").groupBy("source", "surface").agg(F.sum("count").alias("count"))


def facts(records: DataFrame) -> DataFrame:
    """p_partkey, source, surface, attr, value: a headword for authorities and authored sources, and what the tag is routed to."""
    headword = F.when(F.col("role") <= 1, F.array(F.struct(F.lit("headword").alias("attr"), F.col("surface").alias("value"), F.lit(0).alias("ordinal")))).otherwise(F.array().cast(f"array<{FACT}>"))
    every = F.concat(headword, routed(F.col("tag")))
    return records.where("surface IS NOT NULL").select("p_partkey", "source", "surface", F.explode(every).alias("f")).select("p_partkey", "source", "surface", "f.attr", "f.value")


def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(parsed(spark, d))


def extract_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Per source: rows in, rejects, rows out, facts; rows in are rejects and rows out."""
    records = parsed(spark, d)
    rows = records.groupBy("source").agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("surface").isNull()).alias("rejects"), F.count("surface").alias("rows_out"))
    made = facts(records).groupBy("source").agg(F.count(F.lit(1)).alias("facts"), F.count_if((F.col("attr") == "evidence") & (F.col("value") == "notAWord")).alias("denials"))
    return rows.join(made, "source", "left").select("source", "rows_in", "rejects", "rows_out", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("denials", F.lit(0)).alias("denials"))


def extract_senses(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, attr, value and ordinal: a conversation's turns as definitions in their order, and its first words as synonyms, sorted and without the first turn's own."""
    turns = table(spark, d, "conversations").where("text IS NOT NULL")
    word = F.regexp_extract(F.lower("text"), "([a-z]+)", 1)
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("gloss"), word.alias("word")))).alias("l"))
    definitions = F.transform("l", lambda x, i: F.struct(F.lit("definition").alias("attr"), x["gloss"].alias("value"), i.alias("ordinal")))
    own = F.get(F.col("l"), F.lit(0))["word"]
    peers = F.array_remove(F.array_sort(F.array_distinct(F.array_remove(F.col("l")["word"], ""))), own)
    synonyms = F.transform(peers, lambda x, i: F.struct(F.lit("synonym").alias("attr"), x.alias("value"), i.alias("ordinal")))
    return listed.select("conv_id", F.explode(F.concat(definitions, synonyms)).alias("f")).select("conv_id", "f.attr", "f.value", F.col("f.ordinal").cast("long").alias("ordinal"))


def extract_synsets(spark: SparkSession, d: str) -> DataFrame:
    """p_partkey, synonym, others, gloss and translation of lines of four tab-separated fields.

    The members of a synset are sorted and each once. Each is listed with the others. The gloss is what stands before
    ||; only a direct link is a translation. Lines are built from part: words of name and type, gloss, link, target.
    """
    members = F.concat_ws(",", F.translate("p_name", " ", ","), F.lower("p_type"))
    link = F.when(F.col("p_size") % 2 == 0, "Direct").otherwise("Hypernymy")
    lines = table(spark, d, "part").select("p_partkey", F.concat_ws("\t", members, F.concat("p_type", F.lit(" part || as in "), "p_name"), link, "p_brand").alias("line"))
    field = F.split("line", "\t")
    synset = F.array_sort(F.array_distinct(F.transform(F.split(field[0], ","), F.trim)))
    rows = lines.select("p_partkey", synset.alias("synset"), F.trim(F.split(field[1], "\\|\\|")[0]).alias("gloss"), F.when(field[2] == "Direct", field[3]).alias("translation"))
    each = rows.select("p_partkey", "synset", "gloss", "translation", F.explode("synset").alias("synonym"))
    return each.select("p_partkey", "synonym", F.array_join(F.array_remove("synset", F.col("synonym")), "|").alias("others"), "gloss", "translation")


def extract_peers(spark: SparkSession, d: str) -> DataFrame:
    """user_id, first event and size of each run of two or more equal event types that follow each other, and the distinct hours in it: members of a run are peers as a class, not as pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    change = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("int")
    runs = table(spark, d, "events").withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy("user_id", "run").agg(F.min(F.struct("ts", "event_id")).alias("first"), F.count(F.lit(1)).alias("size"), F.countDistinct(F.hour("ts")).alias("hours")).where("size > 1")
    return grouped.select("user_id", F.col("first.event_id").alias("first_event"), "size", "hours")


def entry_fields(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, plain and lead: a turn without its bracketed parts, and what comes before its first character outside ASCII."""
    text = F.coalesce("text", F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "\\([^()]*\\)", " "), " +", " "))
    return table(spark, d, "conversations").select("conv_id", "turn", plain.alias("plain"), F.regexp_extract(text, "^([\\x00-\\x7F]*)", 1).alias("lead"))


def html_clean(spark: SparkSession, d: str) -> DataFrame:
    """page_id, title (underscores as spaces) and words of a page without comments, scripts, styles and tags."""
    page = F.coalesce("html", F.lit(""))
    title = F.trim(F.regexp_replace(F.translate(F.regexp_extract(page, "(?s)<title>(.*?)</title>", 1), "_", " "), "[ \\n\\t]+", " "))
    bare = F.regexp_replace(F.regexp_replace(page, "(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>", " "), "<[^>]*>", " ")
    return table(spark, d, "pages").select("page_id", title.alias("title"), F.size(F.regexp_extract_all(bare, F.lit("([^ \\n\\t]+)"), 1)).cast("long").alias("words"))


def normalised(spark: SparkSession) -> object:
    """A function of a text column: composed form, without white space around. Spark has no function for composition; batches go through Arrow."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t).strip(), na_action="ignore")

    return nfc


def composed_texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, digest of the composed text and whether composing changed it; null texts stay null."""
    nfc = normalised(spark)
    made = table(spark, d, "documents").select("doc_id", "text", nfc("text").alias("made"))
    return made.select("doc_id", F.md5(F.col("made").cast("binary")).alias("digest"), (F.col("made") != F.col("text")).alias("changed"))


def clean_markup(text: Column) -> Column:
    """Wiki markup as plain text: without comments, references, templates (three deep) and tags; links by their label."""
    out = F.regexp_replace(text, "(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "")
    for _ in range(3):
        out = F.regexp_replace(out, "\\{\\{[^{}]*\\}\\}", "")
    out = F.regexp_replace(out, "\\[\\[(?:[^|\\]\\[]*\\|)?([^|\\]\\[]*)\\]\\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "'{2,}|<[^>]*>", ""), "[ \t]+", " "))


def wiki_senses(pages: DataFrame, most: int = 24) -> DataFrame:
    """title, ordinal and sense of pages (title, text): the lines that begin with one #, without examples (#: and #*) and empty ones; `most` a page."""
    whole = F.regexp_replace(F.coalesce("text", F.lit("")), "(?s)<!--.*?-->", "")  # comments may run over lines
    listed = F.filter(F.split(whole, "\n"), lambda line: line.rlike("^#[^#:*]"))
    senses = F.filter(F.transform(listed, lambda line: clean_markup(F.regexp_replace(line, "^#", ""))), lambda x: x != "")
    rows = pages.select("title", F.posexplode(F.slice(senses, 1, most)).alias("ordinal", "sense"))
    return rows.select("title", F.col("ordinal").cast("long").alias("ordinal"), "sense")


def authored_violations(rows: DataFrame, themes: list[str]) -> DataFrame:
    """word and rule of authored entries (word, theme, meanings): trimmed and composed words, a known theme, meanings that are there, trimmed and each once, and each word once."""
    nfc = normalised(rows.sparkSession)
    made = rows.withColumn("_made", nfc("word"))
    trimmed = F.forall("meanings", lambda m: (F.trim(m) == m) & (m != ""))
    single = violations(made, ["word"], {"composed": F.col("_made") == F.col("word"), "theme": F.col("theme").isin(*themes), "meanings": F.size("meanings") > 0, "trimmed": trimmed, "distinct": F.size(F.array_distinct("meanings")) == F.size("meanings")})
    return single.unionAll(repeated(rows, ["word"], "unique"))


_PARSED = f"p AS (SELECT p_partkey, p_brand AS source, CASE WHEN len(s) > 5 THEN s END AS surface, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS count, p_type AS tag, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % {ROLES} AS role FROM (SELECT *, trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g')) AS s FROM part))"
_ROUTES = [(tag, "pos", v) for tag, vs in POS_ALIASES.items() for v in vs] + [(t, "evidence", v) for t, v in (EVIDENCE_ALIASES | REJECT_ALIASES).items()] + [(t, "category", v) for t, v in CATEGORY_ALIASES.items()]
_FACTS = f"{_PARSED}, f AS (SELECT p_partkey, source, surface, 'headword' AS attr, surface AS value FROM p WHERE surface IS NOT NULL AND role <= 1 UNION ALL SELECT p_partkey, source, surface, attr, value FROM p JOIN (VALUES {', '.join(map(str, _ROUTES))}) r(t, attr, value) ON tag = t WHERE surface IS NOT NULL)"
_NAMES = (extract_observations, extract_facts, extract_ledger, extract_senses, extract_synsets, extract_peers, entry_fields, html_clean, composed_texts)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLES = {
    "extract_observations": f"WITH {_PARSED} SELECT source, surface, CAST(sum(count) AS BIGINT) AS count FROM p WHERE surface IS NOT NULL GROUP BY 1, 2",
    "extract_facts": f"WITH {_FACTS} SELECT * FROM f",
    "extract_ledger": f"WITH {_FACTS} SELECT source, count(*) AS rows_in, count(*) - count(surface) AS rejects, count(surface) AS rows_out, (SELECT count(*) FROM f WHERE f.source = p.source) AS facts, (SELECT count(*) FROM f WHERE f.source = p.source AND attr = 'evidence' AND value = 'notAWord') AS denials FROM p GROUP BY source",
    "extract_senses": "WITH t AS (SELECT conv_id, turn, text, regexp_extract(lower(text), '[a-z]+') AS w FROM conversations WHERE text IS NOT NULL), o AS (SELECT conv_id, arg_min(w, turn) AS own FROM t GROUP BY 1), s AS (SELECT DISTINCT t.conv_id, w FROM t JOIN o ON t.conv_id = o.conv_id WHERE w <> own AND w <> '') SELECT conv_id, 'definition' AS attr, text AS value, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS ordinal FROM t UNION ALL SELECT conv_id, 'synonym', w, row_number() OVER (PARTITION BY conv_id ORDER BY w) - 1 FROM s",
    "extract_synsets": "WITH l AS (SELECT p_partkey, list_sort(list_distinct(list_append(string_split(p_name, ' '), lower(p_type)))) AS m, p_type || ' part' AS gloss, CASE WHEN p_size % 2 = 0 THEN p_brand END AS translation FROM part) SELECT p_partkey, w AS synonym, array_to_string(list_filter(m, lambda x: x <> w), '|') AS others, gloss, translation FROM (SELECT *, unnest(m) AS w FROM l)",
    "extract_peers": "WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 0 ELSE 1 END AS ch FROM events), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT user_id, arg_min(event_id, row(ts, event_id)) AS first_event, count(*) AS size, count(DISTINCT hour(ts)) AS hours FROM r GROUP BY user_id, run HAVING count(*) > 1",
    "entry_fields": r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\([^()]*\)', ' ', 'g'), ' +', ' ', 'g'), ' ') AS plain, regexp_extract(coalesce(text, ''), '^[\x00-\x7F]*') AS lead FROM conversations",
    "composed_texts": r"WITH t AS (SELECT doc_id, text, regexp_replace(nfc_normalize(text), '^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS m FROM documents) SELECT doc_id, md5(m) AS digest, m <> text AS changed FROM t",
    "html_clean": r"WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), b AS (SELECT page_id, h, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS b FROM p) SELECT page_id, trim(regexp_replace(translate(regexp_extract(h, '(?s)<title>(.*?)</title>', 1), '_', ' '), '[ \n\t]+', ' ', 'g'), ' ') AS title, len(regexp_extract_all(b, '[^ \n\t]+')) AS words FROM b",
}
