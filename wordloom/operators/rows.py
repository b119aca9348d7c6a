"""Small expressions over rows of tables: sets and multisets, scores, clocks, answers, and the rows that a lexicon publishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.texts import tokens
from wordloom.sources.tables import table

#: Sources that count as spoken; what a hint costs, by how many were taken; points of a letter.
SPOKEN, HINT_COSTS, POINTS = ("src1", "src2", "src3"), (5, 10, 20), 10


def population_union(spark: SparkSession, d: str) -> DataFrame:
    """surface and where it is from: documents, benchmark or both; each surface once."""
    seen = table(spark, d, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("surface"), F.lit(1).alias("side"))
    listed = table(spark, d, "benchmark").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("surface"), F.lit(2).alias("side"))
    sides = seen.unionAll(listed).groupBy("surface").agg(F.bit_or("side").alias("sides"))
    return sides.select("surface", F.element_at(F.array(F.lit("documents"), F.lit("benchmark"), F.lit("both")), F.col("sides")).alias("origin"))


def less(left: Column, right: Column) -> Column:
    """The letters of `left`, sorted, less those of `right`, each as often as it occurs."""
    letters = F.array_sort(F.array_distinct(left))
    often = lambda all_of, x: F.size(F.filter(all_of, lambda y: y == x))
    return F.flatten(F.transform(letters, lambda x: F.array_repeat(x, F.greatest(often(left, x) - often(right, x), F.lit(0)))))


def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    """p_partkey and what is left of the letters of a part's name without those of its type; null if the type needs letters that the name lacks."""
    chars = lambda c: F.filter(F.split(F.lower(c), ""), lambda x: x.between("a", "z"))
    rows = table(spark, d, "part").select("p_partkey", chars("p_name").alias("a"), chars("p_type").alias("b"))
    return rows.select("p_partkey", F.array_join(less(F.col("a"), F.col("b")), "").alias("rest"), F.array_join(less(F.col("b"), F.col("a")), "").alias("missing"))


def rival_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per customer of orders: the priorities that its nation's customers use and it does not, that it shares with all of the first, and whether it shares any."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = orders.groupBy("o_custkey", "c_nationkey").agg(F.collect_set("o_orderpriority").alias("own"))
    nation = orders.groupBy("c_nationkey").agg(F.collect_set("o_orderpriority").alias("every"))  # priorities are few
    rows = own.join(nation, "c_nationkey")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    urgent = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return rows.select("o_custkey", joined(F.array_except("every", "own")).alias("rivals"), joined(F.array_intersect("own", urgent)).alias("pressing"), F.arrays_overlap("own", urgent).alias("any_pressing"))


def letter_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of places of the two-letter blanks of a part's brand, in order, and the brand with both blanked."""
    n = F.length("p_brand")
    places = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.filter(F.sequence(F.lit(1), n), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.explode(places).alias("p"))
    blank = lambda w, at: F.overlay(w, F.lit("_"), at, F.lit(1))
    return rows.select("p_brand", F.col("p.i").cast("long").alias("i"), F.col("p.j").cast("long").alias("j"), blank(blank(F.col("p_brand"), F.col("p.i")), F.col("p.j")).alias("blanked"))


def crc32_buckets(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, the crc32 of its source and the one of 64 buckets that gives."""
    return table(spark, d, "documents").select("doc_id", F.crc32(F.coalesce("source", F.lit("")).cast("binary")).alias("crc"), (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 64).alias("bucket"))


def event_scores(spark: SparkSession, d: str) -> DataFrame:
    """event_id, score (points less the costs of the hints, 0 at least), share (of 100, half up), clock (minutes and seconds of the value, rounded up)."""
    k = F.from_json("props", "k long")["k"]
    hints = F.slice(F.array(*map(F.lit, HINT_COSTS)), F.lit(1), (k % 4).cast("int"))
    base = (k % 7 + 1) * POINTS
    seconds = F.ceil("value")
    return table(spark, d, "events").select(
        "event_id",
        F.greatest(F.lit(0), base - F.aggregate(hints, F.lit(0).cast("long"), lambda a, x: a + x)).alias("score"),
        F.floor(F.lit(100) * (k % 11) / 10 + 0.5).alias("share"),
        F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60).alias("clock"),
    )


def day_before(spark: SparkSession, d: str) -> DataFrame:
    """Days with orders: the day before, the ordinal of the day, whether it is a theme's (every 31st), and whether the day before has orders too."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    before = days.select(F.date_add("date", 1).alias("date"), F.lit(True).alias("follows"))
    ordinal = F.unix_date("date") + 719163
    return days.join(before, "date", "left").select(F.date_format("date", "yyyy-MM-dd").alias("day"), F.date_format(F.date_sub("date", 1), "yyyy-MM-dd").alias("before"), ordinal.cast("long").alias("ordinal"), (ordinal % 31 == 0).alias("theme"), F.coalesce("follows", F.lit(False)).alias("follows"))


def answer_words(spark: SparkSession, d: str) -> DataFrame:
    """conv_id and the answers that its payload gives: its word, then those of its targets, each once in that order. Payloads are JSON, written from the first words of the turns."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "([a-z]+)", 1).alias("word"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "word"))).alias("l"))
    payload = F.to_json(F.struct(F.get(F.col("l"), F.lit(0))["word"].alias("word"), F.transform("l", lambda x: F.struct(x["word"].alias("word"))).alias("targets")))
    read = listed.select("conv_id", F.from_json(payload, "word string, targets array<struct<word string>>").alias("p"))
    words = F.array_distinct(F.filter(F.concat(F.array("p.word"), F.col("p.targets")["word"]), lambda w: w != ""))
    return read.select("conv_id", F.array_join(words, ",").alias("answers"))


def published_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each language and source: the best document, ordered lengths, spoken share, attestations, and a line of JSON without nulls.

    Each part is resolved by itself and then joined to the keys, so a key without a part keeps its row.
    """
    facts = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    keys = facts.groupBy("lang", "source").agg(F.sum("n_chars").alias("frequency"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("quality") == 1).alias("tier_one"))
    best = facts.where("quality = 1").groupBy("lang", "source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best"))
    spoken = facts.where(F.col("source").isin(*SPOKEN)).groupBy("lang").agg(F.sum("n_chars").alias("spoken"))
    whole = facts.groupBy("lang").agg(F.sum("n_chars").alias("whole"))
    rows = keys.join(best, ["lang", "source"], "left").join(whole, "lang", "left").join(spoken, "lang", "left")
    share = F.when(F.col("whole") > 0, F.bround(F.coalesce("spoken", F.lit(0)) / F.col("whole"), 6))
    return rows.select("lang", "source", "frequency", "documents", "tier_one", "best", share.alias("spoken_ratio"), F.to_json(F.struct("lang", "source", "best")).alias("line"))


def provenance_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per source: distinct surfaces, surfaces that no other source has, and labelled documents."""
    docs = table(spark, d, "documents")
    words = docs.select("source", F.explode(F.array_distinct(tokens(F.col("text")))).alias("surface")).distinct()
    alone = words.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source")).where("n = 1").groupBy("source").agg(F.count(F.lit(1)).alias("alone"))
    labelled = docs.join(table(spark, d, "labels"), "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("labelled"))
    rows = words.groupBy("source").agg(F.count(F.lit(1)).alias("surfaces")).join(alone, "source", "left").join(labelled, "source", "left")
    return rows.select("source", "surfaces", F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce("labelled", F.lit(0)).alias("labelled"))


def enrichment_queue(spark: SparkSession, d: str) -> DataFrame:
    """Documents of good quality with what is missing of them, by attribute: those without a benchmark word, a label of toxicity, or a length above 100."""
    facts = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id")
    listed = table(spark, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("surface")).distinct()
    used = facts.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("surface")).join(listed, "surface").groupBy("doc_id").agg(F.count(F.lit(1)).alias("meanings"))
    rows = facts.join(used, "doc_id", "left")
    missing = F.array_compact(F.array(F.when(F.col("meanings").isNull(), F.lit("meaning")), F.when(F.col("toxic").isNull(), F.lit("label")), F.when(F.col("n_chars") <= 100, F.lit("length"))))
    return rows.where(F.size(missing) > 0).select("doc_id", F.array_join(missing, ",").alias("missing"))


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """how many surfaces have each length, and how many of those share their letters with another one."""
    words = table(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("surface")).distinct()
    keyed = words.groupBy(F.array_join(F.array_sort(F.split("surface", "")), "").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.groupBy(F.length("key").cast("long").alias("length")).agg(F.sum("n").alias("surfaces"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"))


def anagram_partners(spark: SparkSession, d: str) -> DataFrame:
    """Each frequent surface with the others of the same letters, sorted; the groups are of one multiset of letters and small."""
    words = table(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("surface")).groupBy("surface").agg(F.count(F.lit(1)).alias("n")).where("n >= 3 AND length(surface) <= 8")
    groups = words.groupBy(F.array_join(F.array_sort(F.split("surface", "")), "").alias("key")).agg(F.array_sort(F.collect_list("surface")).alias("all")).where(F.size("all") > 1)
    return groups.select(F.explode("all").alias("surface"), "all").select("surface", F.array_join(F.array_remove("all", F.col("surface")), ",").alias("partners"))


def _crc_table() -> list[int]:
    """The remainders of all bytes, by the polynomial of CRC-32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(source, ''), ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
_W = "unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')))"
_LESS = "coalesce((SELECT string_agg(repeat(c, greatest(na - coalesce(nb, 0), 0)), '' ORDER BY c) FROM (SELECT c, count(*) AS na FROM (SELECT unnest(string_split({a}, '')) AS c) GROUP BY 1) x LEFT JOIN (SELECT c AS cb, count(*) AS nb FROM (SELECT unnest(string_split({b}, '')) AS c) GROUP BY 1) y ON c = cb), '')"
_NAMES = (
    population_union, multiset_difference, rival_sets, letter_pairs, crc32_buckets, event_scores, day_before, answer_words, published_rows, provenance_counts, enrichment_queue, length_histogram, anagram_partners,
)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLES = {
    "population_union": f"WITH a AS (SELECT DISTINCT {_W} AS surface FROM documents), b AS (SELECT DISTINCT {_W} AS surface FROM benchmark) SELECT coalesce(a.surface, b.surface) AS surface, CASE WHEN b.surface IS NULL THEN 'documents' WHEN a.surface IS NULL THEN 'benchmark' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.surface = b.surface",
    "multiset_difference": f"WITH p AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS a, regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS b FROM part) SELECT p_partkey, {_LESS.format(a='a', b='b')} AS rest, {_LESS.format(a='b', b='a')} AS missing FROM p",
    "rival_sets": "WITH o AS (SELECT DISTINCT o_custkey, c_nationkey, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT DISTINCT c_nationkey, p FROM o), k AS (SELECT DISTINCT o_custkey, c_nationkey FROM o) SELECT o_custkey, coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM n WHERE n.c_nationkey = k.c_nationkey AND NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = k.o_custkey AND o.p = n.p)), '') AS rivals, coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM o WHERE o.o_custkey = k.o_custkey AND p IN ('1-URGENT', '2-HIGH')), '') AS pressing, EXISTS (SELECT 1 FROM o WHERE o.o_custkey = k.o_custkey AND p IN ('1-URGENT', '2-HIGH')) AS any_pressing FROM k",
    "letter_pairs": "WITH b AS (SELECT DISTINCT p_brand, len(p_brand) AS n FROM part), i AS (SELECT p_brand, n, unnest(range(1, n + 1)) AS i FROM b), j AS (SELECT p_brand, i, unnest(range(i + 1, n + 1)) AS j FROM i) SELECT p_brand, i, j, substr(p_brand, 1, i - 1) || '_' || substr(p_brand, i + 1, j - i - 1) || '_' || substr(p_brand, j + 1) AS blanked FROM j",
    "crc32_buckets": f"WITH x AS (SELECT doc_id, {_CRC} AS crc FROM documents, (SELECT {_crc_table()}::BIGINT[] AS t)) SELECT doc_id, crc, crc % 64 AS bucket FROM x",
    "event_scores": f"WITH e AS (SELECT event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, greatest(0, (k % 7 + 1) * {POINTS} - coalesce(list_sum({list(HINT_COSTS)}[1:k % 4]), 0))::BIGINT AS score, CAST(floor(100 * (k % 11) / 10 + 0.5) AS BIGINT) AS share, CAST(CAST(ceil(value) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(ceil(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM e",
    "day_before": "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), o AS (SELECT d, date_diff('day', DATE '1970-01-01', d) + 719163 AS n FROM d) SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d - 1, '%Y-%m-%d') AS before, n AS ordinal, n % 31 = 0 AS theme, d - 1 IN (SELECT d FROM d) AS follows FROM o",
    "answer_words": "WITH t AS (SELECT conv_id, turn, regexp_extract(lower(coalesce(text, '')), '[a-z]+') AS w FROM conversations), f AS (SELECT conv_id, w, min(turn) AS turn FROM t WHERE w <> '' GROUP BY 1, 2) SELECT c.conv_id AS conv_id, coalesce((SELECT string_agg(w, ',' ORDER BY f.turn, w) FROM f WHERE f.conv_id = c.conv_id), '') AS answers FROM (SELECT DISTINCT conv_id FROM t) c",
    "published_rows": f"WITH f AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), k AS (SELECT lang, source, CAST(sum(n_chars) AS BIGINT) AS frequency, count(*) AS documents, count(*) FILTER (WHERE quality = 1) AS tier_one, max_by(doc_id, row(n_chars, -doc_id)) FILTER (WHERE quality = 1) AS best FROM f GROUP BY 1, 2), w AS (SELECT lang AS l, sum(n_chars) AS whole, sum(CASE WHEN source IN {SPOKEN} THEN n_chars ELSE 0 END) AS spoken FROM f GROUP BY 1) SELECT lang, source, frequency, documents, tier_one, best, CASE WHEN whole > 0 THEN round_even(spoken / whole, 6) END AS spoken_ratio, '{{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"' || coalesce(',\"best\":' || best, '') || '}}' AS line FROM k JOIN w ON lang = l",
    "provenance_counts": f"WITH w AS (SELECT DISTINCT source, {_W} AS surface FROM documents), o AS (SELECT min(source) AS source FROM w GROUP BY surface HAVING count(*) = 1) SELECT source, count(*) AS surfaces, (SELECT count(*) FROM o WHERE o.source = w.source) AS alone, (SELECT count(*) FROM documents d WHERE d.source = w.source AND doc_id IN (SELECT doc_id FROM labels)) AS labelled FROM w GROUP BY source",
    "enrichment_queue": f"WITH b AS (SELECT DISTINCT {_W} AS s FROM benchmark), f AS (SELECT * FROM documents JOIN labels USING (doc_id) WHERE quality = 1), u AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, {_W} AS s FROM f) WHERE s IN (SELECT s FROM b)), m AS (SELECT doc_id, list_filter([CASE WHEN doc_id NOT IN (SELECT doc_id FROM u) THEN 'meaning' END, CASE WHEN toxic IS NULL THEN 'label' END, CASE WHEN n_chars <= 100 THEN 'length' END], lambda x: x IS NOT NULL) AS m FROM f) SELECT doc_id, array_to_string(m, ',') AS missing FROM m WHERE len(m) > 0",
    "length_histogram": f"WITH w AS (SELECT DISTINCT {_W} AS s FROM documents), k AS (SELECT s, count(*) OVER (PARTITION BY list_sort(string_split(s, ''))) AS n FROM w) SELECT len(s) AS length, count(*) AS surfaces, count(*) FILTER (WHERE n > 1) AS shared FROM k GROUP BY 1",
    "anagram_partners": "WITH w AS (SELECT s, list_sort(string_split(s, '')) AS k FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS s FROM documents) GROUP BY s HAVING count(*) >= 3 AND len(s) <= 8) SELECT a.s AS surface, string_agg(b.s, ',' ORDER BY b.s) AS partners FROM w a JOIN w b ON a.k = b.k AND a.s <> b.s GROUP BY 1",
}
