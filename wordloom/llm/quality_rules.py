"""Quality rules from single texts and from how often a host repeats lines. DataFrame functions only.

Texts are read once: what the rules ask of a single text, and the hashes of its normalised lines, go into a table, and
all that follows works on that. For each host and line the documents that have it are counted. A line above the limits
is boilerplate: it is taken out of every document of its host, and a document is rejected if that takes too much of
it. Copies of one document also repeat lines, but they repeat them together; so the documents with a line are counted
a second time by their signature, a hash of all distinct lines of the document, which only copies share. A line is
above the limits only if its documents differ in that too.

Lines are told apart by 64-bit hashes. A line is wrongly taken for a frequent one of its host with odds of the host's
frequent lines to 2**64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written

#: Limits on a line: documents of one host at least, as a number and as a share of the host's documents with lines;
#: signatures among them at least, as a share. A document is depleted if more than MOST of its words go.
MIN_DOCS, MIN_SHARE, MIN_VARIETY, MOST = 20, 0.001, 0.25, 0.5
#: The base rules.
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: What judge() adds.
RULED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")
#: Parts that each frequent line is split into when it is joined back to the documents; frequent lines that are broadcast instead, at most.
SALTS, BROADCAST_ROWS = 16, 100_000

WHITE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE)), " "), "")


def with_repeated_words(df: DataFrame, w: str, out: str, size: int = 3) -> DataFrame:
    """df with `out`: the words of the array `w` inside windows of `size` words that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hash. Sorted with their places, equal ones are neighbours; the places of those
    are sorted again, and each counts the words it covers before the next one starts. Each step is a column of its
    own, as functions with lambdas work out their arguments anew wherever they are named.
    """
    last = F.size(w) - size
    windows = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.xxhash64(*[F.get(w, k + j) for j in range(size)]).alias("h"), k.alias("k")),
    )
    follow = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    pairs = F.zip_with("_a", follow(F.col("_a")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["k"], b["k"])))
    gaps = F.zip_with("_b", follow(F.col("_b")), lambda a, b: F.when(b.isNull(), F.lit(size)).otherwise(F.least(b - a, F.lit(size))))
    df = df.withColumn("_a", F.sort_array(windows)).withColumn("_b", F.filter(pairs, lambda x: x.isNotNull()))
    df = df.withColumn("_b", F.sort_array(F.array_distinct(F.flatten("_b"))))
    return df.withColumn(out, F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)).drop("_a", "_b")


def base_features(docs: DataFrame) -> DataFrame:
    """docs with the single-text features and base_failed added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_w", words(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " " + WHITE, "")) > 0)
    out = out.withColumn("_raw", lines).withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long"),
        }
    )
    out = with_repeated_words(out, "_w", "n_repeat_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_w", "_raw")


def normal(text: Column) -> Column:
    """Lower case, one space for white space inside lines and none around the whole."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "\t\x0b\x0c\r", " " * 4), "  +", " "))


def with_lines(docs: DataFrame) -> DataFrame:
    """docs with `_lines`, hash and words of each normalised line with a word, and `_signature`, the same for texts of the same distinct lines."""
    lines = F.filter(F.split(normal(F.coalesce(F.col("text"), F.lit(""))), " ?\n ?"), lambda x: F.length(x) > 0)
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")))
    return docs.withColumn("_lines", hashed).withColumn("_signature", F.xxhash64(F.sort_array(F.array_distinct(F.col("_lines")["line"]))))


def salted(df: DataFrame) -> DataFrame:
    """Each row once for each salt, to meet rows of hot hosts or lines that are dealt over the salts."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def frequent_lines(rows: DataFrame) -> DataFrame:
    """source and line of the lines above the limits. Counts are taken in two steps, by signature and then over signatures."""
    each = rows.select("source", F.explode(F.array_distinct(F.col("_lines")["line"])).alias("line"), "_signature")
    by_signature = each.groupBy("source", "line", "_signature").agg(F.count(F.lit(1)).alias("n"))
    counted = by_signature.groupBy("source", "line").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_signatures")).where(F.col("n_docs") >= MIN_DOCS)
    hosts = rows.where(F.size("_lines") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"))
    counted = counted.withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int"))
    joined = counted.alias("c").join(salted(hosts).alias("h"), F.col("c.source").eqNullSafe(F.col("h.source")) & (F.col("c.salt") == F.col("h.salt")))
    above = (F.col("n_docs") >= MIN_SHARE * F.col("host_docs")) & (F.col("n_signatures") >= MIN_VARIETY * F.col("n_docs"))
    return joined.where(above).select("c.source", "line")


def lines_to_remove(rows: DataFrame) -> DataFrame:
    """_id of each row that has frequent lines, those lines, and how many words stand in them."""
    hot = written(frequent_lines(rows), "frequent-lines")
    each = rows.select(F.col("_row").alias("_id"), "source", F.explode("_lines").alias("l")).select("_id", "source", "l.line", "l.words")
    same = F.col("l.source").eqNullSafe(F.col("h.source")) & (F.col("l.line") == F.col("h.line"))
    if hot.count() <= BROADCAST_ROWS:  # some tens of bytes each
        found = each.alias("l").join(F.broadcast(hot).alias("h"), same)
    else:
        dealt = each.withColumn("salt", F.pmod("_id", F.lit(SALTS)).cast("int"))
        found = dealt.alias("l").join(salted(hot).alias("h"), same & (F.col("l.salt") == F.col("h.salt")))
    return found.select("l._id", "l.line", "l.words").groupBy("_id").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("_frequent"))


def _judged(docs: DataFrame, keep_text: bool) -> DataFrame:
    """docs with the features, the frequent lines of each row and the verdict; without text unless it is asked for."""
    rows = with_lines(base_features(docs)).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows if keep_text else rows.drop("text"), "quality-rows")
    gone = written(lines_to_remove(rows), "lines-to-remove")
    joined = rows.join(gone, F.col("_row") == F.col("_id"), "left").drop("_id", "_row", "_lines", "_signature")
    removed = F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")
    joined = joined.withColumn("n_removed_words", removed)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= MOST * F.col("n_words")))


def _packed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, text, source, and all other columns as one struct, so that their names cannot clash with the rules' own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    return docs.select("doc_id", "text", "source", F.struct(*others).alias("_rest") if others else F.lit(0).alias("_rest")), others


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and source of docs, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept, and the other columns but text.

    docs has doc_id, text and source (the host); other columns pass through, unless they bear one of those names. One
    row for each row of docs. A null text counts as empty: it fails the base rules. Null sources are one host of their
    own. Each row is a document to the line frequencies, whatever its id. Empty tables give none.
    """
    rows, others = _packed(docs)
    return _judged(rows, False).select("doc_id", "source", *RULED, *[F.col("_rest")[c].alias(c) for c in others if c not in RULED])


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with the columns of docs, and without their frequent lines."""
    rows, others = _packed(docs)
    each = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains("_frequent", F.xxhash64(normal(line))))
    text = F.when(F.col("_frequent").isNull(), F.col("text")).otherwise(F.array_join(each, "\n"))
    kept = _judged(rows, True).where("kept").withColumn("text", text)
    return kept.select(*[F.col("_rest")[c].alias(c) if c in others else F.col(c) for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, unnest(range(len(w) - 2)) AS k, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, k, w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] AS g FROM t),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, sum(least(3, coalesce(nk - k, 3))) AS n_repeat_words
      FROM (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS nk FROM r) GROUP BY doc_id),
n AS (SELECT doc_id, source, unnest(list_transform(string_split(regexp_replace(lower(text), '[\t\x0B\x0C\r ]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' '))) AS s FROM d),
h AS (SELECT doc_id, source, md5(s) AS line, len(s) - len(replace(s, ' ', '')) + 1 AS words FROM n WHERE s <> ''),
sig AS (SELECT doc_id, source, string_agg(DISTINCT line, ',' ORDER BY line) AS signature FROM h GROUP BY 1, 2),
l AS (SELECT h.doc_id, h.source, line, signature, sum(words) AS words FROM h JOIN sig ON h.doc_id = sig.doc_id AND h.source = sig.source GROUP BY 1, 2, 3, 4),
hosts AS (SELECT source, count(*) AS host_docs FROM sig GROUP BY 1),
hot AS (SELECT f.source, f.line FROM (SELECT source, line, count(*) AS n_docs, count(DISTINCT signature) AS n_sig FROM l GROUP BY 1, 2) f
        JOIN hosts ON f.source = hosts.source
        WHERE n_docs >= {MIN_DOCS} AND n_docs >= {MIN_SHARE} * host_docs AND n_sig >= {MIN_VARIETY} * n_docs),
gone AS (SELECT l.doc_id, sum(l.words) AS n FROM l JOIN hot ON l.source = hot.source AND l.line = hot.line GROUP BY 1),
f AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(array_to_string(w.w, '')), 0) AS BIGINT) AS word_chars,
        CAST(len(w.text) - len(translate(w.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND n_removed_words <= {MOST} * n_words AS kept
FROM b
"""
