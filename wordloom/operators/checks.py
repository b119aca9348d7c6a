"""Rules that rows and tables must keep, as the rows that break them, and digests of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.tables import table

#: Languages and event types that may occur; band of quality values.
LANGUAGES, EVENTS = ("de", "en", "es", "fr"), ("click", "purchase", "signup", "view")

#: The tables and their columns, with the kind where that is neither an integer nor text.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal:number c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:number",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:number",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:number o_orderdate:time o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:number l_extendedprice:number l_discount:number l_tax:number l_returnflag l_linestatus l_shipdate:time",
    "events": "event_id ts:time user_id event_type value:number props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding:vector label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """key and rule for each rule that a row breaks; a rule that is null for a row is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(keeps, F.lit(False)), F.lit(name)) for name, keeps in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


def repeated(rows: DataFrame, key: list[str], rule: str) -> DataFrame:
    """key and rule for each key that more than one row has."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, F.lit(rule).alias("rule"))


def document_violations(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and rule: length as stated, trimmed, of a known language, without a mark of junk, and each text once (the least id keeps it)."""
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    single = violations(
        docs,
        ["doc_id"],
        {"length": F.length(text) == F.coalesce("n_chars", F.lit(0)), "trimmed": F.trim(text) == text, "language": F.col("lang").isin(*LANGUAGES), "marks": ~text.rlike("[#%$*]{3}"), "empty": F.length(text) > 0},
    )
    keyed = docs.where("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = keyed.join(first, "digest").where("doc_id > first").select("doc_id", F.lit("unique").alias("rule"))
    return single.unionAll(again)


def event_violations(spark: SparkSession, d: str) -> DataFrame:
    """event_id and rule: a known type, a value of two decimals that is not negative, props with a k below 90, and an hour of the day before 23."""
    k = F.from_json("props", "k long")["k"]
    value = F.col("value")
    return violations(table(spark, d, "events"), ["event_id"], {"type": F.col("event_type").isin(*EVENTS), "value": (value >= 0) & (F.abs(value * 100 - F.round(value * 100)) < 1e-6), "props": k < 90, "hour": F.hour("ts") < 23})


def census_violations(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey and rule: an order's lines exist, are numbered without gaps from their least number, and have each number once."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_linenumber").alias("distinct"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))
    rows = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("k"), "left")
    return violations(rows, ["o_orderkey"], {"lines": F.col("n") > 0, "numbers": F.col("high") - F.col("low") + 1 == F.col("distinct"), "once": F.col("n") == F.col("distinct")})


def config_violations(weights: dict[str, float], priority: list[str], classes: list[str]) -> list[str]:
    """What is wrong with a classifier's settings: weights that are negative or add up to more than 1, a priority that does not rank each class once."""
    found = [f"weight {k} is negative" for k, v in weights.items() if v < 0]
    if sum(weights.values()) > 1 + 1e-9:
        found.append("weights add up to more than 1")
    if sorted(priority) != sorted(classes):
        found.append("priority is no order of all classes")
    return found


def digest(rows: DataFrame) -> DataFrame:
    """rows and hash of a table, whatever the order of its rows: the sum over all rows of 48 bits of a digest of all columns, by name.

    Numbers that are no integers count in millionths, times in microseconds (local ones in the zone of the session). A null and an empty string differ. The sum
    is a decimal, so 10**26 rows fit.
    """

    def shown(c: Column, kind: str) -> Column:
        if kind.startswith("array<"):
            return F.array_join(F.transform(c, lambda x: shown(x, kind[6:-1])), ",")
        if kind in ("double", "float"):
            return F.floor(c.cast("double") * 1e6 + 0.5).cast("string")
        return (F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c).cast("string")

    parts = [F.coalesce(F.concat(F.lit("="), shown(F.col(c), kind)), F.lit("-")) for c, kind in sorted(rows.dtypes)]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("hash"))


def table_digest(spark: SparkSession, d: str) -> DataFrame:
    """name, rows and hash of each table; see digest()."""
    out = None
    for name in COLUMNS:
        one = digest(table(spark, d, name)).select(F.lit(name).alias("name"), "rows", "hash")
        out = one if out is None else out.unionAll(one)
    return out


def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the tables of a lexicon: observations, distinct sources and languages, facts, and distinct texts of both kinds together."""
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    counted = docs.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"))
    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("t")).unionAll(bench.select(F.md5(F.col("text").cast("binary")))).where("t IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("texts"))
    return counted.join(F.broadcast(bench.agg(F.count(F.lit(1)).alias("items")))).join(F.broadcast(texts))  # one row each


def _rule(table_name: str, key: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS rule FROM {table_name} WHERE NOT coalesce({keeps}, false)" for name, keeps in rules.items())


#: How SQL shows a column of each kind, as digest() does.
_SHOWN = {"": "{}", "number": "CAST(floor(CAST({} AS DOUBLE) * 1e6 + 0.5) AS BIGINT)", "time": "epoch_us({})", "vector": "array_to_string(list_transform({}, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1e6 + 0.5) AS BIGINT)), ',')"}


def _hash(name: str) -> str:
    columns = sorted((c.partition(":")[::2]) for c in COLUMNS[name].split())
    row = " || '|' || ".join(f"coalesce('=' || CAST({_SHOWN[kind].format(c)} AS VARCHAR), '-')" for c, kind in columns)
    return f"SELECT '{name}' AS name, count(*) AS rows, CAST(coalesce(sum(CAST(CAST('0x' || substr(md5({row}), 1, 12) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR) AS hash FROM {name}"


QUERIES = {f.__name__: f for f in (document_violations, event_violations, census_violations, table_digest, store_statistics)}
ORACLES = {
    "document_violations": "WITH t AS (SELECT doc_id, lang, n_chars, text AS raw, coalesce(text, '') AS text FROM documents) "
    + _rule("t", "doc_id", {"length": "len(text) = coalesce(n_chars, 0)", "trimmed": "trim(text, ' ') = text", "language": f"lang IN {LANGUAGES}", "marks": "NOT regexp_matches(text, '[#%$*]{3}')", "empty": "len(text) > 0"})
    + " UNION ALL SELECT doc_id, 'unique' FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY raw) AS first FROM t WHERE raw IS NOT NULL) WHERE doc_id > first",
    "event_violations": "WITH t AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) "
    + _rule("t", "event_id", {"type": f"event_type IN {EVENTS}", "value": "value >= 0 AND abs(value * 100 - round(value * 100)) < 1e-6", "props": "k < 90", "hour": "hour(ts) < 23"}),
    "census_violations": "WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS u, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey, n, u, low, high FROM orders LEFT JOIN l ON o_orderkey = l_orderkey) "
    + _rule("t", "o_orderkey", {"lines": "n > 0", "numbers": "high - low + 1 = u", "once": "n = u"}),
    "table_digest": " UNION ALL ".join(map(_hash, COLUMNS)),
    "store_statistics": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(DISTINCT lang) FROM documents) AS languages, (SELECT count(*) FROM benchmark) AS items, (SELECT count(*) FROM (SELECT text FROM documents WHERE text IS NOT NULL UNION SELECT text FROM benchmark WHERE text IS NOT NULL)) AS texts",
}
