"""The contracts of published entries, word lists and ladders, as the rows that break them. What a row states is worked out anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.texts import multiset_key, tokens, units
from wordloom.operators.checks import violations
from wordloom.operators.classes import _LEAD, OPEN, OPENED, PLAIN, WRITTEN, spelled
from wordloom.operators.derive import GATES
from wordloom.operators.resolution import strata
from wordloom.sources.shared import written
from wordloom.sources.tables import table


def _sorted_once(c: str) -> Column:
    """A set as a list: sorted, each member once, and never empty; null where there is none."""
    return F.col(c).isNull() | (F.size(c) > 0) & (F.array_sort(F.array_distinct(c)) == F.col(c))


def entry_violations(entries: DataFrame, key: str) -> DataFrame:
    """key and rule for each rule that an entry breaks. entries has word, length, attestations, tier_one, pos, synonyms, categories and senses.

    length: the word's units. tierOne: no more than all attestations. pos, synonyms, categories: sets. synonyms has not the word itself.
    senses: in any order, each once, none empty.
    """
    rules = {
        "length": F.col("length") == F.size(units(F.col("word"))),
        "tierOne": F.col("tier_one") <= F.col("attestations"),
        "pos": _sorted_once("pos"),
        "synonyms": _sorted_once("synonyms") & ~F.coalesce(F.array_contains("synonyms", F.col("word")), F.lit(False)),
        "categories": _sorted_once("categories"),
        "senses": F.col("senses").isNull() | (F.size("senses") > 0) & (F.size(F.array_distinct("senses")) == F.size("senses")) & ~F.exists("senses", lambda s: F.trim(s) == ""),
    }
    return violations(entries, [key], rules)


def wordlist_violations(words: DataFrame, ledgers: DataFrame) -> DataFrame:
    """list, word and rule. words has list, word, frequency, stratum and fan_out; ledgers has list, rows, and one column for each of GATES.

    stratum: the quarter of the list by falling frequency and then word. fanOut: how many of the list's words have the
    same letters. ledger: the gates' rows add up to `rows`. kept: as many words as the ledger kept. Rules of a ledger
    have a null word. No task holds a list: places are numbered by ranges, letters are counted by key.
    """
    placed = strata(words.withColumnRenamed("stratum", "said"), "list", "frequency", "word")
    fan = words.groupBy("list", multiset_key(units(F.col("word"))).alias("letters")).agg(F.count(F.lit(1)).alias("n"))
    rated = placed.withColumn("letters", multiset_key(units(F.col("word")))).join(fan, ["list", "letters"])
    each = violations(rated, ["list", "word"], {"stratum": F.col("said") == F.col("stratum"), "fanOut": F.col("fan_out") == F.col("n")})
    counts = words.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    total = sum((F.coalesce(F.col(g), F.lit(0)) for g in GATES), F.lit(0))
    whole = violations(ledgers.join(counts, "list", "left"), ["list"], {"ledger": total == F.col("rows"), "kept": F.col("kept") == F.coalesce("n", F.lit(0))})
    return each.unionAll(whole.select("list", F.lit(None).cast("string").alias("word"), "rule"))


def _without(letters: Column, gone: Column) -> Column:
    """The letters less those of `gone`, each as often as it is there."""
    return F.aggregate(gone, letters, lambda rest, x: F.when(F.array_position(rest, x) > 0, F.concat(F.slice(rest, F.lit(1), F.array_position(rest, x).cast("int") - 1), F.slice(rest, F.array_position(rest, x).cast("int") + 1, F.size(rest)))).otherwise(rest))


def ladder_violations(ladders: DataFrame) -> DataFrame:
    """ladder and rule. ladders has ladder, rungs (words from the bottom up), bank (letters) and also (for each rung a list of other words; null: none).

    rungs: two at least. grows: each rung has the units of the one below and one more. bank: it has every unit that is
    added, as often as it is added. also: as many lists as rungs, and each word in them is not the rung's own and is
    spelled by the rung below and one letter of the bank; the lowest rung has none. repeats: no word twice.
    """
    rows = ladders.withColumn("u", F.transform("rungs", units))
    steps = F.when(F.size("u") > 1, F.sequence(F.lit(1), F.size("u") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("added", F.transform(steps, lambda k: _without(F.get("u", k), F.get("u", k - 1))))
    rows = rows.withColumn("lost", F.transform(steps, lambda k: _without(F.get("u", k - 1), F.get("u", k))))
    bank = F.split("bank", "")
    reached = lambda w, k: (F.size(_without(units(w), F.get("u", k - 1))) == 1) & (F.size(_without(F.get("u", k - 1), units(w))) == 0) & F.arrays_overlap(_without(units(w), F.get("u", k - 1)), bank)
    also = F.transform("also", lambda words, k: F.forall(words, lambda w: F.when(k == 0, F.lit(False)).otherwise((w != F.get("rungs", k)) & reached(w, k))))
    rules = {
        "rungs": F.size("rungs") >= 2,
        "grows": F.forall("added", lambda x: F.size(x) == 1) & F.forall("lost", lambda x: F.size(x) == 0),
        "bank": F.size(_without(F.flatten("added"), bank)) == 0,
        "also": F.col("also").isNull() | (F.size("also") == F.size("rungs")) & F.forall(also, lambda ok: ok),
        "repeats": F.size(F.array_distinct("rungs")) == F.size("rungs"),
    }
    return violations(rows, ["ladder"], rules)


def part_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of parts, not all of them in order: words of their names as words, synonyms and senses, types and brands as sets."""
    words = F.transform(F.split("p_name", " "), spelled)
    odd = lambda n: F.col("p_size") % n == 0
    return table(spark, d, "part").select(
        "p_partkey",
        words[0].alias("word"),
        (F.size(units(words[0])) + F.when(odd(7), 1).otherwise(0)).alias("length"),
        (F.col("p_size") % 4).alias("attestations"),
        (F.col("p_size") % 3).alias("tier_one"),
        F.array("p_type", "p_brand").alias("pos"),
        F.when(odd(5), F.array(words[0])).when(odd(2), F.array(words[1])).alias("synonyms"),
        F.when(odd(11), F.array("p_type", "p_type")).otherwise(F.array("p_type")).alias("categories"),
        F.when(odd(13), F.array("p_name", "p_name")).when(odd(9), F.array("p_name", F.lit(" "))).otherwise(F.array("p_name")).alias("senses"),
    )


def entry_contract(spark: SparkSession, d: str) -> DataFrame:
    return entry_violations(part_entries(spark, d), "p_partkey")


def wordlist_contract(spark: SparkSession, d: str) -> DataFrame:
    """Lists by segment of customers' orders: names as words, the number of orders as frequency; a tenth of the rows states something else, and the ledgers of nations in two regions do not add up."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("frequency"))
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("list"), F.col("c_name").alias("word"), "c_custkey", "frequency")
    rows = written(strata(rows, "list", "frequency", "word"), "strata")
    fan = rows.groupBy("list", multiset_key(units(F.col("word"))).alias("letters")).agg(F.count(F.lit(1)).alias("fan_out"))
    rows = rows.withColumn("letters", multiset_key(units(F.col("word")))).join(fan, ["list", "letters"])
    off = lambda n: F.when(F.col("c_custkey") % n == 0, 1).otherwise(0)
    words = rows.select("list", "word", "frequency", (F.col("stratum") + off(10)).alias("stratum"), (F.col("fan_out") + off(15)).alias("fan_out"))
    counts = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    gates = [F.when(F.lit(g) == "kept", F.col("n") + F.when(F.col("list") == "BUILDING", 1).otherwise(0)).otherwise(F.lit(k)).alias(g) for k, g in enumerate(GATES)]
    ledgers = counts.select("list", (F.col("n") + sum(range(len(GATES) - 1)) + F.when(F.col("list") == "MACHINERY", 5).otherwise(0)).alias("rows"), *gates)
    return wordlist_violations(words, ledgers)


def ladder_contract(spark: SparkSession, d: str) -> DataFrame:
    """Ladders of the benchmark's words of five letters and more: their beginnings as rungs. Some miss a letter in the bank, skip a rung, or list what cannot be spelled."""
    words = table(spark, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("ladder")).where("length(ladder) >= 5").distinct()
    w, n = F.col("ladder"), F.length("ladder")
    rungs = F.transform(F.sequence(F.lit(2), n), lambda k: F.substr(w, F.lit(1), k))
    rungs = F.when(w.startswith("a"), F.concat(F.slice(rungs, F.lit(1), F.lit(1)), F.slice(rungs, F.lit(3), n))).otherwise(rungs)
    bank = F.when(w.startswith("t"), F.substr(w, F.lit(4))).otherwise(F.concat(F.substr(w, F.lit(3)), F.lit("q")))
    also = F.when(w.startswith("o"), None).otherwise(F.transform(rungs, lambda r, k: F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.substr(r, F.lit(1), F.length(r) - 1), F.lit("q"))))))
    return ladder_violations(words.select("ladder", rungs.alias("rungs"), bank.alias("bank"), also.alias("also")))


def _spell(surface: str) -> str:
    return f"(SELECT translate(translate(substr(j, 1, 1), '{OPEN}', '{OPENED}'), '{PLAIN}', '{WRITTEN}') || translate(substr(j, 2), '{PLAIN}', '{WRITTEN}') FROM (SELECT {_LEAD.replace('surface', surface)} AS j))"


def _rule(source: str, keys: str, rule: str, broken: str) -> str:
    return f"SELECT {keys}, '{rule}' AS rule FROM {source} WHERE {broken}"


QUERIES = {f.__name__: f for f in (entry_contract, wordlist_contract, ladder_contract)}
ORACLES = {
    "entry_contract": f"WITH e AS (SELECT p_partkey, p_type, p_brand, p_size AS s, {_spell('string_split(p_name, chr(32))[1]')} AS a, {_spell('string_split(p_name, chr(32))[2]')} AS b FROM part) "
    + " UNION ALL ".join(_rule("e", "p_partkey", name, broken) for name, broken in {"length": "s % 7 = 0", "tierOne": "s % 3 > s % 4", "pos": "p_type >= p_brand", "synonyms": "s % 5 = 0 OR s % 2 = 0 AND a = b", "categories": "s % 11 = 0", "senses": "s % 13 = 0 OR s % 9 = 0"}.items()),
    "wordlist_contract": "WITH w AS (SELECT c_mktsegment AS list, c_name AS word, c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) SELECT list, word, 'stratum' AS rule FROM w WHERE k % 10 = 0 UNION ALL SELECT list, word, 'fanOut' FROM w WHERE k % 15 = 0 "
    "UNION ALL SELECT DISTINCT list, NULL, 'ledger' FROM w WHERE list IN ('BUILDING', 'MACHINERY') UNION ALL SELECT DISTINCT list, NULL, 'kept' FROM w WHERE list = 'BUILDING'",
    "ladder_contract": "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS ladder FROM benchmark), l AS (SELECT * FROM w WHERE len(ladder) >= 5) SELECT ladder, 'grows' AS rule FROM l WHERE ladder LIKE 'a%' UNION ALL "
    "SELECT ladder, 'bank' FROM l WHERE ladder LIKE 't%' UNION ALL SELECT ladder, 'also' FROM l WHERE ladder LIKE 'a%' OR ladder LIKE 't%' AND NOT contains(substr(ladder, 4), 'q') OR ladder NOT LIKE 'o%' AND contains(substr(ladder, 3), 'q')",
}
