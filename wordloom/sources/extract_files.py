"""Extract files: what a source's records became, as JSON lines of several kinds between a header and a summary.

An extract is a folder. It is written under a temporary name, counted while it is written, and takes its name only if
the counts reconcile; so a folder that has the name is whole, and a reader checks that it still is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import extracts
from wordloom.sources.shared import shared_dir

#: Version of the layout and of what extractors do; another one makes an extract stale.
VERSION = 1
RECORD = "record string, surface string, count long, word string, attr string, value string, ordinal int"
COUNTED = ("observations", "facts")


def _path(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, folder: str, document: dict) -> None:
    path, files = _path(spark, folder)
    out = files.create(path, True)
    out.write(bytearray((json.dumps(document, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    out.close()


def _get(spark: SparkSession, file: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(file).first().value)  # one line


def reconciled(summary: dict) -> list[str]:
    """What does not add up in a summary: every row that came in went out or was rejected, and all counts are there and not negative."""
    names = ("rowsIn", "rowsOut", "parseRejects", *COUNTED)
    wrong = [f"{n} is missing or negative" for n in names if not isinstance(summary.get(n), int) or summary[n] < 0]
    if not wrong and summary["rowsIn"] != summary["rowsOut"] + summary["parseRejects"]:
        wrong.append(f"{summary['rowsIn']} rows came in, {summary['rowsOut']} went out and {summary['parseRejects']} were rejected")
    return wrong


def write_extract(folder: str, header: dict, observations: DataFrame, facts: DataFrame, ledger: dict) -> dict:
    """Writes observations (surface, count) and facts (word, attr, value, ordinal) of a source to `folder`, and returns the summary.

    header has sourceId and sha256, and what else tells of the source; ledger has rowsIn, rowsOut and parseRejects.
    Observations and facts are counted as they are written. If the summary does not reconcile, nothing is left and it
    is an error. An extract that has the name already is replaced when the new one is whole.
    """
    spark = observations.sparkSession
    each = observations.select(F.lit("observation").alias("record"), "surface", "count").unionByName(facts.select(F.lit("fact").alias("record"), "word", "attr", "value", "ordinal"), allowMissingColumns=True)
    seen = Observation()
    counted = each.observe(seen, F.count_if(F.col("record") == "observation").alias("observations"), F.count_if(F.col("record") == "fact").alias("facts"))
    partial = f"{folder.rstrip('/')}.{uuid.uuid4().hex}.partial"
    counted.select(F.to_json(F.struct(*each.columns)).alias("value")).write.text(f"{partial}/records")
    summary = {"record": "summary", **ledger, **{n: seen.get[n] for n in COUNTED}}
    path, files = _path(spark, partial)
    if wrong := reconciled(summary):
        files.delete(path, True)
        raise ValueError(f"{header.get('sourceId')}: " + "; ".join(wrong))
    _put(spark, f"{partial}/header.json", {"record": "header", "extractorVersion": VERSION, **header})
    _put(spark, f"{partial}/summary.json", summary)
    name, _ = _path(spark, folder)
    old, _ = _path(spark, f"{folder.rstrip('/')}.{uuid.uuid4().hex}.old")
    replaced = files.exists(name) and files.rename(name, old)
    if not files.rename(path, name):
        raise OSError(f"{partial} could not be renamed to {folder}")
    if replaced:
        files.delete(old, True)
    return summary


def is_current(spark: SparkSession, folder: str, sha256: str) -> bool:
    """Whether there is an extract of these bytes by this version."""
    path, files = _path(spark, f"{folder}/summary.json")
    if not files.exists(path):
        return False
    header = _get(spark, f"{folder}/header.json")
    return header.get("sha256") == sha256 and header.get("extractorVersion") == VERSION


def read_extract(spark: SparkSession, folder: str) -> tuple[dict, DataFrame, DataFrame]:
    """header, observations and facts of an extract. Counts that differ from its summary, and lines that are no records, are errors."""
    header, summary = _get(spark, f"{folder}/header.json"), _get(spark, f"{folder}/summary.json")
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(f"{folder}/records")
    found = rows.agg(F.count_if(F.col("record") == "observation").alias("observations"), F.count_if(F.col("record") == "fact").alias("facts"), F.count(F.lit(1)).alias("all")).first()
    wrong = reconciled(summary) + [f"{found[n]} {n} are there, {summary.get(n)} were written" for n in COUNTED if found[n] != summary.get(n)]
    if found["all"] != found["observations"] + found["facts"]:
        wrong.append("there are lines that are no records")
    if wrong:
        raise ValueError(f"{folder}: " + "; ".join(wrong))
    return header, rows.where("record = 'observation'").select("surface", "count"), rows.where("record = 'fact'").select("word", "attr", "value", "ordinal")


def extract_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """kind, name and n: surfaces with what is observed of them, and attributes of facts, of the parts' extract as it is read back."""
    records = extracts.parsed(spark, d)
    counts = records.agg(F.count(F.lit(1)).alias("all"), F.count("surface").alias("out")).first()
    seen = records.where("surface IS NOT NULL").groupBy("surface").agg(F.sum("count").alias("count"))
    facts = extracts.facts(records).select(F.col("surface").alias("word"), "attr", "value", F.lit(0).alias("ordinal"))
    folder = f"{shared_dir(spark)}/extract-{uuid.uuid4().hex}"
    write_extract(folder, {"sourceId": "part", "sha256": "-"}, seen, facts, {"rowsIn": counts["all"], "rowsOut": counts["out"], "parseRejects": counts["all"] - counts["out"]})
    _, observed, told = read_extract(spark, folder)
    return observed.select(F.lit("observation").alias("kind"), F.col("surface").alias("name"), F.col("count").alias("n")).unionAll(told.groupBy("attr").agg(F.count(F.lit(1)).alias("n")).select(F.lit("fact"), "attr", "n"))


QUERIES = {"extract_roundtrip": extract_roundtrip}
ORACLES = {"extract_roundtrip": f"WITH {extracts._FACTS} SELECT 'observation' AS kind, surface AS name, CAST(sum(count) AS BIGINT) AS n FROM p WHERE surface IS NOT NULL GROUP BY 2 UNION ALL SELECT 'fact', attr, count(*) FROM f GROUP BY 2"}
