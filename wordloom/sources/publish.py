"""What is published: rows as JSON lines in files of bounded size by class and first letter, and days that are written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import letters as L
from wordloom.functions.texts import first_letter_hex, unit_kind, units
from wordloom.operators.classes import _LABEL, _POP, _SHAPES, _defect, _kind, spellings
from wordloom.sources.shared import shared_dir, written
from wordloom.sources.snapshots import write_partitions
from wordloom.sources.tables import table

#: Bytes that a file may have; days of a bank that are broadcast, more are joined by a shuffle.
CEILING, MOST_DAYS = 64 << 20, 100_000
KEYS = ["word_class", "base", "part"]


def with_parts(rows: DataFrame, ceiling: int) -> DataFrame:
    """rows (word_class, word and more) with `base`, the first letter's hex, and `part`, so that the JSON lines of one part of a class and letter, in the order of words, are `ceiling` bytes at most.

    Bytes before a row are added up range by range, so no task has to hold a letter. A part takes the rows that begin
    within a stretch of the ceiling less the longest line; a line of more than half the ceiling is an error.
    """
    sized = rows.withColumn("base", first_letter_hex(F.col("word"))).withColumn("_bytes", F.octet_length(F.to_json(F.struct(*[c for c in rows.columns if c != "word_class"]))) + 1)
    ranged = written(sized.repartitionByRange("word_class", "word").withColumn("_range", F.spark_partition_id()), "ranged")
    longest = ranged.agg(F.max("_bytes")).first()[0] or 0
    if 2 * longest > ceiling:
        raise ValueError(f"a line of {longest} bytes is too long for files of {ceiling}")
    sums = ranged.groupBy("_range", "word_class", "base").agg(F.sum("_bytes").alias("_sum"))  # as many rows as ranges and letters
    before = F.sum("_sum").over(Window.partitionBy("word_class", "base").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("_bytes").over(Window.partitionBy("_range", "word_class", "base").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("_inside", inside).join(sums, ["_range", "word_class", "base"])
    return placed.withColumn("part", F.floor((F.col("_before") + F.col("_inside")) / (ceiling - longest)).cast("int")).select(*rows.columns, "base", "part")


def publish(rows: DataFrame, folder: str, ceiling: int = CEILING) -> DataFrame:
    """Writes rows (word_class, word and more) as JSON lines, and returns the manifest: path, word_class, base, part, bytes and sha256 of each file.

    What an earlier publication left in the folder goes. Each file is read back for its digest; one over the ceiling is
    an error. Rows without a class or word are an error, as no file would name them.
    """
    rows = written(rows, "rows")
    if rows.where("word_class IS NULL OR word IS NULL OR word = ''").limit(1).count():
        raise ValueError("rows without a class or a word")
    files = write_partitions(with_parts(rows, ceiling), folder, KEYS, "word")
    listed = written(files, "manifest")
    if listed.where(F.col("bytes") > ceiling).limit(1).count():
        raise ValueError(f"a file has more than {ceiling} bytes")
    key = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    return listed.select("path", key("word_class").alias("word_class"), key("base").alias("base"), key("part").cast("int").alias("part"), "bytes", "sha256")


def letter_index(manifest: DataFrame) -> DataFrame:
    """base, letter, roman and kind of the letters that a manifest's files are filed under; a base that is no letter is an error."""
    letter = F.decode(F.unhex("base"), "UTF-16BE")
    label = L.roman(letter)
    known = F.when(label.isNotNull(), label).otherwise(F.raise_error(F.concat(F.lit("files are filed under what is no letter: "), "base")).cast("string"))
    return manifest.select("base").distinct().select("base", letter.alias("letter"), known.alias("roman"), unit_kind(letter).alias("kind"))


def days_of(spark: SparkSession, folder: str) -> DataFrame:
    """day and bytes of the days that a bank's folder holds, from the paths of its files; none if there is no folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "day string, bytes long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    return files.groupBy(F.regexp_extract("path", "/day=([0-9-]+)/", 1).alias("day")).agg(F.sum("length").alias("bytes"))


def bank_days(rows: DataFrame, folder: str) -> int:
    """Writes the days of rows (day, yyyy-mm-dd, and more) that the folder does not hold yet, and returns how many. What is there is never written again."""
    spark = rows.sparkSession
    known = written(days_of(spark, folder).select("day"), "known-days")
    few = known.limit(MOST_DAYS + 1).count() <= MOST_DAYS
    new = written(rows.join(F.broadcast(known) if few else known, "day", "left_anti"), "days")
    count = new.select("day").distinct().count()
    if count:
        new.repartition("day").write.partitionBy("day").mode("append").json(folder)
    return count


def published_letters(spark: SparkSession, d: str) -> DataFrame:
    """word_class, base, letter, roman, kind, rows and bytes of the published words that begin with a letter, read back by the manifest of their files."""
    words = spellings(spark, d).where(L.letter_defect(F.get(units(F.col("word")), F.lit(0))).isNull())
    rows = words.select(F.when(L.shape(F.col("word"))["has_grantha"], "loanword").otherwise("headword").alias("word_class"), "word", F.size(units(F.col("word"))).alias("length"))
    manifest = publish(rows, f"{shared_dir(spark)}/published-{uuid.uuid4().hex}")
    files = [r.path for r in manifest.select("path").toLocalIterator()]
    read = spark.read.schema("word string, length int").json(files).withColumn("base", first_letter_hex(F.col("word"))) if files else spark.createDataFrame([], "word string, length int, base string")
    counts = read.withColumn("word_class", F.when(L.shape(F.col("word"))["has_grantha"], "loanword").otherwise("headword")).groupBy("word_class", "base").agg(F.count(F.lit(1)).alias("rows"))
    sizes = manifest.groupBy("word_class", "base").agg(F.sum("bytes").alias("bytes"))
    return counts.join(sizes, ["word_class", "base"]).join(letter_index(manifest), "base").select("word_class", "base", "letter", "roman", "kind", "rows", "bytes")


def day_bank(spark: SparkSession, d: str) -> DataFrame:
    """day and rows of a bank of the days of events, filled in two runs: first the purchases of even days, then all days that are missing."""
    folder = f"{shared_dir(spark)}/bank-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type")
    bank_days(rows.where("event_type = 'purchase' AND cast(right(day, 2) AS int) % 2 = 0"), folder)
    bank_days(rows, folder)
    read = spark.read.schema("day string, event_id long, event_type string").option("basePath", folder).json(folder)
    return read.groupBy("day").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {"published_letters": published_letters, "day_bank": day_bank}
ORACLES = {
    "published_letters": f"""WITH {_POP}, {_SHAPES}, f AS (SELECT word, len(u) AS length, u[1] AS unit, CASE WHEN has_grantha THEN 'loanword' ELSE 'headword' END AS word_class FROM sh WHERE len(u) > 0 AND ({_defect('u[1]')}) IS NULL),
g AS (SELECT word_class, lpad(lower(to_hex(unicode(unit))), 4, '0') AS base, unit[1] AS letter, word, length FROM f), h AS (SELECT word_class, base, letter, count(*) AS rows, CAST(sum(octet_length(encode('{{"word":"' || word || '","length":' || length || '}}')) + 1) AS BIGINT) AS bytes FROM g GROUP BY 1, 2, 3),
k AS (SELECT *, letter AS unit, ({_defect('letter')}) AS defect FROM h) SELECT word_class, base, letter, {_LABEL} AS roman, {_kind('letter')} AS kind, rows, bytes FROM k""",
    "day_bank": "WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type = 'purchase' AS p, day(ts) % 2 = 0 AS even FROM events) SELECT day, CASE WHEN bool_or(p AND even) THEN count(*) FILTER (WHERE p) ELSE count(*) END AS rows FROM e GROUP BY 1",
}
