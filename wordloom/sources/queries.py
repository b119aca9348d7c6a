"""Queries over the readers: tables written in a raw format to the shared folder and read back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.sources import json_arrays
from wordloom.sources.shared import shared_dir
from wordloom.sources.tables import table

#: Rows of an array that one file holds; bounds what a task of the writer puts together.
FILE_ROWS = 1_000


def write_json_arrays(rows: DataFrame, path: str, root: str) -> None:
    """The rows as objects of arrays under the key `root`, FILE_ROWS or so in each file."""
    files = max(1, math.ceil(rows.count() / FILE_ROWS))
    listed = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(files)).alias("file"), F.to_json(F.struct(*rows.columns)).alias("o"))
    text = F.concat(F.lit(f'{{"written": "[", "{root}": ['), F.array_join(F.collect_list("o"), ",\n"), F.lit("]}"))
    listed.groupBy("file").agg(text.alias("value")).write.partitionBy("file").text(path)


def json_array_elements(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, role and digest of the text of all turns, from files that each hold an array of them."""
    path = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}"
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    write_json_arrays(turns, path, "turns")
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in turns.schema])
    return json_arrays.read(spark, path, kind, "turns").select("element.conv_id", "element.turn", "element.role", F.md5(F.col("element.text").cast("binary")).alias("digest"))


QUERIES = {"json_array_elements": json_array_elements}
ORACLES = {"json_array_elements": "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations"}
