"""A store of observations and facts by source: one folder for each version of a source, and a manifest that names what holds.

A change writes new folders and then one new manifest; readers see the old state until that is there. Replacing a
source by what it holds already gives the same store, in any order of sources.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATIONS, FACTS = "source_id string, surface string, count long", "source_id string, word string, attr string, value string, ordinal int"


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> dict:
        """epoch, and for each source its folder and digest; the newest manifest in the folder."""
        found = self._listed("manifest-*.json")
        if not found:
            return {"epoch": 0, "sources": {}}
        return json.loads("".join(r.value for r in self.spark.read.option("wholetext", True).text(max(found)).collect()))  # one small file

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, pattern: str) -> list[str]:
        jvm, files = self._files()
        return [str(s.getPath()) for s in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")) or []]

    def _commit(self, manifest: dict) -> None:
        jvm, files = self._files()
        name = f"{self.folder}/manifest-{manifest['epoch']:012d}.json"
        temporary = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{uuid.uuid4().hex}.tmp")
        out = files.create(temporary, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not files.rename(temporary, jvm.org.apache.hadoop.fs.Path(name)):
            raise RuntimeError(f"{name} is there already: another writer was faster")

    def replace(self, source: str, observations: DataFrame, facts: DataFrame, digest: str) -> bool:
        """The source anew: counts of equal surfaces are summed, facts stay a bag. False if it has that digest already."""
        manifest = self.manifest()
        if manifest["sources"].get(source, {}).get("digest") == digest:
            return False
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        summed = observations.groupBy("surface").agg(F.sum("count").cast("long").alias("count"))
        summed.select(F.lit(source).alias("source_id"), "surface", "count").write.parquet(f"{folder}/observations")
        facts.select(F.lit(source).alias("source_id"), "word", "attr", "value", F.col("ordinal").cast("int")).write.parquet(f"{folder}/facts")
        manifest["sources"][source] = {"folder": folder, "digest": digest}
        self._commit({"epoch": manifest["epoch"] + 1, "sources": manifest["sources"]})
        return True

    def remove(self, source: str) -> None:
        manifest = self.manifest()
        if source not in manifest["sources"]:
            raise KeyError(f"{source} is not in the store")
        del manifest["sources"][source]
        self._commit({"epoch": manifest["epoch"] + 1, "sources": manifest["sources"]})

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{s['folder']}/{what}" for s in self.manifest()["sources"].values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def observations(self) -> DataFrame:
        return self._read("observations", OBSERVATIONS)

    def facts(self) -> DataFrame:
        return self._read("facts", FACTS)


def digest(df: DataFrame) -> DataFrame:
    """rows and hash of a table's contents; the order of rows does not matter, repeated rows do."""
    columns = sorted(df.columns)
    each = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(each).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("xor")).select("rows", F.sha2(F.concat_ws("|", "rows", "sum", "xor"), 256).alias("hash"))


def write_partitions(df: DataFrame, folder: str, keys: list[str], order: str) -> DataFrame:
    """Newline-delimited JSON, a folder for each value of keys, rows in order; nulls are left out. Returns path, bytes and digest of the files."""
    df.repartition(*keys).sortWithinPartitions(*keys, order).write.partitionBy(*keys).mode("overwrite").json(folder)
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_partitions(spark: SparkSession, folder: str, schema: str, wanted: dict[str, list[str]], manifest: DataFrame | None = None) -> DataFrame:
    """Rows of write_partitions() of the wanted values of its keys; only their folders are read. With a manifest, files whose digest differs are an error."""
    found = spark.read.schema(schema).json(folder)
    for key, values in wanted.items():
        found = found.where(F.col(key).isin(*values))
    if manifest is not None:
        now = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path", F.sha2("content", 256).alias("now"))
        bad = manifest.join(now, "path", "full").where(~F.col("sha256").eqNullSafe(F.col("now"))).limit(1).count()
        if bad:
            raise ValueError(f"files below {folder} are not those of the manifest")
    return found
