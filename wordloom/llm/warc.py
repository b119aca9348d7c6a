"""WARC archives from a table of pages, written the same way every time, and read back.

Records are ordered by page id and cut into shards, ranges of ids with about equal bytes (parts of one id by digest, if
it has more). Each shard's task writes its
records one gzip member each, begins a new file when the compressed size is reached, and makes headers and digests
anew from the rows. A file is written under a temporary name of its own, then renamed; the task then reports its
files, and the table of those reports, which Spark commits as a whole, is the manifest. Readers take what it lists. A
task that runs again or twice writes the same bytes under the same names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from math import inf

import pyarrow as pa
from pyarrow import fs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import slices, written

#: Least payload that may be a revisit; bytes of html in a shard and compressed bytes of a file; shards at most.
LEAST_REVISIT, SHARD_BYTES, FILE_BYTES, MOST_SHARDS = 1000, 32 << 20, 32 << 20, 16_384
DATE, HTTP = "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
#: Tasks at most that read archives.
READERS = 10_000

MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and size and digest of the payload."""
    text = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", "html", F.octet_length(text).cast("long").alias("size"), F.sha1(text.cast("binary")).alias("digest"))


def revisits(sized: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the pages that revisit another: the greatest page id with an equal long payload."""
    long = sized.where(F.col("size") >= LEAST_REVISIT).select("page_id", "digest")
    last = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    earlier = (F.col("page_id") != F.col("refers_to")) | F.col("page_id").isNull() & F.col("refers_to").isNotNull()
    return long.join(last, "digest").where(earlier).select("page_id", "digest", "refers_to").distinct()


def with_shards(records: DataFrame, pages: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """records (page_id, digest) with `shard` and `sub`, and how many pairs of them there are.

    Page ids are cut where the bytes of html before them, in order of id, pass a multiple of shard_bytes (of more, if
    that would make over MOST_SHARDS). Null ids come first. An id that has more than that by itself, null too, parts
    by digest. All of this follows from the rows alone, whatever partitions they come in.
    """
    bytes_of = F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long"))
    ids = written(pages.groupBy("page_id").agg(bytes_of.alias("bytes")), "ids")
    total = ids.agg(F.sum("bytes")).first()[0] or 0
    step = max(shard_bytes, -(-total // MOST_SHARDS))
    hot = written(ids.where(F.col("bytes") > step).select(F.col("page_id").alias("hot_id"), F.ceil(F.col("bytes") / step).cast("int").alias("parts")), "hot-ids")
    ranged = written(ids.where("page_id IS NOT NULL").repartitionByRange("page_id").withColumn("part", F.spark_partition_id()), "ids-in-order")
    offset, starts = 0, []
    for row in sorted(ranged.groupBy("part").agg(F.min("page_id").alias("low"), F.sum("bytes").alias("n")).collect(), key=lambda r: r.low):  # a row a partition
        starts.append((row.part, offset))
        offset += row.n
    running = F.col("offset") + F.sum("bytes").over(Window.partitionBy("part").orderBy("page_id"))
    passed = ranged.join(F.broadcast(records.sparkSession.createDataFrame(starts, "part int, offset long")), "part").select("page_id", "bytes", running.alias("running"))
    last = passed.where(F.expr(f"running div {step} > (running - bytes) div {step}")).select("page_id").collect()  # MOST_SHARDS at most
    cuts = sorted({float(r.page_id) + 1 for r in last})
    places = Bucketizer(splits=[-inf, *cuts, inf], inputCol="_id", outputCol="_shard", handleInvalid="keep")
    placed = places.transform(records.withColumn("_id", F.col("page_id").cast("double"))) if cuts else records.withColumn("_shard", F.lit(0.0)).withColumn("_id", F.lit(0.0))
    shard = F.when(F.col("page_id").isNull(), F.lit(-1)).otherwise(F.col("_shard").cast("int")).cast("long").alias("shard")
    found = placed.join(F.broadcast(hot), F.col("page_id").eqNullSafe(F.col("hot_id")), "left")  # MOST_SHARDS rows at most
    sub = F.coalesce(F.pmod(F.xxhash64("digest"), F.col("parts")), F.lit(0)).cast("long").alias("sub")
    return found.select(*records.columns, shard, sub), len(cuts) + 2 + (hot.agg(F.sum("parts")).first()[0] or 0)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def sha1_name(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    block = HTTP.format(size).encode() + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    lines += [f"Payload-Length: {size}", f"WARC-Payload-Digest: {sha1_name(bytes.fromhex(digest))}", f"WARC-Block-Digest: {sha1_name(hashlib.sha1(block).digest())}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """A file that exists under its name only when it is whole."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str):
        self.store, self.folder, self.name = store, folder, name
        self.temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
        self.stream, self.records, self.bytes, self.digest = store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()

    def add(self, data: bytes) -> None:
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = member.compress(data) + member.flush()
        self.stream.write(packed)
        self.digest.update(packed)
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)

    def close(self) -> tuple:
        self.stream.close()
        self.store.move(self.temporary, f"{self.folder}/{self.name}")
        return self.name, self.records, self.bytes, self.digest.hexdigest()


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives into the new folder, a URI that all executors reach, and returns the manifest.

    One record for each row, repeated rows and null ids included; null html has an empty payload, a null url no target.
    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the greatest page id are responses and the
    others revisits of it. An empty table gives an empty manifest; further columns are ignored.
    """
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    pages = pages.select("page_id", "url", "html")
    sized = digests(pages)
    # What a page refers to travels as a row of its own before the page's, so that payloads are shuffled once only.
    nothing = F.lit(None).cast("string")
    notes = revisits(sized).select("page_id", nothing.alias("url"), nothing.alias("html"), F.lit(None).cast("long").alias("size"), "digest", "refers_to")
    rows, shards = with_shards(sized.withColumn("refers_to", F.lit(None).cast("long")).unionAll(notes), pages, shard_bytes)
    rows = rows.repartitionByRange(shards, "shard", "sub").sortWithinPartitions("shard", "sub", "page_id", "digest", F.col("refers_to").isNull(), "url")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        open_file, shard, number, done, note = None, None, 0, [], None
        place = lambda r: (r["shard"], r["sub"])
        for whole in batches:
            for batch in slices([whole], "html"):
                for r in batch.to_pylist():
                    if r["size"] is None:
                        note = r
                        continue
                    refers_to = note["refers_to"] if note and (note["page_id"], note["digest"]) == (r["page_id"], r["digest"]) else None
                    if place(r) != shard or open_file and open_file.bytes >= file_bytes:
                        done += [open_file.close()] if open_file else []
                        number = number + 1 if place(r) == shard else 0
                        shard = place(r)
                        open_file = _File(store, path, f"pages-{shard[0]:08d}-{shard[1]:05d}-{number:05d}.warc.gz")
                    payload = b"" if refers_to is not None else (r["html"] or "").encode("utf-8")
                    open_file.add(record(r["page_id"], r["url"], payload, r["size"], r["digest"], refers_to))
        done += [open_file.close()] if open_file else []
        columns = zip(*done, strict=True) if done else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=MANIFEST.names)

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(pages.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, records, bytes and sha256 of each archive in the folder."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a stream, one by one."""
    rest = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            rest = rest or stream.read(READ_BYTES)
            if not rest:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(member.decompress(rest))
            rest = member.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """One record; raises where its digests or lengths do not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or sha1_name(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"]:
        raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
    payload, kind = block.partition(b"\r\n\r\n")[2], headers["WARC-Type"]
    if kind == "response" and sha1_name(hashlib.sha1(payload).digest()) != headers["WARC-Payload-Digest"]:
        raise ValueError(f"wrong payload {headers['WARC-Record-ID']}")
    number = lambda key: int(headers[key]) if key in headers else None
    url = headers.get("WARC-Target-URI")
    return {
        "page_id": number("Page-Id"),
        "url": url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "payload_bytes": len(payload) if kind == "response" else number("Payload-Length"),
        "payload_digest": base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex(),
        "record_type": kind,
        "refers_to": number("Refers-To-Page-Id"),
        "payload": payload if kind == "response" else None,
    }


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all archives that the folder's manifest lists; payload is null for revisits, or for all if not asked for."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = T.StructType(RECORDS.fields[: 7 if payload else 6])

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(schema.names, kinds, strict=False)], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        rows.append(parse(data))
                        size += len(data) if payload else 200
                        if size >= READ_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    files = manifest(spark, folder).select("file")
    return files.repartitionByRange(max(1, min(READERS, files.count())), "file").mapInArrow(run, schema)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p),
r AS (SELECT *, payload_bytes >= {LEAST_REVISIT} AND page_id < last AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r
"""
