"""Deterministic sharded WARC archives.

Records are range-sorted by id. The cuts come from the ids whose hashes are lowest, so they
depend on the data alone, not on a random sample, and another run, another cluster or a lost
executor gives the same files byte for byte. Each shard is written by one task as gzip members,
one per record, and rolls to a new file when the compressed size passes a limit. Headers and
digests are regenerated from the payload. A file is written under a name of its attempt and
renamed when complete; the manifest, written last, names the files that count.

Of records with equal payloads of at least `least_bytes` the one with the largest id is the
response; the others are revisits that refer to it and carry no payload. Which one that is, is
counted by digest before any payload moves; decisions and payloads then meet in the one range
shuffle, where a decision sorts just before its payload.

Defined results: a null payload is empty; a null id sorts first and is written as an empty
number; a null url gives no target header; of repeated rows with the largest id the first is the
response, the others revisit it; other columns are not read; an empty table gives no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgov.llm.common import cut_lineage, work_dir
from promptgov.plans.lineage import task_count

#: Compressed bytes after which a file is closed, raw bytes in a shard, ids that place the cuts.
ROLL_BYTES, SHARD_BYTES, CUT_IDS = 32 << 20, 256 << 20, 20_000
DATE = "1970-01-01T00:00:00Z"
SLICE = 1 << 13
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MANIFEST = "file string, records long, bytes long, sha256 string"
READ = ("record_type string, page_id string, refers_to string, payload_digest string, payload_bytes long, "
        "url string, payload binary")


def digest(payload: Column) -> Column:
    """Bare base32 of SHA-1: five hex digits at a time are four letters."""
    hexed = F.sha1(payload)
    letters = []
    for i in range(8):
        part = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(part, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                    for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def shard_cuts(pages: DataFrame, id_col: str, shards: int, ids: int = CUT_IDS) -> list[int]:
    """Ids that cut the table into about equal shards, from the `ids` ids with the lowest hashes."""
    if shards < 2:
        return []
    rows = pages.select(F.col(id_col).alias("id")).filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(ids).collect()
    found = sorted(r["id"] for r in rows)
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


def header(kind: str, page_id, url, payload_digest: str, refers_to, block: bytes) -> bytes:
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    lines.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def member(kind: str, page_id, url, payload_digest: str, refers_to, payload: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    record = header(kind, page_id, url, payload_digest, refers_to, block) + block + b"\r\n\r\n"
    return gzip.compress(record, compresslevel=6, mtime=0)


class Rolling:
    """Files of one shard: written under an attempt's name, renamed when full."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.shard, self.limit, self.number, self.done = shard, limit, 0, []
        self.stream = None

    def add(self, data: bytes) -> None:
        if self.stream is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = posixpath.join(self.path, f"_{self.name}.{uuid.uuid4().hex}.tmp")
            self.stream, self.records, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0, 0
            self.sum = hashlib.sha256()
        self.stream.write(data)
        self.sum.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(self.temporary, posixpath.join(self.path, self.name))
            self.done.append((self.name, self.records, self.size, self.sum.hexdigest()))
            self.stream, self.number = None, self.number + 1


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write the archives to a folder that all executors reach; returns the manifest."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.select("id", F.octet_length("payload").alias("n"), digest(F.col("payload")).alias("digest"))
    keyed = cut_lineage(keyed, "digests")
    total = keyed.agg(F.sum("n").alias("n")).first()["n"] or 0
    cuts = shard_cuts(keyed, "id", -(-total // shard_bytes))
    # The largest id of equal payloads, for those ids that are not alone.
    keeper = keyed.filter(F.col("n") >= least_bytes).groupBy("digest", "n").agg(
        F.max("id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    decided = keyed.join(keeper, ["digest", "n"]).select("id", "digest", "keeper").distinct()
    decided = decided.select("id", "digest", F.lit(0).alias("part"), "keeper", F.lit(None).cast("string").alias("url"),
                             F.lit(None).cast("binary").alias("payload"))
    # Payloads cross the network compressed.
    full = rows.select("id", digest(F.col("payload")).alias("digest"), F.lit(1).alias("part"),
                       F.lit(None).cast("long").alias("keeper"), "url", "payload")
    full = full.mapInArrow(_packed, full.schema)
    shard = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(c).cast("long") for c in cuts])
        shard = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("id"))))
    ordered = full.unionByName(decided).withColumn("shard", shard.cast("int")).repartition(
        max(len(cuts) + 1, task_count(spark)), "shard").sortWithinPartitions("shard", "id", "digest", "part", "url")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, keeper, of, first, done = None, None, None, True, []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "id", "digest", "part", "keeper", "url", "payload")]
            for i in range(batch.num_rows):
                number, page_id, found, part, kept, url, data = (c[i].as_py() for c in columns)
                if out is None or out.shard != number:
                    if out is not None:
                        out.close()
                        done += out.done
                    out = Rolling(folder, number, roll_bytes)
                if part == 0:
                    keeper, of, first = kept, (page_id, found), True
                    continue
                if of != (page_id, found):
                    keeper, of, first = page_id, (page_id, found), True
                kind = "response" if keeper == page_id and first else "revisit"
                first = False
                out.add(member(kind, page_id, url, found, keeper, unpack(data)))
        if out is not None:
            out.close()
            done += out.done
        columns = list(zip(*done, strict=True)) if done else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            names=["file", "records", "bytes", "sha256"])

    manifest = ordered.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _packed(batches):
    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        i = batch.schema.get_field_index("payload")
        small = [compress(p) for p in batch.column(i).to_pylist()]
        yield batch.set_column(i, "payload", pa.array(small, pa.binary()))


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one gzip member at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        # What a member leaves of its last slice is copied, so slices are small.
        unzip, parts = zlib.decompressobj(wbits=31), []
        while not unzip.eof and at < len(view):
            parts.append(unzip.decompress(view[at:at + SLICE]))
            at += min(SLICE, len(view) - at)
        at -= len(unzip.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files in the manifest. Payload digests are checked on the way."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(
        manifest.select("file"), "file", "left_semi").select("content")

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for fields, block in records(content.as_py()):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (
                            base64.b32encode(hashlib.sha1(body).digest()).decode() != found or len(body) != size):
                        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
                    number = lambda key: fields.get(key, "<urn:page:>")[10:-1] or None
                    rows.append((fields["WARC-Type"], number("WARC-Record-ID"), number("WARC-Refers-To"), found, size,
                                 fields.get("WARC-Target-URI"), body if payloads else None))
                    held += len(body)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield packed(rows)
                        rows, held = [], 0
                yield packed(rows)

    def packed(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    read = files.mapInArrow(parse, READ)
    return read.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive the pages in the shared folder and read the records back."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    uri = folder if "://" in folder else folder.replace("file:/", "file:///") if folder.startswith("file:/") else f"file://{folder}"
    write_warc(pages, uri, least_bytes=least_bytes)
    return read_warc(spark, uri, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
