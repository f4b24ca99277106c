"""Deterministic sharded WARC archives: range-sorted records, rolled files, digests made anew, two-step commit."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions

DATE = "2024-01-01T00:00:00Z"
#: The most shards of an archive: beyond so many times shard_bytes, shards grow.
SHARDS = 65_536


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}|{digest}'.encode()).digest()[:16], version=5)}>"


def _safe(url: str) -> str:
    """A URL fit for a header line: what would end or blur the line is percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, which holds the payload's length, and drops the payload."""
    digest = b32(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, digest)}", f"WARC-Refers-To-Page-ID: {first}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{b32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def rank_key() -> Column:
    """33 letters whose order is that of (id, hash of the payload), null ids first."""
    digits = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(F.col("id").isNull(), "0").otherwise("1"), digits(F.coalesce("id", F.lit(0).cast("long"))), digits(F.xxhash64("payload")))


def shard_starts(sizes: DataFrame, shard_bytes: int, path: str) -> list[str]:
    """The first key of each shard, in order, from (key, n) rows: a shard ends with the key whose sum of all n so far
    passes the next multiple of shard_bytes, so it holds at most that and one key more, however keys are spread.

    Sums are exact, so the shards do not depend on partitions. Keys are summed within ranges; the driver gets one total a
    range (spark.sql.shuffle.partitions of them) and at most SHARDS + 1 keys."""
    spark = sizes.sparkSession
    ranged = sizes.groupBy("key").agg(F.sum("n").alias("n")).repartitionByRange(partitions(spark), "key").withColumn("part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema("key string, n long, part int").parquet(path)
    before, total = [], 0
    for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        before.append((r["part"], total))
        total += r["n"]
    step = max(shard_bytes, -(-total // SHARDS))
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    so_far = F.sum("n").over(W.partitionBy("part").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = ranged.withColumn("sum", so_far).join(offsets, "part").select("key", F.floor((F.col("before") + F.col("sum") - F.col("n")) / F.lit(step)).alias("shard"))
    return [r["key"] for r in placed.groupBy("shard").agg(F.min("key").alias("key")).orderBy("shard").collect()]


def write_archive(
    df: DataFrame, id_col: str, url_col: str, payload_col: str, out: str, shard_bytes: int = 16 << 20, roll_bytes: int = 4 << 20, min_revisit: int = 0, date: str = DATE
) -> DataFrame:
    """Writes one record per row under out (a URI that all machines reach) and returns the committed manifest.

    Records are sorted by (shard, id); a shard is a range of ids (of payloads too where ids repeat) with about shard_bytes
    of payload, and its files are rolled at roll_bytes compressed. Shards depend on ids, payloads and sizes only, so reruns
    give the same files byte for byte. Tasks write
    temporary names that no two attempts share; the rows that a successful attempt returns are the manifest; a second
    job renames by it, and can be repeated after a loss; the manifest that readers use is written last.

    Of rows with equal payloads of at least min_revisit bytes, that with the smallest id is the response, the others
    revisit it; rows that repeat that smallest id are responses too. Null payload: empty. Null id: sorts first, has no
    page header, and never is what others refer to unless all ids of the payload are null (then all are responses). Null
    URL: no target header. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    small = rows.select("id", "digest", "size")

    starts = shard_starts(rows.select(rank_key().alias("key"), (F.col("size") + 400).alias("n")), shard_bytes, f"{out}/_sizes")
    shards = max(1, len(starts))
    sent = spark.sparkContext.broadcast(np.array(starts, "S33"))

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(sent.value, keys.to_numpy().astype("S33"), "right") - 1, 0).astype(np.int32))

    twice = small.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    twice.write.parquet(f"{out}/_repeats")
    twice = spark.read.schema(twice.schema).parquet(f"{out}/_repeats")
    marked = rows.join(twice, (F.col("digest") == F.col("d")) & (F.col("size") >= min_revisit), "left")
    revisit = F.col("d").isNotNull() & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    marked = marked.select(shard_of(rank_key()).alias("shard"), "id", "url", "payload", "first", revisit.alias("revisit"))
    ordered = marked.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "id", "url", "revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(out)
        store.create_dir(f"{root}/_partial", recursive=True)
        attempt, done = uuid.uuid4().hex, []
        stream, shard, seq, size, records, digest, tmp = None, None, 0, 0, 0, None, ""

        def close() -> None:
            nonlocal stream, seq
            if stream is not None:
                stream.close()
                done.append({"name": f"part-{shard:06d}-{seq:05d}.warc.gz", "partial": tmp, "bytes": size, "records": records, "sha1": digest.hexdigest()})
                stream, seq = None, seq + 1

        for b in batches:
            for s, i, url, payload, first, again in zip(*(b.column(k).to_pylist() for k in range(6))):
                if s != shard:
                    close()
                    shard, seq = s, 0
                if stream is None:
                    tmp = f"{attempt}-{shard:06d}-{seq:05d}"
                    stream, digest, records = store.open_output_stream(f"{root}/_partial/{tmp}", compression=None), hashlib.sha1(), 0
                    info = f"software: tessera\r\nformat: WARC File Format 1.1\r\nisPartOf: {shard:06d}-{seq:05d}\r\n".encode()
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(-1, f'{shard}-{seq}')}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    packed = member(head.encode() + info + b"\r\n\r\n")
                    stream.write(packed)
                    digest.update(packed)
                    size = len(packed)
                packed = member(record(i, url, payload, first, again, date))
                stream.write(packed)
                digest.update(packed)
                size, records = size + len(packed), records + 1
                if size >= roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=MANIFEST)

    ordered.mapInArrow(write, "name string, partial string, bytes long, records long, sha1 string").write.parquet(f"{out}/_written")
    written = spark.read.schema("name string, partial string, bytes long, records long, sha1 string").parquet(f"{out}/_written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(out)
        for b in batches:
            for r in b.to_pylist():
                source, to = f"{root}/_partial/{r['partial']}", f"{root}/{r['name']}"
                if store.get_file_info(source).type != pafs.FileType.NotFound:
                    store.move(source, to)
                if store.get_file_info(to).size != r["bytes"]:
                    raise OSError(f"archive file {r['name']} is missing or incomplete")
            yield b.select(["name", "bytes", "records", "sha1"])

    final = "name string, bytes long, records long, sha1 string"
    written.mapInArrow(commit, final).write.parquet(f"{out}/_manifest")
    store, root = open_fs(out)
    if store.get_file_info(f"{root}/_partial").type != pafs.FileType.NotFound:
        store.delete_dir(f"{root}/_partial")  # what failed attempts left
    return spark.read.schema(final).parquet(f"{out}/_manifest")


MANIFEST = pa.schema([("name", pa.string()), ("partial", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string())])


def records_of(stream, block: int = 1 << 18) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip-member archive, one record in memory at a time."""
    pending, ended = b"", False
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not pending and not ended:
                pending = stream.read(block)
                ended = not pending
            if not pending:
                if parts:
                    raise ValueError("archive ends within a record")
                return
            parts.append(z.decompress(pending))
            pending = z.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if len(rest) < size:
            raise ValueError("record is shorter than its Content-Length")
        yield fields, rest[:size]


def read_archive(spark: SparkSession, out: str, with_payload: bool = False) -> DataFrame:
    """The records of a committed archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload).

    Block and payload digests are checked; a difference fails the query. Files are dealt out, none is read whole."""
    manifest = spark.read.schema("name string, bytes long, records long, sha1 string").parquet(f"{out}/_manifest")
    files = manifest.count()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * with_payload]
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(out)
        rows, held = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, block in records_of(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-block-digest"] != f"sha1:{b32(block)}" or (kind == "response" and b32(payload) != digest):
                            raise ValueError(f"digest differs in {name}")
                        length = next(int(x[15:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
                        page, first = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                        row = {"page_id": None if page is None else int(page), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": None if first is None else int(first), "url": fields.get("warc-target-uri")}
                        if with_payload:
                            row["payload"] = payload if kind == "response" else None
                            held += len(payload)
                        rows.append(row)
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    text = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return manifest.select("name").repartition(max(1, files)).mapInArrow(read, text)
