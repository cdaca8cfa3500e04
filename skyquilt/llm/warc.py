"""WARC archives with an index written first, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

#: Equal payloads below this size are written out each time.
REVISIT_BYTES = 100
#: Bytes of records that a task reads back.
TASK_BYTES = 8 << 20
#: zlib level of the records.
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
INDEX = "key string, page_id long, url string, archive string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
_INDEX_KINDS = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder that all executors share."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def record(kind: str, key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record, a gzip member of its own. A revisit carries the HTTP header only; both kinds name digest and size of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{key}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode().rstrip('=')}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one compressed record."""
    data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    fields["payload-bytes"] = str(size)
    return fields, payload


def record_key(page_id: int | None, place: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}/{place}"))


def write_archives(pages: DataFrame, stage: Stage) -> DataFrame:
    """Writes one record for each page into archives in the shared folder; returns the staged index.

    Of pages with equal payloads of at least 100 bytes, the one with the smallest page_id is a response
    and the others revisit it; smaller payloads are always responses. Of rows that repeat that smallest
    page_id, the first by url is the response. A null page_id comes after all others; where all are null,
    every such row is a response. A null html is an empty payload. Every task attempt writes a file of
    its own, and the index holds only those of finished attempts, so a lost executor leaves no trace. An empty
    table makes no record.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    # Null ids are dealt by url; the keys of copies are joined first, so that payloads are exchanged once.
    rows = rows.withColumn("deal", F.coalesce(F.col("page_id"), F.xxhash64("url", "payload_digest")))
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "deal", "payload_digest")
    copies = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = stage.write(large.join(copies, "payload_digest").select("deal", "payload_digest", "first").distinct(), "copies")
    order = Window.partitionBy("deal", "payload_digest").orderBy("url")
    rows = rows.join(firsts, ["deal", "payload_digest"], "left").withColumn("place", F.row_number().over(order) - 1)
    root = f"{stage.root}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(root)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.stageId()}-{task.taskAttemptId()}.warc.gz"
        at = 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                index: list[tuple] = []
                for page_id, url, body, digest, size, first, place in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                    again = first is not None and (page_id != first or place > 0)
                    kind = "revisit" if again else "response"
                    key = record_key(page_id, (task.partitionId() << 32) + at if page_id is None or place else 0)
                    data = record(kind, key, url, body, digest, record_key(first, 0) if again else None)
                    out.write(data)
                    index.append((key, page_id, url, name, at, len(data), digest, size, kind, first if again else None))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), _INDEX_KINDS, strict=True)] if index else [pa.array([], f.type) for f in _INDEX_KINDS], schema=_INDEX_KINDS)

    ordered = rows.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "first", "place")
    return stage.write(ordered.mapInArrow(run, INDEX), "index")


def read_records(index: DataFrame, root: str, *, gap: int = 1 << 16, most: int = 8 << 20, tasks: int | None = None) -> DataFrame:
    """Reads the records that ``index`` selects: key, page_id, url, record_type, refers_to_key, payload_digest, payload_bytes, payload.

    The index is dealt by archive and ranges of offsets, to ``tasks`` (by default one for each TASK_BYTES of
    records), and sorted by offset; ranges less than ``gap`` bytes apart are read at
    once, up to ``most`` bytes. Every payload's digest is checked. A revisit has no payload (null).
    """

    def ranges(rows: Iterator[tuple]) -> Iterator[tuple[str, int, int, list[tuple]]]:
        held: list[tuple] = []
        for r in rows:
            if held and (r[0] != held[0][0] or r[1] > held[-1][1] + held[-1][2] + gap or r[1] + r[2] - held[0][1] > most):
                yield held[0][0], held[0][1], held[-1][1] + held[-1][2], held
                held = []
            held.append(r)
        if held:
            yield held[0][0], held[0][1], held[-1][1] + held[-1][2], held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(root)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["key", "page_id", "url", "record_type", "refers_to_key", "payload_digest", "payload_bytes", "payload"]
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
        name, file = None, None
        for archive, low, high, held in ranges(rows):
            if archive != name:
                name, file = archive, fs.open_input_file(f"{path}/{archive}")
            data, out = file.read_at(high - low, low), []
            for _, offset, length, page_id, url in held:
                fields, payload = parse(data[offset - low : offset - low + length])
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha256:") + "====").hex()
                whole = fields["warc-type"] == "response"
                if whole and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"digest differs: {archive} at {offset}")
                back = fields.get("warc-refers-to")
                out.append((fields["warc-record-id"][10:-1], page_id, url, fields["warc-type"], back and back[10:-1], digest, int(fields["payload-bytes"]), payload if whole else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    chosen = index.select("archive", "offset", "length", "page_id", "url")
    tasks = tasks or 1 + chosen.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // TASK_BYTES
    chosen = chosen.repartition(tasks, "archive", F.expr(f"offset div {TASK_BYTES}"))
    schema = "key string, page_id long, url string, record_type string, refers_to_key string, payload_digest string, payload_bytes long, payload binary"
    return chosen.sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Adds ``refers_to``, the page_id of the response that a revisit points to.

    A revisit whose response is not among the records raises an error; null where the response's page has no id.
    """
    heads = records.where("record_type = 'response'").select(F.col("key").alias("refers_to_key"), F.struct("page_id").alias("head"))
    found = records.join(heads, "refers_to_key", "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit "), F.col("key"))).cast("long")
    return found.withColumn("refers_to", F.when((F.col("record_type") == "revisit") & F.col("head").isNull(), lost).otherwise(F.col("head.page_id"))).drop("head")


def op5_indexed_warc(spark, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record, reads all archives back by the index, and returns what was read."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    stage = Stage(spark, "warc")
    index = write_archives(pages, stage)
    records = read_records(index, f"{stage.root}/archives").drop("payload")
    return resolve(stage.write(records, "read")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
