"""WARC archives in dictionary-compressed Zstandard, written and read back.

A file starts with a skippable frame (magic 0x184D2A5D) that embeds the Zstandard dictionary, as the ``.warc.zst``
convention has it; then each record is a frame of its own. The dictionary is built from the payloads of a bounded
sample (it only helps compression). The first record of a file is its ``warcinfo``.

Of rows with equal payloads (SHA-1) of at least ``min_payload`` bytes the one with the smallest page_id is archived as
``response``, the others as ``revisit`` with an empty block, the digest, the full payload's length and the record they
refer to. Smaller payloads are all responses.

Cases: null html is the empty payload; rows that repeat a page_id share its role; rows without page_id never become the
one referred to, and without any other are responses; urls are percent-encoded where a header could not hold them; very long
payloads are one record like any other; an empty table gives no rows; further columns are ignored. Files are named for each attempt, and only those that a finished
task reports are read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_files import _dictionary, _files, sampled, train

OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
FILES = "path string, records long"
#: Fixed value: the skippable frame that holds a dictionary.
SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(kind: str, record_id: str, block: bytes, headers: dict[str, object]) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **headers, "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    headers: dict[str, object] = {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Target-URI": urllib.parse.quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")}
    if kind == "revisit":
        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": name_of(refers_to), "WARC-Truncated": "length", "Payload-Length": len(payload)}
        block = b""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record(kind, name_of(page_id), block, headers | {"Content-Type": "application/http; msgtype=response"})


def head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def records(source, chunk: int = 1 << 18) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open file, front to back, one frame in memory at a time."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(source.read(size)))
    rest, frame, parts = b"", None, []
    while data := rest or source.read(chunk):
        frame = frame or unzip.decompressobj()
        parts.append(frame.decompress(data))
        rest = b""
        if frame.eof:
            raw, rest, frame, parts = b"".join(parts), frame.unused_data, None, []
            top, _, block = raw.partition(b"\r\n\r\n")
            lines = top.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("not a WARC record")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            if len(block) != int(headers["Content-Length"]) + 4:
                raise ValueError("a record of the wrong length")
            yield headers, block[:-4]
    if frame is not None:
        raise ValueError("a frame is cut off")


def classified(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(page_id, url, html, kind, refers_to). Groups of equal payloads are aggregated before the shuffle; Spark splits what a frequent payload makes large in the join."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("key", F.sha1(F.encode("html", "UTF-8")))
    first = keyed.where(F.octet_length("html") >= min_payload).groupBy("key").agg(F.min("page_id").alias("first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = keyed.join(first, "key", "left").withColumn("again", again)
    return joined.select("page_id", "url", "html", F.when(F.col("again"), "revisit").otherwise("response").alias("kind"), F.when(F.col("again"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_payload: int = 0, sample: int = 400) -> DataFrame:
    """Writes archives below ``folder``, one a task; gives the list of files."""
    dictionary = train([t.encode() for t in sampled(pages.select("page_id", "html"), sample)])
    store, path = _files(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, path = _files(folder)
        pack = zstandard.ZstdCompressor(3, dict_data=_dictionary(dictionary), write_content_size=True)
        stream, count, name = None, 0, f"{path}/{uuid.uuid4().hex}.warc.zst"
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("page_id", "url", "html", "kind", "refers_to"))
            for page_id, url, html, kind, refers_to in zip(*columns, strict=True):
                if stream is None:
                    stream = store.open_output_stream(name)
                    stream.write(head(dictionary))
                    info = b"software: lightwalk\r\nformat: WARC File Format 1.1\r\n"
                    stream.write(pack.compress(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", info, {"Content-Type": "application/warc-fields"})))
                stream.write(pack.compress(page_record(page_id, url, html.encode(), kind, refers_to)))
                count += 1
        if stream is not None:
            stream.close()
            yield pa.record_batch([[os.path.basename(name)], pa.array([count], pa.int64())], names=["path", "records"])

    return common.materialize(classified(pages, min_payload).mapInArrow(run, FILES), "warc-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """What the archives hold of each page, from the archives alone; a payload that does not match its digest is an error."""

    def number(name: str | None) -> int | None:
        value = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return None if value in ("", "none") else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        for batch in batches:
            for name in batch["path"].to_pylist():
                rows = []
                with store.open_input_stream(f"{path}/{name}") as source:
                    for headers, block in records(source):
                        if (kind := headers["WARC-Type"]) == "warcinfo":
                            continue
                        given = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            length, found = len(payload), digest(payload)
                            if found != given:
                                raise ValueError("a payload does not match its digest")
                        else:
                            length, found = int(headers["Payload-Length"]), given
                        rows.append((number(headers["WARC-Record-ID"]), length, found, kind, number(headers.get("WARC-Refers-To"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, OUT)


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "warc")
    return read(write(common.table(spark, sf_dir, "pages"), folder), folder)


OP4_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload, sha1(encode(coalesce(html, ''))) as hex from pages
), b as (
  select hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
      (strpos('0123456789abcdef', substr(hex, 1 + (5 * k) // 4, 1)) - 1) * 16
      + (strpos('0123456789abcdef', substr(hex || '0', 2 + (5 * k) // 4, 1)) - 1) as int)
      // (case (5 * k) % 4 when 0 then 8 when 1 then 4 when 2 then 2 else 1 end) % 32, 1), '' order by k) as digest
  from (select distinct hex from p), (select unnest(range(32)) as k) group by hex
), f as (select hex, min(page_id) as first_id from p group by hex)
select page_id, octet_length(payload) as payload_bytes, digest as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from p join b using (hex) join f using (hex)
"""
