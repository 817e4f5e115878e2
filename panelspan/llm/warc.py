"""WARC archives: written as one gzip member a record, read by byte ranges.

Writing: Spark's own text writer puts the members into files, so its commit protocol guards them and any store that
Spark writes to will do. It ends each row with one byte; a gzip member's last byte is the high byte of
its length, zero below 16 MiB, so rows leave that byte to the writer (longer members are followed by an empty one).

Reading: files are cut into byte ranges. A task looks for the gzip magic number from the start of its range, decodes each
candidate until a WARC header shows that a member begins there, and then goes from member to member. It owns the
records that start inside its range and reads on past the end for the last of them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, digest: bytes, refers_to: str | None = None) -> bytes:
    """One record: an HTTP response around the payload, or for a revisit its head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d%s" % (len(payload), END)
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        # A line break or blank would end the header.
        head.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in uri))
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(head).encode() + END + block + END


def write(pages: DataFrame, path: str, level: int = 1, date: str | None = None) -> None:
    """``pages`` (record_id, target_uri, payload binary, refers_to_id: null for a response) -> files below ``path``."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    payload = r["payload"] or b""
                    kind = "revisit" if r["refers_to_id"] else "response"
                    data = record(kind, r["record_id"], r["target_uri"], date, payload, hashlib.sha1(payload).digest(), r["refers_to_id"])
                    member = _member(data, level)
                    rows.append((member if member[-1] == 0 else member + _member(b"", level))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    members = pages.select("record_id", "target_uri", "payload", "refers_to_id").mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def _open(path: str):
    """A seekable file of any store: local folders, or those that pyarrow knows (HDFS, S3, ...)."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class _Window:
    """Bytes of a file from a position on, read as far as they are asked for."""

    def __init__(self, file, start: int, step: int = 1 << 20):
        file.seek(start)
        self.file, self.start, self.step, self.data, self.ended = file, start, step, bytearray(), False

    def more(self) -> bool:
        part = b"" if self.ended else self.file.read(self.step)
        self.ended = not part
        self.data += part
        return bool(part)

    def drop(self, count: int) -> None:
        del self.data[:count]
        self.start += count


class Broken(ValueError):
    """A member that doesn't decode, though one has to begin there."""


def _inflate(window: _Window, at: int, certain: bool) -> tuple[bytes, int] | None:
    """The member that begins at ``at`` and where it ends.

    A mere candidate gives none if nothing decodes there, or something that isn't a WARC record. From the moment that a WARC record is seen, and
    where a member surely begins (``certain``), what doesn't decode to its end raises.
    """
    machine, out, size = zlib.decompressobj(31), [], 0
    seen = certain

    def broken(why: str) -> None:
        if seen:
            raise Broken(f"the member at byte {window.start + at0} {why}")

    at0 = at
    while True:
        part = bytes(window.data[at : at + (1 << 16)])
        if not part:
            if not window.more():
                return broken("is cut short")
            continue
        try:
            out.append(machine.decompress(part))
        except zlib.error as e:
            return broken(f"is damaged: {e}")
        size += len(out[-1])
        if not seen and size >= 5:
            if b"".join(out)[:5] != b"WARC/":
                return None
            seen = True
        at += len(part)
        if machine.eof:
            return (b"".join(out), at - len(machine.unused_data)) if seen else None


def members(file, start: int, end: int, strict: bool = False) -> Iterator[bytes]:
    """Decoded members that begin in [start, end) and hold a WARC record.

    A record that has begun and doesn't decode to its end raises. ``strict``: so do other bytes between members.
    Members stand one after the other, so from the first one on it is known where each has to begin: at the file's beginning, and where
    the one before ends. What begins there and doesn't decode raises; so does the first one after the range, whose own reader can't tell
    a damaged beginning from chance bytes. Of a record after the range only its first bytes are decoded.
    """
    window = _Window(file, start)
    at, certain = 0, strict and start == 0
    while window.start + at < end:
        if not certain:
            found = window.data.find(MAGIC, at)
            if found < 0:
                # The last two bytes may begin a magic number that the next read completes.
                window.drop(max(len(window.data) - 2, 0))
                at = 0
                if not window.more():
                    return
                continue
            if window.start + found >= end:
                return
            at = found
        elif at >= len(window.data) and not window.more():
            return
        own = _inflate(window, at, certain)
        if own is None:
            at += 1
            continue
        if own[0][:5] == b"WARC/":
            yield own[0]
        window.drop(own[1])
        at, certain = 0, strict
    if certain and (at < len(window.data) or window.more()):
        while len(window.data) < at + 1024 and window.more():
            pass
        try:
            begun = zlib.decompressobj(31).decompress(bytes(window.data[at : at + 1024]))[:5] == b"WARC/"
        except zlib.error:
            begun = False
        if not begun:
            # No record, or a damaged one: only its whole says which.
            _inflate(window, at, True)


def parse(data: bytes) -> dict | None:
    """The fields of RECORD, or none where the record isn't complete."""
    head, _, rest = data.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields.get("content-length", -1))
    if not lines[0].startswith("WARC/") or size < 0 or len(rest) < size:
        return None
    block = rest[:size]
    kind = fields.get("warc-type")
    payload, length = block, size
    if "application/http" in fields.get("content-type", ""):
        http, _, payload = block.partition(END)
        told = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        length = int(told[0]) if told else len(payload)
    digest = fields.get("warc-payload-digest", "")
    if kind == "response":
        digest = hashlib.sha1(payload).hexdigest()
    elif digest.startswith("sha1:"):
        digest = base64.b32decode(digest[5:]).hex()
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": None if kind == "revisit" else payload,
    }


def read(spark: SparkSession, path: str, columns: list[str] | None = None, split: int = 16 << 20, strict: bool = True) -> DataFrame:
    """Records (RECORD) of the archives below ``path``, in ranges of ``split`` bytes.

    Members that hold no WARC record are passed over. A member that is cut short or damaged, bytes between members and a record shorter than
    it says raise an error with path and offset; nothing is left out silently. Without ``strict``, bytes that aren't members are passed over. Empty files have no rows, nor has a folder without files.
    """
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    wanted = [n for n in names if n in (columns or names)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))

    def named(found: Iterator[bytes], path: str) -> Iterator[bytes]:
        try:
            yield from found
        except Broken as e:
            raise Broken(f"{path}: {e}") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                with _open(r["path"]) as file:
                    for data in named(members(file, r["start"], r["start"] + split, strict), r["path"]):
                        found = parse(data)
                        if found is None:
                            raise Broken(f"{r['path']}: a record is shorter than it says")
                        rows.append({n: found[n] for n in wanted})
                        size += len(data)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c for c in RECORD.split(", ") if c.split(" ")[0] in wanted]
    kinds = pa.schema([(c.split(" ")[0], arrow[c.split(" ")[1]]) for c in fields])
    # A number of its own, or the few bytes of the list would all go to one task.
    return ranges.repartition(max(1, min(ranges.count(), 20_000)), "path", "start").mapInArrow(run, ", ".join(fields))


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html) -> what ``write`` takes. Of equal payloads of at least ``least`` bytes, the record with the
    largest page_id keeps the payload (every row with that page_id), others revisit it. Null html is empty.
    Pages without an id are written as responses and never revisited."""
    page_id = F.col("page_id").cast("long")
    base = pages.select(page_id.alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    keepers = base.where("digest is not null").groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).where("least < keeper").drop("least")
    joined = base.join(keepers, ["digest", "size"], "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(name(F.col("page_id")).alias("record_id"), "target_uri", "payload", F.when(F.col("keeper") != F.col("page_id"), name(F.col("keeper"))).alias("refers_to_id"))


def page_id_of(record_id) -> F.Column:
    return F.nullif(F.substring_index(record_id, ":", -1), F.lit("")).cast("long")
