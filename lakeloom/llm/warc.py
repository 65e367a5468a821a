"""WARC archives: pages to records, archives to records, records to one nested row per capture.

Archives are written and read with Spark's text source, so any file system that Spark knows will do. A record ends
with CR LF CR LF, which is the line separator of the writer; the reader gets the lines of a gzip file in order (such
files are never split) and cuts records by their Content-Length, holding one record and one batch of lines at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "file string, ordinal long, record_type string, record_id string, concurrent_to array<string>, refers_to string, "
    "target_uri string, date string, http_status int, fields map<string,string>, payload binary, payload_bytes long, "
    "payload_digest string, truncated boolean"
)
PRIMARY = ("response", "revisit", "resource", "conversion")


def _record_id(role: str, row: Column, page_id: Column, digest: Column) -> Column:
    """row tells apart pages that are alike in everything."""
    key = F.md5(F.concat_ws("|", F.lit(role), row.cast("string"), F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list, block: Column) -> Column:
    """headers: strings and columns, each a whole line; null columns leave the line out."""
    lines = [F.lit(h) if isinstance(h, str) else h for h in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, length), F.lit(CRLF * 2), block)


def page_records(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """One row per page, its text the page's request, response or revisit, and metadata record.

    Of equal payloads of min_revisit_bytes or more, the rows of the largest page id are responses and the others revisit
    one of them; where all ids are null, all are responses. A null payload counts as empty, a null url leaves its header
    out, a null id never is the largest. Every row gets records of its own, whether it repeats another or not: the rows
    are numbered, and cut (see stored()), so that a lost task can't renumber them. Other columns are ignored.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    uri = F.regexp_replace(F.col(url).cast("string"), r"[\r\n]", "%0A")
    p = pages.select(F.col(page_id).alias("page"), uri.alias("uri"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"))
    p = p.withColumns({"size": F.octet_length("body").cast("long"), "row": F.monotonically_increasing_id()})
    p = stored(p, "warc-pages")
    groups = p.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size")
    groups = groups.agg(F.max(F.struct("page", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first.page IS NOT NULL")
    groups = stored(groups.select("digest", "size", F.col("first.page").alias("keeper"), F.col("first.row").alias("keeper_row")), "warc-repeats")
    p = p.join(groups, ["digest", "size"], "left")  # bodies are only shuffled if the repeated digests are too many to broadcast
    revisit = ~F.col("keeper").eqNullSafe(F.col("page")) & F.col("keeper").isNotNull()
    own = lambda role: _record_id(role, F.col("row"), F.col("page"), F.col("digest"))
    rid = F.when(revisit, own("revisit")).otherwise(own("response"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    uri, when, digest = line("WARC-Target-URI", F.col("uri")), f"WARC-Date: {date}", line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http_type, request_type = "Content-Type: application/http; msgtype=response", "Content-Type: application/http; msgtype=request"
    ok = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: ")
    http = F.concat(ok, F.col("size").cast("string"), F.lit(CRLF * 2))
    request = _record(
        ["WARC-Type: request", line("WARC-Record-ID", own("request")), line("WARC-Concurrent-To", rid), uri, when, request_type],
        F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}")),
    )
    plain = _record(["WARC-Type: response", line("WARC-Record-ID", rid), uri, when, digest, http_type], F.concat(http, F.col("body")))
    refers_to = line("WARC-Refers-To", _record_id("response", F.col("keeper_row"), F.col("keeper"), F.col("digest")))
    again = _record(["WARC-Type: revisit", line("WARC-Record-ID", rid), refers_to, f"WARC-Profile: {PROFILE}", uri, when, digest, http_type], http)
    metadata = _record(
        ["WARC-Type: metadata", line("WARC-Record-ID", own("metadata")), line("WARC-Concurrent-To", rid), uri, when, "Content-Type: application/warc-fields"],
        F.concat(F.lit("page_id: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    return p.select(F.concat_ws(CRLF * 2, request, F.when(revisit, again).otherwise(plain), metadata).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the rows of page_records() as gzip archives, one per partition."""
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


class _Cutter:
    """Cuts the bytes of one archive into records."""

    def __init__(self, file: str, keep_payload: bool):
        self.file, self.keep, self.buffer, self.head, self.need, self.ordinal = file, keep_payload, bytearray(), None, 0, 0

    def feed(self, data: bytes) -> Iterator[dict]:
        self.buffer += data
        at = 0
        while True:
            if self.head is None:
                while self.buffer[at : at + 1] in (b"\r", b"\n"):
                    at += 1
                end = self.buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                lines = bytes(self.buffer[at:end]).decode("utf-8", "replace").split(CRLF)
                if not lines[0].startswith("WARC/"):  # damaged: go on at the next record
                    at = max(at + 1, self.buffer.find(b"WARC/1.", at + 1))
                    continue
                self.head = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
                length = dict(self.head).get("content-length", "")
                self.need = int(length) if length.isdigit() else 0
                at = end + 4
            if len(self.buffer) - at < self.need:
                break
            yield self.record(bytes(self.buffer[at : at + self.need]), False)
            at += self.need
        del self.buffer[:at]

    def close(self) -> Iterator[dict]:
        if self.head is not None:
            yield self.record(bytes(self.buffer), True)

    def record(self, block: bytes, truncated: bool) -> dict:
        head, links = dict(reversed(self.head)), [v for k, v in self.head if k == "warc-concurrent-to"]
        self.head = None
        kind, fields, status = head.get("warc-type", ""), None, None
        payload = block
        if head.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            first = http.split(b"\r\n", 1)[0].split(b" ")
            status = int(first[1]) if kind != "request" and len(first) > 1 and first[1].isdigit() else None
        elif head.get("content-type", "").startswith("application/warc-fields"):
            fields = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if s]
            fields = list(dict(fields).items())
        digest = hashlib.sha1(payload).hexdigest()
        if kind == "revisit":
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
        self.ordinal += 1
        return {
            "file": self.file, "ordinal": self.ordinal, "record_type": kind, "record_id": head.get("warc-record-id") or f"{self.file}#{self.ordinal}", "concurrent_to": links,
            "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "http_status": status, "fields": fields,
            "payload": payload if self.keep else None, "payload_bytes": len(payload), "payload_digest": digest, "truncated": truncated,
        }


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records (RECORDS) of gzip archives, each with its payload's length and SHA-1.

    path: a folder or files ending in .gz; others are refused, since Spark would split them. Without payload that
    column is null. A record cut off by the end of its archive is kept and marked; bytes that start no record are skipped.
    """
    arrow = pa.schema([
        ("file", pa.string()), ("ordinal", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
        ("target_uri", pa.string()), ("date", pa.string()), ("http_status", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("truncated", pa.bool_()),
    ])

    def cut(batches):
        cutter, out, held = None, [], 0
        for batch in batches:
            lines, files = batch.column(0), batch.column(1)
            start = 0
            while start < batch.num_rows:
                file = files[start].as_py()
                if not file.endswith(".gz"):
                    raise ValueError(f"{file}: only gzip archives are read")
                stop = batch.num_rows if files[batch.num_rows - 1].as_py() == file else next(i for i in range(start, batch.num_rows) if files[i].as_py() != file)
                found = []
                if cutter is None or cutter.file != file:
                    found += cutter.close() if cutter else []
                    cutter = _Cutter(file, payload)
                found += cutter.feed(b"\n".join([*lines.slice(start, stop - start).to_pylist(), b""]))
                for r in found:
                    out.append(r)
                    held += r["payload_bytes"] * payload + 500
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, held = [], 0
                start = stop
        out += cutter.close() if cutter else []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file")).mapInArrow(cut, RECORDS)


def _once(records: DataFrame) -> DataFrame:
    """records without those whose id an earlier one has, by file and place. Only the ids are shuffled, and what repeats."""
    repeated = records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record_id")
    places = records.select("record_id", "file", "ordinal").join(repeated, "record_id", "left_semi")
    first = places.groupBy("record_id").agg(F.min(F.struct("file", "ordinal")).alias("first"))
    later = places.join(first, "record_id").where(F.struct("file", "ordinal") != F.col("first")).select("file", "ordinal")
    return records.join(stored(later, "warc-later"), ["file", "ordinal"], "left_anti")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, record_type, target_uri, refers_to, request, response, metadata (an array).

    A request or metadata record belongs to the response, revisit, resource or conversion that it names in
    WARC-Concurrent-To or that names it, or to the capture of a record that it names; of several, to that of the
    smallest id. A capture takes its request of the smallest id and every metadata record, by id. Records without a
    capture make one of their own, with a null response. Repeated record ids count once (the first by file and place).
    The links are found on ids alone; then one shuffle brings a capture's records together.
    """
    records = stored(records, "warc-records")
    r = _once(records)
    nested = F.struct("record_id", *(c for c in records.columns if c != "record_id"))
    ids = r.select("record_id", "record_type", "concurrent_to")
    main, rest = ids.where(F.col("record_type").isin(*PRIMARY)), ids.where(F.col("record_type").isin("request", "metadata"))
    named = rest.select("record_id", F.explode("concurrent_to").alias("target"))
    named = named.unionByName(main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("target")))
    near = named.join(main.select(F.col("record_id").alias("target")), "target").groupBy("record_id").agg(F.min("target").alias("capture_id"))
    near = stored(near, "warc-near")
    far = named.join(near.select(F.col("record_id").alias("target"), "capture_id"), "target").groupBy("record_id").agg(F.min("capture_id").alias("far_id"))
    linked = r.where(F.col("record_type").isin(*PRIMARY, "request", "metadata")).join(near, "record_id", "left").join(far, "record_id", "left")
    is_main = F.col("record_type").isin(*PRIMARY)
    capture = F.when(is_main, F.col("record_id")).otherwise(F.coalesce("capture_id", "far_id", "record_id"))
    want = F.col("record_type") == "request"
    tell = F.when(F.col("record_type") == "metadata", F.struct(F.col("record_id").alias("id"), nested.alias("of")))
    out = linked.withColumn("capture_id", capture).groupBy("capture_id").agg(
        F.min_by(F.when(is_main, nested), F.when(is_main, F.col("record_id"))).alias("response"),
        F.min_by(F.when(want, nested), F.when(want, F.col("record_id"))).alias("request"),
        F.collect_list(tell).alias("metadata"),
    )
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    out = out.withColumn("metadata", F.transform(F.array_sort("metadata", by_id), lambda x: x["of"]))
    out = out.withColumn("metadata", F.when(F.size("metadata") > 0, F.col("metadata")))
    uri = F.coalesce("response.target_uri", "request.target_uri", F.get("metadata", F.lit(0))["target_uri"])
    return out.select("capture_id", "response.record_type", uri.alias("target_uri"), "response.refers_to", "request", "response", "metadata")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """captures with payload_bytes, payload_digest and refers_to_page, a revisit's taken from the response it refers to."""
    pages = F.transform("metadata", lambda m: F.try_element_at(m.fields, F.lit("page_id")))
    page = F.get(F.filter(pages, lambda x: x != ""), F.lit(0))
    c = stored(captures.withColumn("page_id", page.cast("long")), "warc-captures")
    first = c.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("refers_to_page"), F.col("response.payload_bytes").alias("full_bytes"), F.col("response.payload_digest").alias("full_digest"))
    again, whole = c.where("refers_to IS NOT NULL").join(first, "refers_to", "left"), c.where("refers_to IS NULL")
    c = again.unionByName(whole, allowMissingColumns=True)
    return c.withColumn("payload_bytes", F.coalesce("full_bytes", "response.payload_bytes")).withColumn("payload_digest", F.coalesce("full_digest", "response.payload_digest")).drop("full_bytes", "full_digest")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lakeloom/warc-{uuid.uuid4().hex}"
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    captures = assemble(read_warc(spark, path, payload=False).drop("payload"))
    sizes, fields = F.struct("response.payload_bytes", "response.payload_digest"), F.transform("metadata", lambda m: F.struct(m.fields.alias("fields")))
    captures = captures.where(F.col("record_type").isNotNull()).select("capture_id", "record_type", "target_uri", "refers_to", sizes.alias("response"), fields.alias("metadata"))
    return resolve_revisits(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "target_uri")
