"""ARC archives converted to WARC, written and read back.

An ARC file starts with a version block, whose first line is a header line itself (``filedesc://...``)
and whose body names the version; version 1 header lines hold URL, IP, date, type and length, those of
version 2 also status, checksum, location, offset and file name. Each header line is followed by as many
bytes as it declares. Converted records carry what the header and bytes tell: a response where the bytes
are an HTTP message, a resource otherwise; the date in ISO form; a record id that is a name of the
record's URL, date, digests and key, so that a task run again makes the same one; SHA-1 digests in
base32 of the block and the payload. Of records with equal payloads, all but the one with the least
key become revisits, which keep the HTTP header and point to it.

WARC files are text files of Spark's writer whose line end is the blank line that ends a record, in the
folder the caller names; they are read with ``binaryFile`` by the declared lengths.
"""

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
END = b"\r\n\r\n"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_line(line, version):
    """The fields of an ARC header line; the URL takes what blanks there are too many."""
    names = FIELDS[version]
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC header line of version {version}: {line[:200]!r}")
    return dict(zip(names, parts, strict=True))


def arc_records(data):
    """The records of an ARC file (plain or gzip) as (fields, bytes), without the version block."""
    if data[:2] == b"\x1f\x8b":
        data = gunzip(data)
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line, at = data[at:end], end + 1
        if not line.strip():
            continue
        if version is None:  # the version block; its own header line may be of either version
            found = re.match(rb"filedesc://.* (\d+)\s*$", line)
            if not found:
                raise ValueError("an ARC file starts with a filedesc line")
            body = data[at : at + int(found[1])]
            version = int(body[: body.index(b" ")])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            at += int(found[1])
            continue
        fields = header_line(line, version)
        size = int(fields["length"])
        if at + size > len(data):
            raise ValueError(f"record of {size} bytes is cut off: {line[:200]!r}")
        yield fields, data[at : at + size]
        at += size


def gunzip(data):
    """The members of a gzip file, one after the other."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def payload_of(block):
    """(HTTP header with the blank line, payload) of a block; no header where it is not an HTTP message."""
    if block[:5] == b"HTTP/":
        cut = block.find(END)
        if cut >= 0:
            return block[: cut + 4], block[cut + 4 :]
    return b"", block


def iso(date):
    d = re.sub(r"\D", "", date)[:14]
    d += "19700101000000"[len(d) :]  # what a short date leaves open
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


CONVERTED = {
    "url": pa.string(), "ip": pa.string(), "date": pa.string(), "http": pa.binary(), "payload": pa.binary(),
    "payload_digest": pa.string(), "payload_bytes": pa.int64(), "record_id": pa.string(),
}
KINDS = "url string, ip string, date string, http binary, payload binary, payload_digest string, payload_bytes long, record_id string"


def _convert(batches):
    for batch in batches:
        keys, arcs = batch.column("key"), batch.column("arc")
        rows, size = [], 0
        for i in range(batch.num_rows):
            for fields, block in arc_records(arcs[i].as_py() or b""):
                http, payload = payload_of(block)
                own = digest(payload)
                name = "\n".join([fields["url"], fields["date"], digest(http), own, str(keys[i].as_py())])
                record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, name))
                rows.append((i, fields["url"], fields["ip"], iso(fields["date"]), http, payload, own, len(payload), record_id))
                size += len(block)
                if size > 1 << 22:
                    yield _rows(keys, rows)
                    rows, size = [], 0
        if rows:
            yield _rows(keys, rows)


def _rows(keys, rows):
    at, *columns = zip(*rows, strict=True)
    columns = [pa.array(c, t) for c, t in zip(columns, CONVERTED.values(), strict=True)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *columns], ["key", *CONVERTED])


def converted(archives, key="key", arc="arc"):
    """One row per record of the ARC files in column ``arc``, with the key of its file. Null files hold none."""
    rows = archives.select(F.col(key).cast("long").alias("key"), F.col(arc).cast("binary").alias("arc"))
    return rows.mapInArrow(_convert, f"key long, {KINDS}")


def with_revisits(records, least_bytes=0):
    """``records`` with ``first`` and ``first_id``: key and record id of the response that a revisit is of.

    Of records with equal payloads of at least ``least_bytes`` the one with the least key is the response
    (rows that share that key all are); null keys come last. Responses have null in both columns.
    """
    heads = records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.min(F.struct(F.col("key").isNull(), "key", "record_id")).alias("head"), F.count("*").alias("n")
    )
    heads = heads.where("n > 1").select("payload_digest", "payload_bytes", "head.key", "head.record_id").toDF(
        "payload_digest", "payload_bytes", "first", "first_id"
    )
    rows = records.join(heads, ["payload_digest", "payload_bytes"], "left")
    other = F.col("first_id").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return rows.withColumns({"first": F.when(other, F.col("first")), "first_id": F.when(other, F.col("first_id"))})


def _write(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            revisit = r["first_id"] is not None
            kind = "revisit" if revisit else "response" if r["http"] else "resource"
            block = r["http"] if revisit else r["http"] + r["payload"]
            lines = [
                "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{r['record_id']}>", f"WARC-Date: {r['date']}",
                f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}",
                f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{digest(block)}",
                f"Payload-Length: {r['payload_bytes']}", f"Source-Key: {'' if r['key'] is None else r['key']}",
            ]
            if revisit:
                lines += [
                    "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    f"WARC-Refers-To: <urn:uuid:{r['first_id']}>", f"Refers-To-Key: {'' if r['first'] is None else r['first']}",
                ]
            form = "application/http; msgtype=response" if r["http"] else "application/octet-stream"
            lines += [f"Content-Type: {form}", f"Content-Length: {len(block)}"]
            out.append("\r\n".join(lines).encode() + END + block)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_warc(records, path, per_file=2000):
    """Writes records (from ``with_revisits``) as gzip WARC files below ``path``."""
    rows = records.mapInArrow(_write, "record binary").select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def warc_records(data):
    """The records of a WARC file (plain or gzip) as (fields in lower case, block)."""
    if data[:2] == b"\x1f\x8b":
        data = gunzip(data)
    at = 0
    while at < len(data):
        cut = data.index(END, at)
        version, *lines = data[at:cut].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:100]!r}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
        end = cut + 4 + int(fields["content-length"])
        if data[end : end + 4] != END:
            raise ValueError("a record does not end where its length says")
        yield fields, data[cut + 4 : end]
        at = end + 4


READ = {
    "key": pa.int64(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "refers_to": pa.int64(), "target_uri": pa.string(), "record_id": pa.string(), "intact": pa.bool_(),
}


def _read(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for f, block in warc_records(content.as_py()):
                number = lambda name, f=f: int(f[name]) if f.get(name) else None
                own = f["warc-payload-digest"].removeprefix("sha1:")
                intact = f["warc-block-digest"] == f"sha1:{digest(block)}"
                if f["warc-type"] != "revisit":
                    payload = payload_of(block)[1]
                    intact = intact and own == digest(payload) and len(payload) == number("payload-length")
                rows.append((
                    number("source-key"), f["warc-type"], number("payload-length"), own, number("refers-to-key"),
                    f["warc-target-uri"], f["warc-record-id"][10:-1], intact,
                ))
            columns = zip(*rows, strict=True) if rows else [[]] * len(READ)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, READ.values(), strict=True)], list(READ))


def read_warc(spark, path):
    """One row per record of the WARC files below ``path``; intact: lengths and digests hold."""
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return files.mapInArrow(_read, ", ".join(f"{c} {kinds[t]}" for c, t in READ.items()))


def as_arc(pages, key="page_id", url="url", html="html"):
    """(key, arc): each page as an ARC file of one record, of version 1 for even keys and 2 for odd ones.

    The bytes are an HTTP response with the page as UTF-8 (null: empty). The date counts seconds by key.
    """
    body = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    http = F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "UTF-8")
    size = F.length(http) + F.length(body)
    where = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("-")), r"\s", "%20")
    second = F.coalesce(F.pmod(F.col(key).cast("long"), F.lit(10**9)), F.lit(0)) + 820454400
    date = F.date_format(F.timestamp_seconds(second), "yyyyMMddHHmmss")
    odd = F.coalesce(F.pmod(F.col(key).cast("long"), F.lit(2)) == 1, F.lit(False))
    blocks = {v: f"{v} 0 pages\n{' '.join(FIELDS[v])}\n\n" for v in FIELDS}
    first = {1: f"filedesc://pages.arc 0.0.0.0 19960101000000 text/plain {len(blocks[1])}\n{blocks[1]}",
             2: f"filedesc://pages.arc 0.0.0.0 19960101000000 text/plain 200 - - 0 pages.arc {len(blocks[2])}\n{blocks[2]}"}
    line = F.concat_ws(" ", where, F.lit("127.0.0.1"), date, F.lit("text/html"))
    old = F.concat(F.lit(first[1]), line, F.lit(" "), size.cast("string"), F.lit("\n"))
    new = F.concat(F.lit(first[2]), line, F.lit(f" 200 - - {len(first[2])} pages.arc "), size.cast("string"), F.lit("\n"))
    arc = F.concat(F.encode(F.when(odd, new).otherwise(old), "UTF-8"), http, body, F.encode(F.lit("\n"), "UTF-8"))
    return pages.select(F.col(key).cast("long").alias("key"), arc.alias("arc"))
