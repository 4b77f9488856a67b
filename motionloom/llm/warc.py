"""Operator 9: WARC records, and the resolution of not-modified revisits.

A revisit record says that the server answered 304 Not Modified; its body is
that of an earlier full response for the same url. Each revisit is joined
as-of to the latest earlier full response by canonical url; its validators
(ETag, Last-Modified) must agree with the stored ones, and the headers that a
304 may update replace the stored ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may update in the stored response. Fixed values (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
RECORD = "warc_type string, uri string, date string, record_id string, http_status int, headers map<string,string>, payload binary, error string"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without www., default port, fragment or trailing slash; http and https alike."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    tail = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1), r"/+(\?|$)", "$1")
    return F.concat(host, tail)


def _weak(etag: Column) -> Column:
    """An ETag for weak comparison."""
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame, chunk: int = 4096) -> DataFrame:
    """One row for each revisit. records: record_id long, url, ts long, kind ('response' or 'revisit'), headers map<string,string> (lower-case names), digest string.

    Columns: record_id, url_key, ts, source_id (the latest full response with
    an earlier ts, null if none), source_digest, status (``resolved``,
    ``mismatch`` if a validator that both have differs, ``no_validator`` if they share none,
    ``orphan`` if there is no earlier response), headers (of a resolved
    revisit: the source's, updated by the permitted ones of the revisit; else null).

    Of responses with the same ts the greatest record_id counts. Rows with a
    null url, ts or record_id are orphans as revisits and never sources.
    Repeated revisits give repeated rows. Other kinds are left out.

    The as-of join works on the different (url, ts), of which those of
    responses and of revisits are summed up before the shuffle. A url with a
    large share of the rows is split: points go by (url, ``chunk`` ticks of
    ts), so at most two for each tick meet. Within a chunk a window finds the
    latest response; the last response of each chunk is carried to later chunks
    by a window over the summaries only.
    """
    base = records.select(
        "record_id", canonical_url(F.col("url").cast("string")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest",
    ).withColumn("slot", F.floor(F.col("ts") / F.lit(chunk)).cast("long"))
    sources = base.filter("kind = 'response' AND url_key IS NOT NULL AND ts IS NOT NULL AND record_id IS NOT NULL")
    source = F.struct("ts", "record_id", "digest", F.map_entries("headers").alias("headers"))
    visits = base.filter("kind = 'revisit'")
    # By url and slot: what was the last response in an earlier slot.
    last = sources.groupBy("url_key", "slot").agg(F.max(F.struct("ts", "record_id")).alias("last"))
    wanted = visits.filter("url_key IS NOT NULL AND slot IS NOT NULL").select("url_key", "slot").distinct().withColumn("last", F.lit(None).cast("struct<ts:bigint,record_id:bigint>"))
    slots = last.unionByName(wanted).groupBy("url_key", "slot").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("carry", F.last("last", ignorenulls=True).over(earlier)).select("url_key", "slot", "carry")
    # Within a slot.
    points = sources.groupBy("url_key", "slot", "ts").agg(F.max("record_id").alias("record_id")).select("url_key", "slot", "ts", F.struct("ts", "record_id").alias("here"), F.lit(False).alias("asked"))
    asked = visits.filter("url_key IS NOT NULL AND ts IS NOT NULL").select("url_key", "slot", "ts").distinct()
    points = points.unionByName(asked.select("url_key", "slot", "ts", F.lit(None).cast("struct<ts:bigint,record_id:bigint>").alias("here"), F.lit(True).alias("asked")))
    before = Window.partitionBy("url_key", "slot").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("near", F.max("here").over(before)).filter("asked")
    points = points.join(carried, ["url_key", "slot"], "left").select("url_key", "ts", F.coalesce("near", "carry").alias("at"))
    found = visits.join(points, ["url_key", "ts"], "left").withColumn("visit", F.struct("record_id", "headers"))
    found = found.select("visit.record_id", "url_key", "ts", F.col("visit.headers").alias("own"), F.col("at.record_id").alias("source_id"))
    kept = sources.groupBy("url_key", F.col("record_id").alias("source_id")).agg(F.max(source).alias("source"))
    out = found.join(kept, ["url_key", "source_id"], "left")
    theirs = F.map_from_entries("source.headers")
    out = out.withColumn("theirs", F.when(F.col("source").isNotNull(), theirs))
    tag, own_tag = _weak(F.col("theirs")["etag"]), _weak(F.col("own")["etag"])
    day, own_day = F.col("theirs")["last-modified"], F.col("own")["last-modified"]
    differ = F.coalesce(tag != own_tag, F.lit(False)) | F.coalesce(day != own_day, F.lit(False))
    shared = (tag.isNotNull() & own_tag.isNotNull()) | (day.isNotNull() & own_day.isNotNull())
    status = F.when(F.col("source_id").isNull(), "orphan").when(differ, "mismatch").when(~shared, "no_validator").otherwise("resolved")
    update = F.map_filter("own", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("theirs", lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    return out.withColumn("status", status).select("record_id", "url_key", "ts", "source_id", F.col("source.digest").alias("source_digest"), "status", F.when(F.col("status") == "resolved", merged).alias("headers"))


def serialize(record: dict) -> bytes:
    """A WARC/1.1 record of an HTTP response. Keys as in RECORD."""
    lines = [f"HTTP/1.1 {record['http_status']} "] + [f"{k}: {v}" for k, v in (record["headers"] or {}).items()]
    block = "\r\n".join([*lines, "", ""]).encode() + (record["payload"] or b"")
    head = {"WARC-Type": record["warc_type"], "WARC-Target-URI": record["uri"], "WARC-Date": record["date"], "WARC-Record-ID": record["record_id"], "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", block).splitlines()[1:]:
        name, _, value = line.partition(b":")
        key = name.strip().lower().decode("utf-8", "replace")
        text = value.strip().decode("utf-8", "replace")
        out[key] = f"{out[key]}, {text}" if key in out else text
    return out


_NAMES = [x.split(" ")[0] for x in RECORD.split(", ")]


def _broken(error: str, head: dict[str, str] | None = None) -> dict:
    head = head or {}
    known = {"warc_type": head.get("warc-type"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "record_id": head.get("warc-record-id")}
    return dict.fromkeys(_NAMES) | known | {"headers": {}, "error": error}


def _record(head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    is_http = http.startswith(b"HTTP/")
    status = re.match(rb"HTTP/\S+ +(\d{1,9})\b", http)
    return _broken("", head) | {"http_status": int(status[1]) if status else None, "headers": _headers(http) if is_http else {}, "payload": payload if is_http else block, "error": None}


def parse(data):
    """The records of a WARC file (bytes; not compressed, or gzip members) as dicts with the keys of RECORD, one at a time.

    What isn't a record gives one dict with ``error`` for each stretch of it,
    and reading goes on at the next line that begins with ``WARC/``. A record
    that is cut short, or a broken gzip member, gives one with what is known of
    it. An empty file has no records.
    """
    import gzip
    import io
    import zlib

    stream = io.BytesIO(data)
    if bytes(data[:2]) == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    lost, head = False, None
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                if line.strip() and not lost:
                    lost = True
                    yield _broken("no record begins here")
                continue
            lost, lines = False, [line]
            while (line := stream.readline()).strip():
                lines.append(line)
            head = _headers(b"".join(lines))
            size = head.get("content-length", "")
            if not re.fullmatch(r"\d{1,18}", size, re.ASCII):
                yield _broken("no content length", head)
                lost = True
                continue
            block = stream.read(int(size))
            yield _record(head, block) if len(block) == int(size) else _broken("cut short", head)
            head = None
    except (EOFError, OSError, zlib.error) as e:
        yield _broken(f"broken gzip member: {e}", head)


def read_warc(spark, path: str) -> DataFrame:
    """The records of all WARC files under a path, with the columns of RECORD.

    One file is read by one task, which holds its bytes as they are stored and
    one batch of records; files of 2 GB or more can't be read, so write files
    of bounded size. Defined results: fields that a record lacks are null;
    broken records are rows with an ``error`` and don't stop the read; empty
    files give no rows; repeated records are repeated rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def rows(it):
        import pandas as pd

        for frame in it:
            for content in frame["content"]:
                held, size = [], 0
                for record in parse(content):
                    held.append(record)
                    size += len(record["payload"] or b"") + 1000
                    if size >= 4 << 20:
                        yield pd.DataFrame(held, columns=_NAMES)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=_NAMES)

    return files.mapInPandas(rows, RECORD)
