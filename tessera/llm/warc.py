"""WARC archives: writing captures, reading records, assembling transactions.

Writing. Every capture becomes a request, a response (or a revisit of an equal payload) and a metadata record; request and metadata
name the response in WARC-Concurrent-To. Spark's text writer lays the records out, so a lost executor's files are written anew
and only committed ones count: a record is a header and a block, and the line separator is the record's end. Files are gzip'd.

Reading takes any WARC 1.x file, plain or gzip'd as a whole or by record, one file a row through Spark's own reader, and
yields records one by one. A file must fit in an executor (Spark reads at most 2 GB); ours hold one partition of pages.

Assembly. A response or revisit is a capture. Requests and metadata join it by the concurrent-to identifiers, named by
either side, directly or over any number of other records of the transaction: rounds of joins go on until no record is added, and a record
belongs to the captures that it reaches in the fewest steps. All of them stand in the capture's row; a capture with more than PART of them goes
on in further rows, so that no row grows without bound. Records that reach no capture are no part of a transaction and left out.

Nulls and edges: a null html is an empty payload; null urls are left out of the header; rows with a null page_id keep an empty one; repeated
rows are captures of their own; of rows with the largest page_id of a payload, all are responses. A record cut short by the file's end
or by a broken gzip member, or with a malformed length, is skipped. A capture without identifier stands alone; a request or metadata record
without one joins what it names. Equal records count once; unlike ones of one identifier stay together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: About so many requests and metadata records of a capture stand in one row.
PART = 1000
RECORDS = "record_id string, type string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes bigint, http_head string, fields map<string,string>, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a binary column's SHA-1: five hex digits are four base-32 digits."""
    digest = F.upper(F.sha1(payload))
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(bits, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


def _urn(kind: str, page: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}")]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"\r\n{k}: "), v)).otherwise("") for k, v in fields]
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", min_revisit: int = 0) -> None:
    """Writes pages (page_id, url, html) as WARC files below path. Payloads under min_revisit bytes are never revisits."""
    p = pages.select(F.col("page_id").cast("long").alias("page"), F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    # The latest capture of each payload that occurs twice; small rows, summed up before they are shuffled.
    first = p.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.max(F.struct("page", "url")).alias("of"), F.count("*").alias("c")).filter("c > 1").select(F.col("digest").alias("d"), F.col("of.page").alias("of_page"), F.col("of.url").alias("of_url"))
    p = p.join(first.hint("shuffle_hash"), (F.col("digest") == F.col("d")) & (F.col("size") >= min_revisit), "left")
    revisit = F.col("of_page").isNotNull() & ~F.col("page").eqNullSafe(F.col("of_page"))
    ids = {k: _urn(k, F.col("page"), F.col("url"), F.col("digest")) for k in ("request", "response", "metadata")}
    when, uri, sha = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", [("WARC-Record-ID", ids["response"]), when, uri, sha, http], F.concat(head, F.col("html")))
    again = _record("revisit", [("WARC-Record-ID", ids["response"]), when, uri, sha, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", _urn("response", F.col("of_page"), F.col("of_url"), F.col("digest"))), http], head)
    request = _record("request", [("WARC-Record-ID", ids["request"]), when, uri, ("WARC-Concurrent-To", ids["response"]), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce("url", F.lit("")), F.lit(" HTTP/1.1" + END)))
    facts = F.concat(F.lit("pageId: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("\r\npayloadBytes: "), F.col("size").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", [("WARC-Record-ID", ids["metadata"]), when, uri, ("WARC-Concurrent-To", ids["response"]), ("Content-Type", F.lit("application/warc-fields"))], facts)
    p.select(F.concat(request, F.lit(END), F.when(revisit, again).otherwise(response), F.lit(END), metadata).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one file, one after another; gzip members are inflated as they are met. What follows a broken or cut gzip member is
    skipped, and so is a record whose length is missing its number or runs past the end."""
    import gzip
    import io
    import zlib

    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        yield from _records(stream)
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def _records(stream) -> Iterator[dict]:
    import base64
    import hashlib

    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        size = fields.get("content-length", ["0"])[0]
        if not (size.isascii() and size.isdigit()):
            continue  # the next line that starts a record goes on
        block = stream.read(int(size))
        if len(block) < int(size):
            return
        kind = fields.get("warc-type", [""])[0].lower()
        one = lambda k: fields.get(k, [None])[0]
        head, payload, facts, digest, known = None, None, {}, one("warc-payload-digest"), None
        if kind in ("response", "request", "revisit") and "http" in (one("content-type") or "http"):
            start, _, body = block.partition(b"\r\n\r\n")
            head = start.decode("utf-8", "replace")
            if kind == "response":
                payload, known = body, len(body)
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        elif kind == "metadata":
            facts = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k.strip()}
        yield {"record_id": one("warc-record-id"), "type": kind, "target_uri": one("warc-target-uri"), "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "payload_digest": (digest or "").rpartition(":")[2].upper() or None, "payload_bytes": known, "http_head": head, "fields": facts, "payload": payload}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the WARC files below path; without payloads only their size and recomputed digest are kept."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["record_id", "type", "target_uri", "concurrent_to", "refers_to", "payload_digest", "payload_bytes", "http_head", "fields", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

        def out(rows: list[dict]):
            cols = [[(list(r[n].items()) if n == "fields" else r[n]) for r in rows] for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for r in parse(data.as_py()):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    held += len(r["payload"] or b"") + 500
                    if held > 8_000_000:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORDS)


def _belongings(captures: DataFrame, side: DataFrame) -> DataFrame:
    """(id, capture) of side records (id, concurrent_to) and captures (record_id, concurrent_to): a breadth-first search from the captures.
    Most archives are done after the first join; only records that it leaves out take part in the rounds that follow."""
    links = side.select("id", F.explode("concurrent_to").alias("other"))
    named = captures.select(F.explode("concurrent_to").alias("id"), F.col("record_id").alias("capture"))
    direct = links.join(captures, F.col("other") == F.col("record_id"), "left_semi").select("id", F.col("other").alias("capture"))
    found = [stored(direct.unionByName(named).distinct(), "belongs")]
    left = side.select("id").join(found[0], "id", "left_anti")
    if left.isEmpty():
        return found[0]
    both = links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other")))
    edges = stored(both.join(left, "id", "left_semi"), "edges")
    while True:
        last = found[-1].select(F.col("id").alias("other"), "capture")
        more = stored(edges.join(last, "other").select("id", "capture").distinct(), "belongs")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(more)
        edges = stored(edges.join(more, "id", "left_anti"), "edges")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (record_id, part, response, requests, metadata, n_requests, n_metadata), arrays sorted by identifier. part is 0
    but for captures with more than PART side records, whose arrays are dealt over several rows, each with the response."""
    captures = records.filter(F.col("type").isin("response", "revisit"))
    content = F.concat_ws("|", "type", "target_uri", "http_head", F.to_json("fields"), F.array_join("concurrent_to", " "))
    own = F.coalesce("record_id", F.concat(F.lit("?"), F.md5(content)))
    side = records.filter(F.col("type").isin("request", "metadata")).select(own.alias("id"), "record_id", "type", "target_uri", "http_head", F.map_entries("fields").alias("facts"), "concurrent_to")
    belongs = _belongings(captures.filter("record_id is not null").select("record_id", "concurrent_to"), side.select("id", "concurrent_to"))
    large = belongs.groupBy(F.col("capture").alias("large")).agg(F.ceil(F.count("*") / PART).alias("parts")).filter("parts > 1")
    mine = belongs.join(large, F.col("capture") == F.col("large"), "left").select(F.col("id").alias("side_id"), "capture", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    of = lambda k, *c: F.collect_set(F.when(F.col("type") == k, F.struct("record_id", *c)))
    body = side.groupBy("id").agg(of("request", "target_uri", "http_head").alias("requests"), of("metadata", "target_uri", "facts").alias("metadata"))
    every = lambda c: F.sort_array(F.flatten(F.collect_list(c))).alias(c)
    sides = mine.join(body, F.col("side_id") == F.col("id")).groupBy("capture", "part").agg(every("requests"), every("metadata"))
    whole = captures.select("record_id", F.struct(*[c for c in records.columns if c not in ("concurrent_to", "fields")]).alias("response"))
    found = whole.filter("record_id is not null").join(sides, F.col("record_id") == F.col("capture"), "left").drop("capture")
    # Captures without identifier would all meet at the join's null key.
    found = found.unionByName(whole.filter("record_id is null"), allowMissingColumns=True)
    metadata = F.transform("metadata", lambda m: F.struct(m["record_id"].alias("record_id"), m["target_uri"].alias("target_uri"), F.map_from_entries(m["facts"]).alias("fields")))
    found = found.select("record_id", F.coalesce("part", F.lit(0)).alias("part"), "response", F.coalesce("requests", F.array()).alias("requests"), F.coalesce(metadata, F.array()).alias("metadata"))
    return found.withColumn("n_requests", F.size("requests").cast("long")).withColumn("n_metadata", F.size("metadata").cast("long"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives, reads them back, assembles the captures: page_id, payload size and digest, type, refers_to."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    c = assemble(stored(read_archives(spark, path, payloads=False), "records"))  # the joins read the records several times
    facts = F.get("metadata", F.lit(0))["fields"]
    page = facts["pageId"].try_cast("long")
    rows = c.select(page.alias("page_id"), F.coalesce("response.payload_bytes", facts["payloadBytes"].try_cast("long")).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_refers"), "record_id")
    # Only revisits refer to a record; responses would all meet at a null key.
    plain = rows.filter("record_type = 'response'")
    targets = plain.groupBy(F.col("record_id").alias("_refers")).agg(F.max("page_id").alias("refers_to"))
    again = rows.filter("record_type = 'revisit' and _refers is not null").join(targets, "_refers", "left")
    lost = rows.filter("record_type = 'revisit' and _refers is null").unionByName(plain).withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return again.select(columns).unionByName(lost.select(columns))
