"""Content-addressed WARC archive.

An archive is a folder with two tables: `payloads` (each distinct payload once, under its SHA-256, with the id of the record
that holds it) and `headers` (one row per record: the exact header bytes and the digest of its payload). Of records with
equal payloads the one with the largest id is the `response`; the others are `revisit` records that refer to it. `restore`
checks each stored payload against its digest, joins the tables, and gives the records back, header and block, from which
`record` makes WARC/1.1 bytes and `parsed` reads them; `read_warc` parses WARC files, plain or gzip by member.

`archive_pages` moves a payload across the network once, by its digest and after each task has merged its equal ones, so a
payload that a third of all rows share costs one row per task. The payload table is bucketed by digest: to rebuild records
only headers are shuffled, to the payloads' places. Headers of a hot digest are salted where they meet that digest's facts.

Defined results: a null payload is the empty payload, of 0 bytes; empty payloads are equal to one another; a null url gives
an empty target URI; a null id is written as an empty one, comes back as null and counts as smaller than all others; equal
(id, payload) rows are each a record, and of those one with the largest id counts as response by its id. Pages may be added
to an archive: payloads that it holds are not stored again, and their new records are revisits of the stored response.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, shared_folder, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: No clock is read: the same rows give the same archive.
DATE = "2024-01-01T00:00:00Z"


def base32(hex40: Column) -> Column:
    """Base32 (20 bytes, no padding) of 40 hexadecimal digits: five bytes make eight characters."""
    chars = []
    for group in range(4):
        value = F.conv(F.substring(hex40, 10 * group + 1, 10), 16, 10).cast("long")
        chars += [F.substring(F.lit(BASE32), F.shiftright(value, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*chars)


def hashed(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(id, url, payload, sha256, payload_bytes, sha1) of each row of pages."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    base = pages.select(F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    return base.withColumns({"sha256": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})


def described(out: DataFrame) -> DataFrame:
    """Rows (id, url, sha256, sha1, payload_bytes, first_id) with record_type, refers_to and header, whose bytes are exact."""
    held = F.col("id").eqNullSafe(F.col("first_id"))
    out = out.withColumns({"record_type": F.when(held, "response").otherwise("revisit"), "refers_to": F.when(~held, F.col("first_id")), "digest": base32(F.col("sha1"))})
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    uri = lambda c: F.regexp_replace(c, r"[\r\n]", "%20")
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn("id")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(held, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", profile))),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(held, F.col("payload_bytes")).otherwise(0).cast("string")), F.lit("\r\n"),
    )
    return out.withColumn("header", header.cast("binary"))


def _name(folder: str) -> str:
    return "warc_" + hashlib.md5(folder.encode()).hexdigest()


def payload_table(spark: SparkSession, folder: str, create: int = 0) -> DataFrame:
    """The payload table of an archive, known to the session as bucketed by digest; create: buckets of a new archive."""
    layout = f"{folder}/layout"
    if create:
        spark.createDataFrame([(create,)], "buckets int").write.mode("ignore").parquet(layout)
    n = spark.read.schema("buckets int").parquet(layout).collect()[0][0]
    name = _name(folder)
    place = f"{folder}/payloads".replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (sha256 STRING, payload BINARY, first_id BIGINT, copies BIGINT) USING parquet OPTIONS (path '{place}') CLUSTERED BY (sha256) INTO {n} BUCKETS")
    return spark.table(name)


def archive_pages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write a record of each row of pages to the archive in folder, a new one or one that is there."""
    spark = pages.sparkSession
    base = hashed(pages, key, url, payload).withColumn("id", F.col("id").cast("long"))
    before = payload_table(spark, folder, create=int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = base.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("id").alias("first_id"), F.count("*").alias("copies"))
    if not before.isEmpty():
        whole = whole.join(before.select("sha256"), "sha256", "left_anti")
    whole.write.insertInto(_name(folder))
    spark.catalog.refreshByPath(f"{folder}/payloads")
    first = payload_table(spark, folder).select(F.xxhash64("sha256").alias("k"), "sha256", "first_id", F.col("copies").alias("n"))
    light = base.select(F.xxhash64("sha256").alias("k"), "sha256", "id", "url", "payload_bytes", "sha1")
    met = salted_join(light, first.drop("n"), ["k", "sha256"], hot_keys(first, "k"), F.struct("id", "url"))
    described(met).select("id", "record_type", "header", "sha256", "payload_bytes").write.mode("append").parquet(f"{folder}/headers")


def restore(spark: SparkSession, folder: str, full: bool = False) -> DataFrame:
    """Records (header, block, payload_bytes, sha256, sha1) of an archive; with full, payload too (also of revisits).

    The block of a response is its payload, that of a revisit is empty; payload_bytes and sha1 are those of the full
    payload. Each payload is checked against its digest where it is stored, and what is made of it fails if it differs; a
    header without a payload of its digest and length fails too.
    """
    heads = spark.read.schema("id long, record_type string, header binary, sha256 string, payload_bytes long").parquet(f"{folder}/headers")
    held = payload_table(spark, folder)
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("sha256")))
    fine = F.sha2("payload", 256) == F.col("sha256")
    checked = held.select("sha256", F.when(fine, F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))
    facts = (F.octet_length("payload").cast("long").alias("stored_bytes"), F.sha1("payload").alias("sha1"))
    keyed = lambda df: df.withColumn("k", F.xxhash64("sha256"))
    hot = hot_keys(held.select(F.xxhash64("sha256").alias("k"), F.col("copies").alias("n")), "k")
    # One response per digest goes to the payload's bucket. Revisits, of which a digest may have very many, meet facts alone.
    responses = heads.where("record_type = 'response'").join(checked, "sha256", "left").withColumns({"block": F.col("payload"), "stored_bytes": facts[0], "sha1": facts[1]})
    other = keyed(checked.select("sha256", *([F.col("payload")] if full else []), *facts))
    revisits = salted_join(keyed(heads.where("record_type <> 'response'")), other, ["k", "sha256"], hot, F.col("id"), "left").withColumn("block", F.lit(b""))
    columns = ["header", "block", "payload_bytes", "stored_bytes", "sha256", "sha1"] + ["payload"] * full
    both = responses.select(*columns).unionByName(revisits.select(*columns))
    whole = F.coalesce(F.col("stored_bytes") == F.col("payload_bytes"), F.lit(False))
    sure = lambda c, kind: F.when(whole, F.col(c)).otherwise(wrong.cast(kind)).alias(c)
    return both.select("header", sure("block", "binary"), sure("payload_bytes", "long"), "sha256", sure("sha1", "string"), *([sure("payload", "binary")] if full else []))


def record() -> Column:
    """The WARC bytes of a row (header, block)."""
    return F.concat(F.col("header"), F.col("block"), F.lit(b"\r\n\r\n"))


def parsed(rec: Column) -> tuple[Column, Column]:
    """Header (as text, a character a byte) and block (bytes) of a record's bytes; a record that is cut short fails."""
    text = F.decode(rec, "ISO-8859-1")
    head = F.concat(F.substring_index(text, "\r\n\r\n", 1), F.lit("\r\n\r\n"))
    size = field(head, "Content-Length").cast("int")
    block = F.substring(rec, F.length(head) + 1, size)
    short = F.octet_length(rec) != F.length(head) + size + 4
    return head, F.when(F.coalesce(short, F.lit(True)), F.raise_error(F.lit("truncated record")).cast("binary")).otherwise(block)


def field(header: Column, name: str) -> Column:
    """A header field's value, or null."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of an open WARC file; a record that is cut short or fails its SHA-1 is an error."""
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        header, fields = version, {}
        while (line := stream.readline()).strip():
            header += line
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        header += line
        length = int(fields.get(b"content-length", 0))
        block = stream.read(length)
        if not line or len(block) < length:
            raise ValueError("truncated WARC record")
        kind, _, digest = fields.get(b"warc-payload-digest", b"").partition(b":")
        if kind.lower() == b"sha1" and fields.get(b"warc-type") != b"revisit":
            payload = block.partition(b"\r\n\r\n")[2] if fields.get(b"content-type", b"").startswith(b"application/http") else block
            if base64.b32encode(hashlib.sha1(payload).digest()) != digest.upper():
                raise ValueError("payload does not match its digest")
        yield header, block


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file's bytes, plain or gzip; inflated record by record."""
    stream = io.BytesIO(data)
    yield from records(io.BufferedReader(gzip.GzipFile(fileobj=stream)) if bytes(data[:2]) == b"\x1f\x8b" else stream)


def read_warc(spark: SparkSession, path: str, rows: int = 256) -> DataFrame:
    """Rows (path, header, block) of the WARC files at path. A file is the unit of work: a task holds the file as it is
    stored (Spark reads files of at most 2 GB so) and `rows` of its records."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                found = parse_warc(content.as_buffer())
                while part := list(itertools.islice(found, rows)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array([h for h, _ in part], pa.binary()), pa.array([b for _, b in part], pa.binary())], ["path", "header", "block"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "path string, header binary, block binary")


def gzip_member(record: bytes) -> bytes:
    """One record as a gzip member of its own, as in .warc.gz files."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives pages, rebuilds every record's bytes from the archive, and reads the columns off those bytes."""
    folder = shared_folder(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages"), folder)
    back = restore(spark, folder).select(record().alias("record"), "payload_bytes", "sha1")
    head, block = parsed(F.col("record"))
    back = back.select(head.alias("h"), block.alias("b"), "payload_bytes", "sha1")
    number = lambda name: F.regexp_extract(field(F.col("h"), name), r"<urn:record:(-?\d+)>", 1).try_cast("long")
    held = field(F.col("h"), "WARC-Type") == "response"
    # A response's figures are those of its block; a revisit's those of the payload that its digest leads to.
    size = F.when(held, F.octet_length("b").cast("long")).otherwise(F.col("payload_bytes"))
    sha1 = F.when(held, F.sha1("b")).otherwise(F.col("sha1"))
    out = back.select(number("WARC-Record-ID").alias("page_id"), size.alias("payload_bytes"), base32(sha1).alias("payload_digest"), field(F.col("h"), "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), field(F.col("h"), "WARC-Payload-Digest").alias("said"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))).alias("digest_verified"))


OP6_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS top FROM p),
g AS (SELECT page_id, octet_length(b) AS n, top, h, unnest(range(4)) AS k FROM m),
v AS (SELECT *, CAST('0x' || substr(h, CAST(10 * k + 1 AS BIGINT), 10) AS BIGINT) AS v FROM g),
d AS (SELECT page_id, string_agg(list_reduce(list_transform(range(8), lambda i: substr('{BASE32}', CAST(((v >> CAST(35 - 5 * i AS BIGINT)) & 31) + 1 AS BIGINT), 1)), lambda a, b: a || b), '' ORDER BY k) AS digest, any_value(n) AS n, any_value(top) AS top FROM v GROUP BY page_id)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to, true AS digest_verified FROM d
"""
