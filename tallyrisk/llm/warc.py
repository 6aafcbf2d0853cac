"""WARC archives written and read as tables of chunks.

A record is a run of rows (record identifier, chunk number). A payload over `chunk_bytes` is
written as WARC segments: the first is the response, the others are continuations that name it,
the last carries the total length. Chunks of a record follow each other in one file, so a reader
carries one running digest and one chunk, never a whole record.

Equal payloads of at least `min_bytes` bytes are stored once: the record with the smallest page_id
is the response, the others are revisits of it.

Files are written and read by Spark's own text source, so they may lie in any store it knows.
They are gzip files, which Spark reads in one task each, in order. Every record starts with
`WARC/1.1` and the identifier of the archive; that pair of lines, which no payload can know
beforehand, is where the reader splits.

Defined results: a null html is an empty payload; a null page_id never counts as the smallest
while others exist, and stays null; a null url is written as a name made of the page_id; line
breaks in a url are percent-encoded; rows repeated in page_id and payload have the same type each;
an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path
from .common import store

CHUNK_BYTES = 1 << 20
MIN_BYTES = 0
BREAK = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal digest of 40 characters: 20 bits, or 4 characters, at a time."""
    out = []
    for group in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1), F.lit(1))
                for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def marker(archive: str) -> str:
    return f"WARC/1.1{BREAK}WARC-Warcinfo-ID: <urn:uuid:{archive}>{BREAK}"


def _urn(*parts) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK)), F.lit(""))


def record_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, digest and first (smallest page_id with the same payload), distinct."""
    keys = pages.select("page_id", F.col("digest"), F.octet_length("payload").alias("bytes")).distinct()
    firsts = keys.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    return keys.join(firsts, "digest", "left").select("page_id", "digest", F.coalesce("first", "page_id").alias("first"))


def write_archive(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES) -> str:
    """Write pages (page_id, url, html) as WARC files below `path`; the archive's identifier."""
    archive = str(uuid.uuid4())
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # one digest per row, in hexadecimal; the base32 form is made from it where a header is written
    rows = rows.withColumn("digest", F.sha1("payload"))
    types = store(record_types(rows, min_bytes), "record_types").withColumnsRenamed({"page_id": "_p", "digest": "_d"})
    typed = rows.join(types, rows["page_id"].eqNullSafe(F.col("_p")) & (rows["digest"] == F.col("_d")), "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first"))
    whole = F.octet_length("payload")
    chunks = F.expr(
        f"transform(sequence(0, greatest(cast(ceil(octet_length(payload) / {chunk_bytes}D) as int), 1) - 1), "
        f"i -> cast(substring(payload, i * {chunk_bytes} + 1, {chunk_bytes}) as string))")
    parts = typed.select("page_id", "url", "digest", "first", revisit.alias("revisit"), whole.alias("whole"),
                         F.when(revisit, F.array(F.lit(""))).otherwise(chunks).alias("chunks"))
    parts = parts.select("page_id", "url", "digest", "first", "revisit", "whole", F.size("chunks").alias("n"),
                         F.posexplode("chunks").alias("number", "chunk"))
    http = F.when(F.col("number") == 0, F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.when(F.col("revisit"), 0).otherwise(F.col("whole")).cast("string"), F.lit(BREAK + BREAK))).otherwise("")
    segmented, started = F.col("n") > 1, F.col("number") > 0
    own = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    record = _urn(F.lit(archive), own, "digest")
    header = F.concat(
        F.lit(marker(archive)),
        _field("WARC-Type", F.when(F.col("revisit"), "revisit").when(started, "continuation").otherwise("response")),
        _field("WARC-Record-ID", F.when(started, _urn(F.lit(archive), own, "digest", F.col("number").cast("string"))).otherwise(record)),
        _field("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _field("WARC-Target-URI", F.coalesce("url", F.concat(F.lit("urn:page:"), own))),
        _field("WARC-Page-ID", F.col("page_id")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        _field("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.lit(archive), F.col("first").cast("string"), "digest"))),
        _field("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Segment-Number", F.when(segmented, F.col("number") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(started, record)),
        _field("WARC-Segment-Total-Length", F.when(segmented & (F.col("number") + 1 == F.col("n")), F.col("whole"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(F.concat(http, "chunk"))), F.lit(BREAK))
    lines = parts.select(F.concat(header, http, "chunk").alias("value"))
    lines.write.option("lineSep", BREAK + BREAK).option("compression", "gzip").text(path)
    return archive


def read_chunks(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """One row per chunk, in file order: record_id (of the first segment), number (from 0), last,
    type, page_id, refers_to, digest (as declared) and content. Without `archive` the identifier is
    looked up in the files."""
    if archive is None:
        lines = spark.read.option("lineSep", BREAK).text(path).where("value like 'WARC-Warcinfo-ID: %'")
        found = lines.select(F.regexp_extract("value", "<urn:uuid:([0-9a-f-]+)>", 1).alias("a")).head()
        if found is None:
            return spark.createDataFrame([], CHUNK_SCHEMA)
        archive = found["a"]
    raw = spark.read.option("lineSep", marker(archive)).text(path).where("value <> ''")
    header = F.substring_index("value", BREAK + BREAK, 1)

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("header", f"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))

    rows = raw.select(header.alias("header"), F.col("value").cast("binary").alias("value"))
    content = F.substring(F.col("value"), F.octet_length("header") + 5, field("Content-Length").cast("int"))
    number = F.coalesce(field("WARC-Segment-Number").cast("int") - 1, F.lit(0))
    last = field("WARC-Segment-Number").isNull() | field("WARC-Segment-Total-Length").isNotNull()
    return rows.select(
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record_id"), number.alias("number"),
        last.alias("last"), field("WARC-Type").alias("type"), field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Refers-To").alias("refers_to"), F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        content.alias("content"))


CHUNK_SCHEMA = ("record_id string, number int, last boolean, type string, page_id long, refers_to string, digest string,"
                " content binary")


def records(chunks: DataFrame, in_order: bool = True) -> DataFrame:
    """One row per record: record_id, type, page_id, refers_to, payload_bytes, payload_digest.

    Goes over the chunks with one running digest. Chunks that do not come in file order have to
    be dealt out by record first (`in_order=False`). A chunk out of turn, or a payload that does
    not have its declared digest, is an error.
    """
    if not in_order:
        chunks = chunks.repartition("record_id").sortWithinPartitions("record_id", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, size, turn, head = None, None, 0, 0, None
        for batch in batches:
            out = []
            ids, numbers, lasts, types, pages, refers, declared = (batch.column(i).to_pylist() for i in range(7))
            contents = batch.column(7)
            for i, record in enumerate(ids):
                content = contents[i].as_buffer().to_pybytes() if contents[i].is_valid else b""
                if numbers[i] == 0:
                    now, digest, size, turn = record, hashlib.sha1(), 0, 0
                    head = (record, types[i], pages[i], refers[i], declared[i])
                    content = content[content.index(b"\r\n\r\n") + 4:]  # the HTTP head is not payload
                if record != now or numbers[i] != turn:
                    raise ValueError(f"chunk {numbers[i]} of {record} is out of turn")
                digest.update(content)
                size, turn = size + len(content), turn + 1
                if lasts[i]:
                    name = base64.b32encode(digest.digest()).decode()
                    if head[1] != "revisit" and head[4] is not None and head[4] != name:
                        raise ValueError(f"payload of {record} does not have its declared digest")
                    out.append((*head[:4], size, name))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=RECORD_NAMES)

    return chunks.mapInArrow(run, "record_id string, type string, page_id long, refers_to string,"
                                  " payload_bytes long, payload_digest string")


RECORD_NAMES = ["record_id", "type", "page_id", "refers_to", "payload_bytes", "payload_digest"]


def resolved(found: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id). Revisits
    take size and digest from the response they name."""
    found = store(found, "records")
    answers = found.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.first("page_id").alias("_page"), F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_digest"))
    again = found.join(answers, "refers_to", "left")
    visit = F.col("type") == "revisit"
    return again.select(
        "page_id", F.when(visit, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(visit, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(visit, F.col("_page")).alias("refers_to"))


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write an archive into the shared folder and read it back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    archive = write_archive(pages, path, chunk_bytes, min_bytes)
    return resolved(records(read_chunks(spark, path, archive)))
