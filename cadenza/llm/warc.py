"""WARC archives: write one record per page, read them back, rebuild segments.

Writing.  A page whose payload equals an earlier page's is a ``revisit`` of it,
others are ``response`` records with a chunked HTTP body.  A block longer than
``segment_bytes`` is cut into a first segment and ``continuation`` records that
name it as their origin.  A record is text and ends with two line ends, so
Spark's text writer with that separator makes archives through the committer of
whatever file system holds them, and a lost task leaves nothing behind.

Reading.  Archives come as binary files, each of at most ``records_per_file``
records of one segment.  Whole records are decoded at once; only segments are
shuffled, by origin, ordered by number, joined and checked against the total
length.  A revisit takes length and digest from the record it refers to, whose
lookup Spark may split where one page has very many copies.

Defined results: a null html is an empty payload; payloads below 100 bytes are
never revisits; a null page id counts as the largest; rows that repeat a page id
with the same payload are one response and revisits of it; repeated ids with
different payloads are separate records; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import common
from cadenza.session import run_dir

END = "\r\n\r\n"
PARSED = (
    "record string, type string, origin string, segment int, total long, page_id long, "
    "refers_to string, digest string, block binary"
)


def _page_number(record: str | None) -> int | None:
    if record is None:
        return None
    value = record.removeprefix("<urn:page:").split(":")[0]
    return int(value) if value != "null" else None


def _cuts(block: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes that end between characters."""
    at = 0
    while len(block) - at > size:
        end = at + size
        while end > at + 1 and block[end] & 0xC0 == 0x80:
            end -= 1
        yield block[at:end]
        at = end
    yield block[at:]


def _chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for piece in _cuts(payload, size):
        if piece:
            parts.append(b"%x\r\n%s\r\n" % (len(piece), piece))
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """Payload of a chunked transfer; framing errors raise."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        parts.append(body[at : at + size])
        at += size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk without line end")
        at += 2


def _records(page: str, url: str, html: str, digest: str, refers: str | None, segment: int, chunk: int) -> Iterator[str]:
    kind = "revisit" if refers else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http if refers else http + _chunked(html.encode(), chunk)
    parts = list(_cuts(block, segment))
    for number, part in enumerate(parts, 1):
        name = page if number == 1 else f"{page[:-1]}:{number}>"
        head = {
            "WARC-Type": kind if number == 1 else "continuation",
            "WARC-Record-ID": name,
            "WARC-Date": "2024-01-01T00:00:00Z",
            "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]+", "%20", url or "about:blank"),
            "Content-Type": "application/http; msgtype=response",
            "Content-Length": str(len(part)),
        }
        if number == 1:
            head["WARC-Payload-Digest"] = f"sha256:{digest}"
            if refers:
                head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                head["WARC-Refers-To"] = refers
        if len(parts) > 1:
            head["WARC-Segment-Number"] = str(number)
            if number > 1:
                head["WARC-Segment-Origin-ID"] = page
            if number == len(parts):
                head["WARC-Segment-Total-Length"] = str(len(block))
        lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
        yield f"WARC/1.1\r\n{lines}\r\n{part.decode()}"


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 100,
    segment_bytes: int = 64 << 10,
    chunk_bytes: int = 8 << 10,
    records_per_file: int = 1000,
) -> None:
    """Write ``pages`` as compressed archives below ``path``."""
    html = common.text_of(html_col)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).alias("bytes"),
    )
    # one row per digest, id and task reaches the shuffle; no page text does.  The
    # digests that repeat are written, so the planner knows their size: it sends
    # them to every task only below the session's threshold.
    last = F.lit((1 << 63) - 1)
    rows = rows.withColumn("own", F.coalesce("page_id", last))
    first = common.materialize(
        rows.where(F.col("bytes") >= least_bytes)
        .groupBy("digest", "own")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.min(F.struct("own", "n")).alias("least"), F.sum("n").alias("copies"))
        .where(F.col("copies") > 1)
        .select("digest", F.col("least.own").alias("first_id"), (F.col("least.n") > 1).alias("tied")),
        "warc-first",
    )
    rows = rows.join(first, "digest", "left")
    tied = F.coalesce(F.col("tied") & (F.col("own") == F.col("first_id")), F.lit(False))
    plain = rows.where(~tied).withColumn("turn", F.lit(1)).drop("tied")
    # equal rows become one with a count, then as many as before
    equal = (
        rows.where(tied)
        .groupBy("page_id", "digest", "bytes", "own", "first_id")
        .agg(F.min("url").alias("url"), F.min("html").alias("html"), F.count(F.lit(1)).cast("int").alias("n"))
        .withColumn("turn", F.explode(F.sequence(F.lit(1), "n")))
        .drop("n")
    )
    rows = plain.unionByName(equal)
    revisit = F.col("first_id").isNotNull() & ((F.col("own") != F.col("first_id")) | (F.col("turn") > 1))

    def name(number, digest):
        return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))

    target = F.when(F.col("first_id") == last, F.lit(None)).otherwise(F.col("first_id"))
    rows = rows.select(
        F.when(revisit | (F.col("bytes") >= least_bytes), name(F.col("page_id"), F.col("digest")))
        .otherwise(name(F.col("page_id"), F.concat("digest", F.lit("-small"))))
        .alias("name"),
        "url",
        F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"),
        "digest",
        F.when(revisit, name(target, F.col("digest"))).alias("refers"),
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for r in batch.itertuples(index=False):
                for record in _records(r.name, r.url, r.html, r.digest, r.refers, segment_bytes, chunk_bytes):
                    out.append(record)
                    size += len(record)
                    if size > 1 << 24:
                        yield pd.DataFrame({"value": out})
                        out, size = [], 0
            yield pd.DataFrame({"value": out})

    (
        rows.mapInPandas(encode, "value string")
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _parse(content: bytes) -> Iterator[tuple]:
    data = zlib.decompress(content, wbits=47)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size:
            raise ValueError("record cut short")
        at = stop + 4 + size + len(END)
        record = head["WARC-Record-ID"]
        number = head.get("WARC-Segment-Number")
        yield (
            record,
            head["WARC-Type"],
            head.get("WARC-Segment-Origin-ID", record),
            int(number) if number else None,
            int(head["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in head else None,
            _page_number(record),
            head.get("WARC-Refers-To"),
            (head.get("WARC-Payload-Digest") or "").removeprefix("sha256:") or None,
            block,
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record or segment of the archives below ``path``."""
    columns = [c.split()[0] for c in PARSED.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out, size = [], 0
                for row in _parse(content):
                    out.append(row)
                    size += len(row[-1])
                    if size > 1 << 24:
                        yield _frame(out, columns)
                        out, size = [], 0
                yield _frame(out, columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parse, PARSED)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    for c in ("segment", "total", "page_id"):
        frame[c] = frame[c].astype("Int64")
    return frame


def whole_records(records: DataFrame) -> DataFrame:
    """Segments joined by origin; a missing or short segment raises.

    All segments of a record meet in one row, which is as large as the record.
    """
    single = records.where(F.col("segment").isNull())
    segments = records.where(F.col("segment").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    first = F.col("segment") == 1
    joined = segments.groupBy("origin").agg(
        parts.alias("parts"),
        F.max("total").alias("total"),
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("record", "type", "page_id", "refers_to", "digest")],
    )
    block = F.expr("aggregate(parts, cast('' as binary), (b, p) -> concat(b, p.block))")
    joined = joined.withColumn("whole", block)
    sound = (F.octet_length("whole") == F.col("total")) & (
        F.element_at("parts", -1)["segment"] == F.size("parts")
    )
    joined = joined.select(
        "record", "type", "origin", F.lit(None).cast("int").alias("segment"), "total", "page_id", "refers_to", "digest",
        F.when(F.coalesce(sound, F.lit(False)), F.col("whole"))
        .otherwise(F.raise_error(F.concat(F.lit("segments do not add up: "), F.col("origin"))))
        .alias("block"),
    )
    return single.unionByName(joined)


def payloads(records: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Decoded responses and revisits: record, type, page, reference, length, digest."""
    schema = "record string, type string, page_id long, refers_to string, payload_bytes long, payload_digest string" + (
        ", payload binary" if keep_payload else ""
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                body = b"" if r.type == "revisit" else dechunk(r.block[r.block.index(b"\r\n\r\n") + 4 :])
                digest = hashlib.sha256(body).hexdigest()
                if r.type != "revisit" and digest != r.digest:
                    raise ValueError(f"digest of {r.record} differs")
                out.append((r.record, r.type, r.page_id, r.refers_to, len(body), digest, body)[: 7 if keep_payload else 6])
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)
            frame["page_id"] = frame["page_id"].astype("Int64")
            yield frame

    return records.select("record", "type", "page_id", "refers_to", "digest", "block").mapInPandas(decode, schema)


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: full payload length and digest, its type and reference."""
    found = common.materialize(payloads(whole_records(read_records(spark, path))), "warc-payloads")
    responses = found.where(F.col("type") == "response").select(
        F.col("record").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")
    )
    seen = found.where(F.col("type") == "response").withColumn("to", F.lit(None).cast("long"))
    again = found.where(F.col("type") == "revisit").join(responses, "refers_to", "left")
    again = again.select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.regexp_extract("refers_to", r"^<urn:page:(-?\d+):", 1).try_cast("long").alias("refers_to"),
    )
    return seen.select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("to").alias("refers_to")
    ).unionByName(again)


def op6_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    return page_report(spark, path)


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS payload_digest,
         strlen(coalesce(html, '')) AS payload_bytes
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
