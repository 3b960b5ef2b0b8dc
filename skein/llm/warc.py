"""WARC archives with segmented records: write, reassemble, decode.

The writer turns each page into an HTTP response in chunked transfer framing and cuts what is
long into a first record and continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID,
and WARC-Segment-Total-Length on the last). It writes through Spark's text sink, so archives can
lie in any store Spark reaches.

The reader takes archives of versions 1.0 and 1.1 with payloads of any bytes. Spark cuts files of
any size at each ``WARC/1.`` and splits them among tasks; a record ends where its Content-Length
says, so a payload that holds that mark, or whole records, is put together again from its pieces:
in files where a piece is not one whole record, the sizes of the pieces (not the pieces) of each
file are walked in order to find which record each belongs to. It groups segments by origin
identifier, orders them by segment number, verifies the total length, and decodes the framing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import save, shared_path, small_batches

MARK = "WARC/1."
START = f"{MARK}1\r\n"
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
CHUNK = 8192
SEGMENT = 65536
LEAST = 100


def chunked(text: str, size: int = CHUNK) -> str:
    """Chunked transfer framing, no chunk border inside a character, one inside each ``WARC/`` (so that archives of this writer are read in one pass)."""
    out = []
    for piece in _pieces(text):
        for i in range(0, len(piece), size):
            part = piece[i : i + size]
            out.append(f"{len(part.encode('utf-8', 'surrogatepass')):x}\r\n{part}\r\n")
    return "".join(out) + "0\r\n\r\n"


def _pieces(text: str) -> list[str]:
    parts = text.split("WARC/")
    return [("/" if i else "") + p + ("WARC" if i < len(parts) - 1 else "") for i, p in enumerate(parts)]


def dechunk(block: bytes) -> bytes:
    """The payload of chunked framing; raises ValueError where it is cut short or malformed."""
    out, at = [], 0
    while True:
        end = block.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        n = int(block[at:end].split(b";")[0].strip() or b"x", 16)
        if not n:
            return b"".join(out)
        if block[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(block[end + 2 : end + 2 + n])
        at = end + 4 + n


def _digest(sha_hex: str) -> str:
    return "sha256:" + base64.b32encode(bytes.fromhex(sha_hex)).decode().rstrip("=")


def _records(segment: int):
    def headers(fields: dict) -> str:
        return "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"

    def cut(block: str) -> list[str]:
        return [block[a : a + segment] for a in range(0, len(block), segment)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                page = None if pd.isna(row.page_id) else int(row.page_id)
                me = f"<urn:skein:page:{row.number}>"
                url = (row.url or "about:blank").replace("\r", "%0D").replace("\n", "%0A").replace("WARC/", "WARC%2F")
                common = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": url, "WARC-Payload-Digest": _digest(row.digest)}
                if page is not None and not pd.isna(row.first_page) and page != int(row.first_page):
                    block = HTTP
                    fields = {"WARC-Type": "revisit", "WARC-Record-ID": me, "Page-ID": page} | common
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Page-ID": int(row.first_page)}
                    out.append(headers(fields | {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}) + block)
                    continue
                pieces = cut(HTTP + chunked(row.html))
                total = sum(len(p.encode("utf-8", "surrogatepass")) for p in pieces)
                for n, piece in enumerate(pieces, 1):
                    own = {"WARC-Type": "response" if n == 1 else "continuation", "WARC-Record-ID": me if n == 1 else f"{me[:-1]}:{n}>"}
                    own |= ({"Page-ID": page} if n == 1 else {}) | common
                    if len(pieces) > 1:
                        own |= {"WARC-Segment-Number": n}
                    if n > 1:
                        own |= {"WARC-Segment-Origin-ID": me}
                    if n == len(pieces) > 1:
                        own |= {"WARC-Segment-Total-Length": total}
                    out.append(headers(own | {"Content-Type": "application/http;msgtype=response", "Content-Length": len(piece.encode("utf-8", "surrogatepass"))}) + piece)
            yield pd.DataFrame({"value": [START + r for r in out]}, dtype=object)

    return run


def write_warc(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Write each row of ``pages`` (page_id, url, html) as a record, long ones segmented.

    Of rows with equal payloads of at least ``least`` bytes those with the smallest page_id are
    responses, the others revisits; rows with a null page_id are responses always. A null html is
    an empty payload. Further columns are not read.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    groups = base.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur again: Spark broadcasts this table where it is small, else sorts both sides.
    again = save(groups.where("n > 1").select(F.col("digest").alias("_digest"), "first_page"), "payloads")
    joined = base.join(again, F.col("digest") == F.col("_digest"), "left").withColumn("number", F.monotonically_increasing_id())
    rows = joined.select("page_id", "url", "html", "digest", "first_page", "number").mapInPandas(_records(segment), "value string")
    rows.write.option("lineSep", "\r\n\r\n").text(path)


def _head(piece: bytes) -> tuple[dict[str, str], int]:
    """The fields of a record that begins with the last of its version, and where its block begins; ({}, -1) if none does."""
    at = piece.find(END)
    if piece[:3] not in (b"0\r\n", b"1\r\n") or at < 0:
        return {}, -1
    lines = (line.partition(":") for line in piece[3:at].decode("utf-8", "replace").split("\r\n"))
    fields = {k.strip().lower(): v.strip() for k, _, v in lines}
    good = fields.get("content-length", "").isdecimal() and "warc-type" in fields and "warc-record-id" in fields
    return (fields, at + len(END)) if good else ({}, -1)


def _need(piece: bytes) -> int:
    """Bytes of the record that begins with ``piece``, without what parts records; -1 if none does."""
    fields, at = _head(piece)
    return at + int(fields["content-length"]) if fields else -1


def _numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces with ``at``, the place of each in its block of its file."""
    last, n = None, 0
    for frame in frames:
        at = np.empty(len(frame), np.int64)
        for i, own in enumerate(zip(frame["file"], frame["block"], strict=True)):
            n = n + 1 if own == last else 0
            last, at[i] = own, n
        yield frame.assign(at=at)


def _sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, block, at, size, need) of each piece."""
    for frame in _numbered(frames):
        yield frame.assign(size=frame["bytes"].map(len).astype("int64"), need=frame["bytes"].map(_need).astype("int64")).drop(columns="bytes")


def _owners(frame: pd.DataFrame) -> pd.DataFrame:
    """The piece with which the record of each piece begins; what stands before the first record has none."""
    frame = frame.sort_values(["block", "at"])
    block, at, size, need = (frame[c].to_numpy() for c in ("block", "at", "size", "need"))
    own_block, own_at = np.full(len(frame), -1, np.int64), np.full(len(frame), -1, np.int64)
    open_, left = -1, 0
    for i in range(len(frame)):
        if left <= 0 and need[i] >= 0:
            open_, left = i, need[i] - size[i]
        elif open_ >= 0 and left > 0:
            left -= size[i] + len(MARK)
        else:
            open_ = -1
        if open_ >= 0:
            own_block[i], own_at[i] = block[open_], at[open_]
    return frame[["file", "block", "at"]].assign(own_block=own_block, own_at=own_at)


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each record from its pieces."""
    for frame in frames:
        records = [MARK.encode().join(bytes(p["bytes"]) for p in sorted(parts, key=lambda p: (p["block"], p["at"]))) for parts in frame["pieces"]]
        yield pd.DataFrame({"bytes": records}, dtype=object)


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """(bytes): each record of the archives in ``path``, without the first bytes of its version."""
    lines = spark.read.option("lineSep", MARK).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("bytes"))
    # A file's text begins with the mark, so its first piece is empty.
    sizes = save(pieces.mapInPandas(_sizes, "file string, block long, at long, size long, need long"), "sizes")
    plain = F.col("need").isNotNull() & ((F.col("size") - F.col("need")).isin(0, len(END)) | ((F.col("size") == 0) & (F.col("at") == 0)))
    odd = save(sizes.where(~plain & ~((F.col("size") == 0) & (F.col("block") == 0))).select("file").distinct(), "odd")
    if odd.isEmpty():
        return pieces.where(F.octet_length("bytes") > 0).select("bytes")
    same = pieces.join(odd, "file", "left_anti").where(F.octet_length("bytes") > 0).select("bytes")
    owned = sizes.join(odd, "file", "left_semi").groupBy("file").applyInPandas(_owners, "file string, block long, at long, own_block long, own_at long")
    cut = pieces.mapInPandas(_numbered, "file string, block long, bytes binary, at long").join(odd, "file", "left_semi")
    joined = cut.join(save(owned.where("own_block >= 0"), "owners"), ["file", "block", "at"])
    grouped = joined.groupBy("file", "own_block", "own_at").agg(F.collect_list(F.struct("block", "at", "bytes")).alias("pieces"))
    return same.unionAll(grouped.select("pieces").mapInPandas(_whole, "bytes binary"))


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for value in frame["bytes"]:
            fields, at = _head(value)
            if not fields:
                continue
            length = int(fields["content-length"])
            body = value[at : at + length]
            number = int(fields.get("warc-segment-number", 1))
            total = fields.get("warc-segment-total-length")
            whole = len(body) == length and value[at + length :].strip(b"\r\n") == b""
            page, refers = fields.get("page-id"), fields.get("warc-refers-to-page-id")
            out.append(
                (fields.get("warc-segment-origin-id", fields["warc-record-id"]), number, fields["warc-type"], None if page is None else int(page), None if refers is None else int(refers),
                 fields.get("warc-target-uri"), fields.get("warc-payload-digest"), int(total) if total else -1, "warc-segment-number" not in fields, whole, body)
            )
        f = pd.DataFrame(out, columns=["origin", "number", "type", "page_id", "refers_to", "url", "stated", "total", "single", "whole", "body"])
        yield f.astype({"page_id": "Int64", "refers_to": "Int64"})


_SEGMENT = "origin string, number int, type string, page_id long, refers_to long, url string, stated string, total long, single boolean, whole boolean, body binary"


def _assemble(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for parts in frame["parts"]:
            parts = sorted(parts, key=lambda p: p["number"])
            first, error = parts[0], None
            body = b"".join(p["body"] for p in parts)
            if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or not (first["single"] or parts[-1]["total"] >= 0):
                error = "segments missing"
            elif not all(p["whole"] for p in parts):
                error = "record cut short"
            elif parts[-1]["total"] >= 0 and parts[-1]["total"] != len(body):
                error = "total length differs"
            payload = b""
            head, _, rest = body.partition(b"\r\n\r\n")
            if error is None and first["type"] == "response":
                try:
                    payload = dechunk(rest) if b"transfer-encoding: chunked" in head.lower() else rest
                except ValueError as e:
                    error = str(e)
            sha = hashlib.sha256(payload).hexdigest()
            if error is None and first["type"] == "response" and (first["stated"] or "").startswith("sha256:") and first["stated"] != _digest(sha):
                error = "digest differs"
            stated = first["stated"]
            if first["type"] == "revisit" and stated and stated.startswith("sha256:"):
                sha = base64.b32decode(stated[7:] + "=" * (-len(stated[7:]) % 8)).hex()
            out.append((first["page_id"], first["url"], first["type"], first["refers_to"], len(payload), sha, payload if first["type"] == "response" else None, error))
        f = pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"])
        yield f.astype({"page_id": "Int64", "refers_to": "Int64"})


_PART = [c.split()[0] for c in _SEGMENT.split(", ")[1:]]


def _alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in _parse(frames):
        yield from _assemble([pd.DataFrame({"parts": [[part] for part in frame[_PART].astype(object).where(frame[_PART].notna(), None).to_dict("records")]})])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, error) of each origin record.

    A record whose segments are missing, cut short or of another total length, whose framing is
    malformed or whose digest differs keeps its row, with ``error`` saying so. A revisit has no
    payload of its own: its payload is null and its payload_bytes 0 until ``resolve`` finds them.
    """
    small_batches(spark)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
    records = records_of(spark, path)
    segmented = F.contains(F.lower(F.substring_index(F.col("bytes").cast("string"), "\r\n\r\n", 1)), F.lit("warc-segment-number:"))
    # A record's segments are bounded by one page; a hot origin cannot arise. Records in one piece stay where they are read.
    segments = records.where(segmented).mapInPandas(_parse, _SEGMENT)
    grouped = segments.groupBy("origin").agg(F.collect_list(F.struct(*_PART)).alias("parts"))
    return grouped.select("parts").mapInPandas(_assemble, schema).union(records.where(~segmented).mapInPandas(_alone, schema))


def resolve(records: DataFrame) -> DataFrame:
    """Give each revisit the length of the payload it refers to."""
    kept = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
    kept = save(kept, "records")
    asked = kept.where("record_type = 'revisit'").select("refers_to").distinct()
    found = kept.where("record_type = 'response'").join(asked.withColumnRenamed("refers_to", "_asked"), F.col("page_id") == F.col("_asked"))
    target = found.groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_sha")).agg(F.max("payload_bytes").alias("_bytes"))
    joined = kept.join(target, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_sha")), "left")
    return joined.select("page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "error")


def round_trip(pages: DataFrame, least: int = LEAST, segment: int = SEGMENT) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, least, segment)
    return resolve(read_warc(pages.sparkSession, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
