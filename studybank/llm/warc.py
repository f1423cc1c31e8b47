"""WARC archives: a writer, and a sequential reader.

The writer makes one gzip member per record.  Spark's text sink writes each row's bytes
as they are, followed by a separator of at least one byte; a gzip member ends with the
high byte of its length, which is zero below 16 MiB, so that byte serves as the separator
and the files are exactly the members in a row.  The reader inflates a file
piece by piece, member by member, frames each record by its Content-Length and verifies
both digests.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studybank.llm.common import stored

#: Smallest payload that may be replaced by a revisit record.
MIN_REVISIT_BYTES = 1000
#: Pages in one archive; bounds the file that one reading task holds.
PAGES_PER_ARCHIVE = 2000
#: Compressed bytes handed to zlib at a time, and most bytes inflated in one call.
PIECE = 1 << 16
#: An empty gzip member (header, empty block, CRC and length of nothing).
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" + "0300" + "00" * 8)

RECORD_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, url string, verified boolean, payload binary")


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload digest and the page that a record revisits.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest
    page_id is the response and the others refer to it.  Null html is an empty payload; a
    row with null page_id refers to the response if the group has one.  Repeated rows of
    the largest page_id are all responses.  Other columns are ignored.
    Only digests shared by several rows are joined back."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", F.col("html").alias("html"),
                        F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n"))
    groups = (base.filter(F.col("n") >= min_bytes).groupBy("digest")
              .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
              .filter("copies > 1 and first_id is not null").select("digest", "first_id"))
    groups = stored(groups, "warc-groups")  # a plain exchange below the join lets Spark split a hot digest
    return (base.join(groups, "digest", "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
            .select("page_id", "url", "html", "digest", "n", "refers_to"))


def _urn(page_id) -> str:
    return "" if page_id is None else f"<urn:page:{page_id}>"


def _record(page_id, url, html, digest, n, refers_to) -> bytes:
    """One WARC record: named fields, then an HTTP block (a revisit has only its header)."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = head + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _urn(page_id) or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest + target)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", target)] if url is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        *([("WARC-Refers-To", _urn(refers_to)),
           ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
          if kind == "revisit" else []),
        ("Content-Length", str(len(block))),
    ]
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return top.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, level: int = 1,
               per_archive: int = PAGES_PER_ARCHIVE) -> None:
    """Write every row of ``pages`` as a record into archives below ``path``.

    ``path`` may be in any store Spark can write.  An empty table gives an empty folder."""
    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["page_id"].astype(object), b["url"], b["html"], b["digest"], b["n"],
                       b["refers_to"].astype(object))
            yield pd.DataFrame({"m": [_member(_record(*(None if pd.isna(x) else x for x in r)), level)[:-1]
                                      for r in rows]})

    ready = revisits(pages, min_bytes)
    ready = ready.select(F.col("page_id").cast("string"), "url", "html", "digest", "n",
                         F.col("refers_to").cast("string"))
    (ready.mapInPandas(members, "m binary").select(F.col("m").cast("string").alias("value"))
     .write.mode("overwrite").option("lineSep", "\u0000").option("maxRecordsPerFile", per_archive).text(path))


class _Body:
    """The inflated bytes of one gzip member, read in order."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at = data, at
        self.z = zlib.decompressobj(31)
        self.rest = b""

    def _more(self) -> bytes:
        if self.z.eof:
            return b""
        while True:
            feed = self.z.unconsumed_tail or bytes(self.data[self.at:self.at + PIECE])
            if not self.z.unconsumed_tail:
                self.at += len(feed)
            if not feed:
                raise ValueError("a gzip member ends early")
            out = self.z.decompress(feed, PIECE * 4)
            if self.z.eof:
                self.at -= len(self.z.unused_data)
            if out or self.z.eof:
                return out

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the member."""
        while (i := self.rest.find(mark)) < 0:
            more = self._more()
            if not more:
                if self.rest:
                    raise ValueError("a record's header ends early")
                return None
            self.rest += more
        out, self.rest = self.rest[:i + len(mark)], self.rest[i + len(mark):]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.rest:
                self.rest = self._more()
                if not self.rest:
                    raise ValueError("a record's block ends early")
            out, self.rest = self.rest[:n], self.rest[n:]
            n -= len(out)
            yield out

    def drain(self) -> int:
        """Bytes left in the member; afterwards ``at`` is the next member's first byte."""
        n = len(self.rest)
        while more := self._more():
            n += len(more)
        return n


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    out = {"": lines[0]}
    for line in lines[1:]:
        k, sep, v = line.partition(":")
        if sep:
            out[k.strip().lower()] = v.strip()
    return out


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def records(archive: bytes, payloads: bool = True) -> Iterator[tuple]:
    """The records of one archive in order, as rows of RECORD_SCHEMA.

    ``verified``: block digest, and for responses payload digest and length, all agree."""
    data, at = memoryview(archive), 0
    while at < len(data):
        body = _Body(data, at)
        head = body.until(b"\r\n\r\n")
        if head is not None:
            f = _fields(head)
            if not f[""].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {f['']!r}")
            left = int(f["content-length"])
            whole, inner, kept, http, size = hashlib.sha1(), hashlib.sha1(), [], b"", 0
            in_payload = False
            for piece in body.exactly(left):
                whole.update(piece)
                if not in_payload:
                    http += piece
                    i = http.find(b"\r\n\r\n")
                    if i < 0:
                        continue
                    http, piece, in_payload = http[:i + 4], http[i + 4:], True
                inner.update(piece)
                size += len(piece)
                if payloads:
                    kept.append(piece)
            kind = f.get("warc-type")
            digest = f.get("warc-payload-digest", "").removeprefix("sha1:").lower()
            claimed = int(_fields(http).get("content-length", size))
            ok = whole.hexdigest() == f.get("warc-block-digest", "").removeprefix("sha1:").lower()
            if kind == "response":
                ok = ok and inner.hexdigest() == digest and size == claimed
            if body.drain() != 4:
                raise ValueError("a record isn't followed by two line ends")
            yield (_page(f.get("warc-record-id")), claimed, digest, kind, _page(f.get("warc-refers-to")),
                   f.get("warc-target-uri"), ok, b"".join(kept) if payloads and kind == "response" else None)
        else:
            body.drain()
        at = body.at


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path``: RECORD_SCHEMA.

    A damaged member raises; a record whose digests differ has ``verified`` false."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for b in batches:
            for content in b["content"]:
                rows, held = [], 0
                for r in records(content, payloads):
                    rows.append(r)
                    held += len(r[-1] or b"")
                    if len(rows) >= 1000 or held >= 1 << 24:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parse, RECORD_SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("page_id", "payload_bytes", "refers_to"):
        out[c] = pd.array(out[c].tolist(), dtype="Int64")
    out["verified"] = out["verified"].astype(bool)
    return out
