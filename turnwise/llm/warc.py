"""WARC archives of pages, written and read back.

Payloads go out as HTTP responses in chunked transfer framing, each record a gzip member.  A block
longer than a segment is continued in further records.  The reader decodes whole records where it
finds them; segments are grouped by the identifier of their origin record, put in the order of
their numbers, checked against the total length that the last one states, and decoded.

Archives are written below the shared folder, under names that hold the task attempt; the manifest
lists only those of attempts that ended, so a lost executor leaves no half file to be read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, spool

#: Bytes of a segment, of an HTTP chunk and of an archive; payloads from SMALL bytes may be revisits.
SEGMENT, CHUNK, ARCHIVE, SMALL = 16 << 10, 4 << 10, 64 << 20, 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    return fields, unchunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body


def record(fields: dict, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def zipped(raw: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def page_records(page_id, url, digest: str, first, payload: bytes, own: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a response in as many segments as it takes, or a revisit."""
    common = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": " ".join(url.split()) if url else None, "WARC-Page-ID": page_id, "WARC-Payload-Digest": f"sha256:{digest}"}
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own)}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = "application/http;msgtype=response"
    if first is not None:
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": name} | common | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{first}>", "Content-Type": kind}, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    many = len(parts) > 1
    yield record({"WARC-Type": "response", "WARC-Record-ID": name} | common | {"WARC-Segment-Number": 1 if many else None, "Content-Type": kind}, parts[0])
    for i, part in enumerate(parts[1:], 2):
        own_name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}/{i}')}>"
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": own_name, "WARC-Date": common["WARC-Date"], "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": i, "WARC-Segment-Total-Length": len(block) if i == len(parts) else None}, part)


def records(file, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, gzipped or not, read as a stream; one that ends
    inside a record or a gzip member raises."""
    held, zip_, ended, begun = bytearray(), zlib.decompressobj(31), False, False
    left = file.read(size)
    packed = left[:2] == b"\x1f\x8b"
    while True:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            lines = held[:end].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(fields["content-length"])
            if len(held) >= end + 8 + n:
                if not lines[0].startswith("WARC/") or held[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
                    raise ValueError("this is no WARC record")
                yield fields, bytes(held[end + 4 : end + 4 + n])
                del held[: end + 8 + n]
                continue
        if ended:
            if held or begun and not zip_.eof:
                raise ValueError("the archive ends inside a record")
            return
        data = left or file.read(size)
        if not data:
            ended = True
            continue
        if not packed:
            held += data
            left = b""
            continue
        if zip_.eof:
            zip_ = zlib.decompressobj(31)
        begun = True
        held += zip_.decompress(data)
        left = zip_.unused_data


def marked(pages: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    """(page_id, url, digest, first, payload): first is the page that this one revisits, or null."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    known = base.where(F.length("payload") >= SMALL).select("page_id", "digest")
    firsts = spool(known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "firsts")
    later = known.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct().select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    return base.join(later, base["page_id"].eqNullSafe(later["p"]) & (base["digest"] == later["d"]), "left").select("page_id", "url", "digest", "first", "payload")


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """Write a record for each row; returns the manifest (path, records).

    A null page is an empty payload.  Of equal payloads of 100 bytes or more all rows with the
    smallest page_id are responses and the others revisit it; null ids revisit, too, unless all
    are null.  Repeated rows get a record each."""
    to = shared_path(pages.sparkSession, "warc")
    info = b"software: turnwise\r\nformat: WARC File Format 1.1\r\n"

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(to)
        system.create_dir(base, recursive=True)
        file, path, number, count, size, rows = None, None, 0, 0, 0, 0
        done = []
        for batch in batches:
            for p, u, d, f, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += 1
                for raw in page_records(p, u, d, f, payload, f"{to}/{task.partitionId()}/{rows}", segment):
                    if file is None:
                        path = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number}-{uuid.uuid4().hex[:12]}.warc.gz"
                        file, size, count, number = system.open_output_stream(f"{base}/{path}", compression=None), 0, 0, number + 1
                        file.write(zipped(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, info)))
                    raw = zipped(raw)
                    file.write(raw)
                    size, count = size + len(raw), count + 1
                    if size >= archive:  # a response may go on in the next archive
                        file.close()
                        file = None
                        done.append((path, count))
        if file is not None:
            file.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([f"{to}/{x}" for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return spool(marked(pages, page_id, url, page).mapInArrow(run, "path string, records long"), "manifest", as_is=True)


_ROW = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, complete boolean"


def assembled(head: dict, block: bytes, total: int | None, payloads: bool) -> tuple:
    """The row of a record from its first segment's fields and its whole block."""
    kind = head["warc-type"]
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    complete = total is None or total == len(block)
    payload = None
    if complete:
        http, payload = http_payload(block)
        n = int(http.get("content-length", 0)) if kind == "revisit" else len(payload)
        if kind != "revisit":
            own = hashlib.sha256(payload).hexdigest()
            complete, digest = own == digest or not digest, own
    page = head.get("warc-page-id")
    refers = head.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    return (int(page) if page else None, head.get("warc-target-uri"), kind, int(refers) if refers else None, digest or None, n if complete else None, payload if payloads and kind != "revisit" else None, complete)


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit of the archives of a manifest.

    complete is false, and the payload null, where segments are missing, the total length is not
    that of the parts, or the payload is not that of the digest; without the first segment all
    else is null, too."""
    import json

    def scan(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                out: list[tuple] = []
                held = 0
                with system.open_input_stream(at, compression=None) as file:
                    for f, block in records(file):
                        if f["warc-type"] in ("response", "revisit") and "warc-segment-number" not in f:
                            row = assembled(f, block, None, payloads)
                            out.append((f["warc-record-id"], 0, None, None, None, row))
                        elif f["warc-type"] in ("response", "continuation"):
                            total = f.get("warc-segment-total-length")
                            out.append((f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), int(total) if total else None, json.dumps(f), block, None))
                        held += len(block) + 300
                        if held > 8 << 20:
                            yield parts(out)
                            out, held = [], 0
                yield parts(out)

    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]

    def rows(found):
        return [pa.array([None if r is None else r[i] for r in found], k) for i, k in enumerate(kinds)]

    def parts(out):
        first = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*first, *rows([x[5] for x in out])], names=["origin", "number", "total", "head", "block", *names])

    paths = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = manifest.select("path").repartition(paths, "path").mapInArrow(scan, f"origin string, number int, total long, head string, block binary, {_ROW}")
    whole = F.first(F.when(F.col("number") == 0, F.struct(*names)), ignorenulls=True).alias("row")
    groups = found.groupBy("origin").agg(whole, F.sort_array(F.collect_list(F.when(F.col("number") > 0, F.struct("number", "total", "head", "block")))).alias("segments"))

    def join(batches):
        for batch in batches:
            out = []
            for row, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if row is not None:
                    out.append(tuple(row[n] for n in names))
                    continue
                unique = {s["number"]: s for s in own}
                order = [unique[i] for i in sorted(unique)]
                total = order[-1]["total"]
                if order[0]["number"] != 1:  # its first record is lost, and with it what page it was
                    out.append((None, None, "response", None, None, None, None, False))
                    continue
                gap = [s["number"] for s in order] != list(range(1, len(order) + 1)) or total is None
                out.append(assembled(json.loads(order[0]["head"]), b"".join(s["block"] for s in order), -1 if gap else total, payloads))
            yield pa.RecordBatch.from_arrays(rows(out), names=names)

    return groups.select("row", "segments").mapInArrow(join, _ROW)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, from archives
    that were written and read back."""
    return read(write(pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, min(page_id) as first from p where strlen(h) >= 100 group by h)
select p.page_id, strlen(p.h)::bigint as payload_bytes, sha256(p.h) as payload_digest,
  case when g.first is not null and p.page_id is distinct from g.first then 'revisit' else 'response' end as record_type,
  case when p.page_id is distinct from g.first then g.first end as refers_to
from p left join g on g.h = p.h
"""
