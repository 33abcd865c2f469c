"""WARC archives: one gzip member for each record, and a sequential reader.

Writing: pages with equal payloads of at least ``min_revisit`` bytes become one response, that with the largest id, and
revisits of it; every task writes archives of bounded size to the shared folder, under names of its own, and a manifest lists those of
tasks that succeeded. Payloads are equal by SHA-256 and length. Reading: an archive's bytes go through an incremental inflater piece by piece; each member is one record, framed by
Content-Length, whose stated block and payload digests must hold; records of other writers and of other types are read too.

Defined results: null html is an empty payload; a null id is written as the word null and is never the largest; rows tied at the
largest id are all responses; a null url is empty; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import materialise, new_path
from docloom.shipping import ship

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(s: str | None) -> str:
    return " ".join((s or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, before compression. A revisit's block ends with the HTTP head, which has the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a file object, one at a time."""
    z, out, began = zlib.decompressobj(31), [], False
    data = stream.read(PIECE)
    while data:
        began = True
        out.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out, began = zlib.decompressobj(31), [], False
        if not data:
            data = stream.read(PIECE)
    if began:
        raise ValueError("the archive ends within a record")


def _digest_holds(stated: str | None, data: bytes) -> bool:
    """Of sha1 and sha256 in base 32 or hexadecimal; a digest that is not stated, or of another kind, holds."""
    kind, _, value = (stated or "").strip().partition(":")
    if kind.lower() not in ("sha1", "sha256"):
        return True
    raw = hashlib.new(kind.lower(), data).digest()
    return value.lower() in (raw.hex(), base64.b32encode(raw).decode().rstrip("=").lower())


def _page(record_id: str | None) -> int | None:
    """The page that this module's writer put into a record's id; ids of other writers name none."""
    hit = re.fullmatch("<urn:page:(-?[0-9]+)>", record_id or "")
    return int(hit[1]) if hit else None


def parse(data: bytes) -> dict:
    """The fields of a record after framing and the stated digests are verified; payload is None for a revisit.

    Only type and Content-Length are needed: warcinfo, request and other records are read as well, with their block as payload unless it is HTTP.
    """
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    name, n = f.get("warc-record-id"), int(f["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{name}: Content-Length does not frame the block")
    if not _digest_holds(f.get("warc-block-digest"), block):
        raise ValueError(f"{name}: block digest")
    revisit, payload, length = f["warc-type"] == "revisit", block, None
    if "application/http" in f.get("content-type", "") or block.startswith(b"HTTP/") or f["warc-type"] == "request":
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])
        length = next((int(v) for k, _, v in stated if k.strip().lower() == "content-length" and v.strip().isdigit()), None)
    if not revisit:
        if length is not None and f["warc-type"] == "response" and len(payload) != length or not _digest_holds(f.get("warc-payload-digest"), payload):
            raise ValueError(f"{name}: payload digest")
        digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
    else:
        kind, _, value = f.get("warc-payload-digest", "").partition(":")
        digest = base64.b32decode(value.upper()).hex() if kind == "sha1" and len(value) == 32 else value.lower() or None
    return {
        "page_id": _page(name),
        "url": f.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": f["warc-type"],
        "refers_to": _page(f.get("warc-refers-to")),
        "payload": None if revisit else payload,
    }


def _store(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archives in folder, a URI that all executors can write to; returns the manifest: path, records."""
    ship(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("sha", F.sha2("html", 256))
    size = F.octet_length("html")
    small = pages.select(F.col(id_col).cast("long").alias("id"), html.alias("html")).select("id", F.sha2("html", 256).alias("sha"), size.alias("n")).filter(F.col("n") >= min_revisit)
    # Only payloads that occur more than once are in the table; Spark knows its written size.
    again = materialise(small.groupBy("sha", "n").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "again")
    p = p.withColumn("n", size).join(again, ["sha", "n"], "left").select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        out, path, held, records, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, records))
                out = None

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, held, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)  # members are compressed one by one
                data = member(record(page_id, url, payload, refers_to))
                out.write(data)
                held, records = held + len(data), records + 1
                if held >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return materialise(p.mapInArrow(write, "path string, records long"), "manifest")


def read_warc(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archives that the manifest lists."""
    fields = [("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long")]
    fields += [("payload", pa.binary(), "binary")] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(folder)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t, _ in fields], [k for k, _, _ in fields])
        for b in batches:
            for path, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data))
                        seen, held = seen + 1, held + len(data)
                        if held >= 16 << 20 or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{path}: {seen} records, the manifest has {records}")
                yield batch(rows)

    ship(manifest.sparkSession)
    archives = max(1, manifest.count())
    return manifest.repartition(archives).mapInArrow(read, ", ".join(f"{k} {t}" for k, _, t in fields))


def warc_digest(pages: DataFrame) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = "file://" + folder
    manifest = write_warc(pages, folder)
    return read_warc(manifest, folder, payload=False).drop("url")
