"""WARC archives as a PySpark Python data source (format ``warc``).

Writing: each task writes files of gzip members, one per record, and reports those it finished;
the commit lists them in ``_manifest``, so files of failed or repeated attempts are never read.
Reading: the plan has a partition per listed file. Predicates on the record type and on headers
are pushed down. A record's headers are inflated first; when they fail a predicate, or payloads
are not asked for, the rest of the member is skipped by the length in its gzip extra field, not
inflated.

Paths go through ``pyarrow.fs`` (file, s3, gs, hdfs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, Not, WriterCommitMessage

SCHEMA = ("record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
          "payload_bytes long, http_header string, payload binary")
#: Column of each header that predicates can name.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
ROLL_BYTES = 64 << 20
HEAD = 2048


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, at.rstrip("/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records

def member(block: bytes, level: int = 4) -> bytes:
    """One gzip member whose extra field ``sl`` holds its compressed and plain length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(block) + z.flush()
    total = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(block) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """A response with its payload, or a revisit with the payload's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def _header(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if sep:
            out[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


def _value(header: dict[str, str], column: str) -> str | None:
    v = header.get(HEADERS[column].lower())
    if v is None:
        return None
    if column == "payload_digest":
        return v.removeprefix("sha1:")
    return v[1:-1] if v[:1] == "<" and v[-1:] == ">" else v


class _Reader:
    """Members of one file, in order."""

    def __init__(self, stream):
        self.stream, self.buf = stream, b""

    def fill(self, n: int) -> bool:
        while len(self.buf) < n:
            more = self.stream.read(max(1 << 20, n - len(self.buf)))
            if not more:
                return False
            self.buf += more
        return True

    def records(self, wanted, payloads: bool):
        """(header, HTTP header, payload or None, payload length) of the records that ``wanted`` takes."""
        at = 0
        while True:
            if len(self.buf) - at < 64 + HEAD:
                self.buf, at = self.buf[at:], 0
                self.fill(64 + HEAD)
            if len(self.buf) - at < 18:
                if len(self.buf) - at:
                    raise ValueError("truncated WARC member")
                return
            if self.buf[at:at + 4] != b"\x1f\x8b\x08\x04" or self.buf[at + 12:at + 14] != b"sl":
                raise ValueError("a member without its length in the gzip header")
            total, plain = struct.unpack_from("<II", self.buf, at + 16)
            z = zlib.decompressobj(-15)
            start = at + 24
            end = at + total - 8
            raw = z.decompress(self.buf[start:min(end, len(self.buf))], HEAD)
            fed = min(end, len(self.buf)) - start            # bytes of the body given to z so far
            while (cut := raw.find(b"\r\n\r\n")) < 0 and len(raw) < plain:
                raw += self._more(z, at, start, end, fed, HEAD)
                fed = max(fed, min(end, len(self.buf)) - start)
            header = _header(raw[:cut])
            if wanted(header):
                size = int(header["content-length"])
                if payloads or header["warc-type"] != "revisit":
                    need = cut + 4 + size if payloads else cut + 4 + min(size, HEAD)
                else:
                    need = cut + 4 + size
                parts, have = [raw], len(raw)
                while have < need:
                    part = self._more(z, at, start, end, fed, need - have)
                    fed = max(fed, min(end, len(self.buf)) - start)
                    parts.append(part)
                    have += len(part)
                block = b"".join(parts)[cut + 4:need]
                http_end = block.find(b"\r\n\r\n") + 4
                if http_end < 4:
                    raise ValueError("a record whose HTTP header is missing or too long")
                yield header, block[:http_end], block[http_end:] if payloads else None, size - http_end
            if not self.fill(at + total) and len(self.buf) < at + total:
                raise ValueError("truncated WARC member")
            at += total
            if at > 8 << 20:
                self.buf, at = self.buf[at:], 0

    def _more(self, z, at, start, end, fed, most):
        if z.unconsumed_tail:
            return z.decompress(z.unconsumed_tail, most)
        if not self.fill(min(end, start + fed + (1 << 16))) and len(self.buf) <= start + fed:
            raise ValueError("truncated WARC member")
        return z.decompress(self.buf[start + fed:min(end, len(self.buf))], most)


# ---------------------------------------------------------------- data source

@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class _WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() == "true"
        self.push = options.get("pushdown", "false").lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            if not self.push:
                yield f
                continue
            g, no = (f.child, True) if isinstance(f, Not) else (f, False)
            column = g.attribute[0] if getattr(g, "attribute", None) and len(g.attribute) == 1 else None
            if column in HEADERS and isinstance(g, (EqualTo, In)) and (column == "record_type" or not no):
                self.tests.append((column, "out" if no else "in", (g.value,) if isinstance(g, EqualTo) else tuple(g.value)))
            elif column in HEADERS and isinstance(g, (IsNull, IsNotNull)) and not no:
                self.tests.append((column, "null" if isinstance(g, IsNull) else "set", ()))
            else:
                yield f

    def wanted(self, header: dict[str, str]) -> bool:
        for column, how, values in self.tests:
            v = _value(header, column)
            if not {"in": v in values and v is not None, "out": v is not None and v not in values, "null": v is None, "set": v is not None}[how]:
                return False
        return True

    def partitions(self):
        fs, at = _fs(self.path)
        with fs.open_input_stream(f"{at}/_manifest") as f:
            return [_File(x) for x in json.loads(f.read())]

    def read(self, part):
        if part is None:                                     # an archive without files
            return
        fs, at = _fs(self.path)
        rows = {k: [] for k in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload_bytes", "http_header", "payload")}
        types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))
        held = 0
        with fs.open_input_stream(f"{at}/{part.path}", compression=None) as stream:
            for header, http, payload, size in _Reader(stream).records(self.wanted, self.payloads):
                for k in HEADERS:
                    rows[k].append(_value(header, k))
                if header["warc-type"] == "revisit":         # the payload's length stands in its HTTP header
                    size, payload = int(_header(http).get("content-length", 0)), None
                rows["payload_bytes"].append(size)
                rows["http_header"].append(http.decode("utf-8", "replace"))
                rows["payload"].append(payload)
                held += len(payload or b"") + 500
                if held > 4 << 20:
                    yield batch()
                    rows, held = {k: [] for k in rows}, 0
        if rows["record_type"]:
            yield batch()


@dataclass
class _Wrote(WriterCommitMessage):
    files: list


class _WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, batches):
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        files, out, size = [], None, 0
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)) for k in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload")]
            for row in zip(*(col for col in cols)):
                kind, rid, uri, digest, refers, payload = (v.as_py() for v in row)
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{at}/{files[-1]}", compression=None), 0
                data = member(record(kind, rid, uri, digest, refers, payload or b""))
                out.write(data)
                size += len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Wrote(files)

    def commit(self, messages):
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/_manifest") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages):
        fs, at = _fs(self.path)
        for m in messages:
            for x in m.files if m is not None else ():
                fs.delete_file(f"{at}/{x}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _WarcReader(self.options)

    def writer(self, schema, overwrite):
        return _WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True, where: str | None = None) -> DataFrame:
    """The records of an archive; ``payload=False`` inflates headers only.

    Predicates are pushed down when given as ``where``. Spark keeps the predicates pushed last
    with a loaded relation and applies them to later plans over it that push none, so a relation
    read without ``where`` takes none, and one with ``where`` pushes its own in every plan."""
    register(spark)
    df = (spark.read.format("warc").option("payload", str(payload).lower())
          .option("pushdown", str(where is not None).lower()).load(path))
    return df if where is None else df.where(where)


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows of record_type, record_id, target_uri, payload_digest, refers_to, payload."""
    register(records.sparkSession)
    records.select("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload").write.format("warc").mode("append").save(path)


# ---------------------------------------------------------------- pages

_URN = "urn:page:"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Records for pages: of equal payloads (by SHA-1) of ``min_bytes`` or more the smallest id is
    the response, the others revisit it; smaller payloads are all responses. Null html is an
    empty payload; a null id comes after all others; repeated rows of a smallest id are all
    responses."""
    from pyspark.sql import types as T

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("target_uri"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    big = F.octet_length("payload") >= min_bytes
    least = rows.where(big).groupBy("sha").agg(F.min("_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("sha", "least")
    j = rows.join(least, "sha", "left")
    revisit = big & F.col("least").isNotNull() & ~F.col("_id").eqNullSafe(F.col("least"))
    digest = _base32(F.unhex("sha"))
    return j.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.concat(F.lit(_URN), F.coalesce(F.col("_id").cast("string"), F.lit("null"))).alias("record_id"), "target_uri",
                    digest.alias("payload_digest"),
                    F.when(revisit, F.concat(F.lit(_URN), F.col("least").cast("string"))).cast(T.StringType()).alias("refers_to"), "payload")


def _base32(b):
    """Upper-case base32 of 20 bytes: four groups of five bytes, eight digits each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digits = []
    for g in range(4):
        v = F.conv(F.hex(F.substring(b, 5 * g + 1, 5)), 16, 10).cast("long")
        digits += [F.substring(alphabet, (F.shiftright(v, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*digits)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per page to ``path`` and read the archives back with their payloads."""
    write_warc(page_records(pages, id_col, url_col, html_col, min_bytes), path)
    return read_warc(pages.sparkSession, path)


def page_digest(archive: DataFrame, id_type: str = "long") -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to. The digest of a
    response is computed from the payload that was read; a revisit has its header's."""
    key = lambda k: F.expr(f"try_cast(substring({k}, {len(_URN) + 1}) as {id_type})")
    return archive.select(key("record_id").alias("page_id"), "payload_bytes",
                          F.when(F.col("record_type") == "response", _base32(F.unhex(F.sha1("payload")))).otherwise(F.col("payload_digest")).alias("payload_digest"),
                          "record_type", key("refers_to").alias("refers_to"))
