"""WARC archives as a Spark data source named `warc`.

Written records are gzip members of their own, whose extra field `sl` says how long the member is, compressed and not.
A reader plans ranges of members from the index that each writing job leaves beside its archives (whole files where there is none), inflates a
member's headers first, tests record type and header predicates on them, and leaps over members that it doesn't want;
payloads are inflated only if the schema asks for them. Archives of other writers (members without `sl`, or not
compressed) are read too.
"""

from __future__ import annotations

import base64
import binascii
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from veriloom.llm._base import importable, new_path, text_of, written

#: Payloads from this size on are written once; later ones with equal bytes revisit them.
REVISIT_BYTES = 1000
#: Compressed bytes between index entries, and of a planned partition.
STRIDE = 2 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, page_id long, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Revisits up to this many are broadcast to the rows that they mark.
BROADCAST_ROWS = 1_000_000


def _files(path: str):
    """(filesystem, path in it) of a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---- records


def member(record: bytes, level: int = 4) -> bytes:
    """A gzip member with the skip lengths in its extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(page_id: int | None, uri: str, kind: str, refers_to: int | None, digest_hex: str, payload: bytes, full_bytes: int) -> bytes:
    """One WARC/1.1 record around an HTTP response; a revisit has its headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{k}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if uri:
        lines.append(f"WARC-Target-URI: {''.join(uri.split())}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["WARC-Payload-Digest: sha1:" + base64.b32encode(binascii.unhexlify(digest_hex)).decode(), "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + line.strip()
        elif ":" in line:
            key, _, value = line.partition(":")
            last = key.strip().lower()
            out[last] = value.strip()
    return out


def header_row(h: dict[str, str]) -> dict:
    number = lambda k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
    digest = h.get("warc-payload-digest", "")
    if digest.startswith("sha1:"):
        digest = digest[5:]
        digest = base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()
    return {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "page_id": number("x-page-id"), "target_uri": h.get("warc-target-uri"), "refers_to": number("x-refers-to-page-id"), "payload_digest": digest or None}


def http_split(block: bytes, content_type: str) -> tuple[int | None, bytes]:
    """(the Content-Length that the HTTP headers state, the body) of an HTTP block; other blocks are all body."""
    if not content_type.startswith("application/http"):
        return None, block
    head, _, body = block.partition(b"\r\n\r\n")
    size = parse_headers(head).get("content-length", "")
    return (int(size) if size.isdigit() else None), body


class Members:
    """Records of one archive from a byte on, headers first."""

    def __init__(self, stream, start: int, end: int) -> None:
        self.stream, self.at, self.end = stream, start, end
        self.inflated = 0  # bytes inflated so far

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        """(headers, a function that gives the block)."""
        while self.at < self.end:
            self.stream.seek(self.at)
            magic = self.stream.read(12)
            if len(magic) < 12:
                return
            if magic[:2] == b"\x1f\x8b":
                yield from self._zipped(magic)
            else:
                yield from self._plain()

    def _zipped(self, fixed: bytes) -> Iterator:
        begin, size = self.at, None
        head = 10
        if fixed[3] & 4:
            extra_size = struct.unpack("<H", fixed[10:12])[0]
            extra = self.stream.read(extra_size)
            head = 12 + extra_size
            k = 0
            while k + 4 <= len(extra):
                n = struct.unpack("<H", extra[k + 2 : k + 4])[0]
                if extra[k : k + 2] == b"sl" and n >= 8:
                    size = struct.unpack("<I", extra[k + 4 : k + 8])[0]
                k += 4 + n
        if fixed[3] & ~4:  # names, comments: let zlib read the whole header
            head = 0
        inflate = zlib.decompressobj(-15 if head else 31)
        self.stream.seek(begin + head)
        data, read = b"", 0
        pending = b""
        while b"\r\n\r\n" not in data and not inflate.eof:
            chunk = pending or self.stream.read(4096)
            if not chunk:
                break
            read += 0 if pending else len(chunk)
            data += inflate.decompress(chunk, 2048)
            pending = inflate.unconsumed_tail
        top, _, rest = data.partition(b"\r\n\r\n")
        self.inflated += len(data)
        headers = parse_headers(top)
        length = int(headers.get("content-length", 0))
        state = {"rest": rest, "pending": pending, "read": read}

        def finish() -> None:
            parts = [state["rest"]]
            while not inflate.eof:
                chunk = state["pending"] or self.stream.read(1 << 16)
                if not chunk:
                    break
                state["read"] += 0 if state["pending"] else len(chunk)
                parts.append(inflate.decompress(chunk))
                self.inflated += len(parts[-1])
                state["pending"] = b""
            state["rest"] = b"".join(parts)

        def block() -> bytes:
            finish()
            return state["rest"][:length]

        yield headers, block
        if size is None:  # the member's end shows only when it is inflated
            finish()
            size = head + state["read"] - len(inflate.unused_data) + (8 if head else 0)
        self.at = begin + size

    def _plain(self) -> Iterator:
        self.stream.seek(self.at)
        data = b""
        while b"\r\n\r\n" not in data:
            chunk = self.stream.read(4096)
            if not chunk:
                self.at = self.end
                return
            data += chunk
        top = data.partition(b"\r\n\r\n")[0]
        headers = parse_headers(top)
        begin, length = self.at + len(top) + 4, int(headers.get("content-length", 0))

        def block() -> bytes:
            self.stream.seek(begin)
            self.inflated += length
            return self.stream.read(length)

        yield headers, block
        self.at = begin + length + 4


# ---- the data source


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


@dataclass
class Written(WriterCommitMessage):
    """Where the ranges of each archive begin."""

    files: dict[str, list[int]] = field(default_factory=dict)


class WarcReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.schema, self.path = schema, options["path"]
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        """Takes predicates on record type and header columns; gives the others back."""
        for f in filters:
            kind = type(f).__name__
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if column in ("payload", "payload_bytes", None) or kind not in ("EqualTo", "In", "IsNotNull", "IsNull", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "StringStartsWith"):
                yield f
            else:
                self.tests.append((column, kind, value))

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            x = row.get(column)
            if kind == "IsNull":
                ok = x is None
            elif x is None:
                ok = False
            elif kind == "EqualTo":
                ok = x == value
            elif kind == "In":
                ok = x in value
            elif kind == "StringStartsWith":
                ok = x.startswith(value)
            else:
                ok = {"IsNotNull": True, "GreaterThan": value is not None and x > value, "GreaterThanOrEqual": value is not None and x >= value, "LessThan": value is not None and x < value, "LessThanOrEqual": value is not None and x <= value}[kind]
            if not ok:
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        files, root = _files(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root))
        out = []
        index: dict[str, list[int]] = {}
        for x in found:  # one index for each job that wrote here
            if x.base_name.startswith("index-") and x.base_name.endswith(".json"):
                with files.open_input_stream(x.path) as f:
                    index |= json.loads(f.read())
        for x in sorted(found, key=lambda x: x.path):
            if x.type != fs.FileType.File or not x.base_name.endswith((".warc", ".warc.gz")) or x.base_name.startswith((".", "_")) or not x.size:
                continue
            cuts = index.get(x.base_name, [0])
            out += [Range(x.path, a, b) for a, b in zip(cuts, [*cuts[1:], x.size], strict=True)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        names = self.schema.names
        sized, bodies = "payload_bytes" in names, "payload" in names
        kind = self._arrow()
        files, _ = _files(self.path)
        rows: list[dict] = []
        held = 0
        with files.open_input_file(partition.path) as f:
            for headers, block in Members(f, partition.start, partition.end):
                row = header_row(headers)
                if not self._wanted(row):
                    continue
                if sized or bodies:
                    stated, body = http_split(block(), headers.get("content-type", ""))
                    row["payload"] = body if row["record_type"] != "revisit" else None
                    row["payload_bytes"] = stated if row["record_type"] == "revisit" else len(body)
                    held += len(body) if bodies else 0
                rows.append({k: row.get(k) for k in names})
                if len(rows) >= 4096 or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    def _arrow(self) -> pa.Schema:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in self.schema.fields])


class WarcWriter(DataSourceArrowWriter):
    """Each task writes archives under a hidden name; the commit gives them their names."""

    def __init__(self, schema, options) -> None:
        self.schema, self.path, self.most = schema, options["path"], int(options.get("maxbytes", 256 << 20))

    def write(self, iterator):
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        done = Written({})
        out, name, cuts, at = None, "", [], 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.files[name] = cuts
                out = None

        for batch in iterator:
            rows = batch.to_pylist()
            for r in rows:
                if out is not None and at >= self.most:
                    close()
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, cuts, at = files.open_output_stream(f"{root}/.{name}", compression=None), [0], 0
                payload = r["payload"] or b""
                body = member(record(r["page_id"], r["target_uri"] or "", r["record_type"], r["refers_to"], r["payload_digest"], payload, r["payload_bytes"]))
                if at - cuts[-1] >= STRIDE:
                    cuts.append(at)
                out.write(body)
                at += len(body)
        close()
        return done

    def commit(self, messages):
        files, root = _files(self.path)
        found = {name: cuts for m in messages if m for name, cuts in m.files.items()}
        if found:
            with files.open_output_stream(f"{root}/index-{uuid.uuid4().hex}.json") as f:
                f.write(json.dumps(found).encode())
        for name in found:
            files.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages):
        files, root = _files(self.path)
        for m in messages:
            for name in m.files if m else ():
                if files.get_file_info(f"{root}/.{name}").is_file:
                    files.delete_file(f"{root}/.{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only added to: write in mode append")
        return WarcWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known; the classes travel by value, so workers need no import path."""
    import sys

    from pyspark import cloudpickle

    importable(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Rows to write: of equal payloads of `least` bytes or more, that with the largest id is the response, the others revisit it.

    Payload: the html in UTF-8, null as empty. Equal payloads without any id are all responses; rows that repeat the
    largest id are responses too.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), F.encode(text_of(html_col), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    keyed = F.when(F.col("payload_bytes") >= least, F.sha2("payload", 256))
    last = rows.select("page_id", keyed.alias("same")).where("same is not null").groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").drop("n")
    last = written(last, "revisited")
    if last.count() <= BROADCAST_ROWS:
        last = F.broadcast(last)
    joined = rows.withColumn("key", keyed).join(last, F.col("key") == F.col("same"), "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.lit(None).cast("string").alias("record_id"), "page_id", "target_uri",
        F.when(again, F.col("last")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> None:
    register(pages.sparkSession)
    mark_revisits(pages, id_col, url_col, html_col, least).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of the archives under a path; without payload and payload_bytes in `columns`, no payload is inflated."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def archive_report(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of the pages.

    Responses give the size and SHA-1 of the payload that was read; revisits those of their headers. One row per
    input row; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path)
    full = read(spark, path, "record_type string, page_id long, payload binary").where("record_type = 'response'")
    full = full.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read(spark, path, "record_type string, page_id long, refers_to long, payload_digest string, payload_bytes long").where("record_type = 'revisit'")
    return full.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
