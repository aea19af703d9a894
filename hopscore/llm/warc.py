"""WARC archives as a PySpark data source, and archives of pages in which repeated payloads are revisit records.

``spark.read.format("warc").load(folder)`` plans one partition for each file. Comparisons of the record type and of header columns with
constants are pushed to the reader: it parses the headers of a record first, and a record that fails is skipped, by a seek where
its gzip member names its own length. With ``option("payload", "false")`` no payload is decoded at all. The writer is the
same format: one or more files per task, and a list of the files of the tasks that ended, which alone are read back.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from hopscore.llm.storage import file_system, saved, shared_folder

LEAST_REVISIT = 100  # bytes; smaller payloads are always written in full
FILE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
#: A commit leaves a list of its files; files of the writer that no list names are of tasks that failed. Other archives are read as they are.
OWN_LIST, OWN_FILE = re.compile(r"(^|/)_files-[0-9a-f]{32}\.json$"), re.compile(r"(^|/)part-[0-9a-f]{32}\.warc\.gz$")
READ = 1 << 16

# Names of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{name} string" for name in HEADERS) + ", payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(headers: dict[str, str | None], payload: bytes | None) -> bytes:
    """A record as one gzip member, whose extra field holds the member's length (subfield ``sl``, as in annex D of the format)."""
    block = b"" if payload is None else HTTP % len(payload) + payload
    lines = [f"{name}: {value}\r\n" for name, value in headers.items() if value is not None]
    text = VERSION + "".join(lines).encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    head = struct.pack("<4BI2BH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, len(body) + 32, len(text))
    return head + body + struct.pack("<II", zlib.crc32(text), len(text) & 0xFFFFFFFF)


class _Records:
    """Steps through the gzip members of a file; each gives its headers first and its block only if it is asked for."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def __iter__(self) -> Iterator[_Records]:
        while True:
            self.stream.seek(self.at)
            raw = self.stream.read(READ)
            if not raw:
                return
            self.length = None
            if len(raw) >= 24 and raw[3] & 4 and raw[12:14] == b"sl":
                self.length = struct.unpack_from("<I", raw, 16)[0]
            self.inflate, self.fed = zlib.decompressobj(31), len(raw)
            self.text = self.inflate.decompress(raw)
            while b"\r\n\r\n" not in self.text and not self.inflate.eof:
                self._more()
            head, _, self.text = self.text.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {self.at}")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            yield self
            if self.length is None:  # the end of the member is only found by reading through it
                while not self.inflate.eof:
                    self.text = b""
                    self._more()
                self.length = self.fed - len(self.inflate.unused_data)
            self.at += self.length

    def _more(self) -> None:
        raw = self.stream.read(READ)
        if not raw:
            raise ValueError(f"the record at byte {self.at} is cut off")
        self.fed += len(raw)
        self.text += self.inflate.decompress(raw)

    def block(self) -> bytes:
        parts, size, need = [self.text], len(self.text), int(self.headers.get("content-length", "0"))
        while size < need:
            self.text = b""
            self._more()
            parts.append(self.text)
            size += len(self.text)
        return b"".join(parts)[:need]


@dataclass
class File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool, schema):
        self.folder, self.payload, self.names = folder, payload, [field.name for field in schema.fields]
        self.tests: list[tuple[str, str, Sequence]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else ""
            if name in HEADERS and isinstance(one, EqualTo):
                self.tests.append((name, "in", [one.value]))
            elif name in HEADERS and isinstance(one, In):
                self.tests.append((name, "in", list(one.value)))
            elif name in HEADERS and isinstance(one, StringStartsWith):
                self.tests.append((name, "starts", one.value))
            else:
                yield one

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, path = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        prefix = self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else ""
        files = [x.path for x in found if x.type == fs.FileType.File]
        lists = [x for x in files if OWN_LIST.search(x)]
        listed = set()
        for one in lists:
            with system.open_input_file(one) as stream:
                listed.update(x.rpartition("/")[2] for x in json.loads(stream.read()))
        wanted = [x for x in files if x.endswith(".warc.gz") and (not lists or not OWN_FILE.search(x) or x.rpartition("/")[2] in listed)]
        return [File(prefix + x) for x in wanted]

    def _wanted(self, row: dict[str, str | None]) -> bool:
        for name, kind, value in self.tests:
            found = row[name]
            if found is None or (found not in value if kind == "in" else not found.startswith(value)):
                return False
        return True

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        types = [pa.binary() if name == "payload" else pa.string() for name in self.names]
        system, path = file_system(partition.path)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            arrays = [pa.array([row.get(n) for row in rows], t) for n, t in zip(self.names, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=self.names)

        with system.open_input_file(path) as stream:
            rows, size = [], 0
            for one in _Records(stream):
                row = {name: one.headers.get(header.lower()) for name, header in HEADERS.items()}
                if not self._wanted(row):
                    continue
                if self.payload and one.headers.get("content-length", "0") != "0":
                    block = one.block()
                    http = block.startswith(b"HTTP/")
                    row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
                    size += len(block)
                rows.append(row)
                if size > BATCH_BYTES or len(rows) >= 5_000:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with header columns and ``payload``; ``payload`` null gives a record without a block."""

    def __init__(self, folder: str, file_bytes: int):
        self.folder, self.file_bytes = folder, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, stream, size = [], None, 0
        for batch in iterator:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                if stream is None or size > self.file_bytes:
                    if stream is not None:
                        stream.close()
                    files.append(f"{self.folder}/part-{uuid.uuid4().hex}.warc.gz")
                    system, path = file_system(files[-1])
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    stream, size = system.open_output_stream(path, compression=None), 0
                headers = {h: columns[n][i].as_py() if n in columns else None for n, h in HEADERS.items()}
                headers |= {"WARC-Date": "1970-01-01T00:00:00Z"}
                if headers["WARC-Type"] == "revisit":
                    headers["WARC-Profile"] = PROFILE
                raw = record(headers, columns["payload"][i].as_py())
                stream.write(raw)
                size += len(raw)
        if stream is not None:
            stream.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/_files-{uuid.uuid4().hex}.json") as stream:
            stream.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for name in [x for m in messages if m for x in m.files]:
            system, path = file_system(name)
            system.delete_file(path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _urn(column: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The records of pages: of equal payloads of ``least`` bytes or more, all but the smallest page_id are revisits.

    A null html is an empty payload. Rows that repeat the smallest page_id are all responses. A null page_id is larger than all
    others; where it is the only one, all its rows are responses.
    """
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("target_uri"), html.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    repeated = (
        rows.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first")
    )
    joined = rows.join(saved(repeated, "warc-repeated"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _urn(F.col("page_id")).alias("record_id"),
        F.regexp_replace("target_uri", r"[\r\n]", " ").alias("target_uri"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.when(revisit, _urn(F.col("first"))).alias("refers_to"),
        F.col("size").cast("string").alias("payload_length"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _page(column: str, kind: str) -> Column:
    number = F.regexp_extract(column, r"^<urn:page:(.*)>$", 1)
    return F.when(number != "null", number).cast(kind)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives of all pages to a shared folder and read them back, revisits without decoding any payload.

    The digest and length of a response are those of the payload read, and must agree with its headers.
    """
    register(spark)
    folder, kind = shared_folder(spark, "warc"), pages.schema["page_id"].dataType.simpleString()
    page_records(pages).write.format("warc").mode("append").save(folder)
    full = spark.read.format("warc").load(folder).where("record_type = 'response'")
    digest, size = F.sha2(F.coalesce("payload", F.lit(b"")), 256), F.coalesce(F.octet_length("payload"), F.lit(0))
    same = (F.concat(F.lit("sha256:"), digest) == F.col("payload_digest")) & (size.cast("string") == F.col("payload_length"))
    full = full.select(
        _page("record_id", kind).alias("page_id"),
        size.cast("long").alias("payload_bytes"),
        F.when(same, digest).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_digest"),
        "record_type",
        F.lit(None).cast(kind).alias("refers_to"),
    )
    short = spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'revisit'")
    short = short.select(
        _page("record_id", kind).alias("page_id"),
        F.col("payload_length").cast("long").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        _page("refers_to", kind).alias("refers_to"),
    )
    return full.unionByName(short)
