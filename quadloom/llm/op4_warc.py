"""WARC archives as a Python data source.

Reader: the driver only lists files and packs them into partitions by size; a partition reads
record headers first, tests them against the pushed predicates and seeks over the block of a
record that is not wanted, so its payload is neither read nor decoded.  Writer: every task
writes whole files under a name of its own attempt, and the commit renames them into place, so
a repeated or speculative task leaves nothing behind.  File names carry the write they come from:
appending keeps the archives that are there, overwriting removes them once the new ones are in place.

Records are kept uncompressed so that a block can be skipped by its length; the payload in an
HTTP block is compressed by itself (``Content-Encoding: gzip``).

Edge cases: a NULL payload is empty; extra columns are not written; an empty table gives no
archives, and an empty folder no rows; equal page ids give separate records; header values are
percent-escaped where they hold line breaks or other control characters.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In,
                                    InputPartition, WriterCommitMessage)

from .common import scratch_path

SCHEMA = ("record_type string, page_id bigint, target_uri string, record_id string, refers_to string, "
          "payload_digest string, payload_bytes bigint, payload binary")
PLAIN = re.compile(r"[\x00-\x20\x7f%]")
PARTITION_BYTES = 128 << 20
#: Columns that can be tested on the header alone, with the header that holds them.
HEADERS = {"record_type": "WARC-Type", "page_id": "X-Page-Id", "target_uri": "WARC-Target-URI",
           "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path; a plain path is one that all executors share."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def escaped(value: str) -> str:
    return PLAIN.sub(lambda m: quote(m[0], safe=""), value)


def record_bytes(row: dict) -> bytes:
    """One WARC record.  A revisit carries the headers of its payload but no payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", escaped(row["target_uri"] or "")),
            ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
            ("X-Payload-Length", str(row["payload_bytes"]))]
    if row["page_id"] is not None:
        head.append(("X-Page-Id", str(row["page_id"])))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", row["refers_to"])]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += b"\r\n" if revisit else b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(payload, 3, mtime=0)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def read_headers(stream) -> dict[str, str] | None:
    """Headers of the next record, None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins here: {line[:40]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        key, _, value = line.decode().partition(":")
        found[key.strip()] = value.strip()
    return found


def decode_block(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    coded = re.search(rb"(?im)^content-encoding:\s*gzip\s*$", head.replace(b"\r", b""))
    return gzip.decompress(body) if coded and body else body


def column_values(head: dict[str, str]) -> dict:
    page, size = head.get("X-Page-Id"), head.get("X-Payload-Length")
    return {"record_type": head.get("WARC-Type"), "page_id": int(page) if page else None,
            "target_uri": unquote(head.get("WARC-Target-URI", "")), "record_id": head.get("WARC-Record-ID"),
            "refers_to": head.get("WARC-Refers-To"),
            "payload_digest": (head.get("WARC-Payload-Digest") or "").removeprefix("sha1:") or None,
            "payload_bytes": int(size) if size else None}


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.columns = [f.name for f in schema.fields]
        self.limit = int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, frozenset]] = []
        types = options.get("types")
        if types:
            self.wanted.append(("record_type", frozenset(types.split(","))))
        self.payload = options.get("payload", "true") == "true"

    def pushFilters(self, filters):
        for f in filters:
            names = getattr(f, "attribute", ())
            if len(names) == 1 and names[0] in HEADERS and isinstance(f, (EqualTo, In)):
                self.wanted.append((names[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self):
        files, where = filesystem(self.path)
        listed = sorted(((i.size, i.path) for i in files.get_file_info(pafs.FileSelector(where, recursive=True))
                         if i.is_file and i.path.endswith(".warc")), reverse=True)
        out: list[Files] = []
        room = 0
        for size, path in listed:
            if not out or room < size:
                out.append(Files([]))
                room = self.limit
            out[-1].paths.append(path)
            room -= size
        return out or [Files([])]

    def read(self, partition):
        files = filesystem(self.path)[0]
        for path in partition.paths:
            with files.open_input_file(path) as stream:
                yield from self._records(io.BufferedReader(stream, 1 << 18))

    def _records(self, stream):
        while (head := read_headers(stream)) is not None:
            length = int(head["Content-Length"])
            row = column_values(head)
            if any(row[name] not in values for name, values in self.wanted):
                stream.seek(length, 1)
                continue
            if self.payload and head.get("WARC-Type") == "response":
                row["payload"] = decode_block(stream.read(length))
            else:
                stream.seek(length, 1)
            yield tuple(row.get(c) for c in self.columns)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.limit = int(options.get("file_bytes", PARTITION_BYTES))
        self.overwrite = overwrite
        self.name = uuid.uuid4().hex  # of this write, the same in all its tasks

    def write(self, iterator):
        from pyspark import TaskContext

        files, where = filesystem(self.path)
        part = TaskContext.get().partitionId()
        attempt, moves, stream, room = uuid.uuid4().hex, [], None, 0
        drafts = f"{where}/_attempts/{self.name}"
        files.create_dir(drafts, recursive=True)
        for batch in iterator:
            for row in batch.to_pylist():
                data = record_bytes(row)
                if stream is None or room < len(data):
                    if stream:
                        stream.close()
                    draft = f"{drafts}/{attempt}-{len(moves)}"
                    moves.append((draft, f"{where}/part-{self.name}-{part:06d}-{len(moves):04d}.warc"))
                    stream, room = files.open_output_stream(draft), self.limit
                stream.write(data)
                room -= len(data)
        if stream:
            stream.close()
        return Written(moves)

    def commit(self, messages):
        files, where = filesystem(self.path)
        old = pafs.FileSelector(where, recursive=True, allow_not_found=True)
        old = [i.path for i in files.get_file_info(old) if i.is_file and i.path.endswith(".warc")] if self.overwrite else []
        for message in messages:
            for draft, final in message.moves if message else ():
                files.move(draft, final)
        for path in old:
            files.delete_file(path)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        """Remove the drafts of this write, those of dead attempts included."""
        files, where = filesystem(self.path)
        drafts = f"{where}/_attempts/{self.name}"
        if files.get_file_info(drafts).type == pafs.FileType.Directory:
            files.delete_dir(drafts)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; option ``path``.

    Reading: ``types`` keeps record types, ``payload=false`` leaves all payloads out,
    ``partition_bytes`` packs files; equality and IN filters on header columns are pushed down
    where ``spark.sql.python.filterPushdown.enabled`` is on.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark hand it filters."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_rows(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Records for ``pages(page_id, url, html)``: of equal payloads of at least ``least``
    bytes the one with the largest page id is the response, the others revisit it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"),
                             "payload_bytes": F.length("payload").cast("bigint")})
    # Only digests that occur twice matter: a small table, joined without moving the others'
    # payloads when it is small, and split by adaptive execution when a digest is hot.
    twice = (rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
             .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = rows.join(twice, "payload_digest", "left")
    identifier = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri",
        F.coalesce(identifier(F.col("page_id")), F.lit("<urn:page:none>")).alias("record_id"),
        F.when(revisit, identifier(F.col("first"))).alias("refers_to"),
        "payload_digest", "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, mode: str = "append") -> None:
    """Write the records of ``pages`` to ``path``; ``mode`` is append or overwrite."""
    register(pages.sparkSession)
    archive_rows(pages, least).write.format("warc").option("path", path).mode(mode).save()


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).options(**options).load()


def warc_digest(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of the registered query, from archives written and read back.  Lengths and
    digests of responses are those of the decoded payload."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    rows = read_archives(spark, path)
    own = F.col("payload").isNotNull()
    return rows.select(
        "page_id", F.when(own, F.length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type",
        F.regexp_extract("refers_to", r"(-?\d+)>$", 1).try_cast("bigint").alias("refers_to"))
