"""WARC: writing archives with Spark's text writer, and a Python data source that reads them.

The source plans whole files (small ones together), reads the header of a record first, decides by
the pushed filters on the record type and on header fields, and skips the payload's bytes unless the
record stays and the asked schema has ``payload``. Give a schema without ``payload`` to read headers
only. Files may be plain or gzipped. Archives of a cluster lie in a folder that ``pyarrow.fs`` opens.

Defined cases: a null payload is written as an empty one; header fields that are absent are null and
their names are matched whatever their case; a record that the end of a file cuts off, in its header or
in its payload, is an error whether its payload is asked for or not, and so is one without a length; an
empty folder gives no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In,
                                    InputPartition, IsNotNull)

from parley.session import cut, scratch_path

#: Columns and the header fields they hold.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", content_length long, headers map<string, string>, payload binary"
SPLIT_BYTES = 64 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID_PREFIX = "urn:parley:page:"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hex digits, twenty bits, make four letters."""
    def spelled(hexed: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(5)), lambda at: F.conv(
            F.substring(hexed, at, F.lit(5)), 16, 10).cast("int"))
        return F.array_join(F.flatten(F.transform(groups, lambda bits: F.transform(
            F.array(*map(F.lit, (15, 10, 5, 0))), lambda shift: F.substring(
                F.lit(BASE32), F.call_function("shiftright", bits, shift).bitwiseAND(31) + 1, F.lit(1))))), "")

    # a list of one, so that the digest is made once
    return F.transform(F.array(F.sha1(payload)), spelled)[0]


def with_revisits(pages: DataFrame, least_bytes: int = 0, heavy_share: int = 1000) -> DataFrame:
    """Marks every page as response or as revisit of the largest id with an equal payload.

    Adds ``payload``, ``payload_bytes``, ``payload_digest``, ``refers_to``. Payloads that more than
    one page in ``heavy_share`` has are fewer than ``heavy_share`` and are looked up by broadcast, so
    no task of the join gets more than that share of the pages by one key.
    """
    rows = (pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
            .withColumn("payload_bytes", F.length("payload").cast("long"))
            .withColumn("payload_digest", sha1_base32(F.col("payload"))))
    groups = (rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
              .agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1"))
    total = pages.count()
    heavy = groups.where(F.col("n") * heavy_share > total).select(
        "payload_digest", F.col("original").alias("heavy_original"))
    light = groups.where(F.col("n") * heavy_share <= total).select(
        F.col("payload_digest").alias("light_digest"), F.col("original").alias("light_original"))
    marked = rows.join(F.broadcast(heavy), "payload_digest", "left")
    # only revisits of the others take part in a join, by their own ids and payloads: once for rows
    # that are repeated, as each of these meets them
    # a table written first, so that the planner knows its size and spares the payloads a shuffle
    # where it is small
    light_rows = cut(rows.select("page_id", "payload_digest")
                     .join(light, F.col("payload_digest") == F.col("light_digest"))
                     .where("page_id <> light_original")
                     .select(F.col("page_id").alias("light_page"), "light_digest", "light_original")
                     .distinct())
    out = marked.join(light_rows, (F.col("page_id") == F.col("light_page"))
                      & (F.col("payload_digest") == F.col("light_digest")), "left")
    original = F.coalesce("heavy_original", "light_original")
    return out.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                      F.when(original != F.col("page_id"), original).alias("refers_to"))


def record(fields: list[tuple[str, Column]], payload: Column) -> Column:
    """One record up to the two line ends that close it; null fields are left out."""
    head = [F.lit("WARC/1.1\r\n")]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")))
    head.append(F.concat(F.lit("Content-Length: "), F.length(payload).cast("string"), F.lit("\r\n\r\n")))
    return F.concat(F.encode(F.concat(*head), "UTF-8"), payload)


def write_pages(marked: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record per page; a revisit has no payload, but its digest and its size."""
    revisit = F.col("refers_to").isNotNull()
    one_line = F.regexp_replace("url", "[\r\n]", " ")
    body = record([
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(F.lit(f"<{ID_PREFIX}"), F.col("page_id").cast("string"), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", one_line),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(revisit, F.concat(
            F.lit(f"<{ID_PREFIX}"), F.col("refers_to").cast("string"), F.lit(">")))),
        ("X-Payload-Length", F.col("payload_bytes")),
        ("Content-Type", F.lit("text/html")),
    ], F.when(revisit, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload")))
    # bytes pass the text writer as they are; the separator closes the record
    marked.select(body.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)


def _file_system(path: str):
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.columns = schema.names
        self.schema = schema
        self.wanted: list[tuple[str, set | None]] = []  # field in lower case, allowed values (None: any but null)
        self.wanted_names: list[tuple[str, set | None]] = []  # the same for keys of ``headers``, as spelled

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and not-null on header columns; gives back the rest."""
        for f in filters:
            attribute = getattr(f, "attribute", ())
            field = FIELDS.get(attribute[0], "").lower() if len(attribute) == 1 else None
            wanted = self.wanted
            if len(attribute) == 2 and attribute[0] == "headers":
                field, wanted = attribute[1], self.wanted_names
            if field and isinstance(f, IsNotNull):
                wanted.append((field, None))
            elif field and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                wanted.append((field, {f.value}))
            elif field and isinstance(f, In):
                wanted.append((field, set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Whole files, small ones together up to the split size."""
        from pyarrow import fs

        system, root = _file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in found
                       if i.is_file and i.size and not i.base_name.startswith(("_", ".")))
        groups, held = [], self.split
        for path, size in files:
            if held + size > self.split:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Files(g) for g in groups] or [Files([])]

    def _stays(self, headers: dict[str, str], fields: dict[str, str]) -> bool:
        return all(name in held and (allowed is None or held[name] in allowed)
                   for held, wanted in ((fields, self.wanted), (headers, self.wanted_names))
                   for name, allowed in wanted)

    def records(self, stream) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
        """Headers, length and, where it is asked for, payload of the records that stay."""
        payload = "payload" in self.columns
        while True:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
            headers, last = {}, ""
            while (line := stream.readline()) not in (b"\r\n", b"\n"):
                if not line.endswith(b"\n"):
                    raise ValueError("the last record is cut off in its header")
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text[:1] in " \t" and last:
                    headers[last] += " " + text.strip()
                    continue
                last, _, value = text.partition(":")
                headers[last] = value.strip()
            fields = {name.lower(): value for name, value in headers.items()}
            if not fields.get("content-length", "").isdigit():
                raise ValueError("a record without its Content-Length")
            length = int(fields["content-length"])
            stays = self._stays(headers, fields)
            body = stream.read(length) if stays and payload else None
            if body is None and length:
                # the last byte is read, as a file can be moved beyond its end
                stream.seek(length - 1, 1)
                whole = len(stream.read(1)) == 1
            else:
                whole = len(body or b"") == length
            if not whole:
                raise ValueError("the last record is cut off in its payload")
            if stays:
                yield headers, length, body

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _file_system(self.path)
        shape = to_arrow_schema(self.schema)
        rows, held = [], 0
        for path in partition.files:
            raw = system.open_input_file(path)
            with (gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(_Raw(raw), 1 << 20)) as stream:
                for headers, length, body in self.records(stream):
                    rows.append([self._value(c, headers, length, body) for c in self.columns])
                    held += len(body or b"") + 500
                    if held > (8 << 20):
                        yield self._batch(rows, shape)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, shape)

    @staticmethod
    def _value(column: str, headers: dict[str, str], length: int, body: bytes | None):
        if column == "payload":
            return body
        if column == "content_length":
            return length
        if column == "headers":
            return list(headers.items())
        name = FIELDS.get(column, column).lower()
        return next((value for key, value in headers.items() if key.lower() == name), None)

    @staticmethod
    def _batch(rows: list[list], shape: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)


class _Raw(io.RawIOBase):
    """A pyarrow file as a raw stream, so that headers are read through a buffer."""

    def __init__(self, inner):
        self.inner = inner

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        part = self.inner.read(len(into))
        into[:len(part)] = part
        return len(part)

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.inner.seek(offset, whence)

    def tell(self) -> int:
        return self.inner.tell()


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of all files below ``path``; filters on header columns are pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(schema).load(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives and reads them back, with the digest of what was read.

    Responses are read with their payload; revisits by their headers alone.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_pages(with_revisits(pages, least_bytes), path)
    number = lambda c: F.regexp_extract(c, r"(\d+|-\d+)>$", 1).try_cast("long")
    revisits = read(spark, path, "record_type string, record_id string, target_uri string, "
                                 "payload_digest string, refers_to string, headers map<string, string>")
    responses = read(spark, path, "record_type string, record_id string, target_uri string, payload binary")
    one = responses.where("record_type = 'response'").select(
        number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"), F.col("target_uri").alias("url"))
    two = revisits.where("record_type = 'revisit'").select(
        number("record_id").alias("page_id"),
        F.col("headers")["X-Payload-Length"].cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))
    return one.union(two)
