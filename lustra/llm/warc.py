"""WARC archives: a writer on Spark's text sink and a Python data source that reads headers first."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# Fixed values of the format.
VERSION = "WARC/1.1"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

TASK_BYTES = 64 << 20  # archive bytes planned for one task; a larger file is a task of its own
BATCH_BYTES = 4 << 20
FIELDS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")
HEADERS = ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to")
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, http_length bigint, payload binary"
ID = "<urn:page:{}>"
#: Schemes of Hadoop's connectors under the names that Arrow gives the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "wasbs": "abfss"}


def base32_sha1(data: str) -> str:
    """Bare upper-case base32 SHA-1 of a binary expression: eight groups of 20 bits, four digits each."""
    groups = ", ".join(f"lpad(conv(substr(__hex, {1 + 5 * k}, 5), 16, 32), 4, '0')" for k in range(8))
    coded = f"translate(concat({groups}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', '{BASE32}')"
    return coded.replace("__hex", f"sha1({data})")


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest and keeper of every page.

    Of the pages whose payloads of at least ``least`` bytes are equal, ``keeper`` is the largest page_id;
    smaller payloads keep themselves.  A null page_id is below all others.
    """
    rows = pages.selectExpr("page_id", "url", "coalesce(html, '') AS payload").withColumn("digest", F.expr(base32_sha1("payload")))
    # Two groupings of small rows: one that many pages share costs a row a task, and the payload moves once.
    best = rows.filter(f"octet_length(payload) >= {least}").groupBy("digest").agg(F.expr("max(page_id) AS best"), F.expr("count(1) AS n"))
    best = best.filter("n > 1").withColumnRenamed("digest", "__digest").drop("n")
    found = rows.join(best, F.expr("digest = __digest"), "left")
    return found.withColumn("keeper", F.expr("if(__digest IS NULL, page_id, best)")).drop("__digest", "best")


def write_warc(pages: DataFrame, path: str, least: int = 0, compression: str = "gzip") -> None:
    """One record per page into archive files below ``path``, any file system Spark can write.

    Records are text through Spark's own writer, so a lost task is written again and never half seen.  The
    page that keeps a payload is a response, equal ones revisit it without the payload.  A null html is an
    empty payload and a null url has no target header; other columns are left out, line breaks in a url become blanks, and an empty
    table writes no record.  Repeated rows that hold the keeper's id are responses each.
    """
    rows = deduplicated(pages, least).withColumns(
        {
            "same": F.expr("page_id <=> keeper"),
            "http": F.expr(r"concat('HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ', octet_length(payload), '\r\n\r\n')"),
            "target": F.expr(r"if(url IS NULL, '', concat('WARC-Target-URI: ', regexp_replace(url, '[\\x00-\\x1F]', ' '), '\r\n'))"),
        }
    )
    name = lambda column: f"concat('{ID.split('{}')[0]}', coalesce(CAST({column} AS STRING), 'null'), '{ID.split('{}')[1]}')"
    record = rf"""concat('{VERSION}\r\nWARC-Type: ', if(same, 'response', 'revisit'), '\r\nWARC-Record-ID: ', {name('page_id')},
        '\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n', target, 'WARC-Payload-Digest: sha1:', digest, '\r\n',
        if(same, '', concat('WARC-Refers-To: ', {name('keeper')}, '\r\nWARC-Profile: {REVISIT_PROFILE}\r\n')),
        'Content-Type: application/http;msgtype=response\r\nContent-Length: ',
        octet_length(http) + if(same, octet_length(payload), 0), '\r\n\r\n', http, if(same, payload, ''), '\r\n')"""
    # The separator of the sink is the second line end after a record.
    rows.select(F.expr(record).alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def uri(name: str) -> str:
    """A path as Spark's readers name it, as the readers in the tasks know it."""
    scheme, separator, rest = name.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{separator}{rest}"


class WarcFiles(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    """Plans whole files, keeps the pushed predicates on headers, and seeks past payloads nobody asked for."""

    def __init__(self, options: dict):
        self.files = [tuple(f) for f in json.loads(options["files"])]
        self.payload_types = set(json.loads(options.get("payloads", '["response"]')))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in FIELDS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> Sequence[InputPartition]:
        plan: list[WarcFiles] = []
        room = 0
        for name, size in sorted(self.files):
            if size > room or not plan:
                plan.append(WarcFiles([]))
                room = TASK_BYTES
            plan[-1].files.append((name, size))
            room -= size
        return plan or [WarcFiles([])]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kind = pa.schema([*[(n, pa.string()) for n in FIELDS], ("http_length", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for name, _ in partition.files:
            store, path = fs.FileSystem.from_uri(uri(name))
            # Plain files are sought in; compressed ones are read through, and what is skipped is not decoded.
            with (store.open_input_stream if path.endswith(".gz") else store.open_input_file)(path) as stream:
                for row in self._records(Lines(stream)):
                    rows.append(row)
                    held += 256 + len(row[-1] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)

    def _records(self, stream: Lines) -> Iterator[tuple]:
        while True:
            line = stream.line()
            while line in (b"\r\n", b"\n"):
                line = stream.line()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {stream.tell()}: {line[:40]!r}")
            headers = stream.headers()
            length = int(headers["content-length"])
            end = stream.tell() + length
            values = [headers.get(h) for h in HEADERS]
            if all(v in self.wanted[c] for c, v in zip(FIELDS, values) if c in self.wanted):
                http_length = payload = None
                if headers.get("content-type", "").startswith("application/http"):
                    stream.line()
                    size = stream.headers().get("content-length")
                    http_length = int(size) if size else None
                if values[1] in self.payload_types:
                    payload = stream.take(end - stream.tell())
                yield (*values, http_length, payload)
            stream.seek(end)


class Lines:
    """Buffered lines, blocks and forward seeks over a file or a stream."""

    STEP = 1 << 18

    def __init__(self, file):
        self.file, self.start, self.at, self.data = file, 0, 0, b""

    def tell(self) -> int:
        return self.start + self.at

    def _more(self, least: int) -> bool:
        """Reads on until ``least`` bytes are ahead; false if the file ends before."""
        while len(self.data) - self.at < least:
            got = self.file.read(max(self.STEP, least))
            if not got:
                return False
            self.start, self.data, self.at = self.start + self.at, self.data[self.at :] + got, 0
        return True

    def line(self) -> bytes:
        while (end := self.data.find(b"\n", self.at)) < 0:
            if not self._more(len(self.data) - self.at + 1):
                end = len(self.data) - 1
                break
        out, self.at = self.data[self.at : end + 1], end + 1
        return out

    def take(self, n: int) -> bytes:
        if not self._more(n):
            raise ValueError("the archive ends inside a record")
        out, self.at = self.data[self.at : self.at + n], self.at + n
        return out

    def headers(self) -> dict[str, str]:
        out: dict[str, str] = {}
        while (line := self.line()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    def seek(self, to: int) -> None:
        if to <= self.start + len(self.data):
            self.at = to - self.start
        elif self.file.seekable():
            self.file.seek(to)
            self.start, self.at, self.data = to, 0, b""
        else:
            while to > self.start + len(self.data):
                self.start, self.data = self.start + len(self.data), self.file.read(self.STEP)
                if not self.data:
                    raise ValueError("the archive ends inside a record")
            self.at = to - self.start


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payloads: Sequence[str] = ("response",)) -> DataFrame:
    """Records of all archive files below ``path``; payloads only of the given record types, others are null.

    Equality and IN predicates on the header columns are pushed to the reader, which then skips the whole
    block of a record that does not match.  Files are listed by Spark, and read by URI in the tasks.
    """
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    files = json.dumps([[r["path"], r["length"]] for r in listed.collect()])
    return spark.read.format("warc").option("files", files).option("payloads", json.dumps(list(payloads))).load()


def page_number(urn: str) -> str:
    """The page_id inside a record id expression."""
    return f"CAST(nullif(regexp_extract({urn}, '{ID.format('(-?[0-9]+)')}', 1), '') AS BIGINT)"
