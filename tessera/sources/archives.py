"""Archive files as Spark data sources (S16-S22): WARC, ARC, delimited text, MediaWiki dumps.

Files are split among tasks one by one; each is read as a stream, and a gzip member or bz2 file is
opened by its name. ``spark.dataSource.register(WarcSource)`` makes ``format("warc")`` known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    info = system.get_file_info(base)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
    head = path[: len(path) - len(base)] if path.endswith(base) else "file://"
    return sorted(head + f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def open_archive(path: str):
    """A buffered byte stream, decompressed by file name."""
    import bz2
    import gzip
    import io

    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    raw = system.open_input_file(base)
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=raw)
    if path.endswith(".bz2"):
        return bz2.BZ2File(raw)
    return io.BufferedReader(raw)


def headers(stream) -> dict[str, str]:
    """Header lines up to a blank one, names in lower case."""
    out: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def split_response(block: bytes) -> tuple[int | None, str | None, bytes]:
    """(status code, content type, body) of an HTTP response; no code if it isn't one."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not blank:
        return None, None, block
    code = re.match(rb"HTTP/\S+\s+(\d{3})", head)
    kind = re.search(rb"(?im)^content-type:\s*([^\s;]+)", head)
    return int(code[1]) if code else None, kind[1].decode().lower() if kind else None, body


def warc_records(stream) -> Iterator[tuple]:
    """(url, date, code, type, body) of response and resource records."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        h = headers(stream)
        block = stream.read(int(h.get("content-length", 0)))
        url = h.get("warc-target-uri", "").strip("<>")
        if h.get("warc-type") in ("response", "resource") and not url.startswith("dns:"):
            yield (url, h.get("warc-date"), *split_response(block))


def arc_records(stream) -> Iterator[tuple]:
    """(url, date, code, type, body); header lines are ``url ip date type length``."""
    while line := stream.readline():
        parts = line.decode("utf-8", "replace").split()
        if len(parts) < 5 or not parts[-1].isdigit():
            continue
        block = stream.read(int(parts[-1]))
        if not parts[0].startswith(("dns:", "filedesc:")):
            code, kind, body = split_response(block)
            yield parts[0], parts[-3], code, kind or parts[-2], body


class _Reader(DataSourceReader):
    def __init__(self, path: str, records) -> None:
        self.path, self.records = path, records

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open_archive(partition.value) as stream:
            yield from self.records(stream)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "url string, date string, code int, type string, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], warc_records)


class ArcSource(WarcSource):
    @classmethod
    def name(cls) -> str:
        return "arc"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], arc_records)


def read_delimited(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Records of text files parted by a delimiter; the reader splits large files."""
    rows = spark.read.option("lineSep", delimiter).text(path)
    return rows.select(F.trim("value").alias("record")).where("record <> ''")


def read_mediawiki(spark: SparkSession, path: str) -> DataFrame:
    """(title, markup) of the pages of a dump."""
    page = "title string, revision struct<text: string>"
    rows = spark.read.format("xml").option("rowTag", "page").schema(page).load(path)
    return rows.select("title", F.col("revision.text").alias("markup"))


def read_query(spark: SparkSession, url: str, sql: str, properties: dict[str, str]) -> DataFrame:
    """Rows of a database query as ``column``, dashes, ``value`` blocks."""
    rows = spark.read.format("jdbc").options(url=url, query=sql, **properties).load()
    return rows.select(record_text(rows.columns).alias("record"))


def record_text(columns: list[str]):
    parts = [F.concat(F.lit(f"{c}\n----\n"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n====\n")) for c in columns]
    return F.concat(*parts)
