"""Readers: JSON lines in zstd, gzip or plain files, numbered shard lines, TSV lists, WET archives, HTML."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

PAGE = "url string, lang string, lid_prob double, wet_text string, wet_file string"
WET = "url string, wet_text string, wet_file string"


def json_lines(spark: SparkSession, paths: str | list[str], schema: str | StructType = PAGE) -> DataFrame:
    """JSON records of compressed or plain files; only a newline ends a record, since others stand raw in strings."""
    return spark.read.schema(schema).option("lineSep", "\n").json(paths)


def unescaped_json_lines(spark: SparkSession, paths: str | list[str], text: str = "text", schema: str = "text string, url string") -> DataFrame:
    """JSON records whose texts have line ends as the two characters backslash and n."""
    return json_lines(spark, paths, schema).withColumn(text, F.replace(F.col(text), F.lit("\\n"), F.lit("\n")))


def tsv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(paths)


def opened(name: str, stream: BinaryIO) -> BinaryIO:
    """A file's decompressed bytes as a stream, by its name's ending: all frames of ``.zst``, all members of ``.gz``."""
    if name.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    return gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column("path"), b.column("content")):
            shard = path.as_py().rsplit("/", 1)[-1]
            lines = io.TextIOWrapper(io.BufferedReader(opened(shard, io.BytesIO(data.as_buffer()))), "utf-8", "replace", newline="\n")
            records = (x.removesuffix("\n") for x in lines if x != "\n")
            at = 0
            while part := list(islice(records, 10_000)):  # a shard is never held decoded
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part)), pa.array(range(at, at + len(part)), pa.int32()), pa.array(part)], ["shard", "line_no", "record"])
                at += len(part)


def shard_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id, shard, line_no, record): lines numbered from 0 within their shard, empty ones not counted. One task reads a shard."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    rows = files.mapInArrow(_numbered, "shard string, line_no int, record string")
    return rows.select(F.concat_ws(":", "shard", F.col("line_no").cast("string")).alias("id"), "shard", "line_no", "record")


def plain_json_lines(spark: SparkSession, paths: str | list[str], prefix: str, text: str = "content") -> DataFrame:
    """(id, url, text) of JSON lines without ids: ``<prefix>:<file name without ending>:<line>``."""
    rows = shard_lines(spark, paths).withColumn("r", F.from_json("record", f"url string, {text} string"))
    name = F.regexp_extract("shard", r"^([^.]*)", 1)
    return rows.select(F.concat_ws(":", F.lit(prefix), name, F.col("line_no").cast("string")).alias("id"), "r.url", F.col(f"r.{text}").alias("text"))


def listed(spark: SparkSession, list_path: str, root: str, worker: int = 0, workers: int = 1) -> list[str]:
    """The files that a list names, one a line, under a folder: every ``workers``-th from ``worker``. A missing one fails the read."""
    names = [r[0].strip() for r in spark.read.text(list_path, wholetext=True).select(F.explode(F.split("value", "\n"))).collect()]  # names only, in order
    return [f"{root}/{n}" for n in [n for n in names if n][worker::workers]]


def frozen_list(spark: SparkSession, pattern: str, list_path: str, least_bytes: int = 101) -> str:
    """Write the names of the files that match and have ``least_bytes`` or more, sorted, unless the list exists; later files don't change it."""
    files = spark.read.format("binaryFile").load(pattern).where(F.col("length") >= least_bytes).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(list_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        files.orderBy("name").coalesce(1).write.mode("errorifexists").text(list_path)
    return list_path


def robots_state(log: Column) -> Column:
    """How a host's robots file was treated, by the lines of the crawler's log for it."""
    named = lambda pattern: log.rlike(rf"(?m)^\s*robots_{pattern}")
    lines = F.exists(F.regexp_extract_all(log, F.lit(r"(\d+) sitemap lines in robots\.txt"), F.lit(1)), lambda n: n.cast("int") > 0)
    known = F.when(named(r"ok(\s|$)") | lines, "fetched").when(named(r"\S*_allow_all_per_rfc9309(\s|$)"), "absent_4xx").when(named(r"\S*_assumed_open(\s|$)"), "unreachable_assumed_open")
    return F.coalesce(known, F.lit("not recorded"))


# --- WET archives

def wet_records(stream: BinaryIO) -> Iterator[tuple[str, str]]:
    """(url, text) of the conversion records of a WET stream, one at a time; bad bytes are replaced."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            continue
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        body = stream.read(int(headers.get("content-length", "0") or 0))
        if headers.get("warc-type") == "conversion" and headers.get("warc-target-uri"):
            yield headers["warc-target-uri"], body.decode("utf-8", "replace")


def _open(path: str) -> BinaryIO:
    """A file for reading, by path or by the uri of any file system that Arrow knows."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(path)
    return system.open_input_file(inner)


class _WetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.most = int(options.get("maxChars", "20000"))
        self.least = int(options.get("minChars", "200"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, str]]:
        with _open(partition.value) as f:
            for url, text in wet_records(io.BufferedReader(opened(partition.value, f))):
                if len(text) >= self.least:
                    yield url, text[: self.most], partition.value


class WetSource(DataSource):
    """``spark.read.format("wet").option("paths", "a,b").load()``: one partition a file; short texts are left out, long ones cut as the collector's format defines."""

    @classmethod
    def name(cls) -> str:
        return "wet"

    def schema(self) -> str:
        return WET

    def reader(self, schema: StructType) -> _WetReader:
        return _WetReader(self.options)


# --- HTML

# fixed values: sitemap entries, feed links and anchors
LOC = r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"
FEED = r"(?i)type=[\"']application/(?:rss|atom)\+xml[\"']"
HREF = r"(?i)<a\b[^>]*\bhref=[\"']([^\"']+)[\"']"


def sitemap_urls(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LOC), F.lit(1))


def feed_links(html: Column) -> Column:
    """Targets of the link tags that name a feed, whatever the order of their attributes."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link[^>]+>"), F.lit(0)), lambda t: t.rlike(FEED))
    return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, "(?i)href=[\"']([^\"']+)[\"']", 1)), lambda x: x != "")


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


class _Main(HTMLParser):
    SKIP = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "table", "template", "svg", "button", "select"}
    BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "blockquote", "br", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.SKIP
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.depth = max(0, self.depth - 1)
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)


def main_text(html: str | None) -> str | None:
    """The text of a page without navigation, scripts, forms and tables; one line a block."""
    if html is None:
        return None
    parser = _Main()
    parser.feed(html)
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(main_text)


@pandas_udf(StringType())
def decoded_html(content: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes of a page as text: by the charset of its content type; without one as UTF-8 if they are valid, else as ISO-8859-1."""

    def one(data: bytes | None, kind: str | None) -> str | None:
        if data is None:
            return None
        named = re.search(r"charset=[\"']?([\w-]+)", kind or "", re.I)
        try:
            return bytes(data).decode(named.group(1) if named else "utf-8", "replace" if named else "strict")
        except (UnicodeDecodeError, LookupError):
            return bytes(data).decode("iso-8859-1")

    return pd.Series([one(d, k) for d, k in zip(content, content_type)])
