"""Landed crawls as a data source: the responses in WARC files, one after another, as rows ready for page_outcome().

    spark.dataSource.register(LandedCrawl)
    spark.read.format("landed_crawl").load(folder)
    spark.readStream.format("landed_crawl").load(folder)

A file is a partition and is read in pieces; a row holds no more of a body than a page may have, and one byte more, which
tells that it was larger. The stream's offset is the time and name of the last file it has taken, so it resumes there.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagetide.operators.crawl import MAX_HTML_BYTES, page_outcome

SCHEMA = "url string, fetched_at timestamp, status int, failure string, content_type string, declared_bytes long, body_bytes long, body binary, file string, place int"
#: What a metadata record may say of a request that had no response.
FAILURES = ("timeout", "network_error")
CHUNK = 1 << 20
#: Rows and bytes of bodies to an Arrow batch, and the longest header of a record or response.
ROWS, BYTES, LONGEST_HEADER = 200, 8 << 20, 1 << 20
#: Seconds that a file must have been left alone before the stream takes it: until then others may come with the same time.
SETTLE = 2.0


class Pieces:
    """Bytes of a file, plain or of gzip members, of which only what is asked for is kept."""

    def __init__(self, source):
        self.source, self.held, self.at, self.ended, self.waiting = source, b"", 0, False, b""
        first = source.read(2)
        self.zipped = zlib.decompressobj(31) if first == b"\x1f\x8b" else None
        self._take(first)

    def _take(self, data: bytes) -> None:
        if not data:
            self.ended = True
            if self.zipped and not self.zipped.eof:
                raise ValueError("a file is cut off")
            return
        if self.zipped is None:
            new = data
        else:
            new, rest = b"", data
            while rest:
                if self.zipped.eof:
                    self.zipped = zlib.decompressobj(31)
                new += self.zipped.decompress(rest, CHUNK)
                # What would make more than a piece waits in the decompressor's tail, and is asked for again.
                rest = self.zipped.unused_data if self.zipped.eof else self.zipped.unconsumed_tail
                if len(new) >= CHUNK and rest:
                    self.waiting = rest
                    break
            else:
                self.waiting = b""
        self.held, self.at = self.held[self.at :] + new, 0

    def more(self) -> bool:
        if self.ended:
            return False
        self._take(self.waiting or self.source.read(CHUNK))
        return True

    def until(self, mark: re.Pattern) -> bytes | None:
        """What comes before the next mark, without it; None at the end of the file."""
        while self.at < len(self.held) and self.held[self.at] in b"\r\n" or self.at == len(self.held):
            if self.at < len(self.held):
                self.at += 1
            elif not self.more():
                return None
        while not (found := mark.search(self.held, self.at)):
            if len(self.held) - self.at > LONGEST_HEADER:
                raise ValueError("a header has no end")
            if not self.more():
                raise ValueError("a record is cut off")
        data, self.at = self.held[self.at : found.start()], found.end()
        return data

    def block(self, size: int, most: int) -> bytes:
        """The next size bytes, of which only the first most are kept."""
        out = b""
        while size:
            part = self.held[self.at : self.at + size]
            if not part:
                if not self.more():
                    raise ValueError("a record is cut off")
                continue
            size, self.at = size - len(part), self.at + len(part)
            out += part[: most - len(out)]
        return out


BLANK = re.compile(rb"\r?\n\r?\n")


def headers(lines: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the fields, by lower-case name; of several of a name the first."""
    first, *rest = lines.decode("utf-8", "replace").splitlines() or [""]
    fields: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return first, fields


def number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def responses(pieces: Pieces, most: int = MAX_HTML_BYTES) -> Iterator[tuple]:
    """url, fetched_at, status, failure, content_type, declared_bytes, body_bytes, body of each response, and of each metadata record that tells of a failure. body_bytes: all of the body's bytes, kept or not."""
    while (head := pieces.until(BLANK)) is not None:
        kind, fields = headers(head)
        size = number(fields.get("content-length"))
        if not kind.startswith("WARC/") or size is None:
            raise ValueError("no WARC record")
        told = fields.get("warc-type")
        at = fields.get("warc-date", "")
        when = datetime.fromisoformat(at.replace("Z", "+00:00")).astimezone(UTC).replace(tzinfo=None) if at else None
        if told == "response":
            data = pieces.block(size, LONGEST_HEADER + most + 1)
            found = BLANK.search(data)
            line, own = headers(data[: found.start()] if found else data)
            body = data[found.end() :] if found else b""
            whole = size - found.end() if found else 0
            status = re.match(r"HTTP/\S+ (\d{3})(\s|$)", line)
            yield fields.get("warc-target-uri"), when, int(status[1]) if status else None, None if status else "network_error", own.get("content-type"), number(own.get("content-length")), whole, body[: most + 1]
        elif told == "metadata":
            _, own = headers(b"\n" + pieces.block(size, LONGEST_HEADER))
            if own.get("failure") in FAILURES:
                yield fields.get("warc-target-uri"), when, None, own["failure"], None, None, None, None
        else:
            pieces.block(size, 0)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    if not urlsplit(path).scheme:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def files_in(path: str) -> list[tuple[int, str]]:
    """Time (nanoseconds) and path of the folder's files, those of folders in it included, in that order; hidden ones are left out."""
    fs, top = opened(path)
    found = fs.get_file_info(pafs.FileSelector(top, recursive=True))
    shown = [f for f in found if f.is_file and not any(x[:1] in "._" for x in f.path[len(top) :].split("/") if x)]
    return sorted((f.mtime_ns, f.path) for f in shown)


class LandedFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def rows_of(folder: str, path: str, schema: StructType, most: int) -> Iterator[pa.RecordBatch]:
    fs, _ = opened(folder)
    kinds = to_arrow_schema(schema)
    with fs.open_input_stream(path, compression=None) as source:
        out, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            made = [pa.array([v.replace(tzinfo=UTC) if v else None for v in c] if pa.types.is_timestamp(f.type) else list(c), f.type) for c, f in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(made, schema=kinds)

        for place, row in enumerate(responses(Pieces(source), most)):
            out.append((*row, path, place))
            held += len(row[-1] or b"")
            if len(out) >= ROWS or held >= BYTES:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()


class LandedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder, self.most = schema, options["path"], int(options.get("maxBodyBytes", MAX_HTML_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [LandedFile(path) for _, path in files_in(self.folder)]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        return rows_of(self.folder, partition.path, self.schema, self.most)


class LandedStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder, self.most = schema, options["path"], int(options.get("maxBodyBytes", MAX_HTML_BYTES))
        self.settle = float(options.get("settleSeconds", SETTLE))

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        settled = (time.time() - self.settle) * 1e9
        done = [f for f in files_in(self.folder) if f[0] <= settled]
        return {"time": done[-1][0], "file": done[-1][1]} if done else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["time"], start["file"]), (end["time"], end["file"])
        return [LandedFile(path) for at, path in files_in(self.folder) if after < (at, path) <= upto]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        return rows_of(self.folder, partition.path, self.schema, self.most)


class LandedCrawl(DataSource):
    """Options: path; maxBodyBytes (of a body that are kept, and one more); settleSeconds (of a stream)."""

    @classmethod
    def name(cls) -> str:
        return "landed_crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> LandedStream:
        return LandedStream(schema, self.options)


def with_outcome(landed: DataFrame) -> DataFrame:
    """landed rows with html, the text of a body that is html and no larger than a page may be, and outcome. A body that isn't UTF-8 can't be read."""
    large = F.coalesce("declared_bytes", F.lit(0)) > MAX_HTML_BYTES
    text = F.when(~large & (F.col("body_bytes") <= MAX_HTML_BYTES) & F.is_valid_utf8(F.col("body").cast("string")), F.col("body").cast("string"))
    rows = landed.withColumn("html", text)
    outcome = page_outcome(F.col("status"), F.col("failure"), F.col("content_type"), F.col("declared_bytes"), F.col("body_bytes"), F.col("html").isNotNull())
    return rows.withColumn("outcome", outcome).withColumn("html", F.when(F.col("outcome") == "html", F.col("html")))


def register(spark) -> None:
    spark.dataSource.register(LandedCrawl)
