"""Large quoted CSV files and zipped ones, each read by many tasks.

A quoted field may hold line ends, so where a record begins can't be told from the middle of a file. Each byte range is
scanned twice, as if it began outside and inside of quotes; the driver strings the outcomes together, and then every
range knows how it begins and reads the records whose first byte lies in it. A zip's members are a task each, inflated as
a stream; which members there are, and what their headers say, is read from the archive's directory beforehand.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bidweave.session import ship
from bidweave.sources import places

#: Bytes of a range, bytes read at once beyond it, rows of a batch, and bytes that a record may have.
RANGE = 32 << 20
MORE = 1 << 20
ROWS = 4_096
LONGEST = 256 << 20
_FIELD = rb'(?:"(?:[^"]++|"")*+"[^,\r\n]*+|[^",\r\n][^,\r\n]*+|)'
_record = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+").match
_rest = re.compile(rb"[^,\r\n]*+(?:," + _FIELD + rb")*+").match
_quoted = re.compile(rb'(?:[^"]++|"")*+').match
_opening = re.compile(rb'[,\r\n]"').search
_newline = re.compile(rb"\r\n|\r|\n").match
_BOM = b"\xef\xbb\xbf"


def ends_inside(data: bytes, before: bytes, inside: bool) -> bool:
    """Whether a range ends within a quoted field, by how it begins; ``before`` is the byte before it."""
    data, at = before + data, 1
    while True:
        if inside:
            at = _quoted(data, at).end()
            if at >= len(data):
                return True
            at += 1
        found = _opening(data, at - 1)
        if not found:
            return False
        at, inside = found.end(), True


def cut_at(source, nominal: int, size: int) -> int:
    """Where a range really begins: the next place that no quote or split line end touches."""
    if nominal <= 0 or nominal >= size:
        return max(0, min(nominal, size))
    source.seek(nominal - 1)
    at, last = nominal, source.read(1)
    while block := source.read(4096):
        for k in range(len(block)):
            here = block[k : k + 1]
            if last not in (b'"', b"\r") and here != b'"':
                return at
            at, last = at + 1, here
    return size


@dataclass
class Span(InputPartition):
    start: int
    end: int
    inside: bool


def spans(spark: SparkSession, path: str, range_bytes: int = RANGE) -> list[Span]:
    """A file's ranges and how each begins; ranges are scanned in tasks, three numbers of each reach the driver."""
    n = max(1, -(-places.size(path) // range_bytes))
    if n == 1:
        return [Span(0, places.size(path), False)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with places.opened(path) as source:
            size = source.seek(0, 2)
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    start, end = (cut_at(source, k * range_bytes, size) for k in (i, i + 1))
                    source.seek(max(0, start - 1))
                    before = source.read(1) if start else b"\n"
                    source.seek(start)
                    data = source.read(end - start)
                    row = (i, start, end, ends_inside(data, before, False), ends_inside(data, before, True))
                    yield pa.RecordBatch.from_pylist([dict(zip(("i", "start", "stop", "outside", "inside"), row, strict=True))])

    scanned = spark.range(0, n, 1, n).mapInArrow(scan, "i long, start long, stop long, outside boolean, inside boolean")
    out, inside = [], False
    for r in sorted(scanned.collect()):
        out.append(Span(r["start"], r["stop"], inside))
        inside = r["inside"] if inside else r["outside"]
    return [s for s in out if s.start < s.end] or [Span(0, 0, False)]


def records(source, span: Span) -> Iterator[bytes]:
    """The records whose first byte lies in a range, without their line ends; blank lines are none."""
    source.seek(max(0, span.start - 1))
    before = source.read(1) if span.start else b"\n"
    data, base, over = source.read(span.end - span.start), span.start, False

    def more() -> None:
        nonlocal data, over
        if len(data) > span.end - span.start + LONGEST:
            raise ValueError(f"a record of over {LONGEST} bytes begins before byte {span.end}; is a quote left open?")
        block = source.read(MORE)
        over = not block
        data += block

    def end_of(match, at: int) -> int:
        """Where the record goes to that is matched from ``at`` on."""
        while True:
            found = match(data, at)
            end = found.end()
            # At the end of what was read a field, or a pair of CR and LF, may go on.
            if over or (end < len(data) - 1 and data[end : end + 1] in b"\r\n"):
                return end if end == len(data) or data[end : end + 1] in b"\r\n" else len(data)
            more()

    at = 0
    if span.inside or before not in b"\r\n":
        if span.inside:
            while (at := _quoted(data, 0).end()) >= len(data) and not over:
                more()
            at = min(at + 1, len(data))
        start_of_field = not span.inside and before == b","
        at = end_of(_record if start_of_field else _rest, at)
        found = _newline(data, at)
        at = found.end() if found else len(data)
    elif span.start == 0 and data.startswith(_BOM):
        at = len(_BOM)
    while base + at < span.end:
        end = end_of(_record, at)
        if end > at:
            yield data[at:end]
        found = _newline(data, end)
        at = found.end() if found else len(data)
        if at >= RANGE:
            data, base, at = data[at:], base + at, 0


def header(path: str, encoding: str = "utf-8") -> list[str]:
    """Column names of a file, from its first record."""
    with places.opened(path) as source:
        first = next(records(source, Span(0, min(MORE, places.size(path)), False)), b"")
    return next(csv.reader([first.decode(encoding, "replace")]), [])


def _rows(lines: Iterable[str], fields: Sequence[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """Fields (name, place) of parsed records as text; what a record lacks, and empty ones, are null."""
    held: list[list[str | None]] = [[] for _ in fields]
    names, columns = [n for n, _ in fields], [i for _, i in fields]
    for row in csv.reader(lines):
        if not row:
            continue
        n = len(row)
        for values, i in zip(held, columns, strict=True):
            values.append((row[i] or None) if i < n else None)
        if len(held[0]) >= ROWS:
            yield _batch(held, names)
    if held[0]:
        yield _batch(held, names)


def _batch(held: list[list[str | None]], names: list[str]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(v, type=pa.string()) for v in held], names=names)
    for values in held:
        values.clear()
    return out


def _fields_limit() -> None:
    csv.field_size_limit(LONGEST)


class SplitCsv(DataSource):
    """Options: ``path``, ``encoding``, ``fields`` (JSON: names and places of the columns), ``spans`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "split_csv"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n, _ in json.loads(self.options["fields"])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SpanReader(self.options["path"], self.options["encoding"], json.loads(self.options["fields"]), [Span(*s) for s in json.loads(self.options["spans"])])


class _SpanReader(DataSourceReader):
    def __init__(self, path: str, encoding: str, fields: list[tuple[str, int]], spans: list[Span]) -> None:
        self.path, self.encoding, self.fields, self.spans = path, encoding, fields, spans

    def partitions(self) -> list[InputPartition]:
        return list(self.spans)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        _fields_limit()
        with places.opened(self.path) as source:
            found = records(source, partition)
            if partition.start == 0:
                next(found, None)
            yield from _rows((r.decode(self.encoding, "replace") for r in found), self.fields)


def _named(names: Sequence[str], wanted: Sequence[str] | None) -> list[tuple[str, int]]:
    """(name, place) of the wanted columns that there are, or of all; of equal names the first."""
    first = {n: i for i, n in reversed(list(enumerate(names)))}
    return [(n, first[n]) for n in (names if wanted is None else wanted) if n in first]


def read_split(spark: SparkSession, path: str, encoding: str = "utf-8", wanted: Sequence[str] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """A CSV file's rows as text, one task for each range of bytes: the wanted columns that it has, or all.

    Fields stand between commas; one that begins with a quote goes to the closing quote, line ends and doubled quotes
    included as they are; a quote elsewhere in a field is a letter. Records end with LF, CR LF or CR. Bytes that the encoding (one
    that writes ASCII as it is) doesn't know are replaced; missing and empty fields are null, quoted or not, as in Spark's own reader, fields beyond the
    header are dropped, blank lines are no rows, and a byte-order mark is passed over. An empty file has no columns: a
    ValueError. A record of over ``LONGEST`` bytes is an error.
    """
    fields = _named(header(path, encoding), wanted)
    if not fields:
        raise ValueError(f"{path} has none of the columns asked for")
    ship(spark)
    spark.dataSource.register(SplitCsv)
    parts = json.dumps([(s.start, s.end, s.inside) for s in spans(spark, path, range_bytes)])
    return spark.read.format("split_csv").option("path", path).option("encoding", encoding).option("fields", json.dumps(fields)).option("spans", parts).load()


# --- zips ---------------------------------------------------------------------------------------------------


@dataclass
class Member(InputPartition):
    path: str
    name: str
    places: list[int]  # of the wanted columns, -1 where a member lacks one


def _lines(archive: zipfile.ZipFile, name: str, encoding: str) -> io.TextIOWrapper:
    return io.TextIOWrapper(archive.open(name), encoding=encoding, errors="replace", newline="")


def headers(path: str, encoding: str = "utf-8-sig") -> dict[str, list[str]]:
    """The column names of each CSV member of a zip, in the order of the members' names."""
    out = {}
    with places.opened(path) as source, zipfile.ZipFile(source) as archive:
        for name in sorted(n for n in archive.namelist() if n.lower().endswith(".csv")):
            with _lines(archive, name, encoding) as lines:
                out[name] = next(csv.reader(lines), [])
    return out


def members(path: str, wanted: Sequence[str], key: str, encoding: str = "utf-8-sig") -> tuple[list[Member], list[str], dict[str, list[str]]]:
    """The CSV members that have the key column, in the order of their names; names of the others; columns that members lack.

    Read are the archive's directory and the members' first records.
    """
    found, others, missing = [], [], {}
    for name, names in headers(path, encoding).items():
        first = {n: i for i, n in reversed(list(enumerate(names)))}
        if key not in first:
            others.append(name)
            continue
        found.append(Member(path, name, [first.get(c, -1) for c in wanted]))
        if lacks := [c for c in wanted if c not in first]:
            missing[name] = lacks
    return found, others, missing


class ZippedCsv(DataSource):
    """Options: ``columns`` (JSON), ``members`` (JSON), ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in json.loads(self.options["columns"])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _MemberReader([Member(*m) for m in json.loads(self.options["members"])], json.loads(self.options["columns"]), self.options["encoding"])


class _MemberReader(DataSourceReader):
    def __init__(self, members: list[Member], columns: list[str], encoding: str) -> None:
        self.members, self.columns, self.encoding = members, columns, encoding

    def partitions(self) -> list[InputPartition]:
        return list(self.members)

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        _fields_limit()
        beyond = 1 << 30
        with places.opened(partition.path) as source, zipfile.ZipFile(source) as archive, _lines(archive, partition.name, self.encoding) as lines:
            next(csv.reader(lines), None)
            yield from _rows(lines, [(n, i if i >= 0 else beyond) for n, i in zip(self.columns, partition.places, strict=True)])


def read_members(spark: SparkSession, chosen: Sequence[Member], columns: Sequence[str], encoding: str = "utf-8-sig") -> DataFrame:
    """The rows of zipped CSV members as text, one task a member; nothing is unpacked to disk."""
    if not chosen:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in columns]))
    ship(spark)
    spark.dataSource.register(ZippedCsv)
    parts = json.dumps([(m.path, m.name, m.places) for m in chosen])
    return spark.read.format("zipped_csv").option("columns", json.dumps(list(columns))).option("members", parts).option("encoding", encoding).load()
