"""Files that one task need not read whole: JSON arrays by byte ranges, and archives by members and byte ranges."""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART = 64 << 20
BLANK = b" \t\r\n"
_OUT = re.compile(rb'["\[\]{},]')
_IN = re.compile(rb'\\.|"', re.S)


def open_file(path: str, write: bool = False):
    """A seekable file to read, or a stream to write, of any file system that Arrow reaches (local, HDFS, object stores)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if write:
        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(name) if write else where.open_input_file(name)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of the files that Spark finds under a path or pattern; their contents are not read."""
    return [tuple(r) for r in spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()]


def _read(f, begin: int, end: int) -> bytes:
    f.seek(begin)
    return f.read(end - begin)


def _cut(f, at: int, size: int) -> int:
    """The first place from `at` on that no backslash stands before, so no escape is cut."""
    while 0 < at < size and _read(f, at - 1, at) == b"\\":
        at += 1
    return min(at, size)


def _marks(raw: bytes, inside: bool) -> Iterator[tuple[int, bytes]]:
    """(place, byte) of brackets and commas outside strings; at last (length, b'"') if a string is open, else (length, b"")."""
    at = 0
    while True:
        if inside:
            m = _IN.search(raw, at)
            while m and m.group() != b'"':
                m = _IN.search(raw, m.end())
            if not m:
                yield len(raw), b'"'
                return
            at, inside = m.end(), False
        m = _OUT.search(raw, at)
        if not m:
            yield len(raw), b""
            return
        at, inside = m.end(), m.group() == b'"'
        if not inside:
            yield m.start(), m.group()


def _depth(raw: bytes, inside: bool) -> tuple[int, bool]:
    """How much deeper a range ends than it begins, and whether it ends inside a string."""
    deep, last = 0, b""
    for _, last in _marks(raw, inside):
        deep += (last in (b"[", b"{")) - (last in (b"]", b"}"))
    return deep, last == b'"'


def _summaries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each range does to depth and strings, for either state that it may begin in."""
    for pdf in parts:
        for path, size, begin, end in zip(pdf["path"], pdf["size"], pdf["begin"], pdf["end"]):
            with open_file(path) as f:
                begin, end = _cut(f, begin, size), _cut(f, end, size)
                raw = _read(f, begin, end)
            (d0, s0), (d1, s1) = _depth(raw, False), _depth(raw, True)
            yield pd.DataFrame({"path": [path], "size": [size], "begin": [begin], "end": [end], "d0": [d0], "s0": [s0], "d1": [d1], "s1": [s1], "blank": [not raw.strip(BLANK + b"\xef\xbb\xbf")]})


def _elements(f, size: int, begin: int, end: int, inside: bool, depth: int, begun: bool, most: int) -> Iterator[bytes | None]:
    """The elements of the outer array that begin in a range, None for one of more than `most` bytes."""
    raw, start = _read(f, begin, end), None
    if begun and depth == 0 and raw.strip(BLANK):
        raise ValueError("content after the end of a JSON array")
    if not begun and raw.strip(BLANK + b"\xef\xbb\xbf") and not raw.lstrip(BLANK + b"\xef\xbb\xbf").startswith(b"["):
        raise ValueError("not a JSON array")
    for at, mark in _marks(raw, inside):
        if at == len(raw):
            inside = mark == b'"'
            break
        if depth == 1 and mark in (b",", b"]"):
            if start is not None and raw[start:at].strip(BLANK):
                yield raw[start:at].strip(BLANK) if at - start <= most else None
            start = at + 1 if mark == b"," else None
        depth += (mark in (b"[", b"{")) - (mark in (b"]", b"}"))
        if depth == 1 and not begun:
            start, begun = at + 1, True
        if depth == 0 and raw[at + 1 :].strip(BLANK):
            raise ValueError("content after the end of a JSON array")
    if start is None:
        return
    text, at = raw[start:], end  # the last one may end in a later range
    while at < size:
        if len(text) > most:
            yield None
            return
        stop = _cut(f, min(size, at + (1 << 20)), size)
        more = _read(f, at, stop)
        for place, mark in _marks(more, inside):
            if place == len(more):
                inside = mark == b'"'
                break
            if depth == 1 and mark in (b",", b"]"):
                text = (text + more[:place]).strip(BLANK)
                if text:
                    yield text if len(text) <= most else None
                return
            depth += (mark in (b"[", b"{")) - (mark in (b"]", b"}"))
        text, at = text + more, stop


def array_elements(spark: SparkSession, path: str, most: int, part: int = PART) -> DataFrame:
    """(value, large) of the elements of JSON array files, each file read by a task for every `part` bytes.

    A first pass tells what a range does to the depth of brackets and to strings, whether it begins inside a string or
    not; these few numbers, put one after another, give the state that each range really begins in. The second pass reads
    the elements that begin in a range, to their ends. `value` is null and `large` true for an element of more than
    `most` bytes. A file that is no array, is cut short, or goes on after its end fails; one
    of no bytes has no elements.
    """
    ranges = [(p, n, a, min(n, a + part)) for p, n in files_of(spark, path) for a in range(0, max(n, 1), part)]
    table = spark.createDataFrame(ranges, "path string, size long, begin long, end long")
    told = table.repartition(max(1, len(ranges))).mapInPandas(_summaries, "path string, size long, begin long, end long, d0 long, s0 boolean, d1 long, s1 boolean, blank boolean")
    known, states = sorted((tuple(r) for r in told.collect()), key=lambda r: r[:4]), []  # a row for each `part` bytes
    for i, (name, size, begin, end, d0, s0, d1, s1, blank) in enumerate(known):
        if i == 0 or known[i - 1][0] != name:
            inside, depth, begun = False, 0, False
        states.append((name, size, begin, end, inside, depth, begun))
        inside, depth, begun = (s1, depth + d1, begun) if inside else (s0, depth + d0, begun or not blank)
        if end == size and (i + 1 == len(known) or known[i + 1][0] != name) and (inside or depth or not begun):
            raise ValueError("a JSON array is cut short" if begun else "not a JSON array")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, *state in pdf.itertuples(index=False):
                with open_file(name) as f:
                    out: list[bytes | None] = []
                    for element in _elements(f, *state, most):
                        out.append(element)
                        if len(out) == 1000:
                            yield pd.DataFrame({"value": [x and x.decode("utf-8") for x in out], "large": [x is None for x in out]})
                            out = []
                if out:
                    yield pd.DataFrame({"value": [x and x.decode("utf-8") for x in out], "large": [x is None for x in out]})

    table = spark.createDataFrame(states, "path string, size long, begin long, end long, inside boolean, depth long, begun boolean")
    return table.repartition(max(1, len(states))).mapInPandas(read, "value string, large boolean")


class _Piece(InputPartition):
    def __init__(self, archive: str, member: str, offset: int, size: int, begin: int, end: int) -> None:
        self.archive, self.member, self.offset, self.size, self.begin, self.end = archive, member, offset, size, begin, end


class _TarReader(DataSourceReader):
    def __init__(self, archives: list[str], part: int, members: str = "") -> None:
        self.archives, self.part, self.members = archives, part, re.compile(members)

    def partitions(self) -> list[_Piece]:
        """Members of the archives by their headers, cut into ranges; members that are not asked for have none."""
        pieces = []
        for archive in self.archives:
            with open_file(archive) as f, tarfile.open(fileobj=f, mode="r:") as t:
                pieces += [_Piece(archive, m.name, m.offset_data, m.size, a, min(m.size, a + self.part)) for m in t if m.isfile() and self.members.search(m.name) for a in range(0, m.size, self.part)]
        return pieces

    def read(self, piece: _Piece) -> Iterator[tuple]:
        """The lines that begin in the piece, to their ends."""
        with open_file(piece.archive) as f:
            at = piece.begin
            f.seek(piece.offset + max(0, at - 1))
            held, begun = b"", at == 0
            read = max(0, at - 1)
            while True:
                more = f.read(min(1 << 20, piece.size - read))
                read += len(more)
                held += more
                lines = held.split(b"\n")
                held = lines.pop() if more else b""
                for line in lines:
                    if begun:
                        if at >= piece.end:
                            return
                        if line or at + len(line) < piece.size:
                            yield piece.archive, piece.member, at, line.decode("utf-8").rstrip("\r")
                        at += len(line) + 1
                    else:  # the rest of a line that began before; its break may be the byte before the piece
                        at, begun = at + len(line), True
                if not more or (begun and at >= piece.end):
                    return


class TarLines(DataSource):
    """The lines of text members of uncompressed tar files as (archive, member, at, line); `at` is the line's byte
    in its member. Options: `archives` (paths, one a line), `part` (bytes a task) and `members` (a pattern: others are not
    read). Filters are not pushed: Spark 4.1 keeps a Python source's pushed filters for later reads of the same DataFrame."""

    @classmethod
    def name(cls) -> str:
        return "tar_lines"

    def schema(self) -> str:
        return "archive string, member string, at long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options["archives"].split("\n"), int(self.options.get("part", PART)), self.options.get("members", ""))


def read_tar_lines(spark: SparkSession, path: str, part: int = PART, members: str = "") -> DataFrame:
    """The lines of the text members whose names match a pattern, of the archives under a path or pattern."""
    spark.dataSource.register(TarLines)
    return spark.read.format("tar_lines").option("archives", "\n".join(p for p, _ in files_of(spark, path))).option("part", part).option("members", members).load()
