"""Records of large text files whose ends cannot be told from a place in the middle, read in byte ranges.

A line break may lie inside quotes, and an element of one big JSON array may hold any other sign. What
a byte means depends on all bytes before it, but only through a small state: whether a quoted text is
open and, in JSON, how deep brackets are nested. So a file is read twice. First every range tells what
it does to the state, for both states of the quotes; these rows, one per range, are put together in
order. Then each range starts in its true state and gives the records that begin in it, reading on
into the next ranges until the last of them ends. A range is gone through in blocks, so no task holds
more than a block, what it makes of it, and one record.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = 32 << 20
#: Bytes read and looked at together, within a range and beyond its end; working memory is about forty times that.
AHEAD = 1 << 20
#: Records handed on together, at most, and the bytes after which fewer are.
BATCH, BATCH_BYTES = 10_000, 4 << 20
_BACKSLASH, _QUOTE, _NEWLINE, _COMMA = (ord(c) for c in '\\"\n,')
_OPENING, _CLOSING = (np.isin(np.arange(256), [ord(c) for c in signs]) for signs in ("[{", "]}"))


class Signs:
    """Which bytes of a block are quotes, and, outside of quotes, what nests and what separates."""

    def __init__(self, data: np.ndarray, quoted: bool, json: bool, escaped: bool = False):
        marks = data == _QUOTE
        self.escaped_next = escaped and not len(data)
        if json:  # a byte after an odd number of backslashes stands for itself
            slashes = np.flatnonzero(data == _BACKSLASH)
            starts = slashes[np.diff(slashes, prepend=-2) > 1]
            run = slashes - starts[np.searchsorted(starts, slashes, side="right") - 1]
            if escaped and len(starts) and starts[0] == 0:
                run = run + (np.searchsorted(starts, slashes, side="right") == 1)
            active = slashes[run % 2 == 0]
            literal = active[active + 1 < len(data)] + 1
            marks[literal] = False
            if escaped and len(data):
                marks[0] = False
            self.escaped_next = bool(len(active) and active[-1] == len(data) - 1)
        inside = (np.cumsum(marks) + quoted) % 2 == 1  # of a quote itself: the state after it
        self.quoted = bool(inside[-1]) if len(data) else quoted
        self.outside = ~inside & ~marks
        if json:
            opens, closes = _OPENING[data] & self.outside, _CLOSING[data] & self.outside
            self.depth = np.cumsum(opens.astype(np.int64) - closes)  # after each byte
            self.opens, self.closes = opens, closes


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, length, start) of every range of the files."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    return _dealt(files.select("path", "length", starts.alias("start")))


def _dealt(ranges: DataFrame) -> DataFrame:
    """The rows are tiny and the work behind them is not, so their tasks are not to be put together by size."""
    return ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")


def _opened(path: str) -> pa.NativeFile:
    """A file by the path that Spark gives, in which no sign is escaped."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    scheme, _, rest = path.partition("://")
    system, inner = fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return system.open_input_file(inner)


def _read(file: pa.NativeFile, start: int, size: int) -> np.ndarray:
    return np.frombuffer(file.read_at(size, start), dtype=np.uint8)


def _begins_escaped(file: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes ends just before ``start``."""
    count = 0
    while start > 0:
        step = min(start, AHEAD)
        before = _read(file, start - step, step)
        others = np.flatnonzero(before != _BACKSLASH)
        count += step if not len(others) else step - 1 - int(others[-1])
        if len(others):
            break
        start -= step
    return count % 2 == 1


def _change(file: pa.NativeFile, start: int, stop: int, json: bool, escaped: bool, step: int) -> tuple[bool, list[int]]:
    """Whether the bytes hold an odd number of quotes, and by how much they nest deeper if a quoted text is not and is open before."""
    quoted, change = [False, True], [0, 0]
    for place in range(start, stop, step):
        data = _read(file, place, min(step, stop - place))
        if not len(data):
            break
        for i in (0, 1):
            signs = Signs(data, quoted[i], json, escaped)
            quoted[i] = signs.quoted
            change[i] += int(signs.depth[-1]) if json else 0
        escaped = signs.escaped_next
    return quoted[0], change


def _cuts(data: np.ndarray, signs: Signs, json: bool, depth: int) -> np.ndarray:
    """Places of separators; what is between two of them is a record, if it is not blank."""
    if not json:
        return np.flatnonzero((data == _NEWLINE) & signs.outside)
    deep = signs.depth + depth
    opens = signs.opens & (deep == 1)
    return np.flatnonzero(((data == _COMMA) & signs.outside & (deep <= 1)) | opens | (signs.closes & (deep <= 0)))


def _begun(file: pa.NativeFile, row: dict, size: int, json: bool, step: int) -> Iterator[bytes]:
    """The records that begin in a range, in order; ``row`` tells its file, place and true state."""
    place, stop, length = row["start"], row["start"] + size, row["length"]
    quoted, escaped, depth = row["quoted"], row["escaped"], row["depth"]
    tail = [] if not json and place == 0 else None  # of the record that is open; None before the first
    unseen = json and place == 0
    while place < min(stop, length) or (tail is not None and place < length):
        data = _read(file, place, min(step, stop - place) if place < stop else step)
        if not len(data):
            break
        signs = Signs(data, quoted, json, escaped)
        at = _cuts(data, signs, json, depth).tolist()
        raw = data.tobytes()
        if unseen:
            sign = (raw.removeprefix(codecs.BOM_UTF8) if place == 0 else raw).lstrip()[:1]
            if sign not in (b"[", b""):
                raise ValueError(f"{row['path']} is not an array")
            unseen = not sign
        if place >= stop and at:
            tail.append(raw[: at[0]])
            break
        done = 0
        for cut in at:
            if tail is not None:
                tail.append(raw[done:cut])
                yield b"".join(tail)
            tail, done = [], cut + 1
        if tail is not None:
            tail.append(raw[done:])
        place, quoted, escaped = place + len(data), signs.quoted, signs.escaped_next
        depth += int(signs.depth[-1]) if json else 0
    if tail is not None:
        yield b"".join(tail)


def _states(ranges: DataFrame, size: int, json: bool) -> DataFrame:
    """Add ``quoted`` and ``depth``: the state in which each range begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file:
                    escaped = json and _begins_escaped(file, row["start"])
                    odd, change = _change(file, row["start"], row["start"] + size, json, escaped, AHEAD)
                columns = [[row["path"]], [row["length"]], [row["start"]], [odd], [escaped], [change[0]], [change[1]]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
                names = ["path", "length", "start", "odd", "escaped", "outer", "inner"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    told = ranges.mapInArrow(
        run, "path string, length long, start long, odd boolean, escaped boolean, outer long, inner long"
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    opened = told.withColumn("quoted", F.coalesce(F.sum(F.col("odd").cast("long")).over(before), F.lit(0)) % 2 == 1)
    depth = F.coalesce(F.sum(F.when(F.col("quoted"), F.col("inner")).otherwise(F.col("outer"))).over(before), F.lit(0))
    return _dealt(opened.withColumn("depth", depth).select("path", "length", "start", "quoted", "escaped", "depth"))


def _records(ranges: DataFrame, size: int, json: bool, schema: str, rows: Callable) -> DataFrame:
    """The records of each range, by ``rows(raw records) -> RecordBatch``.

    A record begins at the start of the file or after a separator: a line break outside quotes, or in
    JSON a comma or bracket of the outermost array. It belongs to the range its separator lies in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["path"] if row["start"] == 0 else None
                found, held = [], 0
                with _opened(row["path"]) as file:
                    for record in _begun(file, row, size, json, AHEAD):
                        found.append(record)
                        held += len(record)
                        if len(found) == BATCH or held >= BATCH_BYTES:
                            yield rows(found, first)
                            found, held, first = [], 0, None
                if found:
                    yield rows(found, first)

    return ranges.mapInArrow(run, schema)


def json_elements(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The elements of the arrays in the files, each as the text it has there (``value``).

    What is cut off by the end of its file, follows a bracket too many or stands behind the array is a
    row as well, so that whoever parses it can refuse it. A file that begins with another sign than an
    opening bracket is an error.
    """

    def rows(raw: list[bytes], first: str | None) -> pa.RecordBatch:
        texts = [r.strip().decode(errors="replace") for r in raw]
        return pa.RecordBatch.from_arrays([pa.array([t for t in texts if t], pa.string())], ["value"])

    return _records(_states(_ranges(spark, path, size), size, True), size, True, "value string", rows)


def delimited_fields(
    spark: SparkSession, path: str, header: list[str], sep: str = ",", size: int = RANGE
) -> DataFrame:
    """The records of delimited files: ``fields`` (list of texts) and ``line``, the whole as it stands there.

    Quoted line breaks are part of a field, quotes inside quoted text are doubled, and a quote stands
    nowhere else. The first record of each file must be the header and is left out.
    """

    def rows(raw: list[bytes], first: str | None) -> pa.RecordBatch:
        csv.field_size_limit(2**31 - 1)
        texts = [t for t in (line.removesuffix(b"\r").decode(errors="replace") for line in raw) if t]
        fields = [next(csv.reader(io.StringIO(t, newline=""), delimiter=sep)) for t in texts]
        if first is not None and fields:
            names = [fields[0][0].removeprefix("\ufeff"), *fields[0][1:]]
            if names != header:
                raise ValueError(f"{first} has another header than {', '.join(header)}")
            fields, texts = fields[1:], texts[1:]
        return pa.RecordBatch.from_arrays(
            [pa.array(fields, pa.list_(pa.string())), pa.array(texts, pa.string())], ["fields", "line"]
        )

    states = _states(_ranges(spark, path, size), size, False)
    return _records(states, size, False, "fields array<string>, line string", rows)
