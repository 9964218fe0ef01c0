"""One JSON array as a table, read by many tasks.

A file is cut into chunks of equal size. Where a chunk begins, nothing tells whether that is inside a
text or how deep, so a first pass lets every chunk report both cases: what it does to the depth when
it begins inside a text and when outside, and how many quotes it holds. The reports, one row a chunk,
are put together in order, and a second pass reads each chunk with the state it really begins in. A
record belongs to the chunk it begins in, whose task reads on to its end. Small chunks share a task.

Between records nothing but commas may stand; what breaks that rule fails with its place in the file.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from parley.sources import files

CHUNK = 32 << 20
TASKS = 64  # at least so many where there are as many chunks
ROWS = "file string, place long, value string"
QUOTE, SLASH, COMMA = b'"\\,'
OPEN, CLOSE, BEGIN, END = b"[]{}"
_SPACE = np.isin(np.arange(256), list(b" \t\r\n"))


class _File:
    def __init__(self, path: str):
        system, inner = files.at(path)
        self.source = system.open_input_file(inner)
        self.size = self.source.size()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.source.close()

    def bytes(self, begin: int, end: int) -> np.ndarray:
        data = self.source.read_at(max(0, min(end, self.size) - begin), begin)
        out = np.frombuffer(data, np.uint8)
        if begin == 0 and bytes(out[:3]) == b"\xef\xbb\xbf":
            out = np.concatenate([np.full(3, 32, np.uint8), out[3:]])
        return out

    def slashes_before(self, place: int) -> int:
        """How many backslashes stand right before a place."""
        n, reach = 0, 64
        while place > 0:
            data = self.source.read_at(min(reach, place), max(0, place - reach))
            bare = data.rstrip(b"\\")
            n += len(data) - len(bare)
            if bare:
                break
            place, reach = max(0, place - reach), reach * 4
        return n


def _quotes(data: np.ndarray, slashes: int) -> np.ndarray:
    """Places of quotes that no backslash escapes; ``slashes`` of them stand before the data."""
    found = np.flatnonzero(data == QUOTE)
    if not len(found):
        return found
    place = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != SLASH, place, -1))
    last = np.where(found > 0, other[np.maximum(found - 1, 0)], -1)
    run = found - 1 - last + np.where(last < 0, slashes, 0)
    return found[run % 2 == 0]


def _steps(data: np.ndarray) -> np.ndarray:
    return (((data == OPEN) | (data == BEGIN)).astype(np.int8) - ((data == CLOSE) | (data == END))).astype(np.int64)


def report(path: str, begin: int, end: int) -> tuple[int, int, int]:
    """Quotes of a chunk, and what it adds to the depth if it begins outside and inside a text."""
    with _File(path) as source:
        data = source.bytes(begin, end)
        quotes = _quotes(data, source.slashes_before(begin))
    inside = np.searchsorted(quotes, np.arange(len(data))) % 2 == 1
    steps = _steps(data)
    return len(quotes), int(steps[~inside].sum()), int(steps[inside].sum())


def records_of(path: str, begin: int, end: int, inside: bool, depth: int) -> Iterator[tuple[int, str]]:
    """``(place, text)`` of the records that begin in a chunk, given the state it begins in."""
    with _File(path) as source:
        slashes, ahead = source.slashes_before(begin), 1 << 16
        while True:
            data = source.bytes(begin, end + ahead)
            whole = begin + len(data) >= source.size
            tokens = _tokens(path, data, begin, slashes, inside, depth)
            mine = [i for i, (place, _) in enumerate(tokens) if place < end - begin]
            if whole or not mine or mine[-1] + 2 < len(tokens):
                break  # the last token of the chunk has its successor, and a record its end
            ahead *= 4
    if begin == 0 and not tokens:
        raise ValueError(f"{path} does not hold a list")
    for i in mine:
        place, kind = tokens[i]
        after = tokens[i + 1] if i + 1 < len(tokens) else None
        if kind == "]":
            if after is not None:
                raise ValueError(f"{path}: something after the list, at byte {begin + after[0]}")
            continue
        if after is None:
            raise ValueError(f"{path} breaks off at byte {source.size}")
        if after[1] not in {"[": "{]", "{": "}", "}": ",]", ",": "{"}[kind]:
            raise ValueError(f"{path}: unexpected {after[1]!r} at byte {begin + after[0]}")
        if kind == "{":
            yield begin + place, data[place:after[0] + 1].tobytes().decode()


def _tokens(path: str, data: np.ndarray, begin: int, slashes: int, inside: bool, depth: int) -> list[tuple[int, str]]:
    """Brackets and commas around records, with their places; anything else there is an error."""
    quotes = _quotes(data, slashes)
    out = (np.searchsorted(quotes, np.arange(len(data))) % 2 == 1) == inside
    steps = np.where(out, _steps(data), 0)
    before = depth + np.cumsum(steps) - steps
    solid = out & ~_SPACE[data]
    close = solid & (before == 2) & (data == END)
    place = np.flatnonzero(solid & (before <= 1) | close)
    found = []
    for p, b, d in zip(place.tolist(), data[place].tolist(), before[place].tolist()):
        good = b == OPEN if d == 0 else b in (BEGIN, CLOSE, COMMA) if d == 1 else True
        if not good or d < 0:
            if d <= 0 and begin + p == 0 or d == 0 and not found and begin == 0:
                raise ValueError(f"{path} does not hold a list")
            raise ValueError(f"{path}: no record at byte {begin + p}")
        found.append((p, chr(b)))
    return found


@dataclass
class _Chunks(InputPartition):
    chunks: list[list]  # [path, begin, end, inside, depth]


class JsonArraySource(DataSource):
    """Data source ``json_array``; its option ``chunks`` holds the plan that :func:`read` makes."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["chunks"]))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, chunks: list[list]):
        self.chunks = chunks

    def partitions(self) -> list[InputPartition]:
        return [_Chunks(part) for part in _dealt(self.chunks, lambda c: c[2] - c[1])]

    def read(self, part: _Chunks) -> Iterator[tuple]:
        for path, *where in part.chunks:
            for place, value in records_of(path, *where):
                yield path, place, value


def _dealt(chunks: list, size: Callable[[Any], int]) -> list[list]:
    """Consecutive chunks put together up to a ``TASKS``-th of all bytes, ``CHUNK`` at most."""
    most = min(CHUNK, sum(map(size, chunks)) // TASKS)
    out, held = [], 0
    for chunk in chunks:
        if not out or held + size(chunk) > most:
            out.append([])
            held = 0
        out[-1].append(chunk)
        held += size(chunk)
    return out


class _Writer(DataSourceArrowWriter):
    """An array per task, shown when all are written."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> files.Written:
        hidden = files.Hidden()
        try:
            with hidden.create(self.path, f"part-{TaskContext.get().partitionId():05d}-{hidden.mark[:8]}.json") as out:
                lead = "["
                for batch in batches:
                    for text in batch.column(0).to_pylist():
                        out.write(f"{lead}\n{text}".encode())
                        lead = ","
                out.write(b"[]" if lead == "[" else b"\n]")
        except BaseException:
            hidden.drop()
            raise
        return files.Written(hidden.files, {})

    def commit(self, messages: list) -> None:
        files.reveal(messages)

    def abort(self, messages: list) -> None:
        for message in messages:
            if message:
                files.discard(message.files)


def write(df: DataFrame, path: str, record: str = "record") -> None:
    """Texts of records as a folder of arrays, one file a task."""
    df.sparkSession.dataSource.register(JsonArraySource)
    df.selectExpr(f"`{record}` AS value").write.format("json_array").option("path", path).mode("append").save()


def plan(spark: SparkSession, path: str, chunk: int = CHUNK) -> list[list]:
    """``[path, begin, end, inside, depth]`` of every chunk: the first pass."""
    cuts = [(i, name, at, min(at + chunk, size)) for i, (name, size) in enumerate(files.listed(path))
            for at in range(0, max(size, 1), chunk)]
    for name, size in files.listed(path):
        with _File(name) as source:
            head = source.bytes(0, 1 << 16)
        head = head[~_SPACE[head]]
        if len(head) and head[0] != OPEN or not size:
            raise ValueError(f"{name} does not hold a list")
    if len(cuts) == 1:
        return [[*cuts[0][1:], False, 0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, out, within = report(row["path"], row["begin"], row["end"])
                yield pa.RecordBatch.from_pylist([{**row, "quotes": q, "outside": out, "inside": within}])

    schema = "number long, path string, begin long, end long"
    tasks = len(_dealt(cuts, lambda c: c[3] - c[2]))
    found = (spark.createDataFrame(cuts, schema).repartition(tasks)
             .mapInArrow(run, schema + ", quotes long, outside long, inside long").collect())
    chunks, state = [], {}
    for r in sorted(found, key=lambda r: (r.number, r.begin)):
        inside, depth = state.get(r.number, (False, 0))
        chunks.append([r.path, r.begin, r.end, inside, depth])
        state[r.number] = (inside ^ (r.quotes % 2 == 1), depth + (r.inside if inside else r.outside))
    return chunks


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``file, place, value``: the records of a file, or of a folder of files, each one JSON array."""
    spark.dataSource.register(JsonArraySource)
    return spark.read.format("json_array").option("chunks", json.dumps(plan(spark, path, chunk))).load()
