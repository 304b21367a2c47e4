"""Paged documents as a Spark data source and sink, with an injected parser.

``document_source(name, parser, schema)`` makes the class that ``spark.dataSource.register`` takes; then
``spark.read.format(name).load(path)`` gives a row a page. Planning lists names and sizes; only documents over ``split_bytes``
are opened, to be cut into ranges of pages, and small ones share a task. A schema given to the reader is the list of columns
that the parser is asked for. With the option ``conditions`` and spark.sql.python.filterPushdown.enabled both true, conditions on
the page number leave out pages before they are parsed.

The sink writes one file of JSON lines a task to a staging folder; the job's commit moves them, its abort deletes them, so a task
or job that fails leaves no file. Paths are those of pyarrow's file systems (local, hdfs, s3, gcs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes of documents in a task, and documents over which are cut by pages.
SPLIT_BYTES = 64 << 20


class Parser(Protocol):
    """What reads one kind of document. ``columns`` are the columns that are asked for; others need not be worked out."""

    def count(self, data: bytes) -> int: ...

    def pages(self, data: bytes, first: int, last: int, columns: list[str]) -> Iterator[dict]: ...


class JsonPages:
    """Documents of one JSON object a line, a page each: the form that the sink writes."""

    def count(self, data: bytes) -> int:
        return sum(1 for line in data.split(b"\n") if line.strip())

    def pages(self, data: bytes, first: int, last: int, columns: list[str]) -> Iterator[dict]:
        lines = [line for line in data.split(b"\n") if line.strip()]
        for line in lines[first:last]:
            yield json.loads(line)


@dataclass
class Ranges(InputPartition):
    """Documents and the pages of each, first inclusive and last exclusive; no last page means all."""

    parts: list[tuple[str, int, int | None]]


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "hdfs:")) else (fs.LocalFileSystem(), path)


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """Names and sizes of the files below a path, in order of names; hidden ones are left out."""
    from pyarrow import fs

    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    shown = lambda i: not any(p.startswith(("_", ".")) for p in i.path[len(at) :].split("/"))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and shown(i) and i.path.endswith(ending))


def content(path: str, file: str) -> bytes:
    with opened(path)[0].open_input_stream(file) as f:
        return f.read()


class PageReader(DataSourceReader):
    def __init__(self, options: dict, parser: Parser, schema: StructType):
        self.path, self.ending = options["path"], options.get("ending", "")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.parser, self.columns = parser, schema.names
        self.low, self.high = 0, None

    def _between(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)

    def partitions(self) -> Sequence[Ranges]:
        out, held, size = [], [], 0
        for file, n in listed(self.path, self.ending):
            if n > self.split:
                pages = self.parser.count(content(self.path, file))
                each = max(1, -(-pages * self.split // n))
                out += [Ranges([(file, k, min(k + each, pages))]) for k in range(0, pages, each) if k + each > self.low and (self.high is None or k < self.high)]
                continue
            held.append((file, 0, None))
            size += n
            if size >= self.split:
                out.append(Ranges(held))
                held, size = [], 0
        return out + ([Ranges(held)] if held or not out else [])

    def read(self, partition: Ranges) -> Iterator[tuple]:
        wanted = [c for c in self.columns if c not in ("path", "page_no")]
        for file, first, last in partition.parts:
            data = content(self.path, file)
            low = max(first, self.low)
            high = min(x for x in (last, self.high, self.parser.count(data) if last is None else last) if x is not None)
            for k, page in enumerate(self.parser.pages(data, low, high, wanted) if low < high else ()):
                yield tuple(file if c == "path" else low + k if c == "page_no" else page.get(c) for c in self.columns)


class ConditionedReader(PageReader):
    """A reader that is told conditions; Spark asks for them to be switched on in the session too."""

    def pushFilters(self, filters) -> Iterable:
        """Conditions that bound page_no are met by the ranges; Spark applies the others."""
        for f in filters:
            if getattr(f, "attribute", None) != ("page_no",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self._between(f.value, f.value + 1)
            elif isinstance(f, GreaterThan):
                self._between(f.value + 1, None)
            elif isinstance(f, GreaterThanOrEqual):
                self._between(f.value, None)
            elif isinstance(f, LessThan):
                self._between(0, f.value)
            elif isinstance(f, LessThanOrEqual):
                self._between(0, f.value + 1)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class JsonWriter(DataSourceWriter):
    """One staged file a task; a task without rows writes none."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        system, _, stage = self._stage()
        system.create_dir(stage, recursive=True)  # here, not in tasks: one that runs on after an abort finds no folder

    def _stage(self) -> tuple:
        system, at = opened(self.path)
        return system, at, f"{at}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, stage = self._stage()
        name, rows = f"part-{uuid.uuid4().hex}.json", 0
        try:
            with system.open_output_stream(f"{stage}/{name}") as out:
                for row in iterator:
                    out.write(json.dumps(row.asDict(True), ensure_ascii=False, default=str).encode() + b"\n")
                    rows += 1
        except BaseException:  # the staged file of a failed try goes at once
            system.delete_file(f"{stage}/{name}")
            raise
        if not rows:
            system.delete_file(f"{stage}/{name}")
        return Written(name if rows else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, at, stage = self._stage()
        before = [f for f, _ in listed(self.path, ".json")] if self.overwrite else []
        for m in messages:
            if m is not None and m.file:
                system.move(f"{stage}/{m.file}", f"{at}/{m.file}")
        for file in before:
            system.delete_file(file)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        system, _, stage = self._stage()
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)


def document_source(format_name: str, parser: Parser | None = None, columns: str = "") -> type[DataSource]:
    """A data source of that name: path and page_no of every page, and the columns (a schema string) that the parser gives."""
    reads = parser or JsonPages()
    fields = ", ".join(filter(None, ["path string, page_no int", columns]))

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return fields

        def reader(self, schema: StructType) -> PageReader:
            told = self.options.get("conditions", "false").lower() == "true"
            return (ConditionedReader if told else PageReader)(dict(self.options), reads, schema)

        def writer(self, schema: StructType, overwrite: bool) -> JsonWriter:
            return JsonWriter(dict(self.options), overwrite)

    return Documents
