"""Records of arrays that lie deep in large JSON files, read as a stream: one task a file, and one record held at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scorewright.sources.results import _File, _files, _system

#: Characters read at once; where records usually stand, the first array that a file has counts.
PIECE = 1 << 20
PATHS = ("evaluation.records", "records", "evaluation.run_outputs.records", "run_outputs.records", "samples")
_SIGN, _QUOTE, _END = re.compile(r'["{}\[\]]'), re.compile(r'["\\]'), re.compile(r"[,}\]\s]")


class _Text:
    """A text file of which only what is being read is held."""

    def __init__(self, file) -> None:
        import codecs

        self.file, self.decode = file, codecs.getincrementaldecoder("utf-8")("replace")
        self.held, self.at, self.kept = "", 0, None

    def more(self) -> bool:
        raw = self.file.read(PIECE)
        start = self.at if self.kept is None else self.kept
        self.held, self.at = self.held[start:] + self.decode.decode(raw, not raw), self.at - start
        self.kept = None if self.kept is None else 0
        return bool(raw)

    def peek(self) -> str:
        """The next character that is not white space; empty at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def find(self, pattern: re.Pattern) -> str:
        """Moves past the next match and returns it."""
        while not (m := pattern.search(self.held, self.at)):
            self.at = len(self.held)
            if not self.more():
                raise ValueError("the document ends too early")
        self.at = m.end()
        return m.group()

    def string(self) -> None:
        """Moves past a string whose first quote has been read."""
        while self.find(_QUOTE) == "\\":
            if self.at >= len(self.held) and not self.more():
                raise ValueError("the document ends in a string")
            self.at += 1

    def value(self) -> None:
        """Moves past one value."""
        first = self.peek()
        if not first:
            raise ValueError("the document ends before a value")
        if first not in '"{[':
            while not (m := _END.search(self.held, self.at)):
                self.at = len(self.held)
                if not self.more():
                    return
            self.at = m.start()
            return
        depth = 0
        while True:
            sign = self.find(_SIGN)
            if sign == '"':
                self.string()
            else:
                depth += 1 if sign in "{[" else -1
            if depth == 0:
                return

    def taken(self) -> str:
        """One value as it is written."""
        self.peek()
        self.kept = self.at
        self.value()
        out, self.kept = self.held[self.kept : self.at], None
        return out

    def items(self) -> Iterator[None]:
        """Stands before each item of the list or each key of the object that comes next; the caller reads it."""
        self.at += 1
        while self.peek() not in ("]", "}", ""):
            yield
            if self.peek() == ",":
                self.at += 1
        if not self.peek():
            raise ValueError("the document ends too early")
        self.at += 1


def records_of(text: _Text, path: list[str]) -> Iterator[str]:
    """Items of the arrays at a path of keys, as they are written; a list on the way is gone through item by item."""
    here = text.peek()
    if here == "[" and not path:
        for _ in text.items():
            yield text.taken()
    elif here == "[":
        for _ in text.items():
            yield from records_of(text, path)
    elif here == "{" and path:
        for _ in text.items():
            key = json.loads(text.taken())
            text.peek()
            text.at += 1  # the colon
            if key == path[0]:
                yield from records_of(text, path[1:])
            else:
                text.value()
    else:
        text.value()


class JsonRecords(DataSource):
    """``json_records``: path, array, ordinal, record (JSON); the records of the first of several arrays that a file has.

    Options: ``arrays`` (paths of keys, comma-separated), ``nth`` (that ordinal only; the rest of the file is not read).
    Files without such an array, and what follows a fault in a file, give no rows unless ``strict`` is true.
    """

    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        return "path string, array string, ordinal long, record string"

    def reader(self, schema) -> DataSourceReader:
        return _RecordsReader(dict(self.options))


class _RecordsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.arrays = options["path"], [a for a in options.get("arrays", ",".join(PATHS)).split(",") if a]
        self.nth, self.strict = int(options["nth"]) if "nth" in options else None, options.get("strict", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_File(*f) for f in _files(self.uri, ".json")] or [_File(self.uri, None, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        uri, path, _, _ = partition.value
        for array in self.arrays if path is not None else ():
            found = False
            with _system(uri)[0].open_input_stream(path) as file:
                try:
                    for at, record in enumerate(records_of(_Text(file), array.split("."))):
                        found = True
                        if self.nth is None or at == self.nth:
                            yield path, array, at, record
                        if at == self.nth:
                            return
                except ValueError:
                    if self.strict:
                        raise
            if found:
                return


def read_json_records(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    spark.dataSource.register(JsonRecords)
    return spark.read.format("json_records").options(**options).load(path)
