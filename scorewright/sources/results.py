"""Data sources for result files: large JSON documents by their two ends, and the members of zip archives.

Both list their inputs once and read them in tasks, one partition a file (or a run of an archive's members).  They go by
any address that pyarrow's file systems take, such as ``file:``, ``hdfs:`` or ``s3:``; register them with :func:`register`.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read from each end of a file, and of an archive's member at most by default.
END_BYTES, MEMBER_BYTES = 1 << 16, 1 << 26
_BLANK = " \t\r\n"


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _files(uri: str, suffix: str) -> list[tuple[str, str, int, int]]:
    """(address, path, bytes, modified) of a file, or of a folder's files with the suffix, by path."""
    from pyarrow import fs

    system, path = _system(uri)
    found = system.get_file_info(path)
    if found.type == fs.FileType.Directory:
        infos = [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(suffix)]
    elif found.type == fs.FileType.File:
        infos = [found]
    else:
        raise FileNotFoundError(uri)
    return sorted((uri, i.path, i.size, i.mtime_ns or 0) for i in infos)


# --- the two ends of a JSON document


def _past(text: str, at: int, signs: str = _BLANK) -> int:
    while at < len(text) and text[at] in signs:
        at += 1
    return at


def head_members(text: str) -> tuple[dict[str, Any], list[str]]:
    """Members that end within the first part of a document, and the keys of the values that the cut leaves open.

    An object that is cut keeps the members that it has so far; a list, text or number that is cut has none.
    """
    decoder, found, names = json.JSONDecoder(), {}, []
    here, at, n = found, _past(text, 0), len(text)
    if at >= n or text[at] != "{":
        return found, names
    at += 1
    while (at := _past(text, at, _BLANK + ",")) < n and text[at] == '"':
        try:
            key, after = decoder.raw_decode(text, at)
        except ValueError:
            break
        after = _past(text, after)
        if after >= n or text[after] != ":" or (after := _past(text, after + 1)) >= n:
            break
        try:
            value, end = decoder.raw_decode(text, after)
            whole = end < n or isinstance(value, (dict, list, str))  # a number at the edge may go on
        except ValueError:
            whole = False
        if whole:
            here[key], at = value, end
            continue
        names.append(key)
        if text[after] != "{":
            break
        here[key] = {}
        here, at = here[key], after + 1
    return found, names


def tail_members(text: str) -> list[dict[str, Any]]:
    """Members of the objects that are open where the last part of a document begins, the outermost first.

    The document is read backwards from its end, where no string is open.  Lists have no members.
    """
    levels: list[tuple[int, str, list[int]]] = []  # where it closes, how, and the commas seen inside
    at = len(text) - 1
    while at >= 0:
        c = text[at]
        if c == '"':
            at -= 1
            while at >= 0:
                at = text.rfind('"', 0, at + 1)
                slashes = at - len(text[:at].rstrip("\\")) if at > 0 and text[at - 1] == "\\" else 0
                if at < 0 or slashes % 2 == 0:
                    break
                at -= 1
            if at < 0:
                break  # the cut is in a string
        elif c in "}]":
            levels.append((at, c, []))
        elif c in "{[":
            if len(levels) <= 1:
                # The outermost object begins here: all of its members are known.
                if levels and c == "{":
                    levels[-1][2].append(at)
                break
            levels.pop()
        elif c == "," and levels:
            levels[-1][2].append(at)
        at -= 1
    out = []
    for close, kind, commas in levels:
        members: dict[str, Any] = {}
        if kind == "}" and commas:
            try:
                members = json.loads("{" + text[commas[-1] + 1 : close] + "}")
            except ValueError:
                members = {}
        out.append(members)
    return out


def _merged(below: dict, over: dict) -> dict:
    for key, value in over.items():
        below[key] = _merged(below[key], value) if isinstance(below.get(key), dict) and isinstance(value, dict) else value
    return below


def joined_ends(head: str, tail: str) -> dict[str, Any]:
    """What is known of a document from its first and last parts.

    Objects that both parts leave open are taken as one: those of the last part hang under the keys at which the first
    part was cut.
    """
    found, names = head_members(head)
    for depth, members in enumerate(tail_members(tail)):
        if not members or depth > len(names):
            continue
        here = found
        for key in names[:depth]:
            here = here.setdefault(key, {})
            if not isinstance(here, dict):
                break
        else:
            _merged(here, members)
    return found


class _File(InputPartition):
    def __init__(self, *value: Any) -> None:
        super().__init__(value)


class JsonEnds(DataSource):
    """``json_ends``: path, size, whole, body; the body is JSON of what the two ends of a file hold.

    Options: ``bytes`` of each end.  Files of up to twice that are read whole; one that is no JSON object has no body.
    """

    @classmethod
    def name(cls) -> str:
        return "json_ends"

    def schema(self) -> str:
        return "path string, size long, whole boolean, body string"

    def reader(self, schema) -> DataSourceReader:
        return _EndsReader(dict(self.options))


class _EndsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.bytes = options["path"], int(options.get("bytes", END_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [_File(*f) for f in _files(self.uri, ".json")] or [_File(self.uri, None, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        uri, path, size, _ = partition.value
        if path is None:
            return
        with _system(uri)[0].open_input_file(path) as file:
            whole = size <= 2 * self.bytes
            head = file.read(size if whole else self.bytes)
            tail = b"" if whole else (file.seek(size - self.bytes), file.read(self.bytes))[1]
        try:
            body = json.loads(head) if whole else joined_ends(head.decode("utf-8", "ignore"), tail.decode("utf-8", "ignore"))
        except ValueError:
            body = None
        yield path, size, whole, json.dumps(body, ensure_ascii=False) if isinstance(body, dict) and body else None


# --- members of archives


class ZipMembers(DataSource):
    """``zip_members``: archive, member, size, modified, ordinal, body; the texts of an archive's members.

    Options: ``suffix`` of the members (.json), ``bytes`` (a larger member has a null body), ``members`` a partition.
    A damaged archive gives no rows if ``skip_damaged`` is true, else it is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, size long, modified long, ordinal int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(dict(self.options))


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.suffix = options["path"], options.get("suffix", ".json")
        self.bytes, self.run = int(options.get("bytes", MEMBER_BYTES)), int(options.get("members", 1000))
        self.skip = options.get("skip_damaged", options.get("skipdamaged", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri, path, _, modified in _files(self.uri, ".zip"):
            try:
                with _system(uri)[0].open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                    n = len(archive.infolist())  # the directory at the archive's end
            except (zipfile.BadZipFile, ValueError):  # the latter where a file is shorter than an archive can be
                if not self.skip:
                    raise
                continue
            out += [_File(uri, path, modified, lo) for lo in range(0, n, self.run)]
        return out or [_File(self.uri, None, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        uri, path, modified, lo = partition.value
        if path is None:
            return
        with _system(uri)[0].open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            for at, info in enumerate(archive.infolist()[lo : lo + self.run], lo):
                if info.is_dir() or not info.filename.endswith(self.suffix):
                    continue
                body = archive.read(info).decode("utf-8", "replace") if info.file_size <= self.bytes else None
                yield path, info.filename, info.file_size, modified, at, body


def register(spark: SparkSession) -> None:
    for source in (JsonEnds, ZipMembers):
        spark.dataSource.register(source)


def read_ends(spark: SparkSession, path: str, bytes_: int = END_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("json_ends").option("bytes", bytes_).load(path)


def read_archives(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    register(spark)
    return spark.read.format("zip_members").options(**options).load(path)


def last_results(members: DataFrame) -> DataFrame:
    """One row for each (model, benchmark) of archives: of several the one in the archive modified last, then the later member.

    The model is the first folder of a member, empty without one; the benchmark is the file's stem up to two underscores.
    """
    folder = F.regexp_extract("member", r"^([^/]+)/", 1)
    named = members.withColumns({"model": folder, "benchmark": F.regexp_extract("member", r"([^/]+?)(?:__[^/]*)?\.[A-Za-z]+$", 1)})
    last = named.groupBy("model", "benchmark").agg(F.max_by(F.struct("archive", "member", "size", "body"), F.struct("modified", "archive", "ordinal")).alias("row"))
    return last.select("model", "benchmark", "row.*")
