"""Sources of one's own as Spark data sources: spark.read.format("engram") and spark.readStream.format("engram").

An adapter says what there is up to now (a cursor), cuts what lies between two cursors into splits, and reads a split in a
task. Batches read all splits in parallel, with the filters that the adapter can apply itself; streams keep the cursor as
their offset in the checkpoint, so a restarted stream goes on where it stopped and reads nothing twice. Adapters are named
in ADAPTERS, with the options that they take:

    adapters.read(spark, "chapters", "s3://books/novels").where("chapter = 3")
    adapters.stream(spark, "json", "hdfs:/exports")

Filters are pushed where the session has spark.sql.python.filterPushdown.enabled; results are the same without. Files are listed and read through pyarrow's file systems, so a path may be of any scheme that those know.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

NUMERALS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
_HEAD = re.compile("第([0-9" + "".join([*NUMERALS, *UNITS]) + "]+)([回章])")


def numeral(text: str) -> int:
    """A numeral in Chinese or ASCII digits, 万 included; a unit without a digit counts one, a zero nothing."""
    total = section = digit = 0
    for c in text:
        if c in NUMERALS:
            digit = NUMERALS[c]
        elif c == "万":
            total, section, digit = total + (section + digit or 1) * 10000, 0, 0
        elif c in UNITS:
            section, digit = section + (digit or 1) * UNITS[c], 0
        elif c.isdigit():
            digit = digit * 10 + int(c)
    return total + section + digit


def chapters(text: str) -> list[tuple[int, str]]:
    """(number, body) of a novel, by number: a header counts if its number is over that of the chapter before it, and is not
    0; what stands before the first one is left out. A header may stand anywhere in a line."""
    heads, last = [], 0
    for m in _HEAD.finditer(text.lstrip("﻿")):
        n = numeral(m[1])
        if n > last:
            heads.append((m.start(), m.end(), n))
            last = n
    text = text.lstrip("﻿")
    ends = [h[0] for h in heads[1:]] + [len(text)]
    return [(n, text[body:end].strip()) for (_, body, n), end in zip(heads, ends)]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (fs.LocalFileSystem(), path)


class Files:
    """What is common to adapters of files: a cursor is the time and name of the last file, and a split is a file, or a part
    of one, that came after one cursor and up to another."""

    filters: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.options = options

    def _listed(self) -> list[tuple[int, str]]:
        files, path = _opened(self.path)
        got = files.get_file_info(fs.FileSelector(path, recursive=True)) if files.get_file_info(path).type == fs.FileType.Directory else [files.get_file_info(path)]
        return sorted((f.mtime_ns or 0, f.path) for f in got if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))

    def start(self) -> list:
        return [-1, ""]

    def latest(self) -> list:
        return list(max(self._listed(), default=(-1, "")))

    def splits(self, start: list, end: list) -> list[dict]:
        return [s for t, p in self._listed() if start < [t, p] <= end for s in self.parts(p)]

    def parts(self, path: str) -> list[dict]:
        return [{"file": path}]

    def _text(self, path: str) -> str:
        with _opened(self.path)[0].open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")


class Chapters(Files):
    """Novels, one a file: novel (the file's name), chapter, body. Filters on novel keep other files closed."""

    schema = "novel string, chapter int, body string"
    filters = ("novel", "chapter")

    def splits(self, start: list, end: list) -> list[dict]:
        return [s | {"novel": self.novel(s["file"])} for s in super().splits(start, end)]

    @staticmethod
    def novel(path: str) -> str:
        return re.sub(r"\.[^.]*$", "", path.rpartition("/")[2])

    def rows(self, split: dict) -> Iterator[pa.RecordBatch]:
        got = chapters(self._text(split["file"]))
        yield pa.record_batch([pa.repeat(split["novel"], len(got)), pa.array([n for n, _ in got], pa.int32()), pa.array([b for _, b in got], pa.string())], ["novel", "chapter", "body"])


class JsonRows(Files):
    """Rows of an external store exported as JSON, an array a file or an object a line: id, text, score (0.5 where there is
    none, drawn in to 0 to 1)."""

    schema = "id string, text string, score double"
    filters = ("id", "score")

    def rows(self, split: dict) -> Iterator[pa.RecordBatch]:
        raw = self._text(split["file"]).strip()
        got = json.loads(raw) if raw.startswith("[") else [json.loads(x) for x in raw.splitlines() if x.strip()]
        score = [min(1.0, max(0.0, float(r["score"]))) if r.get("score") is not None else 0.5 for r in got]
        yield pa.record_batch([pa.array([None if r.get("id") is None else str(r["id"]) for r in got], pa.string()), pa.array([r.get("text") for r in got], pa.string()), pa.array(score, pa.float64())], ["id", "text", "score"])


class Vectors(Files):
    """Vectors of an external index kept as Parquet: id, vector, and other columns that the option columns names. A split is
    a row group; one whose statistics rule the filters out is not read."""

    filters = ("id",)

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.id, self.vector = options.get("id", "id"), options.get("vector", "vector")
        self.columns = [c for c in options.get("columns", "").split(",") if c]

    @property
    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        files, (_, first) = _opened(self.path)[0], self._listed()[0]
        with files.open_input_file(first) as f:
            own = pq.read_schema(f)
        names = {self.id: "id", self.vector: "vector"}
        return from_arrow_schema(pa.schema([own.field(c).with_name(names.get(c, c)) for c in (self.id, self.vector, *self.columns)]))

    def parts(self, path: str) -> list[dict]:
        with _opened(self.path)[0].open_input_file(path) as f:
            meta = pq.read_metadata(f)
        at = meta.schema.to_arrow_schema().get_field_index(self.id)
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        return [{"file": path, "group": i} | ({"id": [s.min, s.max]} if s is not None and s.has_min_max else {}) for i, s in enumerate(stats)]

    def rows(self, split: dict) -> Iterator[pa.RecordBatch]:
        with _opened(self.path)[0].open_input_file(split["file"]) as f:
            t = pq.ParquetFile(f).read_row_group(split["group"], columns=[self.id, self.vector, *self.columns])
        t = t.select([self.id, self.vector, *self.columns]).rename_columns(["id", "vector", *self.columns])
        yield from t.to_batches(max_chunksize=4096)


ADAPTERS = {"chapters": Chapters, "json": JsonRows, "vectors": Vectors}

_OPS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def _possible(value, f: Filter) -> bool:
    """Can a split hold a row that passes: value is the one it holds of the filter's column, or [least, largest]."""
    if not isinstance(value, list):
        return _OPS[type(f)](value, f.value)
    low, high = value
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    if isinstance(f, In):
        return any(low <= x <= high for x in f.value)
    return _OPS[type(f)](high if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else low, f.value)


class _Split(InputPartition):
    def __init__(self, value: dict):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, adapter):
        self.adapter, self.pushed = adapter, []

    def partitions(self) -> list[_Split]:
        a = self.adapter
        splits = a.splits(a.start(), a.latest())
        return [_Split(s) for s in splits if all(_possible(s[f.attribute[0]], f) for f in self.pushed if f.attribute[0] in s)] or [_Split({})]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        for b in self.adapter.rows(split.value) if split.value else ():
            keep = [all((x := row[f.attribute[0]]) is not None and _OPS[type(f)](x, f.value) for f in self.pushed) for row in b.select([f.attribute[0] for f in self.pushed]).to_pylist()] if self.pushed else None
            yield b if keep is None else b.filter(pa.array(keep, pa.bool_()))


class _PushingReader(_Reader):
    """Spark refuses a reader that takes filters in a session that doesn't push them, so this is a class of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _OPS and len(f.attribute) == 1 and f.attribute[0] in self.adapter.filters and f.value is not None:
                self.pushed.append(f)
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    def __init__(self, adapter):
        self.adapter = adapter

    def initialOffset(self) -> dict:
        return {"cursor": self.adapter.start()}

    def latestOffset(self) -> dict:
        return {"cursor": self.adapter.latest()}

    def partitions(self, start: dict, end: dict) -> list[_Split]:
        return [_Split(s) for s in self.adapter.splits(start["cursor"], end["cursor"])] or [_Split({})]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        yield from self.adapter.rows(split.value) if split.value else ()


class AdapterSource(DataSource):
    """format("engram"): the option adapter is a name in ADAPTERS; path and what else it takes are options as well. With the
    option pushdown = true filters are taken; the session has to push them then."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.adapter = ADAPTERS[options["adapter"]](dict(options))

    @classmethod
    def name(cls) -> str:
        return "engram"

    def schema(self) -> str | StructType:
        return self.adapter.schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(self.adapter)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.adapter)


def _options(spark: SparkSession, reader, adapter: str, options: dict[str, str]):
    spark.dataSource.register(AdapterSource)
    return reader.format(AdapterSource.name()).options(adapter=adapter, pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"), **options)


def read(spark: SparkSession, adapter: str, path: str, **options: str) -> DataFrame:
    """All that an adapter has at a path now."""
    return _options(spark, spark.read, adapter, options).load(path)


def stream(spark: SparkSession, adapter: str, path: str, **options: str) -> DataFrame:
    """What an adapter has at a path and gets there later, as a stream."""
    return _options(spark, spark.readStream, adapter, options).load(path)
