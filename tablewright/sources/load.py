"""Sources: delimited files, workbooks, SQL and sheets. A load gives a numbered table and the profile of its source."""

from __future__ import annotations

import csv
import os
import re
import tempfile
import time
from abc import ABC, abstractmethod
from collections import Counter
from dataclasses import dataclass, field
from pathlib import PurePath
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import SourceError, TablewrightError
from tablewright.operators import profile as profiles
from tablewright.operators.rows import ROW, numbered
from tablewright.plans.settings import Upload
from tablewright.sources import guards, headers
from tablewright.sources.workbook import Workbook, WorkbookSource

REGISTRY: dict[str, type[Source]] = {}
ENDINGS: dict[str, str] = {}
DELIMITERS = ",;\t|"
HEAD_BYTES, HEAD_LINES = 1 << 16, 200


def source(kind: str, *endings: str):
    """Register a class of sources, and the file endings it reads."""

    def add(cls):
        REGISTRY[kind] = cls
        ENDINGS.update(dict.fromkeys(endings, kind))
        cls.kind = kind
        return cls

    return add


def kinds() -> dict[str, tuple[str, ...]]:
    """The registered kinds of sources, with the file endings of each."""
    return {kind: tuple(e for e, k in ENDINGS.items() if k == kind) for kind in sorted(REGISTRY)}


def kind_class(kind: str) -> type[Source]:
    if kind not in REGISTRY:
        raise SourceError(f"no source {kind!r}; there are {', '.join(kinds())}")
    return REGISTRY[kind]


def create(kind: str, *args: Any, **options: Any) -> Source:
    return kind_class(kind)(*args, **options)


def for_upload(spark: SparkSession, name: str, content: bytes, upload: Upload | None = None, **options: Any) -> Source:
    """The source that reads a file, by its ending."""
    upload = upload or Upload()
    name = guards.check_upload(name, content, upload)
    ending = PurePath(name).suffix.lower()
    if ending not in ENDINGS or not issubclass(REGISTRY[ENDINGS[ending]], _File):
        raise SourceError(f"no source reads {ending}")
    return create(ENDINGS[ending], spark, name=name, content=content, upload=upload, **options)


@dataclass(frozen=True)
class Loaded:
    """A table with row numbers, and what is known of its source."""

    table: DataFrame
    kind: str
    name: str
    rows: int
    columns: tuple[profiles.ColumnProfile, ...]
    empty_rows: int
    header_row: int | None
    dropped: tuple[str, ...]
    seconds: float
    details: dict[str, Any] = field(default_factory=dict)

    def preview(self, n: int = 50) -> DataFrame:
        return self.table.orderBy(ROW).limit(n)

    def columns_frame(self) -> DataFrame:
        return profiles.columns_frame(self.table, list(self.columns))

    @property
    def size_label(self) -> str:
        return guards.size_label(self.details.get("size", 0))

    def to_dict(self) -> dict[str, Any]:
        return {
            "kind": self.kind,
            "name": self.name,
            "rows": self.rows,
            "columns": [vars(c) for c in self.columns],
            "empty_rows": self.empty_rows,
            "header_row": self.header_row,
            "dropped": list(self.dropped),
            "seconds": self.seconds,
        } | self.details


class Source(ABC):
    kind: ClassVar[str] = ""

    def __init__(self, spark: SparkSession, name: str, *, header: str | int | None = "auto") -> None:
        self.spark, self.name, self.header = spark, name, header

    @abstractmethod
    def read(self) -> tuple[DataFrame, bool, dict[str, Any]]:
        """Numbered rows, whether they have names already, and details."""

    def table(self) -> tuple[DataFrame, int | None, list[str], dict[str, Any]]:
        try:
            raw, named, details = self.read()
            table, at, dropped = (raw, None, []) if named else headers.promote(raw, self.header)
        except TablewrightError:
            raise
        except Exception as e:
            raise SourceError(f"{self.name} cannot be read: {e}", user_message=f"'{self.name}' could not be read.") from e
        if not [c for c in table.columns if c != ROW]:
            raise SourceError(f"{self.name} has no columns")
        return table, at, dropped, details

    def load(self) -> Loaded:
        began = time.perf_counter()
        table, at, dropped, details = self.table()
        found = tuple(profiles.profile(table))
        total = found[0].non_null_count + found[0].null_count
        return Loaded(table, self.kind, self.name, total, found, profiles.empty_rows(table), at, tuple(dropped), round(time.perf_counter() - began, 3), details)


class _File(Source):
    def __init__(self, spark: SparkSession, name: str, content: bytes | None = None, *, path: str | None = None, upload: Upload | None = None, header: str | int | None = "auto") -> None:
        self.upload = upload or Upload()
        if content is None:
            if path is None or not os.path.exists(path):
                raise SourceError(f"{path} does not exist")
            guards.check_size(name, os.path.getsize(path), self.upload)
            with open(path, "rb") as f:
                content = f.read()
        self.content = content
        super().__init__(spark, guards.check_upload(name, content, self.upload), header=header)

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, **options: Any):
        return cls(spark, os.path.basename(path), path=path, **options)

    def details(self) -> dict[str, Any]:
        return {"size": len(self.content), "sha256": guards.sha256(self.content)}

    def staged(self, content: bytes, ending: str) -> str:
        """Uploads are bounded by the upload limit; on a cluster they are staged where all executors read."""
        folder = (self.spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://")
        handle, path = tempfile.mkstemp(suffix=ending, prefix="upload-", dir=folder if os.path.isdir(folder) else None)
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        return path


def decode(content: bytes, fallbacks: tuple[str, ...], encoding: str | None = None) -> tuple[str, str]:
    """Text and its encoding: the one asked for, else by the byte order mark, else the first that fits."""
    choices = (encoding,) if encoding else ("utf-16", *fallbacks) if content.startswith((b"\xff\xfe", b"\xfe\xff")) else fallbacks
    for choice in choices:
        try:
            return content.decode(choice).removeprefix("﻿"), choice
        except (UnicodeDecodeError, LookupError):
            continue
    raise SourceError(f"not text in any of {', '.join(choices)}", user_message="The file's encoding is not supported.")


def sniff(text: str) -> str:
    """The delimiter: by the standard sniffer, else the most frequent in the first line, else a comma."""
    try:
        return csv.Sniffer().sniff(text[:HEAD_BYTES], DELIMITERS).delimiter
    except csv.Error:
        found = Counter(ch for ch in text.split("\n", 1)[0] if ch in DELIMITERS)
        return found.most_common(1)[0][0] if found else ","


@source("csv", ".csv", ".txt", ".tsv")
class Delimited(_File):
    """Delimited text: all cells are text, only an empty cell is NULL, rows wider than the first HEAD_LINES lines are an error."""

    def __init__(self, *args: Any, delimiter: str | None = None, encoding: str | None = None, **options: Any) -> None:
        super().__init__(*args, **options)
        self.delimiter, self.encoding = delimiter, encoding

    def read(self) -> tuple[DataFrame, bool, dict[str, Any]]:
        text, encoding = decode(self.content, self.upload.csv_encoding_fallbacks, self.encoding)
        rows, mark = _delimited(self.spark, self.name, self.staged(text.encode(), ".csv"), text, self.delimiter, multiline='"' in text)
        return rows, False, self.details() | {"encoding": encoding, "delimiter": mark}


def _delimited(spark: SparkSession, name: str, path: str, head: str, delimiter: str | None, *, encoding: str = "utf-8", multiline: bool = False) -> tuple[DataFrame, str]:
    """Numbered rows of a delimited file, and its delimiter. head: its first lines, or the whole of it."""
    mark = delimiter or sniff(head)
    width = max((len(r) for _, r in zip(range(HEAD_LINES), csv.reader(head.splitlines(keepends=True), delimiter=mark), strict=False)), default=0)
    if not width:
        raise SourceError(f"{name} has no rows")
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)] + [T.StructField("_corrupt", T.StringType())])
    rows = scan_csv(spark, path, schema, mark, encoding=encoding, multiline=multiline)
    wide = rows.where("_corrupt is not null").limit(1).collect()
    if wide:
        raise SourceError(f"a row has more than {width} cells: {wide[0]['_corrupt'][:80]!r}", user_message="A row has more cells than the header.")
    return numbered(rows.drop("_corrupt")), mark


@source("delimited_path")
class DelimitedPath(Source):
    """Delimited text of any size, where Spark reads it (a file or a folder of files): the driver reads the first HEAD_BYTES of
    one file alone, for the encoding, the delimiter and the width; the scan is distributed. A quoted cell has no line feeds,
    unless multiline is set, which makes a file one task."""

    def __init__(self, spark: SparkSession, path: str, *, delimiter: str | None = None, encoding: str | None = None, multiline: bool = False, header: str | int | None = "auto") -> None:
        super().__init__(spark, os.path.basename(path.rstrip("/")), header=header)
        self.path, self.delimiter, self.encoding, self.multiline = path, delimiter, encoding, multiline

    def _head(self) -> bytes:
        context = self.spark.sparkContext
        jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise SourceError(f"{self.path} does not exist")
        files = [f for f in fs.listStatus(path) if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", "."))]
        if not files:
            raise SourceError(f"{self.path} is empty")
        first = min(files, key=lambda f: f.getPath().toString())
        stream = fs.open(first.getPath())
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(HEAD_BYTES, first.getLen())))
        finally:
            stream.close()

    def read(self) -> tuple[DataFrame, bool, dict[str, Any]]:
        head = self._head()
        whole = head.rfind(b"\n") + 1 if len(head) == HEAD_BYTES else len(head)
        text, encoding = decode(head[:whole] or head, Upload().csv_encoding_fallbacks, self.encoding)
        rows, mark = _delimited(self.spark, self.name, self.path, text, self.delimiter, encoding={"utf-8-sig": "utf-8"}.get(encoding, encoding), multiline=self.multiline)
        return rows, False, {"path": self.path, "encoding": encoding, "delimiter": mark}


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, delimiter: str, *, encoding: str = "utf-8", multiline: bool = False) -> DataFrame:
    options = {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "multiLine": multiline, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    # whole rows are parsed, so that a wide one is seen whatever columns are asked for
    rows = spark.read.schema(schema).options(**options, encoding=encoding, columnPruning=False).csv(path)
    cells = F.size(F.split(F.regexp_replace("_corrupt", r'"[^"]*"', ""), re.escape(delimiter)))
    # a short row is marked too, but is only padded
    return rows.withColumn("_corrupt", F.when(cells > len(schema.fields) - 1, F.col("_corrupt")))


@source("xlsx", ".xlsx")
class Excel(_File):
    """One sheet of a workbook; cells are read as text, dates in ISO form; empty rows are left out."""

    def __init__(self, *args: Any, sheet: str | None = None, **options: Any) -> None:
        super().__init__(*args, **options)
        self.sheet = sheet

    def sheets(self) -> tuple[str, ...]:
        return tuple(Workbook(self.content).sheets)

    def read(self) -> tuple[DataFrame, bool, dict[str, Any]]:
        sheet = Workbook(self.content).resolve(self.sheet)
        self.spark.dataSource.register(WorkbookSource)
        path = self.staged(self.content, ".xlsx")
        if next(Workbook(self.content).rows(sheet), None) is None:
            raise SourceError(f"sheet {sheet!r} is empty")
        return self.spark.read.format("workbook").option("sheet", sheet).load(path), False, self.details() | {"sheet": sheet}

    def load_all(self) -> dict[str, Loaded]:
        """Every sheet that can be read."""
        out = {}
        for sheet in self.sheets():
            try:
                out[sheet] = Excel(self.spark, self.name, self.content, upload=self.upload, header=self.header, sheet=sheet).load()
            except SourceError:
                continue
        return out


@source("sql")
class Sql(Source):
    """A table or one read-only query: over JDBC with a URL, else of the session's catalog."""

    def __init__(self, spark: SparkSession, url: str | None = None, *, table: str | None = None, query: str | None = None, params: dict[str, Any] | None = None, options: dict[str, str] | None = None) -> None:
        if (table is None) == (query is None):
            raise SourceError("either a table or a query is needed")
        self.what = guards.check_identifier(table) if table else guards.check_query(query, foreign=url is not None)
        self.is_table, self.url, self.params, self.options = table is not None, url, params or {}, options or {}
        super().__init__(spark, table or "query")

    def read(self) -> tuple[DataFrame, bool, dict[str, Any]]:
        details = {"database": guards.redact(self.url or "catalog"), "query": self.what}
        if self.url:
            reader = self.spark.read.format("jdbc").options(url=self.url, **self.options)
            return numbered(reader.option("dbtable" if self.is_table else "query", self.what).load()), True, details
        df = self.spark.table(self.what) if self.is_table else self.spark.sql(self.what, args=self.params)
        return numbered(df), True, details


@source("sheets")
class Sheets(Source):
    """A worksheet of an online spreadsheet, through a client: worksheets() and values(worksheet)."""

    def __init__(self, spark: SparkSession, client: Any, *, worksheet: str | None = None, header: str | int | None = "auto") -> None:
        self.client, self.worksheet = client, worksheet
        super().__init__(spark, worksheet or "sheet", header=header)

    def worksheets(self) -> list[str]:
        return list(self.client.worksheets())

    def read(self) -> tuple[DataFrame, bool, dict[str, Any]]:
        titles = self.worksheets()
        title = self.worksheet or (titles[0] if titles else None)
        if title not in titles:
            raise SourceError(f"no worksheet {title!r}; there are {', '.join(titles)}")
        rows = self.client.values(title)
        width = max(map(len, rows), default=0)
        if not width:
            raise SourceError(f"worksheet {title!r} is empty")
        cells = [(k + 1, *[None if x in ("", None) else str(x) for x in r], *[None] * (width - len(r))) for k, r in enumerate(rows)]
        return self.spark.createDataFrame(cells, f"{ROW} long, " + ", ".join(f"c{k} string" for k in range(width))), False, {"worksheet": title}


class _Columns(Source):
    """Files that carry their own names and types, read by Spark with pushed filters and pruned columns. What needs a package that
    the session has not got is an error when it is read."""

    def __init__(self, spark: SparkSession, path: str, **options: str) -> None:
        self.path, self.options = path, options
        super().__init__(spark, os.path.basename(path.rstrip("/")))

    def read(self) -> tuple[DataFrame, bool, dict[str, Any]]:
        return numbered(self.spark.read.format(self.kind).options(**self.options).load(self.path)), True, {"path": self.path}


@source("parquet", ".parquet")
class Parquet(_Columns):
    pass


@source("orc", ".orc")
class Orc(_Columns):
    pass


@source("json", ".json", ".jsonl")
class Json(_Columns):
    """A JSON object a line; nested values stay nested and are profiled as text."""


@source("avro", ".avro")
class Avro(_Columns):
    pass
