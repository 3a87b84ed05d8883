"""xlsx workbooks with the standard library: reading sheets, a Spark data source, and writing bounded results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, datetime, timedelta
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablewright.errors import SourceError

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the standard that are dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
EPOCH = datetime(1899, 12, 30)


class Workbook:
    """Sheets of an xlsx file."""

    def __init__(self, content: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
            book = ET.fromstring(self.zip.read("xl/workbook.xml"))
            rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
            raise SourceError(f"the workbook cannot be read: {e}") from e
        self.paths = {s.get("name"): "xl/" + rels[s.get(_REL)].removeprefix("/xl/").removeprefix("xl/") for s in book.iter(f"{_MAIN}sheet")}
        self.strings = self._strings()
        self.dates = self._date_styles()

    @property
    def sheets(self) -> list[str]:
        return list(self.paths)

    def resolve(self, sheet: str | None) -> str:
        if sheet is None:
            return self.sheets[0]
        if sheet not in self.paths:
            raise SourceError(f"no sheet {sheet!r}; there are {', '.join(self.sheets)}")
        return sheet

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = ET.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or "") for f in root.iter(f"{_MAIN}numFmt")}
        dated = DATE_FORMATS | {k for k, code in own.items() if re.search(r"[ymdhs]", code, re.I)}
        cells = root.find(f"{_MAIN}cellXfs")
        return {k for k, xf in enumerate(cells if cells is not None else ()) if int(xf.get("numFmtId") or 0) in dated}

    def _value(self, cell: ET.Element) -> Any:
        kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind in ("str", "e"):
            return v.text
        if kind == "d":
            return datetime.fromisoformat(v.text)
        number = float(v.text)
        if int(cell.get("s") or 0) in self.dates:
            return EPOCH + timedelta(seconds=round(number * 86400))
        return int(number) if number.is_integer() else number

    def rows(self, sheet: str | None = None) -> Iterator[list[Any]]:
        """Rows that are not empty, as long as their last cell."""
        with self.zip.open(self.paths[self.resolve(sheet)]) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[Any] = []
                for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    out += [None] * (at - len(out)) + [self._value(cell)]
                if any(x is not None for x in out):
                    yield out
                row.clear()


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def as_text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d") if value == datetime(value.year, value.month, value.day) else value.isoformat(sep=" ")
    return str(value)


class WorkbookSource(DataSource):
    """spark.read.format("workbook").option("sheet", name).schema(all strings).load(path): one sheet, without a header."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        with open(self.options["path"], "rb") as f:
            width = max((len(r) for r in Workbook(f.read()).rows(self.options.get("sheet"))), default=1)
        return "_source_row long, " + ", ".join(f"c{k} string" for k in range(width))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("sheet"), len(schema.fields) - 1)


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, width: int) -> None:
        self.path, self.sheet, self.width = path, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a sheet is one stream of rows

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            book = Workbook(f.read())
        for k, row in enumerate(book.rows(self.sheet)):
            cells = [as_text(x) for x in row[: self.width]]
            yield (k + 1, *cells, *[None] * (self.width - len(cells)))


def write(path: str, sheets: dict[str, tuple[Sequence[str], Sequence[Sequence[Any]]]]) -> None:
    """A workbook of small tables (header, rows)."""

    def ref(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(x: Any, at: str) -> str:
        if x is None:
            return ""
        if isinstance(x, bool):
            return f'<c r="{at}" t="b"><v>{int(x)}</v></c>'
        if isinstance(x, (datetime, date)):
            moment = x if isinstance(x, datetime) else datetime(x.year, x.month, x.day)
            return f'<c r="{at}" s="1"><v>{(moment - EPOCH).total_seconds() / 86400}</v></c>'
        if isinstance(x, (int, float)):
            return f'<c r="{at}"><v>{x!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    main, rel = _MAIN[1:-1], _REL[1:].split("}")[0]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + f'<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for k, (header, rows) in enumerate(sheets.values(), 1):
            lines = [f'<row r="{i}">' + "".join(cell(x, f"{ref(j)}{i}") for j, x in enumerate(r)) + "</row>" for i, r in enumerate([header, *rows], 1)]
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
