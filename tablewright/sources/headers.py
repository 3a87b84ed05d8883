"""Headers of raw tables: found on the first rows, then promoted."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import values
from tablewright.functions.names import distinct
from tablewright.operators.checks import quoted
from tablewright.operators.rows import ROW

SCAN_ROWS, FILLED = 20, 0.6
_NUMBER = re.compile(r"[-+]?(\d{1,3}(,\d{3})+|\d+)?(\.\d+)?\s*%?")
_DATE = re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}")


def is_label(cell: Any) -> bool:
    """Text that is neither like a number nor like a date."""
    if not isinstance(cell, str) or not (text := cell.strip()):
        return False
    return not _NUMBER.fullmatch(text) and not _DATE.match(text)


def find(rows: Sequence[Sequence[Any]]) -> int:
    """The first row that is filled enough and has different labels only; else 0."""
    width = max((sum(c is not None for c in r) for r in rows), default=0)
    for k, row in enumerate(rows):
        cells = [c for c in row if c is not None and str(c).strip()]
        if width and len(cells) >= max(1, math.ceil(width * FILLED)) and all(map(is_label, cells)) and len({c.strip() for c in cells}) == len(cells):
            return k
    return 0


def names(row: Sequence[Any]) -> list[str]:
    """Blank headers become unnamed_N; repeated ones get _2, _3 and so on."""
    return distinct([str(c).strip() if c is not None and str(c).strip() else f"unnamed_{k + 1}" for k, c in enumerate(row)], taken=[ROW])


def promote(raw: DataFrame, mode: str | int | None = "auto") -> tuple[DataFrame, int | None, list[str]]:
    """raw: numbered rows without a header. The table with names and numbers from 1, the header's row, and the dropped columns:
    those without name and content. mode: auto, the header's row, or None for column_N."""
    columns = [c for c in raw.columns if c != ROW]
    if mode is None:
        return raw.toDF(*[ROW if c == ROW else f"column_{columns.index(c) + 1}" for c in raw.columns]), None, []
    head = [tuple(r) for r in raw.orderBy(ROW).select(*map(quoted, columns)).limit(max(SCAN_ROWS, 0 if mode == "auto" else int(mode) + 1)).collect()]
    at = find(head[:SCAN_ROWS]) if mode == "auto" else int(mode)
    beyond = at >= len(head)
    if beyond:
        at = 0
    own = names(head[at]) if head else []
    body = raw.where(F.col(ROW) > at + 1) if not beyond else raw.limit(0)
    body = body.select((F.col(ROW) - at - 1).alias(ROW), *[quoted(c).alias(n) for c, n in zip(columns, own, strict=False)])
    blank = [n for n in own if n.startswith("unnamed_")]
    dropped = []
    if blank and not beyond:
        filled = body.agg(*[F.bool_or(~values.blank(quoted(n), body.schema[n].dataType)).alias(n) for n in blank]).first()
        dropped = [n for n in blank if not filled[n]]
    return body.drop(*dropped), at, dropped
