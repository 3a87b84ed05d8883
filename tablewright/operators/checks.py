"""Checks: each says what it looks at and which cells fail, as columns, so that all of them run in one projection."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import names, values
from tablewright.operators.rows import ROW, Repeats
from tablewright.plans.contracts import Contract
from tablewright.plans.settings import Validation


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


@dataclass
class Finding:
    """What a check says about a table. checked and failed are numbers, or columns of booleans to be counted."""

    check: str
    dimension: str
    checked: int | Column = 0
    failed: int | Column = 0
    column: str | None = None
    invalidates: bool = False
    blocking: bool = False
    severity: str | None = None  # of any count; else error where something failed
    on_failure: str = "error"
    counted: bool = True  # whether failures enter the score
    only_failing: bool = False  # not reported without a failure
    message: str = ""


@dataclass
class Context:
    """A table, its contract, and its parsed columns."""

    frame: DataFrame
    contract: Contract
    match: names.Match
    settings: Validation
    cells: dict[str, values.Cell] = field(default_factory=dict)
    total: int = 0

    def source(self, name: str) -> Column:
        return quoted(self.match.actual[name])

    def value(self, name: str) -> Column:
        """The parsed value of a contract column."""
        return self._part("value", name)

    def blank(self, name: str) -> Column:
        return self._part("blank", name)

    def invalid(self, name: str) -> Column:
        """Whether a cell that is not blank is not of its type."""
        return self._part("invalid", name)

    def _part(self, part: str, name: str) -> Column:
        return F.col(f"_{part}_{list(self.contract.columns).index(name)}")

    def kind(self, name: str):
        return self.frame.schema[self.match.actual[name]].dataType


class Check(ABC):
    name = ""

    @abstractmethod
    def findings(self, ctx: Context) -> list[Finding]:
        """Findings in the order in which they are reported."""


class RequiredColumns(Check):
    name = "required_columns"

    def findings(self, ctx: Context) -> list[Finding]:
        gone = ctx.match.missing
        text = f"Missing required column(s): {', '.join(gone)}." if gone else "All required columns are present."
        return [Finding(self.name, "conformity", len(ctx.contract.required), len(gone), blocking=bool(gone), message=text)]


class UnexpectedColumns(Check):
    name = "unexpected_columns"

    def findings(self, ctx: Context) -> list[Finding]:
        extra, listed = ctx.match.extra, ", ".join(ctx.match.extra)
        if ctx.contract.allow_unexpected_columns:
            return [Finding(self.name, "conformity", severity="info", message=f"Columns outside the contract: {listed}.")] if extra else []
        return [Finding(self.name, "conformity", len(ctx.match.actual) + len(extra), len(extra), message=f"Columns that are not allowed: {listed or 'none'}.")]


class ColumnMapping(Check):
    name = "column_mapping"

    def findings(self, ctx: Context) -> list[Finding]:
        pairs = ", ".join(f"{a!r} as {n}" for a, n in ctx.match.renamed.items())
        return [Finding(self.name, "conformity", severity="info", message=f"Read by name or alias: {pairs}.")] if pairs else []


class EmptyRows(Check):
    """Failures enter the score, rows do not: they are counted by the missing values."""

    name = "empty_rows"

    def findings(self, ctx: Context) -> list[Finding]:
        return [Finding(self.name, "completeness", 0, F.col("_empty"), invalidates=True, on_failure="warning", only_failing=True, message="{failed} row(s) are empty.")]


class MissingValues(Check):
    name = "missing_values"

    def findings(self, ctx: Context) -> list[Finding]:
        out = []
        for n, rule in ctx.contract.columns.items():
            if n in ctx.match.actual:
                text = f"'{n}' is blank in {{failed}} row(s)."
                if rule.required:
                    out.append(Finding(self.name, "completeness", F.lit(True), ctx.blank(n), n, invalidates=True, message=text))
                else:
                    out.append(Finding(self.name, "completeness", 0, ctx.blank(n), n, on_failure="threshold", counted=False, only_failing=True, message=text))
        return out


class _Parses(Check):
    label = ""

    def applies(self, rule) -> bool:
        raise NotImplementedError

    def findings(self, ctx: Context) -> list[Finding]:
        return [
            Finding(self.name, "validity", ~ctx.blank(n), ctx.invalid(n), n, invalidates=True, message=f"'{n}' has {{failed}} value(s) that are not {self.label}.")
            for n, rule in ctx.contract.columns.items()
            if n in ctx.match.actual and self.applies(rule)
        ]


class InvalidDates(_Parses):
    name, label = "invalid_dates", "dates"

    def applies(self, rule) -> bool:
        return rule.temporal


class InvalidNumbers(_Parses):
    name, label = "invalid_numbers", "numbers"

    def applies(self, rule) -> bool:
        return rule.numeric


class InvalidCategories(Check):
    name = "invalid_categories"

    def findings(self, ctx: Context) -> list[Finding]:
        return [
            Finding(self.name, "validity", ~ctx.blank(n), ctx.invalid(n), n, invalidates=True, message=f"'{n}' has {{failed}} value(s) outside {', '.join(rule.allowed)}.")
            for n, rule in ctx.contract.columns.items()
            if n in ctx.match.actual and rule.allowed
        ]


class Ranges(Check):
    name = "value_range"

    def findings(self, ctx: Context) -> list[Finding]:
        out = []
        for n, rule in ctx.contract.columns.items():
            if n not in ctx.match.actual or not rule.numeric or (rule.min is None and rule.max is None):
                continue
            value, valid = ctx.value(n), ~ctx.blank(n) & ~ctx.invalid(n)
            low = F.lit(False) if rule.min is None else valid & (value < rule.min)
            high = F.lit(False) if rule.max is None else valid & (value > rule.max)
            if rule.type == "percent":
                sides = [("invalid_percentages", low | high, "out of range")]
            else:
                sides = []
                if rule.min is not None:
                    sides.append(("negative_values" if rule.min == 0 else "below_minimum", low, f"below {rule.min:g}"))
                if rule.max is not None:
                    sides.append(("above_maximum", high, f"above {rule.max:g}"))
            out += [Finding(name, "consistency", valid, bad, n, invalidates=True, message=f"'{n}' has {{failed}} value(s) {text}.") for name, bad, text in sides]
        return out


class BetweenColumns(Check):
    name = "consistency_rule"

    def findings(self, ctx: Context) -> list[Finding]:
        out = []
        for rule in ctx.contract.consistency_rules:
            if rule.column in ctx.match.actual and rule.reference in ctx.match.actual:
                left, right = (ctx.value(c) for c in (rule.column, rule.reference))
                both = left.isNotNull() & right.isNotNull()
                bad = both & (left < right if rule.type == "not_before" else left > right)
                out.append(Finding(self.name, "consistency", both, bad, rule.column, invalidates=True, message=f"{{failed}} row(s): {rule.description or rule.type}."))
        return out


class DuplicateRows(Check):
    name = "duplicate_rows"

    def findings(self, ctx: Context) -> list[Finding]:
        if not ctx.settings.duplicate_check:
            return []
        return [Finding(self.name, "uniqueness", F.lit(True), F.col("_copy"), invalidates=True, message="{failed} row(s) copy an earlier one.")]


class DuplicateKeys(Check):
    """Rows are counted by DuplicateRows."""

    name = "duplicate_keys"

    def findings(self, ctx: Context) -> list[Finding]:
        if not ctx.settings.duplicate_check or not keyed(ctx):
            return []
        return [Finding(self.name, "uniqueness", 0, F.col("_same_key"), invalidates=True, message=f"{{failed}} row(s) repeat a business key ({' + '.join(ctx.contract.business_key)}).")]


def keyed(ctx: Context) -> bool:
    return bool(ctx.contract.business_key) and all(k in ctx.match.actual for k in ctx.contract.business_key)


CHECKS: tuple[Check, ...] = (
    RequiredColumns(),
    UnexpectedColumns(),
    ColumnMapping(),
    EmptyRows(),
    MissingValues(),
    InvalidDates(),
    InvalidNumbers(),
    InvalidCategories(),
    Ranges(),
    BetweenColumns(),
    DuplicateRows(),
    DuplicateKeys(),
)


def is_part(column: str) -> bool:
    """Whether a column is one that parsed() adds."""
    return column in ("_empty", "_copy", "_same_key") or column.rpartition("_")[0] in ("_value", "_blank", "_invalid")


def parsed(ctx: Context) -> DataFrame:
    """The table with the parts of each contract column (see Context), _empty, _copy and _same_key. Parts are columns of their own,
    so that each is computed once however many checks read it."""
    frame, parts = ctx.frame, {}
    for k, (n, rule) in enumerate(ctx.contract.columns.items()):
        if n not in ctx.match.actual:
            continue
        source, kind = ctx.source(n), ctx.kind(n)
        if rule.numeric:
            cell = values.number(source, kind)
        elif rule.temporal:
            cell = values.date(source, kind, time=rule.type == "datetime", dayfirst=ctx.settings.dayfirst)
        else:
            empty = values.blank(source, kind)
            bad = ~empty & ~values.key(source).isin([v.strip().lower().replace("ß", "ss") for v in rule.allowed]) if rule.allowed else F.lit(False)
            cell = values.Cell(source.cast("string"), empty, bad)
        parts |= {f"_value_{k}": cell.value, f"_blank_{k}": F.coalesce(cell.blank, F.lit(False)), f"_invalid_{k}": F.coalesce(cell.invalid, F.lit(False))}
    data = [c for c in frame.columns if c != ROW]
    known = {actual: n for n, actual in ctx.match.actual.items()}
    empty = F.lit(True)
    for c in data:
        empty = empty & (ctx.blank(known[c]) if c in known else values.blank(quoted(c), frame.schema[c].dataType))
    out = frame.withColumns(parts).withColumn("_empty", empty)
    if not ctx.settings.duplicate_check:
        return out.withColumns({"_copy": F.lit(False), "_same_key": F.lit(False)})
    asked = {"_copy": ([values.strip(quoted(c).cast("string")) for c in data], None)}
    if keyed(ctx):
        keys = [values.key(ctx.source(k)) for k in ctx.contract.business_key]
        whole = F.lit(True)
        for k in keys:
            whole = whole & k.isNotNull() & (k != "")
        # the first row of a key copies no row, so copies need not be left out to find it
        asked["_same_key"] = (keys, whole)
    found = Repeats(frame, asked)
    out = found.mark(out, "_copy")
    if "_same_key" not in asked:
        return out.withColumn("_same_key", F.lit(False))
    out = found.mark(out, "_same_key")
    return out.withColumn("_same_key", F.col("_same_key") & ~F.col("_copy"))
