"""Cleaning: ordered steps on one annotated frame. Every changed cell is recorded, every removed row is kept with its reasons.

Order: names, white space, placeholders, copies of rows, categories, types, defaults, reasons, quarantine. The original row, the
working values and how many cells each step changed travel together, so data and quarantine are projections of one frame, which is
held. The change log has a plan of its own, of the same steps with the old and new values; it runs when the log is asked for.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import ProcessingFailed, TablewrightError
from tablewright.functions import names, values
from tablewright.operators.checks import quoted
from tablewright.operators.rows import ROW, Repeats, bounded, numbered, repeats
from tablewright.plans.contracts import Catalog, Contract
from tablewright.plans.settings import Cleaning

REASON, ISSUES = "_reason", "_dq_issues"
COPY_REASON = "exact duplicate of an earlier row"
#: Steps that change cells, in order.
STEPS = ("trim", "placeholders", "categories", "types", "defaults")
STEP_NAMES = {
    "names": "Standardise column names",
    "trim": "Trim whitespace",
    "placeholders": "Placeholders → missing",
    "copies": "Remove duplicate rows",
    "categories": "Standardise categories",
    "types": "Convert data types",
    "defaults": "Fill defaults",
    "quarantine": "Quarantine unusable rows",
}
_CHANGE = "array<struct<step: int, ordinal: int, column: string, old: string, new: string>>"


def renaming(columns: list[str], contract: Contract) -> dict[str, str]:
    """Table name -> clean name: contract names, and unique standard names for the rest."""
    found = names.match(columns, contract)
    known = {a: n for n, a in found.actual.items()}
    rest = [c for c in columns if c not in known]
    return known | dict(zip(rest, names.distinct([names.standard(c) for c in rest], known.values()), strict=True))


def modal_spellings(df: DataFrame, columns: list[str]) -> DataFrame:
    """_c, _k, _v: for each column and key the most frequent spelling; of equals one of mixed case, then the first in order."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).cast("string").alias("s")) for c in columns]))
    each = df.select(cells.alias("x")).where("x.s is not null").groupBy(F.col("x.c").alias("_c"), F.col("x.s").alias("_s")).agg(F.count("*").alias("n"))
    style = F.when(values.flat_case(F.col("_s")), 1).otherwise(0)
    best = F.min_by("_s", F.struct(-F.col("n"), style, F.col("_s"))).alias("_v")
    return each.withColumn("_k", values.key(F.col("_s"))).groupBy("_c", "_k").agg(best)


# ---------------------------------------------------------------- steps of single columns, also for use outside the cleaner
def trimmed(c: Column) -> Column:
    """Without white space at the ends, with single spaces inside."""
    return values.squeeze(c)


def without_placeholders(c: Column, placeholders: tuple[str, ...], stripped: Column | None = None) -> Column:
    """NULL where the text is empty or stands for a missing value. stripped: the same text where it is known to be stripped."""
    bare = values.strip(c) if stripped is None else stripped
    return F.when((bare != "") & ~F.lower(bare).isin(list(placeholders)), c)


def spelled_as(c: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed spelling of a value, whatever its case and white space; other values stay."""
    pairs = [x for v in allowed for x in (F.lit(v.strip().lower().replace("ß", "ss")), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), values.key(c)), c.cast("string"))


def typed_as(c: Column, rule, kind: T.DataType, *, dayfirst: bool = True) -> Column:
    """The value of the rule's type, NULL where it is none."""
    if rule.numeric:
        return values.number(c, kind).value
    if rule.temporal:
        return values.date(c, kind, time=rule.type == "datetime", dayfirst=dayfirst).value
    return c.cast("string")


def cased(c: Column, case: str) -> Column:
    return {"title": values.title, "upper": F.upper, "lower": F.lower}.get(case, lambda x: x)(c)


@dataclass
class Step:
    name: str
    rows: int
    cells: int = 0


@dataclass
class Cleaned:
    """data: typed usable rows; quarantine: original rows with reasons, by row; changes: the capped change log (frame: the changes
    of each row)."""

    dataset: str
    data: DataFrame
    quarantine: DataFrame
    frame: DataFrame
    original: DataFrame
    renamed: dict[str, str]
    limit: int
    before: int = 0
    after: int = 0
    removed: int = 0
    modified: int = 0
    cells: int = 0
    steps: list[Step] = field(default_factory=list)
    reasons: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give back what is held; the frames still work, by computing again."""
        for frame in self.held:
            frame.unpersist()

    def changes(self, limit: int | None = None) -> DataFrame:
        """source_row, column, step, old_value, new_value, by step, column and row, up to the limit (0: all)."""
        each = self.frame.select(F.col(ROW).alias("source_row"), F.explode("_changes").alias("c")).select("source_row", "c.*")
        step = F.element_at(F.array(*[F.lit(STEP_NAMES[s]) for s in STEPS]), F.col("step") + 1)
        limit = self.limit if limit is None else limit
        capped = each.orderBy("step", "ordinal", "source_row").limit(limit) if limit else each
        return capped.select("source_row", "column", step.alias("step"), F.col("old").alias("old_value"), F.col("new").alias("new_value"))

    def column_changes(self) -> DataFrame:
        """column, original, type and missing cells before and after."""
        back = {v: k for k, v in self.renamed.items()}
        columns = [c for c in self.data.columns if c not in (ROW, ISSUES)]
        old = {c: back.get(c, c) for c in columns}
        a = self.original.agg(*[F.count_if(values.blank(quoted(old[c]), self.original.schema[old[c]].dataType)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
        b = self.data.agg(*[F.count_if(quoted(c).isNull()).alias(f"m{k}") for k, c in enumerate(columns)]).first()
        rows = [(c, old[c], self.original.schema[old[c]].dataType.simpleString(), self.data.schema[c].dataType.simpleString(), a[k], b[k]) for k, c in enumerate(columns)]
        return self.data.sparkSession.createDataFrame(rows, "column string, original string, type_before string, type_after string, missing_before long, missing_after long")

    def steps_frame(self) -> DataFrame:
        return self.data.sparkSession.createDataFrame([(s.name, s.rows, s.cells) for s in self.steps], "step string, rows long, cells long")

    def to_dict(self) -> dict:
        return {
            "dataset": self.dataset,
            "rows_before": self.before,
            "rows_after": self.after,
            "rows_removed": self.removed,
            "rows_modified": self.modified,
            "cells_modified": self.cells,
            "removed_by_reason": dict(self.reasons),
            "columns_renamed": dict(self.renamed),
            "steps": [vars(s) for s in self.steps],
            "seconds": self.seconds,
        }

    def text(self) -> str:
        lines = [f"{self.dataset}: {self.before:,} rows in, {self.after:,} out, {self.removed:,} removed, {self.modified:,} modified, {self.cells:,} cells changed"]
        lines += [f"  removed: {k}: {v:,}" for k, v in self.reasons.items()]
        return "\n".join(lines + [f"  {s.name}: {s.rows:,} rows, {s.cells:,} cells" for s in self.steps if s.rows or s.cells])


class Cleaner:
    """Cleans tables by the contracts of a catalog."""

    def __init__(self, catalog: Catalog, settings: Cleaning | None = None, *, dayfirst: bool = True) -> None:
        self.catalog, self.settings, self.dayfirst = catalog, settings or Cleaning(), dayfirst
        self._held: list[DataFrame] = []

    def clean(self, df: DataFrame, dataset: str) -> Cleaned:
        contract = self.catalog[dataset]
        began = time.perf_counter()
        try:
            out = self._clean(df, dataset, contract)
        except TablewrightError:
            raise
        except Exception as e:
            raise ProcessingFailed(f"cleaning {dataset} failed: {e}", user_message="The data could not be cleaned.", details={"dataset": dataset}) from e
        out.seconds = round(time.perf_counter() - began, 3)
        return out

    # ------------------------------------------------------------------ plan
    def annotate(self, df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame, dict[str, str], DataFrame]:
        """The frame with _original, clean columns, the number of changes by step (_n_...), _copy and _reasons; its rows with
        _changes (and without the reasons of keys); names; the numbered input."""
        cfg, df = self.settings, numbered(df)
        columns = [c for c in df.columns if c != ROW]
        mapping = renaming(columns, contract) if cfg.standardize_column_names else {c: c for c in columns}
        work = [mapping[c] for c in columns]
        texts = [mapping[c] for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
        frame = df.select(ROW, F.struct(*[quoted(c) for c in columns]).alias("_original"), *[quoted(c).alias(mapping[c]) for c in columns])
        frame = frame.withColumn("_changes", F.array().cast(_CHANGE))

        def change(frame: DataFrame, step: str, new: dict[str, Column], hit) -> DataFrame:
            """new: the value of each column; hit(name, old, new): whether it counts as a change. Values get columns of their own
            first, so that nothing is computed twice."""
            order = {c: k for k, c in enumerate(work if step in ("trim", "placeholders") else contract.columns)}
            held = frame.withColumns({f"_new_{k}": v for k, v in enumerate(new.values())}) if new else frame
            hits = {k: hit(c, quoted(c), F.col(f"_new_{k}")) for k, c in enumerate(new)}
            out = {f"_n_{step}": reduce(lambda a, b: a + b, [F.coalesce(h, F.lit(False)).cast("int") for h in hits.values()], F.lit(0))}
            if "_changes" in frame.columns and new:
                notes = [
                    F.when(
                        hits[k],
                        F.struct(F.lit(STEPS.index(step)).alias("step"), F.lit(order[c]).alias("ordinal"), F.lit(c).alias("column"), quoted(c).cast("string").alias("old"), F.col(f"_new_{k}").cast("string").alias("new")),
                    )
                    for k, c in enumerate(new)
                ]
                out["_changes"] = F.concat("_changes", F.array_compact(F.array(*notes)))
            out |= {c: F.col(f"_new_{k}") for k, c in enumerate(new)}
            return held.withColumns(out).drop(*[f"_new_{k}" for k in range(len(new))])

        differs = lambda c, old, new: old.cast("string") != new.cast("string")
        lost = lambda c, old, new: old.isNotNull() & new.isNull()
        frame = change(frame, "trim", {c: trimmed(quoted(c)) for c in texts} if cfg.trim_whitespace else {}, differs)
        stripped = {c: quoted(c) if cfg.trim_whitespace else values.strip(quoted(c)) for c in texts}
        gone = {c: without_placeholders(quoted(c), cfg.placeholder_values, b) for c, b in stripped.items()}
        frame = change(frame, "placeholders", gone, lost)
        if cfg.remove_duplicate_rows:
            bare = [quoted(c) if c in texts and cfg.trim_whitespace else values.strip(quoted(c).cast("string")) for c in work]
            frame = repeats(frame, bare, "_copy")
        else:
            frame = frame.withColumn("_copy", F.lit(False))
        live = {n: r for n, r in contract.columns.items() if n in work}
        spelled: dict[str, Column] = {}
        if cfg.standardize_categories:
            free = [n for n, rule in live.items() if rule.type == "category" and not rule.allowed]
            spellings = modal_spellings(frame.where(~F.col("_copy")), free) if free else None
            shown = bounded(spellings) if free else None  # categories are few; if not, they are joined with a shuffle
            for n, rule in live.items():
                if rule.type != "category":
                    continue
                if rule.allowed:
                    spelled[n] = spelled_as(quoted(n), rule.allowed)
                else:
                    own = (spellings if shown is None else F.broadcast(shown)).where(F.col("_c") == n).select(F.col("_k").alias(f"_k_{n}"), F.col("_v").alias(f"_v_{n}"))
                    frame = frame.join(own, values.key(quoted(n)) == F.col(f"_k_{n}"), "left").drop(f"_k_{n}")
                    spelled[n] = F.coalesce(cased(F.col(f"_v_{n}"), cfg.category_case), quoted(n).cast("string"))
        frame = change(frame, "categories", spelled, differs).drop(*[f"_v_{n}" for n in live])
        kinds = {f.name: f.dataType for f in frame.schema.fields}
        typed = [n for n, r in live.items() if r.numeric or r.temporal]
        new = {n: typed_as(quoted(n), rule, kinds[n], dayfirst=self.dayfirst) for n, rule in live.items()}
        frame = frame.withColumns({f"_full_{n}": ~values.blank(quoted(n), kinds[n]) for n in typed})
        frame = change(frame, "types", new, lambda c, old, now: F.col(f"_full_{c}") & now.isNull() if c in typed else F.lit(False))
        frame = frame.withColumns({f"_bad_{n}": F.col(f"_full_{n}") & quoted(n).isNull() for n in typed}).drop(*[f"_full_{n}" for n in typed])
        lean = self._keep(frame.drop("_changes"))
        whole = self._whole(lean, [n for n, r in live.items() if r.type == "integer"])
        reasons = self._reasons(contract, live)

        def finish(frame: DataFrame) -> DataFrame:
            out = frame.withColumns({c: quoted(c).try_cast("bigint") for c in whole})
            types = {f.name: f.dataType for f in out.schema.fields}
            defaults = {n: F.coalesce(quoted(n), F.lit(r.default).cast(types[n])) for n, r in live.items() if r.default is not None and not r.required}
            return change(out, "defaults", defaults, lambda c, old, now: old.isNull()).withColumn("_reasons", reasons)

        lean, full = finish(lean), finish(frame)
        key = [k for k in contract.business_key if k in work]
        if cfg.duplicate_keys == "quarantine" and key and len(key) == len(contract.business_key):
            parts = [values.key(quoted(k).cast("string")) for k in key]
            usable = ~F.col("_copy") & (F.size("_reasons") == 0)
            for p in parts:
                usable = usable & p.isNotNull()
            found = Repeats(lean, {"_again": (parts, usable)})
            text = F.array(F.lit(f"duplicate business key ({' + '.join(key)})"))
            lean = found.mark(lean, "_again").withColumn("_reasons", F.when(F.col("_again"), text).otherwise(F.col("_reasons"))).drop("_again")
        own = [f"_bad_{n}" for n in typed]
        return lean.drop(*own), full.drop(*own), {c: mapping[c] for c in columns if c != mapping[c]}, df

    def _keep(self, frame: DataFrame) -> DataFrame:
        """The typed frame, which all results are made from, is held (in memory, on disk beyond it) until release()."""
        self._held.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
        return self._held[-1]

    def _whole(self, frame: DataFrame, columns: list[str]) -> list[str]:
        """The integer columns that become bigint: those where every value is whole; one job for all of them."""
        if not columns or self.settings.integers != "data":
            return columns if self.settings.integers == "bigint" else []
        whole = frame.where(~F.col("_copy")).agg(*[F.bool_and(F.pmod(quoted(c), F.lit(1.0)) == 0).alias(c) for c in columns]).first()
        return [c for c in columns if whole[c] is not False]

    @staticmethod
    def _reasons(contract: Contract, live: dict) -> Column:
        found: list[Column] = []
        for n, rule in live.items():
            c, bad = quoted(n), F.col(f"_bad_{n}") if rule.numeric or rule.temporal else F.lit(False)
            if rule.numeric or rule.temporal:
                found.append(F.when(bad, f"invalid {rule.type} in {n}"))
            if rule.required:
                found.append(F.when(c.isNull() & ~bad, f"missing {n}"))
            if rule.numeric and rule.min is not None:
                found.append(F.when(c < rule.min, f"{n} negative" if rule.min == 0 else f"{n} below {rule.min:g}"))
            if rule.numeric and rule.max is not None:
                found.append(F.when(c > rule.max, f"{n} above {rule.max:g}"))
            if rule.allowed:
                found.append(F.when(~c.isin(list(rule.allowed)), f"{n} not in allowed list"))
        for r in contract.consistency_rules:
            if r.column in live and r.reference in live:
                a, b = quoted(r.column), quoted(r.reference)
                found.append(F.when(a < b, f"{r.column} before {r.reference}") if r.type == "not_before" else F.when(a > b, f"{r.column} after {r.reference}"))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    # ---------------------------------------------------------------- result
    def _clean(self, df: DataFrame, dataset: str, contract: Contract) -> Cleaned:
        cfg = self.settings
        self._held = []
        frame, full, renamed, original = self.annotate(df, contract)
        keep_bad = cfg.invalid_rows == "keep"
        bad = F.size("_reasons") > 0
        kept = ~F.col("_copy") & (F.lit(True) if keep_bad else ~bad)
        frame = frame.withColumn("_kept", kept)
        changed = [f"_n_{s}" for s in STEPS]
        columns = [c for c in frame.columns if c not in (ROW, "_original", "_copy", "_reasons", "_kept", *changed)]
        joined = F.array_join("_reasons", "; ")
        data = frame.where("_kept").select(ROW, *map(quoted, columns), *([F.when(bad, joined).alias(ISSUES)] if keep_bad else []))
        reason = F.when(F.col("_copy"), COPY_REASON).otherwise(joined)
        quarantine = frame.where("not _kept").select(ROW, "_original.*", reason.alias(REASON)).orderBy(ROW)
        some = reduce(lambda a, b: a | b, [(F.col(n) > 0) for n in changed])
        counts = frame.agg(
            F.count("*").alias("n"),
            F.count_if("_kept").alias("kept"),
            F.count_if("_copy").alias("copies"),
            F.count_if(~F.col("_copy") & bad).alias("bad"),
            F.count_if(F.col("_kept") & some).alias("modified"),
            *[F.coalesce(F.sum(F.when(~F.col("_copy") | F.lit(k < 2), F.col(n))), F.lit(0)).alias(s) for k, (s, n) in enumerate(zip(STEPS, changed, strict=True))],  # copies leave after the first two
            F.count_if(~F.col("_copy") & (F.col("_n_types") > 0)).alias("typed"),
        ).first()
        log = full.select(ROW, F.filter("_changes", lambda c: ~F.col("_copy") | (c["step"] < 2)).alias("_changes"))
        out = Cleaned(dataset, data, quarantine, log, original, renamed, cfg.change_log_limit)
        out.before, out.after, out.removed, out.modified = counts["n"], counts["kept"], counts["n"] - counts["kept"], counts["modified"]
        out.cells = sum(counts[s] for s in STEPS)
        for s in STEP_NAMES:
            if s in STEPS:
                skipped = (s == "trim" and not cfg.trim_whitespace) or (s == "categories" and not cfg.standardize_categories)
                if not skipped:
                    out.steps.append(Step(STEP_NAMES[s], counts["typed"] if s == "types" else 0, counts[s]))
            elif s == "copies" and cfg.remove_duplicate_rows:
                out.steps.append(Step(STEP_NAMES[s], counts["copies"]))
            elif s == "quarantine":
                out.steps.append(Step(STEP_NAMES[s], counts["bad"]))
            elif s == "names" and cfg.standardize_column_names:
                out.steps.append(Step(STEP_NAMES[s], 0))
        out.held = list(self._held)
        if out.removed:
            out.reasons = {r["reason"]: r["n"] for r in reason_histogram(quarantine).collect()}  # a row for each kind of reason
        return out


def reason_histogram(quarantine: DataFrame) -> DataFrame:
    """reason, n: the most frequent first."""
    each = quarantine.select(F.explode(F.split(REASON, "; ")).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
