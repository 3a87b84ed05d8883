"""Column builders for raw text: stripping, blanks, comparison keys, numbers and dates. No UDFs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: The currency signs that numbers may carry.
CURRENCY = "₹$€£"
#: How a date may start; only such text is looked at further.
_DATED = rf"^[{WHITE}]*(\d{{4}}([{WHITE}]|$)|\d{{8}}|\d{{4}}[-/.]\d|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d|\d{{1,2}}[- ][A-Za-z]{{3}}|[A-Za-z]{{3,9}}[ -]\d)"
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


@dataclass(frozen=True)
class Cell:
    """A parsed cell: its value, whether it is blank, whether it has a value that is not of the type."""

    value: Column
    blank: Column
    invalid: Column

    @property
    def valid(self) -> Column:
        return ~self.blank & ~self.invalid


def let(value: Column, use) -> Column:
    """use(value) with value computed once and the code of use kept apart; for parts that few cells reach."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tidy(c: Column) -> Column:
    """Whether a text is ASCII without white space but single spaces inside: nothing to strip or collapse."""
    return (F.octet_length(c) == F.char_length(c)) & ~c.rlike(r"[\t-\r\x1c-\x1f]|^ | $|  ")


def strip(c: Column) -> Column:
    return F.when(tidy(c), c).otherwise(F.btrim(c, F.lit(WHITE)))


def squeeze(c: Column) -> Column:
    """Stripped, with inner white space collapsed to one space."""
    return F.when(tidy(c), c).otherwise(F.regexp_replace(F.btrim(c, F.lit(WHITE)), f"[{WHITE}]+", " "))


def key(c: Column) -> Column:
    """Comparison key: squeezed and folded. Folding is lower() and ß as ss; other special foldings are not made."""
    return F.replace(F.lower(squeeze(c.cast("string"))), F.lit("ß"), F.lit("ss"))


def blank(c: Column, kind: T.DataType | None = None) -> Column:
    """NULL, or text of white space only. For floating columns NaN is NULL too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if kind is not None and not isinstance(kind, T.StringType):
        return c.isNull()
    return c.isNull() | F.when(F.ascii(c).between(33, 126), F.lit(False)).otherwise(F.btrim(c, F.lit(WHITE)) == "")


def _dressed(text: Column) -> Column:
    """A number without separators and signs of currency; parentheses make it negative."""
    signed = F.when(text.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.btrim(text, F.lit("()")))).otherwise(text)
    return F.when(signed.rlike(_NUMBER), signed.try_cast("double"))


def number(c: Column, kind: T.DataType | None = None) -> Cell:
    """Numbers with thousands separators, currency signs, a per cent sign, or parentheses for negatives."""
    empty = blank(c, kind)
    if isinstance(kind, T.BooleanType):
        return Cell(F.lit(None).cast("double"), empty, ~empty)
    if isinstance(kind, T.NumericType):
        value = c.cast("double")
        return Cell(F.nullif(value, F.lit(float("nan"))), empty, F.lit(False))
    if kind is not None and not isinstance(kind, T.StringType):
        return Cell(F.lit(None).cast("double"), empty, ~empty)
    last = F.substring(c, -1, 1)  # plain digits need no pattern; a cast alone would take 5d and hexadecimal
    plain = F.when(last.between("0", "9") & ~F.lower(c).contains("x"), c.try_cast("double"))
    value = F.coalesce(plain, F.when(~empty, let(F.regexp_replace(F.regexp_replace(c, f"[,{WHITE}{CURRENCY}]", ""), "%$", ""), _dressed)))
    return Cell(value, empty, ~empty & value.isNull())


def _clock(t: Column) -> Column:
    """`` HH:MM:SS`` of a 24- or 12-hour time, empty for none, NULL for anything else."""
    part = lambda n: F.regexp_extract(t, r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([AaPp][Mm])?$", n)
    hour, half = part(1).try_cast("int"), F.lower(part(4))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    second = F.when(part(3) == "", "00").otherwise(part(3))
    return F.when(t == "", F.lit("")).when(hour.isNotNull(), F.concat(F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(2), F.lit(":"), second))


def _written(text: Column, dayfirst: bool) -> Column:
    parts = r"^(\S.*?)(?:(?<=\d)(?: +|T)(\d{1,2}:\d{2}.*))?$"
    day, clock = F.regexp_extract(text, parts, 1), _clock(F.regexp_extract(text, parts, 2))
    plain = F.regexp_replace(F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), "[/.]", "-")
    by_iso = F.when(plain.rlike(r"^\d{4}(-\d{1,2}){0,2}$"), plain.try_cast("date"))
    full = F.regexp_replace(F.regexp_replace(plain, r"^(\d+-\d+)-([0-5]\d|6[0-8])$", "$1-20$2"), r"^(\d+-\d+)-(69|[7-9]\d)$", "$1-19$2")
    orders = [F.regexp_replace(full, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", to).try_cast("date") for to in ("$3-$2-$1", "$3-$1-$2")]
    by_order = F.when(full.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.coalesce(*(orders if dayfirst else orders[::-1])))
    name = F.regexp_replace(day, r"^(\d{1,2})[- ]([A-Za-z]{3})[A-Za-z]{0,6}[-, ]+(\d{4})$", "$3-$2-$1")
    name = F.regexp_replace(name, r"^([A-Za-z]{3})[A-Za-z]{0,6}[ -](\d{1,2}),?[- ]+(\d{4})$", "$3-$1-$2")
    month = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 6, 3)))
    numbered = F.concat(F.substring(name, 1, 5), ((month + 2) / 3).cast("int").cast("string"), F.substring(name, 9, 3))
    by_name = F.when(name.rlike(r"^\d{4}-[A-Za-z]{3}-\d{1,2}$") & (month % 3 == 1), numbered.try_cast("date"))
    return F.concat(F.coalesce(by_iso, by_order, by_name).cast("string"), clock).try_cast("timestamp_ntz")


def timestamp(c: Column, *, dayfirst: bool = True) -> Column:
    """The closed list of date forms: ISO-8601 (also yyyy, yyyy-MM, yyyyMMdd, yyyy/M/d), day and month in either order with
    - / or . (the other order where the preferred one is impossible), and months by name; each with an optional time of day.
    Times alone and words such as today are not dates."""
    usual = F.when((F.char_length(c) == 10) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-"), c.try_cast("date").cast("timestamp_ntz"))
    return F.coalesce(usual, F.when(c.rlike(_DATED), let(F.btrim(c, F.lit(WHITE)), lambda text: _written(text, dayfirst))))


def date(c: Column, kind: T.DataType | None = None, *, time: bool = False, dayfirst: bool = True) -> Cell:
    """Dates, or moments with time=True."""
    empty = blank(c, kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = c.cast("timestamp_ntz")
    elif kind is None or isinstance(kind, T.StringType):
        value = timestamp(c, dayfirst=dayfirst)
    else:
        value = F.lit(None).cast("timestamp_ntz")
    value = value if time else value.cast("date")
    return Cell(value, empty, ~empty & value.isNull())


def title(c: Column) -> Column:
    """Each run of letters starts in upper case, whatever stands before it."""
    words = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, F.initcap), "")


def flat_case(c: Column) -> Column:
    """Whether all letters are of one case."""
    return ((c == F.upper(c)) | (c == F.lower(c))) & (F.upper(c) != F.lower(c))
