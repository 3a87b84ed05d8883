"""Guards of uploads and queries. Driver only; they look at names, sizes and the first bytes."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from tablewright.errors import SourceError, UnsupportedFile
from tablewright.plans.settings import Upload

#: First bytes of files that are no text.
PROGRAM, PDF, ARCHIVE, OLD_OFFICE, SCRIPT = (b"MZ", b"\x7fELF"), (b"%PDF",), (b"PK\x03\x04",), (b"\xd0\xcf\x11\xe0",), (b"#!",)
#: Byte order marks of encodings in which a zero byte is text.
WIDE_TEXT = (b"\xff\xfe", b"\xfe\xff")
#: Bytes that are looked at, and characters that a name may have.
HEAD, NAME = 8192, 200
#: What a file name may hold beside letters and digits; words that a read-only query must not hold.
NAME_SIGNS = "_.-()&+ "
CHANGING = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "merge", "replace", "attach", "pragma")


def safe_name(name: str) -> str:
    """The last part of a path in its composed form: control characters go, other signs become _."""

    def safe(sign: str) -> str:
        if sign.isalnum() or sign in NAME_SIGNS:
            return sign
        return "" if unicodedata.category(sign)[0] == "C" else "_"

    last = re.split(r"[/\\]", name)[-1]
    kept = "".join(map(safe, unicodedata.normalize("NFKC", last))).strip(". ")
    if not kept:
        raise UnsupportedFile(f"{name!r} is no usable file name")
    return kept[:NAME]


def size_label(n: int) -> str:
    value = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if value < 1024 or unit == "GB":
            return f"{value:.0f} {unit}" if unit == "B" else f"{value:.1f} {unit}"
        value /= 1024
    return ""


def check_size(name: str, size: int, upload: Upload) -> None:
    if size == 0:
        raise UnsupportedFile(f"{name} is empty")
    if size > upload.max_file_size_mb * 1024 * 1024:
        raise UnsupportedFile(f"{name} has {size_label(size)}; at most {upload.max_file_size_mb:g} MB are taken")


def _faults_of_workbooks(head: bytes) -> Iterator[str]:
    if not head.startswith(ARCHIVE):
        yield "is no Excel workbook"


def _faults_of_text(head: bytes) -> Iterator[str]:
    kinds = {"a program": PROGRAM, "a PDF document": PDF, "a compressed archive": ARCHIVE, "a workbook of an old format": OLD_OFFICE, "a script": SCRIPT}
    yield from (f"is {kind}, not text" for kind, marks in kinds.items() if head.startswith(marks))
    if 0 in head and not head.startswith(WIDE_TEXT):
        yield "holds binary data"


#: What is wrong with the first bytes of a file, by its ending; of other endings, as text.
FAULTS: dict[str, Callable[[bytes], Iterator[str]]] = {"xlsx": _faults_of_workbooks}


def check_upload(name: str, content: bytes, upload: Upload | None = None) -> str:
    """The safe name of an upload that may be read."""
    name, upload = safe_name(name), upload or Upload()
    _, dot, ending = name.lower().rpartition(".")
    if dot + ending not in upload.allowed_extensions:
        raise UnsupportedFile(f"{name} is none of {', '.join(upload.allowed_extensions)}")
    check_size(name, len(content), upload)
    for fault in FAULTS.get(ending, _faults_of_text)(content[:HEAD]):
        raise UnsupportedFile(f"{name} {fault}")
    return name


def sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def check_identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", name, re.ASCII):
        raise SourceError(f"{name!r} is no table name")
    return name


def _without_literals(query: str) -> str:
    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " '' ", query, flags=re.S)


def _changes(spark: SparkSession, query: str) -> bool:
    """Whether a statement does anything but select, by the plan that Spark's parser makes of it. ParseException: not one
    statement, or of another dialect."""
    jvm = spark.sparkContext._jvm
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    doing = [jvm.java.lang.Class.forName(logical + kind) for kind in ("Command", "ParsedStatement")]
    plans = [spark._jsparkSession.sessionState().sqlParser().parsePlan(query)]
    while plans:
        plan = plans.pop()
        if any(kind.isInstance(plan) for kind in doing):
            return True
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    return False


def check_query(query: str, *, foreign: bool = False) -> str:
    """A single SELECT or WITH that changes nothing. Spark's parser decides, where there is a session; of what it cannot read in a
    foreign dialect, the words outside literals, quoted names and comments do."""
    bare = _without_literals(query).strip().rstrip(";")
    refused = SourceError("only one SELECT or WITH statement is taken", user_message="The query must be a single SELECT that changes nothing.")
    if not re.match(r"(?i)(select|with)\b", bare):
        raise refused
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and _changes(spark, query.strip().rstrip(";")):
            raise refused
        by_words = spark is None
    except ParseException as e:
        if not foreign:
            raise refused from e
        by_words = True
    if by_words and (";" in bare or re.search(rf"(?i)\b({'|'.join(CHANGING)})\b(?!\s*\()", bare)):
        raise refused
    return query.strip().rstrip(";")


def redact(text: str) -> str:
    """A text without the passwords of its URLs and settings."""
    text = re.sub(r"(://[^:/@\s]+:)[^@\s]*(?=@)", r"\1***", text)
    return re.sub(r"(?i)\b((?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*)[^;&,\s]+", r"\1***", text)
