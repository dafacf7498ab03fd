"""Text patterns, paging and sorting rules of the query surface."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ROWS, MOST_ROWS = 50, 500
#: File name extensions and their languages.
LANGUAGES = {
    ".go": "go",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".py": "python",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".java": "java",
    ".php": "php",
    ".rb": "ruby",
}


def escaped(text: str) -> str:
    """Text whose wildcards stand for themselves in a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def glob(pattern: str) -> str | None:
    """LIKE pattern of a glob with * alone; None matches everything."""
    return None if pattern in ("", "*") else escaped(pattern).replace("*", "%")


def under(prefix: str) -> str:
    """LIKE pattern of paths below a directory."""
    return escaped(prefix if prefix.endswith("/") else prefix + "/") + "%"


def ends_like(column: Column, text: str) -> Column:
    """The text itself, or a path that ends in it, whatever the case of ASCII letters."""
    lowered = F.translate(column, string.ascii_uppercase, string.ascii_lowercase)
    return (column == text) | lowered.endswith("/" + text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def page(limit: int | None, offset: int | None) -> tuple[int, int]:
    """Rows and offset: 50 rows unless asked for, 500 at most, none for 0; no negative offset."""
    rows = DEFAULT_ROWS if limit is None or limit < 0 else min(limit, MOST_ROWS)
    return rows, max(offset or 0, 0)


def language(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, ending)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)", 1)


def module_source(source: Column) -> Column:
    """An import source without a leading ./ and a script file's extension."""
    return F.regexp_replace(F.regexp_replace(source, r"^\./", ""), r"\.(tsx?|jsx?|mjs|cjs)$", "")


def basename(path: Column) -> Column:
    return last_segment(path)


def stem(path: Column) -> Column:
    """A file's name without its last ending."""
    return F.regexp_replace(last_segment(path), r"(.)\.[^.]*$", "$1")


def without_pointer(type_expr: Column) -> Column:
    """A type expression without leading * and &."""
    return F.regexp_replace(type_expr, r"^[*&\s]+", "")


def package_part(dotted: Column) -> Column:
    """A dotted import without its last segment."""
    return F.regexp_replace(dotted, r"\.?[^.]*$", "")


def exported(name: Column) -> Column:
    """Whether a name begins with an upper-case letter of ASCII."""
    return name.rlike("^[A-Z]")


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def contains(line: int | Column, col: int | Column, prefix: str = "") -> Column:
    """Whether the span of a row holds a position, ends included."""
    c = lambda name: F.col(prefix + name)
    line, col = (x if isinstance(x, Column) else F.lit(x) for x in (line, col))
    after = (c("start_line") < line) | ((c("start_line") == line) & (c("start_col") <= col))
    before = (c("end_line") > line) | ((c("end_line") == line) & (c("end_col") >= col))
    return after & before
