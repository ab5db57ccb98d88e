"""Text functions (F01-F07). A missing value stands for an error."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tabulon.functions.values import bind, number_text


def as_text(c: Column, kind: str = "string") -> Column:
    return F.coalesce(number_text(c) if kind in ("double", "float") else c.cast("string"), F.lit(""))


def upper(c: Column) -> Column:
    return F.upper(as_text(c))


def _nth(text: Column, find: Column, n: int) -> Column:
    """1-based position of the n-th occurrence, overlapping ones counted; 0 when there are fewer."""
    # One step per occurrence over a single accumulator; -1 marks that the occurrences ran out.
    step = lambda at, _: F.when(at < 0, at).otherwise(F.coalesce(F.nullif(_locate(find, text, at + 1), F.lit(0)), F.lit(-1)))
    return F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), step), F.lit(0))


def _locate(find: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", find, text, start)


def substitute(c: Column, old: str, new: str, instance: int | None = None) -> Column:
    """Replace every occurrence or only the n-th; null when ``instance`` is below 1."""
    text = as_text(c)
    if old == "":
        return text
    if instance is None:
        return F.replace(text, F.lit(old), F.lit(new))
    if instance < 1:
        return F.lit(None).cast("string")
    pos = _nth(text, F.lit(old), instance)
    head = F.substring(text, F.lit(1), pos - 1)
    tail = F.substring(text, pos + len(old), F.length(text))
    return F.when(pos > 0, F.concat(head, F.lit(new), tail)).otherwise(text)


def text_before(c: Column, delimiter: str, instance: int = 1) -> Column:
    """Text before the n-th delimiter; any negative instance means the last one; null when missing."""
    text = as_text(c)
    if delimiter == "":
        return F.lit("")
    if instance < 0:
        # Everything but the piece after the last delimiter and the delimiter itself.
        last = F.length(F.substring_index(text, delimiter, -1))
        kept = F.length(text) - last - len(delimiter)
        return F.when(F.contains(text, F.lit(delimiter)), F.substring(text, F.lit(1), kept))
    n = max(1, instance)
    found = _occurrences(text, delimiter) >= n
    return F.when(found, F.substring_index(text, delimiter, n))


def text_after(c: Column, delimiter: str, instance: int = 1) -> Column:
    text = as_text(c)
    if delimiter == "":
        return text
    if instance < 0:
        return F.when(F.contains(text, F.lit(delimiter)), F.substring_index(text, delimiter, -1))
    n = max(1, instance)
    before = F.substring_index(text, delimiter, n)
    rest = F.substring(text, F.length(before) + len(delimiter) + 1, F.length(text))
    return F.when(_occurrences(text, delimiter) >= n, rest)


def _occurrences(text: Column, delimiter: str) -> Column:
    removed = F.length(F.replace(text, F.lit(delimiter), F.lit("")))
    return F.floor((F.length(text) - removed) / F.lit(len(delimiter)))


def _splitter(delimiters: Sequence[str]) -> str:
    return "|".join(re.escape(d) for d in delimiters if d)


def text_split(c: Column, columns: Sequence[str] | str, rows: Sequence[str] | str = (), ignore_empty: bool = False) -> Column:
    """Array of rows, each an array of cells; shorter rows are padded with nulls."""
    text = as_text(c)
    cd = [columns] if isinstance(columns, str) else list(columns)
    rd = [rows] if isinstance(rows, str) else list(rows)
    lines = F.split(text, _splitter(rd), -1) if _splitter(rd) else F.array(text)
    if ignore_empty:
        lines = F.filter(lines, lambda x: x != "")

    def cells(line: Column) -> Column:
        parts = F.split(line, _splitter(cd), -1) if _splitter(cd) else F.array(line)
        return F.filter(parts, lambda x: x != "") if ignore_empty else parts

    def padded(grid: Column) -> Column:
        none = F.lit(None).cast("string")
        width = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(1)))
        # The width is found once for the text, and a row gets only the nulls it lacks.
        return bind(width, lambda w: F.transform(grid, lambda r: F.concat(r, F.array_repeat(none, w - F.size(r)))))

    return bind(F.transform(lines, cells), padded)


def search(needle: str, c: Column, start: int = 1) -> Column:
    """1-based case-insensitive position honouring ``*`` and ``?``; null when not found."""
    text, find, start = F.lower(as_text(c)), needle.lower(), max(1, int(start))
    inside = F.length(text) + 1 >= start
    if re.search(r"[*?]", find):
        body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in find)
        at = F.regexp_instr(F.substring(text, F.lit(start), F.length(text)), F.lit("(?i)" + body))
        pos = F.when(at > 0, at + (start - 1))
    else:
        at = _locate(F.lit(find), text, F.lit(start)) if find else F.lit(start)
        pos = F.when(at > 0, at)
    return F.when(inside, pos)


def find(needle: str, c: Column, start: int = 1) -> Column:
    """1-based case-sensitive position; null when not found."""
    at = _locate(F.lit(needle), as_text(c), F.lit(max(1, int(start))))
    return F.when(at > 0, at)


def value(c: Column) -> Column:
    """Number in a text: commas dropped, a trailing percent divides by 100, blank is 0."""
    t = F.replace(F.trim(as_text(c)), F.lit(","), F.lit(""))
    percent = t.endswith("%")
    n = F.when(percent, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    shown = F.when(n.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(n).try_cast("double"))
    return F.when(t == "", F.lit(0.0)).otherwise(F.when(percent, shown / 100).otherwise(shown))


def text_join(delimiter: str, skip_empty: bool, *cells: Column) -> Column:
    if skip_empty:
        return F.concat_ws(delimiter, *[F.nullif(c.cast("string"), F.lit("")) for c in cells])
    return F.concat_ws(delimiter, *[as_text(c) for c in cells])
