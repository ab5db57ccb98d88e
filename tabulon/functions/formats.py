"""Display formats and result text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.dates import serial_to_timestamp
from tabulon.functions.values import number_text

# Currency and date shape per locale.
CURRENCY = {"en": ("$", "", 2), "fr": ("", " €", 2), "ja": ("¥", "", 0)}
DATE_SHAPE = {"en": "MM/dd/yyyy", "fr": "dd/MM/yyyy", "ja": "yyyy/MM/dd"}


def _fixed(c: Column, digits: int, grouped: bool) -> Column:
    # Half-up on the shortest decimal text of the number, as spreadsheets show it.
    text = F.format_number(F.round(c, digits), digits)
    return text if grouped else F.replace(text, F.lit(","), F.lit(""))


def format_value(c: Column, preset: str, locale: str = "en") -> Column:
    """Text of a number (or date serial) under a preset: general, number, thousands, percent, currency, date, datetime, time."""
    if preset == "general":
        return number_text(c)
    if preset == "number":
        return _fixed(c, 2, False)
    if preset == "thousands":
        return _fixed(c, 2, True)
    if preset == "percent":
        return F.concat(_fixed(c * 100, 2, False), F.lit("%"))
    if preset == "currency":
        before, after, digits = CURRENCY[locale]
        amount = F.concat(F.lit(before), _fixed(F.abs(c), digits, True), F.lit(after))
        return F.when(c < 0, F.concat(F.lit("-"), amount)).otherwise(amount)
    ts = serial_to_timestamp(c)
    shapes = {"date": DATE_SHAPE[locale], "datetime": DATE_SHAPE[locale] + " HH:mm", "time": "HH:mm:ss"}
    return F.date_format(ts, shapes[preset])


def result_text(df: DataFrame, column: str) -> Column:
    """Cell text of a query result: ISO dates, ``d.hh:mm:ss`` durations, TRUE/FALSE, empty for null."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType.typeName()
    if kind in ("double", "float"):
        text = number_text(c)
    elif kind == "boolean":
        text = F.upper(c.cast("string"))
    elif kind == "date":
        text = F.date_format(c, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif kind.startswith("interval day") or kind == "daytimeinterval":
        # Whole days towards zero, then the time of day that follows the last midnight.
        part = lambda p, seconds: F.extract(F.lit(p), c).cast("double") * seconds
        total = F.floor(part("DAY", 86400) + part("HOUR", 3600) + part("MINUTE", 60) + part("SECOND", 1)).cast("bigint")
        rest = F.pmod(total, F.lit(86400))
        two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
        days = (total / 86400).cast("bigint").cast("string")
        text = F.concat_ws(":", F.concat(days, F.lit("."), two(rest / 3600)), two(rest % 3600 / 60), two(rest % 60))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))
