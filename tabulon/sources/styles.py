"""Number formats of workbook cells: their class and the text that a cell shows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabulon.functions.dates import serial_to_timestamp
from tabulon.functions.values import bind, number_text

# Format codes behind the built-in ids of the office file standard.
BUILT_IN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss",
    22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
# Format codes that open document files give typed cells.
OPEN_DOCUMENT = {"date": "yyyy-mm-dd", "time": "[h]:mm:ss", "percentage": "0.00%"}


def _bare(code: Column) -> Column:
    """First section of a code in lower case, without quoted text, escaped characters and colours; elapsed units stay."""
    plain = F.regexp_replace(F.lower(code), r'"[^"]*"|\\.|_.|\*.', "")
    units = F.regexp_replace(plain, r"\[(h+|m+|s+)\]", "$1")
    return F.split(F.regexp_replace(units, r"\[[^\]]*\]", ""), ";")[0]


def format_class(code: Column) -> Column:
    """``date, time, datetime, percent, text, scientific, number`` or ``general`` of a format code; null codes are general."""

    def kind(bare: Column) -> Column:
        day, hour = bare.rlike("[yd]"), bare.rlike("[hs]")
        return (
            F.when(F.trim(bare).isin("", "general"), "general").when(day & hour, "datetime").when(day, "date").when(hour, "time")
            .when(bare.rlike("m"), "date").when(F.contains(bare, F.lit("%")), "percent").when(F.contains(bare, F.lit("@")), "text")
            .when(bare.rlike("[0#?]e[+-]"), "scientific").when(bare.rlike("[0#?]"), "number").otherwise("general")
        )

    return F.coalesce(bind(_bare(code), kind), F.lit("general"))


def display_text(value: Column, code: Column) -> Column:
    """What a number with a format code shows, by its class: ISO dates and times, grouped and rounded numbers, per cent.

    Literal parts and colours of a code are left out; fractions and exponents show as plain numbers.
    """
    number, bare = value.try_cast("double"), _bare(code)
    digits = F.length(F.regexp_extract(bare, r"\.([0#?]+)", 1))

    def rounded(x: Column) -> Column:
        # Round half up on the decimal text, as many digits as the code has places for.
        text = F.format_number(x, 0)
        for n in range(1, 11):
            text = F.when(digits == n, F.format_number(x, n)).otherwise(text)
        return F.when(F.contains(bare, F.lit(",")), text).otherwise(F.replace(text, F.lit(","), F.lit("")))

    moment = serial_to_timestamp(number)
    whole = F.floor(number * 24).cast("bigint").cast("string")
    kind = format_class(code)
    elapsed = F.when(F.lower(code).rlike(r"\[h+\]"), F.concat(whole, F.date_format(moment, ":mm:ss"))).otherwise(F.date_format(moment, "HH:mm:ss"))
    shown = (
        F.when(kind == "date", F.date_format(moment, "yyyy-MM-dd")).when(kind == "datetime", F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "time", elapsed).when(kind == "percent", F.concat(rounded(number * 100), F.lit("%")))
        .when(kind == "number", rounded(number)).otherwise(number_text(number))
    )
    return F.coalesce(shown, value)
