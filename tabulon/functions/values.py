"""Number, blank and truth rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the pattern of a number typed as text.
NUMBER_PATTERN = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
NUMERIC_TYPES = ("byte", "short", "integer", "long", "float", "double", "decimal")


def text_number(c: Column) -> Column:
    """Double when the text matches the number pattern; the test first, as failed casts are slow."""
    t = F.trim(c)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def to_number(c: Column, kind: str = "string") -> Column:
    """Double of a number or of number-like text, null for anything else; ``kind`` is the column's type name."""
    if kind in NUMERIC_TYPES:
        return c.cast("double")
    return text_number(c.cast("string"))


def is_blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def finite(c: Column) -> Column:
    """Null in place of NaN and infinities, which stand for a numeric error."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def number_text(c: Column) -> Column:
    """A number as text with at most 15 significant digits and no trailing zeros."""
    d = c.cast("double")
    plain = d.cast("string")

    def rounded(digits: Column) -> Column:
        # ``digits`` is d.dddddddddddddde+xx: 15 significant digits.
        exponent = F.regexp_extract(digits, r"e([-+]\d+)$", 1).cast("int")
        mantissa = F.regexp_replace(F.substring_index(digits, "e", 1), r"\.?0+$", "")
        sign = F.when(exponent < 0, "-").otherwise("+")
        wide = F.concat(mantissa, F.lit("e"), sign, F.abs(exponent).cast("string"))
        fixed = F.regexp_replace(digits.cast("double").cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
        return F.when((exponent < -6) | (exponent >= 15), wide).otherwise(fixed)

    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when((d == F.floor(d)) & (F.abs(d) < 1e15), d.try_cast("bigint").cast("string"))
        # The usual case: the shortest text already has 15 digits or fewer.
        .when((F.length(plain) <= 16) & ~plain.contains("E"), plain)
        .otherwise(bind(F.format_string("%.14e", d), rounded))
    )


def sql_text(c: Column, kind: str = "double") -> Column:
    """A cell as a cast to VARCHAR shows it: a double keeps a digit after its point, and has an exponent below 1e-4 and from 1e16."""
    plain = c.cast("string")
    if kind != "double":
        return plain
    size = F.abs(c)

    def scientific(text: Column) -> Column:
        power = F.substring_index(text, "E", -1).cast("int")
        sign = F.when(power < 0, "e-").otherwise("e+")
        digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
        return F.concat(digits, sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))

    # Spark turns to an exponent earlier, below 1e-3 and from 1e7.
    fixed = F.regexp_replace(plain.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    named = F.when(F.isnan(c), "nan").when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
    ranged = F.when((size >= 1e-4) & (size < 1e16), fixed).otherwise(scientific(plain))
    return F.coalesce(named, F.when(plain.contains("E"), ranged).otherwise(plain))


def truthy(c: Column, kind: str) -> Column:
    """Condition value of a cell: blank false, zero false, TRUE/FALSE text named; other text is an error (null)."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        t = F.upper(F.trim(c))
        return F.when(c.isNull(), F.lit(False)).when(t == "TRUE", F.lit(True)).when(t == "FALSE", F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and pass it to ``use``.

    A column expression is copied wherever it is used; long chains would outgrow the generated method.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
