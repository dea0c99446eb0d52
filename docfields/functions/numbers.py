"""Number clean-up."""

from pyspark.sql import Column, functions as F

from docfields.fixed import NUMERIC
from docfields.functions.whitespace import strip


def plain_number(value: Column, locale: str | None = None) -> Column:
    """The cleaned string: spaces removed, then commas.

    With both `,` and `.` the commas go; with commas only, each becomes a dot. `locale="es"` reads
    `1.234,56` instead: dots go, the comma is the decimal point.
    """
    bare = F.replace(value, F.lit(" "), F.lit(""))
    if locale == "es":
        return F.when(
            F.contains(bare, F.lit(",")), F.translate(F.replace(bare, F.lit("."), F.lit("")), ",", ".")
        ).otherwise(bare)
    if locale is not None:
        raise ValueError(f"unknown locale {locale!r}")
    both = F.contains(bare, F.lit(",")) & F.contains(bare, F.lit("."))
    return F.when(both, F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.translate(bare, ",", "."))


def number_or_null(plain: Column, number_type: str = "double") -> Column:
    """The cleaned string as a number, NULL if it is none.

    The pattern is needed because casts accept `5d`, `nan` and the like. A number too large for its type is none.
    """
    trimmed = strip(plain)
    number = F.when(trimmed.rlike(f"^(?:{NUMERIC})$"), trimmed.try_cast(number_type))
    return F.when(F.abs(number.cast("double")) < F.lit(float("inf")), number)


def normalize_number(value: Column, locale: str | None = None, number_type: str = "double") -> Column:
    """`struct<num, str>` with exactly one of the two set (both NULL for a NULL value)."""
    plain = plain_number(value, locale)
    num = number_or_null(plain, number_type)
    return F.struct(num.alias("num"), F.when(num.isNull(), plain).alias("str"))
