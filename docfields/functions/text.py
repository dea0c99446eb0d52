"""Page text, key and cell clean-up."""

from pyspark.sql import Column, functions as F

from docfields.functions.whitespace import collapse, strip


def clean_text(c: Column) -> Column:
    """Lower-cased and stripped page text; a page that could not be read is empty text."""
    return F.coalesce(strip(F.lower(c)), F.lit(""))


def normalize_text(c: Column) -> Column:
    return collapse(strip(F.lower(c)))


def normalize_key(c: Column) -> Column:
    return F.lower(strip(c))


def normalize_cell(c: Column) -> Column:
    """A table cell as it enters the signature. Once collapsed, only plain spaces are left to strip."""
    return F.lower(F.btrim(collapse(F.coalesce(c.cast("string"), F.lit("")))))


def normalize_header(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
