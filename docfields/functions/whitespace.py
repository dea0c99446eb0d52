"""White space as Python's `str.strip` and `\\s` see it; Spark's `trim` and Java's `\\s` see less."""

from pyspark.sql import Column, functions as F

# Every character for which `str.isspace` holds; none lies above U+3000.
WHITESPACE = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())


def _as_class(chars: str) -> str:
    """`chars` as ranges for use inside a regular expression class."""
    parts, start = [], 0
    for i, char in enumerate(chars):
        if i + 1 == len(chars) or ord(chars[i + 1]) != ord(char) + 1:
            first, last = ord(chars[start]), ord(char)
            parts.append(f"\\x{{{first:x}}}" if first == last else f"\\x{{{first:x}}}-\\x{{{last:x}}}")
            start = i + 1
    return "".join(parts)


SPACE_CLASS = _as_class(WHITESPACE)
# A run that is not already one plain space.
_UNEVEN_RUN = f"(?: [{SPACE_CLASS}]|[{_as_class(WHITESPACE.replace(' ', ''))}])[{SPACE_CLASS}]*"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(c, _UNEVEN_RUN, " ")
