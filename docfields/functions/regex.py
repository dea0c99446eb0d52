"""Regular expressions: from the catalogue's Python dialect to the one Spark evaluates (Java)."""

import functools
import re
import unicodedata
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession, functions as F

from docfields.functions.whitespace import SPACE_CLASS

# i: ignore case, s: dot matches newline, U: Unicode \s \w \d \b, d: only \n ends a line.
FIELD_FLAGS = "(?isUd)"
CUE_FLAGS = "(?iUd)"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"

_TOKEN = re.compile(
    r"\\N\{(?P<name>[^}]+)\}|\\U(?P<wide>[0-9A-Fa-f]{8})|\\(?P<octal>0[0-7]{0,2}|[1-3][0-7]{2})|\\."
    r"|\(\?P<(?P<group>\w+)>|\(\?P=(?P<back>\w+)\)|\(\?\(|\(\?(?P<flags>[aiLmsux]*(?:-[imsx]+)?)(?P<end>[:)])"
    r"|\{(?P<least>\d*)(?P<most>,\d*)?\}|.", re.DOTALL)
# Escapes that mean one letter in Python and a class, or nothing, to the engine; the second holds inside a class only.
_LETTERS = {r"\v": r"\x0B"}
_CLASS_LETTERS = {**_LETTERS, r"\b": r"\x08"}
_ASCII_PUNCTUATION = r"([!-/:-@\[-`{-~])"


class CatalogError(ValueError):
    """A catalogue or one of its patterns cannot be used."""


def _flags(flags: str, end: str) -> str:
    """Inline flags: `a` turns Unicode classes off, `u` is how it is anyway."""
    on, _, off = flags.partition("-")
    off += "U" if "a" in on else ""
    on = "".join(c for c in on if c not in "au")
    if not on and not off:
        return "(?:" if end == ":" else ""
    return f"(?{on}{'-' + off if off else ''}{end}"


def _in_class(piece: str) -> str:
    """Inside a class, tokens of several letters are just their letters."""
    return piece if len(piece) == 1 or piece[0] == "\\" else "".join("\\" + c if c in "[&" else c for c in piece)


@functools.lru_cache(maxsize=4096)
def engine_error(java: str) -> str | None:
    """What the engine that evaluates patterns says against this one; None if nothing, or if no session runs yet."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, PySparkException) as exc:
        told = exc.java_exception.getMessage() if isinstance(exc, Py4JJavaError) else exc
        return str(told).splitlines()[0]
    return None


def to_java(pattern: str) -> str:
    """Return `pattern` (Python syntax, one group at most) for Spark, always with exactly one group.

    A pattern without groups is wrapped in one. More than one group is an error, since then there is
    no single value to take.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            groups = re.compile(pattern, re.IGNORECASE | re.DOTALL).groups
    except re.error as exc:
        raise CatalogError(f"invalid pattern {pattern!r}: {exc}") from exc
    if groups > 1:
        raise CatalogError(f"pattern {pattern!r} has {groups} groups, expected one")
    out, in_class, class_start = [], False, 0
    for token in _TOKEN.finditer(pattern):
        piece, part = token.group(0), token.groupdict()
        if part["name"]:
            piece = f"\\x{{{ord(unicodedata.lookup(part['name'])):x}}}"
        elif part["wide"]:
            piece = f"\\x{{{int(part['wide'], 16):x}}}"
        elif part["octal"]:
            piece = f"\\x{{{int(part['octal'], 8):x}}}"
        elif in_class:
            if piece == "]" and token.start() > class_start:
                in_class = False
            elif piece in ("[", "&", "]"):
                piece = "\\" + piece
            else:
                piece = _CLASS_LETTERS.get(piece, _in_class(piece))
        elif piece == "[":
            in_class, class_start = True, token.end()
            if pattern[class_start:class_start + 1] == "^":
                class_start += 1
        elif piece == r"\Z":
            piece = r"\z"
        elif part["group"]:
            # There is one group at most, and the engine is choosier about names.
            piece = "("
        elif part["back"]:
            piece = r"(?:\1)"
        elif piece == "(?(":
            raise CatalogError(f"pattern {pattern!r}: conditional groups are not supported")
        elif part["end"] and part["flags"]:
            piece = _flags(part["flags"], part["end"])
        elif part["least"] is not None and piece != "{}":
            # Both bounds may be missing.
            piece = f"{{{part['least'] or 0}{part['most'] or ''}}}"
        elif piece in ("{", "}", "{}"):
            piece = "".join("\\" + c for c in piece)
        else:
            piece = _LETTERS.get(piece, piece)
        out.append(piece)
    java = "".join(out)
    java = java if groups else f"({java})"
    refused = engine_error(FIELD_FLAGS + java)
    if refused:
        raise CatalogError(f"pattern {pattern!r}: {refused}")
    return java


def field_regex(pattern: str, flags: str = FIELD_FLAGS, word_boundary: bool = False) -> str:
    java = to_java(pattern)
    return f"{flags}{NOT_AFTER_WORD}(?:{java})" if word_boundary else flags + java


def escape(text: str | Column) -> str | Column:
    """Make `text` match itself, as a Python string or as a column."""
    if isinstance(text, Column):
        return F.regexp_replace(text, _ASCII_PUNCTUATION, r"\\$1")
    return re.sub(_ASCII_PUNCTUATION, r"\\\1", text)


def first_group(text: Column, regex: str) -> Column:
    """Group 1 of the first match, `''` if the group is empty, NULL without a match.

    Stops at the first match; `regexp_extract` alone cannot tell an empty group from no match.
    """
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, 1))


def spaces_to_class(regex: str) -> str:
    """Write the white space of our own patterns out in full (for use outside a class)."""
    return regex.replace(r"\s", f"[{SPACE_CLASS}]")
