"""Finding the value that belongs to a term in page text.

A term with patterns in the catalogue is searched by them first. Otherwise, or if none matches, the
term is looked up literally and the value is read from the text after it.

`low` arguments take `fold(text)` where the caller has it as a column already, so that it is worked
out once per page and not once per term.
"""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from docfields.fixed import ALNUM_WORD, DATE, LABEL_SEPARATORS, LETTERS, NUMBER, SNIPPET_WIDTH
from docfields.functions.casing import fold, fold_str
from docfields.functions.regex import (
    CUE_FLAGS, NOT_AFTER_WORD, NOT_BEFORE_WORD, escape, field_regex, first_group,
)
from docfields.functions.whitespace import SPACE_CLASS, WHITESPACE, strip

Patterns = Mapping[str, Sequence[str]]

_FULL_NUMBER = r"[-+]?(?:\d{1,3}(?:[.,]\d{3})+(?!\d)|\d+)(?:[.,]\d+)?"


def _no_text() -> Column:
    return F.lit(None).cast("string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# -- field patterns ---------------------------------------------------------------------------------

def field_first(text: Column, regexes: Sequence[str], word_boundary: bool = False) -> Column:
    """Stripped first match of the first regex that matches; `''` counts as found, NULL does not."""
    found = [strip(first_group(text, field_regex(r, word_boundary=word_boundary))) for r in regexes]
    return F.coalesce(*found) if found else _no_text()


def field_all(text: Column, regexes: Sequence[str], word_boundary: bool = False) -> Column:
    """All matches of all regexes in order, as found (not stripped); NULL without a match."""
    lists = [
        F.regexp_extract_all(text, F.lit(field_regex(r, word_boundary=word_boundary)), F.lit(1))
        for r in regexes
    ]
    if not lists:
        return F.lit(None).cast("array<string>")
    return let(F.concat(*lists), lambda all_: F.when(F.size(all_) > 0, all_))


def patterns_for(term: Column | str, text: Column, patterns: Patterns | None,
                 word_boundary: bool = False) -> Column:
    """`field_first` with the patterns of the field named `term` (case-folded), NULL if there is none.

    For a term that comes from data this is a CASE over the fields with literal regexes, so that each
    regex is compiled once per task and not once per row.
    """
    patterns = patterns or {}
    if isinstance(term, str):
        return field_first(text, patterns.get(term.lower(), ()), word_boundary)
    cases = [
        F.when(F.lower(term) == F.lit(field), field_first(text, regexes, word_boundary))
        for field, regexes in patterns.items() if regexes
    ]
    return F.coalesce(*cases) if cases else _no_text()


# -- literal search ---------------------------------------------------------------------------------

def _needle(term: Column | str) -> tuple[Column, Column]:
    """The folded term and its length."""
    if isinstance(term, str):
        return F.lit(fold_str(term)), F.lit(len(term))
    return fold(term), F.char_length(term)


def literal_at(low: Column, term: Column | str) -> Column:
    """Where the term first occurs in folded text, from 1; NULL if it does not.

    `contains` comes first because it is several times faster than `position` in ruling a term out.
    """
    needle, _ = _needle(term)
    return F.when(F.contains(low, needle), F.position(needle, low))


def found_at(text: Column, at: Column, term: Column | str) -> Column:
    return F.substring(text, at, _needle(term)[1])


def snippet_at(text: Column, at: Column, term: Column | str, width: int = SNIPPET_WIDTH) -> Column:
    rest = F.substr(text, at + _needle(term)[1])
    return F.substring(F.ltrim(rest, F.lit(WHITESPACE + LABEL_SEPARATORS)), 1, width)


def literal_find(text: Column, term: Column | str, low: Column | None = None) -> Column:
    """The first occurrence of `term`, ignoring case, as spelled in the text; NULL if absent."""
    return found_at(text, literal_at(fold(text) if low is None else low, term), term)


def snippet_after(text: Column, term: Column | str, width: int = SNIPPET_WIDTH,
                  low: Column | None = None) -> Column:
    """Up to `width` characters after the term and its separators, across lines; NULL if absent."""
    return snippet_at(text, literal_at(fold(text) if low is None else low, term), term, width)


def value_cascade(snippet: Column, full_numbers: bool = False) -> Column:
    """The first number in the snippet, else the first alphanumeric word, else the first letters.

    `full_numbers` reads `12345` whole; by default a number without separators ends after three
    digits.
    """
    shapes = (
        f"(?U){_FULL_NUMBER if full_numbers else NUMBER}",
        NOT_AFTER_WORD + ALNUM_WORD + NOT_BEFORE_WORD,
        LETTERS,
    )
    # `regexp_substr` would match twice to tell a hit from a miss.
    return F.coalesce(*[
        let(F.regexp_extract(snippet, shape, 0), lambda v: F.when(v != "", v)) for shape in shapes
    ])


# -- both -------------------------------------------------------------------------------------------

def resolve(term: Column, by_pattern: Column, found: Column, snippet: Column,
            full_numbers: bool = False) -> Column:
    """`struct<key, value>` from the parts of a search.

    A literal hit without a value is `(found, NULL)`, a miss `(NULL, NULL)`.
    """
    return F.struct(
        F.when(by_pattern.isNotNull(), term).otherwise(found).alias("key"),
        F.coalesce(by_pattern, value_cascade(snippet, full_numbers)).alias("value"),
    )


def search_term(text: Column, term: Column | str, patterns: Patterns | None = None,
                low: Column | None = None, full_numbers: bool = False,
                word_boundary: bool = False, width: int = SNIPPET_WIDTH) -> Column:
    """Search one term: catalogue patterns first, then literally. `struct<key, value>`."""
    spelled = F.lit(term) if isinstance(term, str) else term

    def literal(h: Column) -> Column:
        target = term if isinstance(term, str) else h["term"]
        at = F.when(h["pat"].isNull(), literal_at(h["low"], target))
        return let(
            F.struct(h["term"].alias("term"), h["pat"].alias("pat"), at.alias("at")),
            lambda p: value(p, target if isinstance(term, str) else p["term"]),
        )

    def value(p: Column, target: Column | str) -> Column:
        return let(
            F.struct(
                p["term"].alias("term"), p["pat"].alias("pat"),
                found_at(text, p["at"], target).alias("found"),
                snippet_at(text, p["at"], target, width).alias("snippet"),
            ),
            lambda q: resolve(q["term"], q["pat"], q["found"], q["snippet"], full_numbers),
        )

    return let(
        F.struct(
            spelled.alias("term"),
            patterns_for(term, text, patterns, word_boundary).alias("pat"),
            (fold(text) if low is None else low).alias("low"),
        ),
        literal,
    )


def search_all(text: Column, term: str, patterns: Patterns | None = None,
               low: Column | None = None) -> Column:
    """Every pattern match of a term as `array<struct<key, value>>`.

    Without a pattern match this is the one literal hit, or an empty array if the term is absent.
    """
    literal = search_term(text, term, None, low)
    return let(
        F.struct(
            field_all(text, (patterns or {}).get(term.lower(), ())).alias("all"),
            literal.alias("one"),
        ),
        lambda h: F.when(
            h["all"].isNotNull(),
            F.transform(h["all"], lambda v: F.struct(F.lit(term).alias("key"), v.alias("value"))),
        ).otherwise(F.filter(F.array(h["one"]), lambda s: s["key"].isNotNull())),
    )


def date_near(text: Column, term: Column | str) -> Column:
    """The date that follows a term, day first or year first; NULL if there is none."""
    if isinstance(term, str):
        regex = f"{CUE_FLAGS}{escape(term)}[{SPACE_CLASS}{LABEL_SEPARATORS}]*({DATE})"
        return first_group(text, regex)
    regex = F.concat(
        F.lit(CUE_FLAGS), escape(term), F.lit(f"[{SPACE_CLASS}{LABEL_SEPARATORS}]*({DATE})")
    )
    return F.get(F.regexp_extract_all(text, regex, F.lit(1)), F.lit(0))
