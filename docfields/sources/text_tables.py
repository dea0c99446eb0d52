"""Tables laid out in page text.

Three layouts: `lattice` has cells between `|`, `stream` has cells set apart by two or more spaces. A
table is a run of consecutive lines with at least two cells, its first line the header.

`aligned` reads the runs of `stream` by their columns: a border is where all lines of the run are blank. Cells may be empty
and may hold several spaces in a row, and a gap may be one space wide in some of its lines, though not in all. It takes three
lines at least, the header included, and finds nothing in a run without a common gap.

Everything happens inside the page's row: lines that are not table lines become a mark, and splitting
at the marks leaves the tables, in order. No shuffle and no window is needed to number tables and rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docfields.fixed import ALIGNED_LINES, FLAVORS, LAYOUTS
from docfields.functions.search import let

_MARK = "\u0000"
_SEPARATOR = {"lattice": "|", "stream": "  ", "aligned": "  "}
_OUTER_BARS = r"^ *\||\| *$"
TABLE_TYPE = "struct<table_idx:int,header:array<string>,rows:array<array<string>>>"


def flavor_rank(flavor: str) -> int:
    if flavor not in LAYOUTS:
        raise ValueError(f"unknown table layout {flavor!r}, expected one of {LAYOUTS}")
    return LAYOUTS.index(flavor)


def _is_row(line: Column, flavor: str) -> Column:
    """Whether the line has at least two cells."""
    if flavor != "lattice":
        return F.contains(line, F.lit("  ")) & line.rlike("[^ ] {2,}[^ ]")
    bar = F.lit("|")
    return F.contains(line, bar) & F.contains(F.regexp_replace(line, _OUTER_BARS, ""), bar)


def _cells(line: Column, flavor: str) -> Column:
    if flavor == "stream":
        # Split at a letter, which takes no pattern: a split at one compiles it for every line. No line holds a mark.
        return F.split(F.regexp_replace(F.btrim(line), " {2,}", _MARK), _MARK)
    return F.transform(F.split(F.regexp_replace(line, _OUTER_BARS, ""), r"\|"), lambda c: F.btrim(c))


def _aligned_rows(run: Column) -> Column:
    """The cells of the lines of a run, cut where all lines are blank; an empty array if that makes no table."""
    def is_blank(letters: Column, place: Column) -> Column:
        return F.coalesce(F.get(letters, place), F.lit(" ")) == " "

    def cut(b: Column) -> Column:
        places = F.sequence(F.lit(0), F.array_max(F.transform(b["letters"], F.size)) - 1)
        gaps = F.transform(places, lambda p: F.forall(b["letters"], lambda line: is_blank(line, p)))
        return let(F.struct(b["lines"].alias("lines"), b["letters"].alias("letters"), places.alias("places"), gaps.alias("gaps")), started)

    def started(b: Column) -> Column:
        # A column starts behind a gap, one that is at least two spaces wide in a line with text behind it.
        first = F.filter(b["places"], lambda p: ~F.get(b["gaps"], p) & ((p == 0) | F.get(b["gaps"], p - 1)))

        def wide(p: Column) -> Column:
            return F.exists(b["letters"], lambda line: (F.size(line) > p) & ((F.get(line, p - 2) == " ") | (F.get(line, p) == " ")))

        starts = F.filter(first, lambda p, i: (i == 0) | wide(p))
        return let(F.struct(b["lines"].alias("lines"), starts.alias("starts")), rows)

    def rows(b: Column) -> Column:
        def cells(line: Column) -> Column:
            # The last column ends with the line.
            return F.transform(b["starts"], lambda s, i: F.btrim(F.substring(
                line, s + 1, F.coalesce(F.get(b["starts"], i + 1), F.char_length(line) + s + 1) - s)))

        none = F.array().cast("array<array<string>>")
        return F.when((F.size(b["starts"]) > 1) & (F.size(b["lines"]) >= ALIGNED_LINES), F.transform(b["lines"], cells)).otherwise(none)

    lines = F.transform(F.split(run, "\n"), lambda line: F.rtrim(line))
    return let(lines, lambda ls: let(F.struct(ls.alias("lines"), F.transform(ls, lambda x: F.split(x, "")).alias("letters")), cut))


def tables_in(text: Column, flavor: str, header: bool = True) -> Column:
    """The page's tables of one layout as `array<struct<table_idx, header, rows>>`.

    Without `header` the columns are named by their number and the first line is data.
    """
    flavor_rank(flavor)

    bare = F.replace(text, F.lit(_MARK), F.lit(""))
    # Without a carriage return lines end at one letter, at which text is split without a pattern.
    lines = F.when(F.contains(text, F.lit("\r")), F.split(bare, "\r?\n")).otherwise(F.split(bare, "\n"))
    marked = F.transform(lines, lambda line: F.when(_is_row(line, flavor), line).otherwise(F.lit(_MARK)))
    runs = F.transform(F.split(F.array_join(marked, "\n"), _MARK), lambda run: F.btrim(run, F.lit("\n")))

    def table(rows: Column, idx: Column) -> Column:
        if header:
            named, data = F.get(rows, F.lit(0)), F.slice(rows, F.lit(2), F.size(rows))
        else:
            width = F.array_max(F.transform(rows, F.size))
            named = F.transform(F.sequence(F.lit(0), width - 1), lambda i: i.cast("string"))
            data = rows
        return F.struct(idx.alias("table_idx"), named.alias("header"), data.alias("rows"))

    filled = F.filter(runs, lambda run: run != "")
    if flavor == "aligned":
        found = let(F.filter(F.transform(filled, _aligned_rows), lambda rows: F.size(rows) > 0), lambda each: F.transform(each, table))
    else:
        # Lines are cut into cells once, not at each mention.
        found = F.transform(filled, lambda run, idx: let(
            F.transform(F.split(run, "\n"), lambda line: _cells(line, flavor)), lambda rows: table(rows, idx)))
    none = F.array().cast(f"array<{TABLE_TYPE}>")
    return F.when(F.contains(text, F.lit(_SEPARATOR[flavor])), found).otherwise(none)


def text_tables(pages: DataFrame, flavors: Sequence[str] = FLAVORS, header: bool = True,
                skip_without_text: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """The cells of all tables in `pages(page_id, text)`, one row per cell, or with `whole` the tables, one row each (`cells_of`).

    The layouts `skip_without_text` are not looked for where `pages.no_text` says that the document has no text layer. Short rows are filled up with NULL cells; cells beyond the header have a NULL header.
    """
    def found(flavor: str) -> Column:
        tables = tables_in(F.col("text"), flavor, header)
        if flavor not in skip_without_text:
            return tables
        return F.when(F.col("no_text"), F.array().cast(f"array<{TABLE_TYPE}>")).otherwise(tables)

    per_flavor = F.array(*[
        F.struct(
            F.lit(f).alias("flavor"), F.lit(flavor_rank(f)).alias("flavor_rank"),
            found(f).alias("tables"),
        )
        for f in flavors
    ])
    tables = pages.select("page_id", F.inline(per_flavor)).select("page_id", "flavor", "flavor_rank", F.inline("tables"))
    return tables if whole else cells_of(tables)


def cells_of(tables: DataFrame) -> DataFrame:
    """The cells of whole tables, `page_id, flavor, flavor_rank, table_idx, header array, rows array of arrays`, one row per cell.

    Rows with one page, layout and table number are parts of one table, each with its rows numbered from 0.
    """
    return (
        tables
        .select("page_id", "flavor", "flavor_rank", "table_idx", "header",
                F.posexplode("rows").alias("row_idx", "row"))
        .select("page_id", "flavor", "flavor_rank", "table_idx", "row_idx",
                F.posexplode(F.arrays_zip("header", "row")).alias("col_idx", "pair"))
        .select("page_id", "flavor", "flavor_rank", "table_idx", "row_idx", "col_idx",
                F.col("pair.header").alias("header"), F.col("pair.row").alias("cell"))
    )
