"""Table duplicates and table lookup.

Three forms of the same rule. Tables found in page text are looked up inside the page's row, without a
shuffle (`lookup_in_row`). Cells from elsewhere, one row per cell, are looked up with aggregates and
joins (`table_lookup`); every aggregate there is a `min`, `sum` or distinct that Spark combines before
the shuffle, so a page or table that holds much of the data is never gathered in one place. Whole tables,
one row each, are told and searched inside their row; what is left of each, its sums and what it gives for
each term, meets the others of its page in the one shuffle there is.

The rule, per page and term: candidates are the filled cells under a header that contains the term
(kind 0) and the cells that contain it (kind 1). The least (layout, table, kind, column) wins. Kind 0
gives all distinct values of the column, kind 1 the first cell in reading order.
"""

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from docfields.fixed import FLAVORS
from docfields.functions.search import let
from docfields.functions.text import normalize_cell, normalize_header
from docfields.operators.index import contains_pairs, first_positions, spelled_candidates
from docfields.plans.materialize import materialize, stored
from docfields.sources.text_tables import cells_of, flavor_rank, tables_in

# Terms as a list, or as many rows as there are: `terms(term_pos, term)`.
Terms = Sequence[str] | DataFrame
TABLE_KEY = ["page_id", "flavor", "flavor_rank", "table_idx"]


def lookup_terms(terms: Sequence[str]) -> list[tuple[int, str]]:
    """Lower-cased terms with their first position; a repeated term is looked up once."""
    first: dict[str, int] = {}
    for pos, term in enumerate(terms):
        first.setdefault(term.lower(), pos)
    return [(pos, term) for term, pos in first.items()]


# -- signatures and duplicates ----------------------------------------------------------------------

def table_signatures(cells: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """One signature per table over its headers and rows, or its first `sample_rows` rows.

    Each cell with its place and header has an MD5, and the signature is the MD5 of the sum of 60 bits
    of each and of the number of cells. A sum does not depend on order and combines before the shuffle,
    so no table is ever collected.
    """
    cell = F.concat_ws("\u0001", "row_idx", "col_idx", normalize_header(F.col("header")),
                       normalize_cell(F.col("cell")))
    bits = F.conv(F.substring(F.md5(cell.cast("binary")), 1, 15), 16, 10).cast("bigint")
    # Halves of 30 bits add up as whole numbers of the machine, far cheaper than decimals, for up to 2^33 cells a table.
    whole = F.sum("_high").cast("decimal(28,0)") * F.lit(Decimal(1 << 30)) + F.sum("_low").cast("decimal(28,0)")
    told = F.concat_ws("\u0001", whole.cast("decimal(38,0)").cast("string"), F.count("_low").cast("string"))
    signed = cells if sample_rows is None else cells.where(F.col("row_idx") < sample_rows)
    return (
        signed.select(*TABLE_KEY, bits.alias("_bits"))
        .select(*TABLE_KEY, F.shiftright("_bits", 30).alias("_high"), F.col("_bits").bitwiseAND((1 << 30) - 1).alias("_low"))
        .groupBy(*TABLE_KEY)
        .agg(F.md5(told.cast("binary")).alias("signature"))
    )


def is_whole(cells: DataFrame) -> bool:
    """Whether the rows are whole tables (`cells_of`), not cells."""
    return "rows" in cells.columns


def _summed(header: Column, rows: Column, sample_rows: int | None) -> Column:
    """`struct<n, high, low>`: the cells of a table that enter its signature, and the sum of a number for each of them, in halves.

    The number stands for place, header and content, as in `table_signatures`; sums of the parts of a table add up to its own.
    """
    def numbers(names: Column) -> Column:
        signed = rows if sample_rows is None else F.slice(rows, 1, max(0, sample_rows))
        told = F.transform(signed, lambda row, r: F.transform(
            F.zip_with(names, row, lambda h, c: F.concat(F.coalesce(h, F.lit("")), F.lit("\u0001"), normalize_cell(c))),
            lambda cell, c: F.xxhash64(r, c, cell)))
        return F.flatten(told)

    zero = F.lit(0).cast("bigint")
    return let(let(F.transform(header, normalize_header), numbers), lambda each: F.struct(
        F.size(each).cast("bigint").alias("n"),
        F.aggregate(each, zero, lambda total, x: total + F.shiftright(x, 32)).alias("high"),
        F.aggregate(each, zero, lambda total, x: total + x.bitwiseAND((1 << 32) - 1)).alias("low"),
    ))


def _first_tables(tables: DataFrame, kept: Column, sample_rows: int | None) -> DataFrame:
    """`page_id, flavor, flavor_rank, table_idx, kept`: the first table of each signature per page and layout.

    `kept` is an array of what `kept` is in each of the table's parts. Parts, tables and signatures of a page are told apart
    behind one shuffle by the page, so what is kept of a table moves once.
    """
    parts = (
        tables.where(" and ".join(f"{c} is not null" for c in TABLE_KEY))
        .select(*TABLE_KEY, _summed(F.col("header"), F.col("rows"), sample_rows).alias("_sums"), kept.alias("_kept"))
        .select(*TABLE_KEY, "_sums.*", "_kept").repartition("page_id")
    )
    whole = F.sum("high").cast("decimal(28,0)") * F.lit(Decimal(1 << 32)) + F.sum("low").cast("decimal(28,0)")
    merged = parts.groupBy(*TABLE_KEY).agg(
        F.sum("n").alias("n"), whole.cast("decimal(38,0)").alias("_total"), F.collect_list("_kept").alias("kept"))
    first = merged.where("n > 0").groupBy("page_id", "flavor", "flavor_rank", "n", "_total").agg(
        F.min(F.struct("table_idx", "kept")).alias("_first"))
    return first.select("page_id", "flavor", "flavor_rank", "_first.*")


def unique_tables(cells: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """The first table of each signature per page and layout (keys only)."""
    if is_whole(cells):
        cells = cells_of(cells)
    return (
        table_signatures(cells, sample_rows)
        .groupBy("page_id", "flavor", "flavor_rank", "signature")
        .agg(F.min("table_idx").alias("table_idx"))
        .select(*TABLE_KEY)
    )


def dedupe_tables(cells: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Drop tables that repeat an earlier one of the same page and layout. Whole tables stay whole."""
    if is_whole(cells):
        return _first_tables(cells, F.struct("header", "rows"), sample_rows).select(*TABLE_KEY, F.inline("kept"))
    return cells.join(unique_tables(cells, sample_rows), TABLE_KEY, "left_semi")


# -- lookup over cells ------------------------------------------------------------------------------

def _candidates(cells: DataFrame, listed: Terms, kinds: Sequence[int]) -> DataFrame:
    """One row per cell, term and kind; narrow, and most cells give none.

    Terms of a list become options that are exploded first, the empty ones dropped after, all in generated code. Terms that are
    rows are joined by what headers and cells contain.
    """
    filled = cells.where(F.col("cell").isNotNull() & (F.col("cell") != ""))
    lowered = filled.select(*TABLE_KEY, "row_idx", "col_idx", "cell", F.lower("header").alias("_header"),
                            F.lower("cell").alias("_cell"))
    if isinstance(listed, DataFrame):
        return spelled_candidates(lowered, listed, list(kinds)).select(
            *TABLE_KEY, "row_idx", "col_idx", "cell", "term_pos", "term", "kind")
    terms = lookup_terms(listed)
    options = [
        F.when(F.contains(F.col(searched), F.lit(term)),
               F.struct(F.lit(pos).alias("term_pos"), F.lit(term).alias("term"), F.lit(kind).alias("kind")))
        for pos, term in terms
        for kind, searched in enumerate(("_header", "_cell")) if kind in kinds
    ]
    return lowered.select(
        *TABLE_KEY, "row_idx", "col_idx", "cell", F.inline(F.array(*options))
    ).where(F.col("term_pos").isNotNull())


def _rank() -> Column:
    """The order of candidates (layout, table, kind, place) as one number.

    All values of a column rank the same (kind 0), each cell ranks by row and column (kind 1). One
    number and not a struct, because Spark aggregates fixed-width values by hash and structs by sorting.
    The parts take 2, 60, 1 and twice 31 bits.
    """
    table = F.col("table_idx").cast("bigint")
    fits = (table >= 0) & (table < F.lit(1 << 60)) & F.col("flavor_rank").between(0, 3)
    high = F.when(fits, F.shiftleft(F.col("flavor_rank").cast("bigint"), 60) + table).otherwise(
        F.raise_error(F.lit("table_idx or flavor_rank out of range")).cast("bigint")
    )
    col = F.col("col_idx").cast("bigint")
    place = F.shiftleft(F.col("row_idx").cast("bigint"), 31) + col
    low = F.when(F.col("kind") == 0, F.shiftleft(col, 31)).otherwise(F.lit(1 << 62) + place)
    both = high.cast("decimal(19,0)") * F.lit(Decimal(1 << 63)) + low.cast("decimal(19,0)")
    # Never NULL; saying so keeps the joins from checking it once more.
    return F.coalesce(both.cast("decimal(38,0)"), F.lit(Decimal(0)).cast("decimal(38,0)"))


def header_hits(cells: DataFrame, terms: Terms) -> DataFrame:
    """Every filled cell under a header that contains a term."""
    return _candidates(cells, terms, [0]).select(
        "page_id", "term_pos", "term", "flavor_rank", "table_idx", "row_idx", "col_idx", "cell"
    )


def cell_hits(cells: DataFrame, terms: Terms) -> DataFrame:
    """Per table and term the first cell, in reading order, that contains the term."""
    return (
        _candidates(cells, terms, [1])
        .groupBy("page_id", "term_pos", "term", "flavor_rank", "table_idx")
        .agg(F.min(F.struct("row_idx", "col_idx", "cell")).alias("first"))
        .select("page_id", "term_pos", "term", "flavor_rank", "table_idx", "first.*")
    )


def table_lookup(cells: DataFrame, terms: Terms, known: DataFrame | None = None,
                 dedupe: bool = True, sample_rows: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Look terms up in tables: `page_id, term_pos, term, value`, values distinct per page and term.

    `known(page_id, term_pos, key, value)` holds values already recorded; a candidate is passed over
    if the same page, key and value were recorded for this term or an earlier one. With `pairs(page_id, term_pos)` only
    those pages and terms are looked up: candidates of others go before anything else is done with them, and
    what is left is written once, so that cells are read once for candidates and once for duplicates.
    Whole tables as `cells` are looked up behind one shuffle by the page. There a layout has one rank.
    """
    if is_whole(cells):
        if dedupe and known is None:
            if isinstance(terms, DataFrame):
                found = _lookup_whole_by_rows(cells, terms, sample_rows)
            else:
                names = F.create_map(*[F.lit(x) for pair in lookup_terms(terms) for x in pair])
                found = lookup_whole(cells, terms, sample_rows).select(
                    "page_id", "term_pos", names[F.col("term_pos")].alias("term"), F.explode("values").alias("value"))
            if pairs is not None:
                found = found.join(pairs.select("page_id", "term_pos"), ["page_id", "term_pos"], "left_semi")
            return found
        cells = cells_of(cells)
    found = _candidates(cells, terms, [0, 1])
    if pairs is not None:
        # The search gives `term_pos`, so this semi join cannot be pushed below it.
        found = found.join(pairs.select("page_id", "term_pos"), ["page_id", "term_pos"], "left_semi")
    if dedupe:
        # Not a semi join: that would be pushed below the search and shuffle every cell.
        found = found.join(unique_tables(cells, sample_rows), TABLE_KEY)
    if known is not None:
        seen = known.select(
            F.col("page_id").alias("k_page"), F.lower("key").alias("k_key"),
            F.col("value").alias("k_value"), F.col("term_pos").alias("k_pos"),
        ).groupBy("k_page", "k_key", "k_value").agg(F.min("k_pos").alias("k_pos"))
        found = found.join(
            seen,
            (F.col("page_id") == F.col("k_page")) & (F.col("term") == F.col("k_key"))
            & (F.col("cell") == F.col("k_value")) & (F.col("k_pos") <= F.col("term_pos")),
            "left_anti",
        )
    # Each value with its least rank. A value of the best table has the best rank there, so this is the distinct too. Values are
    # keys of the shuffle, so both uses below read the same one, and candidates and duplicates are worked out once.
    valued = found.select("page_id", "term_pos", "term", "cell", _rank().alias("rank")).groupBy(
        "page_id", "term_pos", "term", "cell").agg(F.min("rank").alias("rank"))
    if pairs is not None:
        valued = materialize(valued)
    best = valued.groupBy("page_id", "term_pos").agg(F.min("rank").alias("rank"))
    return valued.join(best, ["page_id", "term_pos", "rank"]).select(
        "page_id", "term_pos", "term", F.col("cell").alias("value")
    )


# -- lookup over whole tables ------------------------------------------------------------------------

def _hits_in_table(header: Column, rows: Column, terms: Sequence[str]) -> Column:
    """`array<struct<term_pos, place, values>>`: what a table gives for each term, and the place of it, the least first.

    Places are those of `_rank`: a column whose header contains the term, else the first cell that does.
    """
    def usable(value: Column) -> Column:
        return value.isNotNull() & (value != "")

    def under(t: Column, i: Column) -> Column:
        return F.struct(F.shiftleft(i.cast("bigint"), 31).alias("place"),
                        F.filter(F.transform(t["rows"], lambda row: F.get(row, i)), usable).alias("values"))

    def hit(t: Column, pos: int, term: str) -> Column:
        def found(part: Column) -> Column:
            return F.when(part.isNotNull(), F.struct(
                F.lit(pos).alias("term_pos"), part["place"].alias("place"), F.array_distinct(part["values"]).alias("values")))

        named = F.filter(F.transform(t["names"], lambda h, i: F.when(F.contains(h, F.lit(term)), i)), lambda i: i.isNotNull())
        columns = F.filter(F.transform(named, lambda i: under(t, i)), lambda c: F.size(c["values"]) > 0)
        cell = F.get(F.filter(t["cells"], lambda c: F.contains(c["low"], F.lit(term))), F.lit(0))
        # Most tables hold a term nowhere, which one look at all headers or cells in a row tells.
        return F.coalesce(
            F.when(F.contains(t["all_names"], F.lit(term)), let(F.get(columns, F.lit(0)), found)),
            F.when(F.contains(t["all_cells"], F.lit(term)), let(cell, found)))

    first_cell = F.lit(1 << 62)
    cells = F.flatten(F.transform(rows, lambda row, r: F.filter(F.transform(row, lambda c, i: F.struct(
        (first_cell + F.shiftleft(r.cast("bigint"), 31) + i).alias("place"), F.array(c).alias("values"), F.lower(c).alias("low"),
    )), lambda c: usable(c["low"]))))
    table = F.struct(F.transform(header, lambda h: F.lower(h)).alias("names"), rows.alias("rows"), cells.alias("cells"))

    def joined(t: Column) -> Column:
        return F.struct(*[t[name].alias(name) for name in ("names", "rows", "cells")], F.array_join(t["names"], "\u0000").alias("all_names"),
                        F.array_join(F.transform(t["cells"], lambda c: c["low"]), "\u0000").alias("all_cells"))

    return let(let(table, joined), lambda t: F.filter(
        F.array(*[hit(t, pos, term) for pos, term in lookup_terms(terms)]), lambda h: h.isNotNull()))


def _merged_hits(parts: Column) -> Column:
    """The hits of a table from those of its parts: for each term the least place, with all its values."""
    def of(every: Column) -> Column:
        def best(pos: Column) -> Column:
            own = F.filter(every, lambda h: h["term_pos"] == pos)
            return let(own, lambda hits: let(F.array_min(F.transform(hits, lambda h: h["place"])), lambda place: F.struct(
                pos.alias("term_pos"), place.alias("place"), F.array_distinct(F.flatten(F.transform(
                    F.filter(hits, lambda h: h["place"] == place), lambda h: h["values"]))).alias("values"))))

        return F.transform(F.array_distinct(F.transform(every, lambda h: h["term_pos"])), best)

    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(let(F.flatten(parts), of))


def lookup_whole(tables: DataFrame, terms: Sequence[str], sample_rows: int | None) -> DataFrame:
    """`page_id, term_pos, values`: the lookup of a list of terms over whole tables, dealt out by page."""
    first = _first_tables(tables, _hits_in_table(F.col("header"), F.col("rows"), terms), sample_rows)
    hits = first.select("page_id", "flavor_rank", "table_idx", F.inline(_merged_hits(F.col("kept"))))
    return hits.groupBy("page_id", "term_pos").agg(
        F.min(F.struct("flavor_rank", "table_idx", "place", "values"))["values"].alias("values"))


def _spelled(kept: Column) -> Column:
    """`array<struct<place, s, values>>`: the lower-cased cells and headers of a table's parts with what they give, in the places of `_rank`."""
    def usable(value: Column) -> Column:
        return value.isNotNull() & (value != "")

    def cells(part: Column) -> Column:
        return F.filter(F.flatten(F.transform(part["rows"], lambda row, r: F.transform(row, lambda c, i: F.struct(
            (F.lit(1 << 62) + F.shiftleft(r.cast("bigint"), 31) + i).alias("place"), F.lower(c).alias("s"), F.array(c).alias("values")
        )))), lambda c: usable(c["s"]))

    def columns(part: Column) -> Column:
        return F.filter(F.transform(part["header"], lambda h, i: F.struct(
            F.shiftleft(i.cast("bigint"), 31).alias("place"), F.lower(h).alias("s"),
            F.array_distinct(F.filter(F.transform(part["rows"], lambda row: F.get(row, i)), usable)).alias("values"),
        )), lambda c: (F.size(c["values"]) > 0) & usable(c["s"]))

    return F.flatten(F.transform(kept, lambda part: F.concat(cells(part), columns(part))))


def _lookup_whole_by_rows(tables: DataFrame, terms: DataFrame, sample_rows: int | None) -> DataFrame:
    """`page_id, term_pos, term, value`: the lookup of terms that are rows over whole tables.

    Which spelling holds which terms is written first, so that Spark sends it to all if it is small; cells then stay where the
    pages are, and no candidate is shuffled.
    """
    spellings = F.array_distinct(F.transform(F.concat("header", F.flatten("rows")), lambda c: F.lower(c)))
    spelled = tables.select(F.explode(spellings).alias("s")).where("s is not null").distinct()
    named = first_positions(terms)
    holding = stored(contains_pairs(spelled, named.select(F.col("term").alias("needle"))).select(
        F.col("s").alias("_s"), F.col("needle").alias("term")).join(named, "term"))
    first = _first_tables(tables, F.struct("header", "rows"), sample_rows)
    cells = first.select("page_id", "flavor_rank", "table_idx", F.inline(_spelled(F.col("kept"))))
    hits = cells.join(holding, F.col("s") == F.col("_s"))
    # Terms may share a position, and parts of a table a place; all they give there counts.
    each = hits.groupBy("page_id", "term_pos", "flavor_rank", "table_idx", "place").agg(
        F.collect_list(F.struct("term", "values")).alias("found"))
    best = each.groupBy("page_id", "term_pos").agg(F.min(F.struct("flavor_rank", "table_idx", "place", "found"))["found"].alias("found"))
    given = F.transform("found", lambda f: F.transform(f["values"], lambda v: F.struct(f["term"].alias("term"), v.alias("value"))))
    return best.select("page_id", "term_pos", F.inline(F.array_distinct(F.flatten(given))))


# -- lookup inside the row --------------------------------------------------------------------------

def _row_signature(table: Column, sample_rows: int | None) -> Column:
    names = F.array_join(F.transform(table["header"], normalize_header), "\u0001")
    rows = F.transform(
        table["rows"] if sample_rows is None else F.slice(table["rows"], 1, sample_rows),
        lambda row: F.array_join(F.transform(row, normalize_cell), "\u0001"),
    )
    return F.md5(F.concat(names, F.lit("\u0002"), F.array_join(rows, "\u0002")).cast("binary"))


def unique_in_row(tables: Column, sample_rows: int | None = None) -> Column:
    """`tables_in` without tables that repeat an earlier one."""
    def unique(found: Column) -> Column:
        signatures = F.transform(found, lambda t: _row_signature(t, sample_rows))
        return F.when(F.size(found) < 2, found).otherwise(let(
            signatures,
            lambda signed: F.filter(
                found, lambda _, i: F.array_position(signed, F.get(signed, i)) == i + 1
            ),
        ))

    # Tables are read from the text once, not at each mention.
    return let(tables, unique)


def page_tables(text: Column, flavors: Sequence[str] = FLAVORS, header: bool = True,
                sample_rows: int | None = None) -> Column:
    """All tables of a page without duplicates, in lookup order."""
    ordered = sorted(flavors, key=flavor_rank)
    return F.concat(*[unique_in_row(tables_in(text, f, header), sample_rows) for f in ordered])


def lookup_in_row(tables: Column, term: Column, known: Column) -> Column:
    """The values of one lower-cased term in the page's tables; NULL if there are none.

    `known` holds the values to pass over.
    """
    def usable(value: Column) -> Column:
        return value.isNotNull() & (value != "") & ~F.array_contains(known, value)

    def in_table(table: Column) -> Column:
        named = F.filter(
            F.transform(table["header"], lambda h, i: F.when(F.contains(F.lower(h), term), i)),
            lambda i: i.isNotNull(),
        )
        columns = F.transform(
            named,
            lambda i: F.filter(F.transform(table["rows"], lambda row: F.get(row, i)), usable),
        )
        under_header = F.get(F.filter(columns, lambda values: F.size(values) > 0), F.lit(0))
        first_cell = F.slice(
            F.filter(F.flatten(table["rows"]), lambda c: F.contains(F.lower(c), term) & usable(c)), 1, 1
        )
        return F.coalesce(
            F.array_distinct(under_header), let(first_cell, lambda c: F.when(F.size(c) > 0, c))
        )

    return F.get(F.filter(F.transform(tables, in_table), lambda v: v.isNotNull()), F.lit(0))
