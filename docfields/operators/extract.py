"""Extraction: every search term on every page, from the text first, then from tables.

Text search is one narrow stage. The term list is unrolled into an array of structs per page, whose
elements keep their patterns as literals, and only what was found leaves the stage: the page text is
never shuffled and never copied per term.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docfields.fixed import FLAVORS, SNIPPET_WIDTH
from docfields.functions import chain as ch
from docfields.functions.casing import fold
from docfields.functions.search import (
    Patterns, found_at, let, literal_at, patterns_for, resolve, snippet_at,
)
from docfields.functions.serials import serial_first
from docfields.functions.text import normalize_key
from docfields.operators.index import long_text_hits
from docfields.operators.tables import is_whole, lookup_in_row, lookup_terms, lookup_whole, page_tables, table_lookup
from docfields.plans.materialize import materialize
from docfields.sources.text_tables import TABLE_TYPE

RESULT_COLUMNS = ["image", "serial", "key", "value", "path"]


def _no_string() -> Column:
    return F.lit(None).cast("string")


def _first_search(pages: DataFrame, terms: Sequence[str], patterns: Patterns | None,
                  serials: bool, word_boundary: bool, width: int, layered: bool = False) -> tuple[DataFrame, Column]:
    """Pages with what the search of all terms shares, and the array with the parts of each search.

    Separate projections, so that the folded text, each pattern and each place are worked out once per
    page.
    """
    text, low = F.col("text"), F.col("_low")
    serial = (
        serial_first(text, (patterns or {}).get("serial"), low, word_boundary) if serials else _no_string()
    )
    by_pattern = F.array(*[patterns_for(t, text, patterns, word_boundary) for t in terms])

    at = F.array(*[
        F.when(F.col("_pat")[i].isNull(), literal_at(low, term)) for i, term in enumerate(terms)
    ])

    def parts(i: int, term: str) -> Column:
        here = F.col("_at")[i]
        return F.struct(
            F.lit(i).alias("term_pos"), F.lit(term).alias("term"), F.col("_pat")[i].alias("pat"),
            found_at(text, here, term).alias("found"), snippet_at(text, here, term, width).alias("snippet"),
        )

    kept = ["page_id", "text", *(["no_text"] if layered else [])]
    shared = (
        pages.select(*kept, fold(text).alias("_low"))
        .select(*kept, "_low", serial.alias("serial"), by_pattern.alias("_pat"))
        .select(*kept, "_low", "serial", "_pat", at.alias("_at"))
    )
    return shared, F.array(*[parts(i, t) for i, t in enumerate(terms)])


def _follow(parts: Column, n: int, trace: bool, patterns: Patterns | None, full_numbers: bool,
            word_boundary: bool, width: int) -> Column:
    """From the parts of each search to `term_pos, term, key, value, path`, following chains."""
    text, low = F.col("text"), F.col("_low")

    def found(h: Column) -> Column:
        return resolve(h["term"], h["pat"], h["found"], h["snippet"], full_numbers)

    def row(h: Column, some: Column, key: Column, value: Column, path: Column) -> Column:
        return F.struct(
            h["term_pos"].alias("term_pos"), h["term"].alias("term"),
            F.when(some, normalize_key(key)).alias("key"), F.when(some, value).alias("value"),
            path.alias("path"),
        )

    def single(h: Column) -> Column:
        return let(found(h), lambda hit: row(
            h, (hit["key"] != "") & (hit["value"] != ""), h["term"] if n else hit["key"], hit["value"],
            _no_string(),
        ))

    def chained(h: Column) -> Column:
        hops = ch.extend(let(found(h), ch.start), text, low, n, patterns, full_numbers, word_boundary, width)
        return let(hops, lambda hops: followed(h, hops))

    def followed(h: Column, hops: Column) -> Column:
        last = F.try_element_at(hops, F.lit(-1))
        return row(h, F.size(hops) > 0, last["term"] if trace else h["term"] if n else hops[0]["term"],
                   last["value"], ch.chain_path(hops) if trace else _no_string())

    return F.transform(parts, chained if n >= 2 or trace else single)


def text_hits(pages: DataFrame, terms: Sequence[str], patterns: Patterns | None = None, *, n: int = 0,
              trace: bool = False, serials: bool = False, full_numbers: bool = False,
              word_boundary: bool = False, width: int = SNIPPET_WIDTH) -> DataFrame:
    """Search all terms in `pages(page_id, text)`.

    One row per page and term: `page_id, serial, term_pos, term, key, value, path`. Key, value and
    path are NULL where the text gives nothing (no hit, or a hit without a value).
    """
    ch.check_hops(n)
    df, parts = _first_search(pages, terms, patterns, serials, word_boundary, width)
    # The whole expression sits inside the generator: a filter on its output cannot be pushed into
    # it, so nothing is searched twice.
    hits = _follow(parts, n, trace, patterns, full_numbers, word_boundary, width)
    return df.select("page_id", "serial", F.inline(hits))


def missed_pairs(hits: DataFrame) -> DataFrame:
    """The page and term pairs of `text_hits` that are left to the tables."""
    return hits.where(F.col("value").isNull()).select("page_id", "term_pos", "term")


def _results(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("page_id").alias("image"), "serial", "key", "value", "path")


def _with_tables_in_text(pages: DataFrame, terms: Sequence[str], patterns: Patterns | None, n: int,
                         trace: bool, serials: bool, flavors: Sequence[str], full_numbers: bool,
                         word_boundary: bool, width: int, sample_rows: int | None, skip: Sequence[str]) -> DataFrame:
    df, parts = _first_search(pages, terms, patterns, serials, word_boundary, width, bool(skip))
    df = df.withColumn("_hits", _follow(parts, n, trace, patterns, full_numbers, word_boundary, width))
    looked_up = [pos for pos, _ in lookup_terms(terms)]

    def eligible(h: Column) -> Column:
        # A table in the text can only hold a term that the text holds.
        open_ = h["term_pos"].isin(looked_up) & F.contains(F.col("_low"), fold(h["term"]))
        return open_ if trace else open_ & h["value"].isNull()

    none = F.array().cast("array<string>")

    def known(h: Column) -> Column:
        if not trace:
            return none
        earlier = F.filter(
            F.col("_hits"),
            lambda x: (x["term_pos"] <= h["term_pos"]) & (x["key"] == F.lower(h["term"])),
        )
        return F.transform(earlier, lambda x: x["value"])

    def rows(h: Column) -> Column:
        from_text = F.struct(h["key"].alias("key"), h["value"].alias("value"), h["path"].alias("path"))
        values = F.when(
            eligible(h), lookup_in_row(F.col("_tables"), F.lower(h["term"]), known(h))
        )
        from_tables = F.transform(
            F.coalesce(values, none),
            lambda v: F.struct(F.lower(h["term"]).alias("key"), v.alias("value"), _no_string().alias("path")),
        )
        return F.concat(F.filter(F.array(from_text), lambda r: r["value"].isNotNull()), from_tables)

    tables = page_tables(F.col("text"), flavors, sample_rows=sample_rows)
    if skip:
        others = [f for f in flavors if f not in skip]
        fewer = page_tables(F.col("text"), others, sample_rows=sample_rows) if others else F.filter(tables, lambda _: F.lit(False))
        tables = F.when(F.col("no_text"), fewer).otherwise(tables)
    empty = F.array().cast(f"array<{TABLE_TYPE}>")
    df = df.withColumn("_tables", F.when(F.exists("_hits", eligible), tables).otherwise(empty))
    return df.select("page_id", "serial", F.inline(F.flatten(F.transform("_hits", rows))))


def _filled_from(hits: DataFrame, cells: DataFrame, terms: Sequence[str], sample_rows: int | None) -> DataFrame:
    """`hits` that have a value as they are, and the table values of the pages and terms without one.

    Hits hold no text. They are written once, so the text is searched once, and what was found needs no join. Only the misses
    go to the tables, and inner joins let Spark split many values of one page and term.
    """
    hits = materialize(hits)
    missed = hits.where(F.col("value").isNull())
    looked = table_lookup(cells, terms, pairs=missed, sample_rows=sample_rows)
    from_tables = missed.select("page_id", "serial", "term_pos").join(looked, ["page_id", "term_pos"]).select(
        "page_id", "serial", F.col("term").alias("key"), "value")
    return hits.where(F.col("value").isNotNull()).select("page_id", "serial", "key", "value", "path").unionByName(
        from_tables, allowMissingColumns=True)


def _filled_from_whole(pages: DataFrame, tables: DataFrame, terms: Sequence[str], patterns: Patterns | None, n: int, serials: bool,
                       full_numbers: bool, word_boundary: bool, width: int, sample_rows: int | None) -> DataFrame:
    """The same with whole tables, one row each. What the text and the tables give for a page meets in one join by the page.

    What was found in a page's text stays one row, so the text is searched once and nothing is written in between.
    """
    df, parts = _first_search(pages, terms, patterns, serials, word_boundary, width)
    hits = F.filter(_follow(parts, n, False, patterns, full_numbers, word_boundary, width), lambda h: h["value"].isNotNull())
    found = df.select("page_id", "serial", F.transform(hits, lambda h: F.struct(
        h["term_pos"].alias("term_pos"), h["key"].alias("key"), h["value"].alias("value"))).alias("hits"))
    looked = lookup_whole(tables, terms, sample_rows).groupBy(F.col("page_id").alias("l_page")).agg(
        F.collect_list(F.struct("term_pos", "values")).alias("looked"))
    names = F.create_map(*[F.lit(x) for pair in lookup_terms(terms) for x in pair])

    def missed(one: Column) -> Column:
        return ~F.exists("hits", lambda h: h["term_pos"] == one["term_pos"])

    def values(one: Column) -> Column:
        return F.transform(one["values"], lambda v: F.struct(names[one["term_pos"]].alias("key"), v.alias("value")))

    from_text = F.transform("hits", lambda h: F.struct(h["key"].alias("key"), h["value"].alias("value")))
    from_tables = F.flatten(F.transform(F.filter("looked", missed), values))
    both = F.when(F.col("looked").isNull(), from_text).otherwise(F.concat(from_text, from_tables))
    # The hint: sizes guessed from packed files are far too low here, and what is taken for small would be sent to all.
    return found.join(looked.hint("merge"), F.col("page_id") == F.col("l_page"), "left").select(
        "page_id", "serial", F.inline(both), _no_string().alias("path"))


def extract(pages: DataFrame, terms: Sequence[str], patterns: Patterns | None = None, *, n: int = 0,
            trace: bool = False, serials: bool = False, cells: DataFrame | None = None,
            flavors: Sequence[str] = FLAVORS, full_numbers: bool = False,
            word_boundary: bool = False, width: int = SNIPPET_WIDTH, sample_rows: int | None = None,
            skip_without_text: Sequence[str] = ()) -> DataFrame:
    """Extract the terms from `pages(page_id, text)` as `image, serial, key, value, path`.

    A term without a value in the text is looked up in the page's tables: in `cells` if given, else
    in the tables laid out in the text (`flavors=()` leaves tables out). With `trace` each row shows
    the path of its chain, the key is the last hop's term, and tables are searched after a text hit too.
    Tables of a page that are equal, or equal in their first `sample_rows` rows, count once. A literal term's value is read
    from the `width` characters after it. `cells` may also be whole tables, one row each (`cells_of`). Tables in the text of the layouts `skip_without_text` are left out where
    `pages.no_text` says that the document has no text layer; cells are skipped where they are made (`text_tables`).
    """
    options = dict(n=n, trace=trace, serials=serials, full_numbers=full_numbers,
                   word_boundary=word_boundary, width=width)
    ch.check_hops(n)
    if not terms:
        return pages.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in RESULT_COLUMNS))
    if cells is None and flavors:
        return _results(_with_tables_in_text(pages, terms, patterns, n, trace, serials, flavors,
                                             full_numbers, word_boundary, width, sample_rows, skip_without_text))
    if cells is not None and is_whole(cells) and not trace:
        return _results(_filled_from_whole(pages, cells, terms, patterns, n, serials, full_numbers, word_boundary, width, sample_rows))
    hits = text_hits(pages, terms, patterns, **options)
    if cells is None:
        return _results(hits.where(F.col("value").isNotNull()))
    if not trace:
        return _results(_filled_from(hits, cells, terms, sample_rows))
    # With a trace the text hits are needed three times: as results, as the values already recorded
    # and for the serials. They hold no text, so they are written once.
    hits = materialize(hits)
    recorded = hits.where(F.col("value").isNotNull())
    serial = hits.where(F.col("term_pos") == 0).select(F.col("page_id").alias("s_page"), "serial")
    from_tables = (
        table_lookup(cells, terms, recorded, sample_rows=sample_rows)
        .join(serial, F.col("page_id") == F.col("s_page"))
        .select("page_id", "serial", F.col("term").alias("key"), "value")
    )
    return _results(recorded.unionByName(from_tables, allowMissingColumns=True))


def extract_long(pages: DataFrame, terms: DataFrame, patterns: Patterns | None = None, *, n: int = 0, serials: bool = False,
                 cells: DataFrame | None = None, full_numbers: bool = False, word_boundary: bool = False,
                 width: int = SNIPPET_WIDTH, sample_rows: int | None = None) -> DataFrame:
    """Extract a long list of literal `terms(term_pos, term)` from `pages(page_id, text)`: `image, serial, key, value, path`.

    The rows of `extract` for such terms, with `n` 0 or 1 and without a trace; the plan does not grow with the list. Terms that
    are fields of `patterns` are left to `extract`. A term without a value in the text is looked up in `cells`. Then
    `page_id` must be distinct.
    """
    if n not in (0, 1):
        raise ValueError(f"long term lists take n = 0 or 1, not {n}")
    fields = sorted(patterns or ())
    if fields:
        terms = terms.where(~F.lower("term").isin(fields))
    hits = long_text_hits(pages, terms, full_numbers=full_numbers, serials=serials,
                          serial_patterns=(patterns or {}).get("serial"), word_boundary=word_boundary, width=width)
    key = normalize_key(F.col("term")) if n else F.col("key")
    filled = hits.where((F.col("key") != "") & (F.col("value") != "")).withColumn("key", key).withColumn("path", _no_string())
    if cells is None:
        return _results(filled)
    # Misses are all pages and terms but the few that hit, so it is the values from tables that are taken away where there is a
    # hit, not the misses that are looked up.
    looked = table_lookup(cells, terms, sample_rows=sample_rows)
    missed = looked.join(filled.select("page_id", "term_pos"), ["page_id", "term_pos"], "left_anti")
    serial = serial_first(F.col("text"), (patterns or {}).get("serial"), None, word_boundary) if serials else _no_string()
    named = pages.select(F.col("page_id").alias("s_page"), serial.alias("serial"))
    from_tables = missed.join(named, F.col("page_id") == F.col("s_page")).select(
        "page_id", "serial", F.col("term").alias("key"), "value", _no_string().alias("path"))
    return _results(filled.unionByName(from_tables, allowMissingColumns=True))
