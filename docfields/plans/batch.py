"""The whole job: folder → pages → extraction → roll-up → datasets."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from docfields.fixed import FLAVORS, SNIPPET_WIDTH
from docfields.operators.extract import extract, extract_long
from docfields.sources.catalog import (
    Catalog, check_doc_type, default_catalog, load_catalog, normalize_catalog, select_terms,
)
from docfields.plans.materialize import materialize
from docfields.sources.files import attempt_text, failures, require_files, scan_folder
from docfields.sources.pages import (
    distinct_pages, file_name, is_pdf, names_may_clash, pages_from_files, pages_of_large_files,
)
from docfields.sources.sinks import write_results
from docfields.sources.text_tables import text_tables


def read_pages(spark: SparkSession, path: str,
               recognise: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """The pages of all documents in a folder; raises FileNotFoundError if there are none."""
    return attempted_pages(spark, path, recognise)[0]


def attempted_pages(spark: SparkSession, path: str,
                    recognise: Callable[[bytes], str | None] | None = None,
                    large_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pages, and the files that could not be read: `path, kind, message`.

    Recognition is dear, so its outcome is written once and both are read from there. With `large_files`, files named like a PDF
    hold text already and are read page by page, whatever their size; `recognise` gets the others.
    """
    files = require_files(scan_folder(spark, path), path)
    if large_files:
        attempts = attempt_text(files.where(~is_pdf(file_name(F.col("path")))), recognise)
        if recognise is not None:
            attempts = materialize(attempts)
        pages = pages_from_files(attempts.select("path", "text")).unionByName(pages_of_large_files(spark, path))
        return distinct_pages(pages) if names_may_clash(files) else pages, failures(attempts)
    attempts = attempt_text(files, recognise)
    if recognise is not None:
        attempts = materialize(attempts)
    pages = pages_from_files(attempts.select("path", "text"))
    # Making names distinct shuffles the text, so it is done only if names can clash at all.
    return distinct_pages(pages) if names_may_clash(files) else pages, failures(attempts)


def run(spark: SparkSession, path: str | DataFrame, doc_type: str, out: str, catalog: Catalog | str | None = None,
        *,
        extra_terms: str | None = None, n: int = 0, trace: bool = False, serials: bool = False,
        recognise: Callable[[bytes], str | None] | None = None, format: str = "parquet",
        full_numbers: bool = False, word_boundary: bool = False, flavors: Sequence[str] = FLAVORS,
        cells: DataFrame | None = None, sample_rows: int | None = None, term_list: DataFrame | None = None,
        width: int = SNIPPET_WIDTH, number_type: str = "double", locale: str | None = None, by: Sequence[str] = (),
        skip_without_text: Sequence[str] = (), large_files: bool = False) -> bool:
    """Extract one document type from a folder, or a DataFrame `pages(page_id, text)`, and write the result datasets below `out`.

    `catalog` is a catalogue, the path of one, or None for the one in the package. `term_list(term_pos, term)` holds further
    literal terms, as many as there are; it takes no chains. A literal term's value is read from the `width` characters after
    it. Numbers are read as in `locale` and summed as `number_type`, apart by the result columns `by`. Files that could
    not be read are a dataset `errors` of their own, written if there are any, also where nothing is found. Layouts in
    `skip_without_text` are not looked for in documents whose first page is blank. With `large_files`, text
    files named like a PDF are read page by page and may be larger than a row. Returns whether anything was found and written.
    """
    if term_list is not None and (n > 1 or trace):
        raise ValueError("a term list takes n = 0 or 1 and no trace")
    if catalog is None:
        loaded = default_catalog()
    elif isinstance(catalog, str):
        loaded = load_catalog(spark, catalog)
    else:
        loaded = normalize_catalog(catalog)
    check_doc_type(loaded, doc_type)
    terms = select_terms(loaded, doc_type, extra_terms)
    pages, failed = (path, None) if isinstance(path, DataFrame) else attempted_pages(spark, path, recognise, large_files)
    results = extract(pages, terms, loaded[doc_type], n=n, trace=trace, serials=serials,
                      full_numbers=full_numbers, word_boundary=word_boundary, flavors=flavors, cells=cells,
                      width=width, sample_rows=sample_rows, skip_without_text=skip_without_text)
    if term_list is not None:
        found = cells if cells is not None else text_tables(
            pages, flavors, skip_without_text=skip_without_text) if flavors else None
        results = results.unionByName(extract_long(
            pages, term_list, loaded[doc_type], n=n, serials=serials, cells=found, full_numbers=full_numbers,
            word_boundary=word_boundary, width=width, sample_rows=sample_rows))
    return write_results(results, out, format, number_type=number_type, locale=locale, by=by, failed=failed)
