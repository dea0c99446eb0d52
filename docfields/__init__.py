"""Document field extraction on Spark."""

from docfields.operators.extract import extract, missed_pairs, text_hits
from docfields.operators.rollup import rollup, rollup_both
from docfields.operators.tables import dedupe_tables, table_lookup, table_signatures
from docfields.plans.batch import read_pages, run
from docfields.sources.catalog import default_catalog, load_catalog, normalize_catalog, select_terms
from docfields.sources.files import extract_text, map_files, scan_folder
from docfields.sources.pages import distinct_pages, explode_pages, pages_from_files, without_text
from docfields.sources.sinks import save_datasets, write_results
from docfields.sources.text_tables import text_tables

__all__ = [
    "dedupe_tables", "default_catalog", "distinct_pages", "explode_pages", "extract", "extract_text",
    "load_catalog", "map_files", "missed_pairs", "normalize_catalog", "pages_from_files", "read_pages",
    "rollup", "rollup_both", "run", "save_datasets", "scan_folder", "select_terms", "table_lookup",
    "table_signatures", "text_hits", "text_tables", "without_text", "write_results",
]
