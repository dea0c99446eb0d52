"""The catalogue: document type → field → regular expressions.

A catalogue is job configuration. It is read once on the driver, checked, and becomes literals in the
plan. `explode_catalogs` reads many catalogue documents as data instead.
"""

import json
import logging
import re
from collections.abc import Mapping, Sequence
from importlib.resources import files

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docfields.fixed import WORD_TAIL
from docfields.functions.regex import CatalogError, escape, to_java
from docfields.functions.whitespace import strip

log = logging.getLogger(__name__)
Catalog = dict[str, dict[str, list[str]]]

def word_pattern(word: str) -> str:
    """The pattern for a field that is given as a plain word."""
    return f"(?i){re.escape(word)}{WORD_TAIL}"


def normalize_catalog(raw: Mapping) -> Catalog:
    """Bring a catalogue to its full form and check its patterns.

    A list of words becomes lower-cased fields with one pattern each, a mapping of fields stays, and
    anything else becomes a document type without fields.
    """
    catalog: Catalog = {}
    for doc_type, fields in raw.items():
        if isinstance(fields, list):
            catalog[doc_type] = {word.lower(): [word_pattern(word)] for word in fields}
        elif isinstance(fields, Mapping):
            catalog[doc_type] = {name: list(regexes) for name, regexes in fields.items()}
        else:
            log.warning("document type %r is neither a list nor a mapping", doc_type)
            catalog[doc_type] = {}
        for name, regexes in catalog[doc_type].items():
            for regex in regexes:
                try:
                    to_java(regex)
                except CatalogError as exc:
                    raise CatalogError(f"{doc_type}.{name}: {exc}") from exc
    return catalog


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Read a JSON catalogue from any file system Spark can reach.

    All files of a folder or glob are one catalogue: in order of their paths, a later file's fields are
    added to a document type, or replace those of the same name. A file that cannot be read or parsed adds nothing and is logged.
    """
    try:
        rows = spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path").collect()
    except PySparkException as exc:
        log.error("catalogue %s could not be read: %s", path, exc)
        return {}
    catalog: Catalog = {}
    for row in rows:
        try:
            raw = json.loads(bytes(row["content"]).decode("utf-8"))
        except ValueError as exc:
            log.error("catalogue %s could not be read: %s", row["path"], exc)
            continue
        if not isinstance(raw, Mapping):
            log.error("catalogue %s is not a mapping", row["path"])
            continue
        for doc_type, fields in normalize_catalog(raw).items():
            catalog.setdefault(doc_type, {}).update(fields)
    return catalog


def default_catalog() -> Catalog:
    """The catalogue that comes with the package; patterns stay on one line and respect words."""
    text = files("docfields").joinpath("catalogs/default.json").read_text(encoding="utf-8")
    return normalize_catalog(json.loads(text))


def check_doc_type(catalog: Mapping, doc_type: str) -> None:
    if doc_type not in catalog:
        raise ValueError(f"unknown document type {doc_type!r}, expected one of {sorted(catalog)}")


def select_terms(catalog: Mapping, doc_type: str, extra_terms: str | None = None) -> list[str]:
    """The fields of a document type in order, then the comma-separated extra terms.

    A document type the catalogue does not hold has no fields. Repeated terms stay.
    """
    terms = list(catalog.get(doc_type, ()))
    extra = (term.strip() for term in (extra_terms or "").split(","))
    return terms + [term for term in extra if term]


def catalog_frame(spark: SparkSession, catalog: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """`doc_type, field, field_pos, pattern_pos, regex`, one row per pattern."""
    rows = [
        (doc_type, field, i, j, regex)
        for doc_type, fields in catalog.items()
        for i, (field, regexes) in enumerate(fields.items())
        for j, regex in enumerate(regexes)
    ]
    schema = "doc_type string, field string, field_pos int, pattern_pos int, regex string"
    return spark.createDataFrame(rows, schema)


# -- catalogues as data -----------------------------------------------------------------------------

def word_pattern_column(word: Column) -> Column:
    return F.concat(F.lit("(?i)"), escape(word), F.lit(WORD_TAIL))


def extra_terms_column(extra: Column) -> Column:
    """Comma-separated terms as an array, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(extra, ","), strip), lambda term: term != "")


def explode_catalogs(df: DataFrame, json_column: str = "json") -> DataFrame:
    """Catalogue documents in a JSON column, one row per pattern, next to the other columns.

    Adds `doc_type, field, field_pos, pattern_pos, regex`. Unreadable documents and document types
    that are neither a list nor a mapping give no rows.
    """
    rest = [c for c in df.columns if c != json_column]
    shape = F.substring(F.btrim("body"), 1, 1)
    words = F.transform(
        F.from_json("body", "array<string>"),
        lambda w: F.struct(F.lower(w).alias("key"), F.array(word_pattern_column(w)).alias("value")),
    )
    fields = F.map_entries(F.from_json("body", "map<string,array<string>>"))
    return (
        df.select(*rest, F.explode(F.from_json(json_column, "map<string,string>")).alias("doc_type", "body"))
        .select(*rest, "doc_type",
                F.posexplode(F.when(shape == "[", words).when(shape == "{", fields)).alias("field_pos", "entry"))
        .select(*rest, "doc_type", F.col("entry.key").alias("field"), "field_pos",
                F.posexplode("entry.value").alias("pattern_pos", "regex"))
    )


def term_patterns(terms: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each row of `terms(term, …)` with the patterns of its field; NULL pattern without a field.

    No broadcast hint: Spark broadcasts `catalog(field, pattern_pos, regex)` if it measures it as small.
    """
    return terms.join(
        catalog.select("field", "pattern_pos", "regex"), F.lower("term") == F.col("field"), "left"
    )
