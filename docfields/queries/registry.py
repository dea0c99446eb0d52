"""The queries: one per operator, as a Spark job and, where it can be told in SQL, as DuckDB SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docfields.functions import chain as ch
from docfields.functions import search as se
from docfields.functions.casing import fold
from docfields.functions.numbers import normalize_number
from docfields.functions.serials import serial_all, serial_first
from docfields.functions.text import clean_text, normalize_cell, normalize_header, normalize_text
from docfields.operators import tables as tb
from docfields.operators.extract import extract, missed_pairs, text_hits
from docfields.operators.index import long_text_hits
from docfields.operators.rollup import rollup, rollup_both
from docfields.queries import forms as fm
from docfields.queries import sql
from docfields.queries.forms import read, read_spread
from docfields.sources.catalog import (
    explode_catalogs, extra_terms_column, term_patterns, word_pattern_column,
)
from docfields.sources.files import try_files
from docfields.sources.pages import distinct_pages, explode_pages, page_path, with_text_layer, without_text
from docfields.sources.text_tables import cells_of, text_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"

PATTERNS = {
    "factura": [r"\bfactura: (F-\d+)"],
    "fecha": [r"emitida el (\d{4})", r"^fecha: (\d\d/\d\d/\d{4})", r"\bfecha: (\d\d/\d\d/\d{4})"],
    "cliente": [r"\bcliente: *(\w+#\d+)"],
    "total": [r"total a pagar: (\d+\.\d\d)\b", r"\btotal = (\d+)"],
}
TERMS = [*PATTERNS, "Prioridad", "subtotal", "vencimiento", "estado", "moneda"]
TABLE_TERMS = ["factura", "total", "cantidad", "devuelto", "estado f", "Estado O", "descuento"]
NOTICE_PATTERNS = {
    "license": [r"the ([A-Za-z0-9.-]+) license", r"license[:\s-]*(\S+)"],
    "token": [r"(?:token|secret|password)\s*[=:]\s*(\S+)"],
}
NOTICE_TERMS = ["license", "version", "token", "id", "não"]
CHAIN_TERMS = ["prioridad", "factura", "vencimiento", "moneda"]
OVERRIDES = (r"prioridad (5-\w+)", r"estado: (P)")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


# -- pages and text ---------------------------------------------------------------------------------

@query("page_explode", f"""with {fm.FORM_PAGES}
select doc_id, page_id, concat('/forms/', page_id) as path, cast(page_no as integer) as page_no, text
from form_pages""")
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fm.form_pages(spark, sf_dir)
    return pages.select("doc_id", "page_id", page_path("/forms", F.col("page_id")).alias("path"),
                        "page_no", "text")


@query("page_names_distinct", f"""with {fm.FORMS}
select page_id, min(text) as text from (
  select concat('customer_', cust_id, '_page_', n, '.png') as page_id, string_split(text, chr(12))[n] as text
  from (select cust_id, text, unnest(range(1, len(string_split(text, chr(12))) + 1)) as n from forms))
group by page_id""")
def page_names_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("customer_"), F.col("cust_id").cast("string")).alias("stem")
    pages = explode_pages(fm.forms(spark, sf_dir).select(stem, "text"))
    return distinct_pages(pages.select("page_id", "text"))


_BLANKED = f"""{fm.FORMS},
blanked as materialized (
  select doc_id, case when doc_id % 10 = 0 then concat(' ', chr(10), chr(9), chr(12), string_split(text, chr(12))[2])
                      else text end as text from forms),
blank_pages as materialized (
  select doc_id, concat('form_', doc_id, '_page_', n, '.png') as page_id, n as page_no, string_split(text, chr(12))[n] as text
  from (select *, unnest(range(1, len(string_split(text, chr(12))) + 1)) as n from blanked)),
no_layer as materialized (select doc_id from blank_pages where page_no = 1 and {sql.strip('lower(text)')} = '')"""


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms as `doc_id, stem, text`, the first page of every tenth order blank."""
    second = F.get(F.split("text", "\f"), F.lit(1))
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" \n\t\f"), second)).otherwise(F.col("text"))
    stem = F.concat(F.lit("form_"), F.col("doc_id").cast("string"))
    return fm.forms(spark, sf_dir).select("doc_id", stem.alias("stem"), text.alias("text"))


@query("no_text_docs", f"with {_BLANKED} select doc_id from no_layer")
def no_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_text(explode_pages(_blanked(spark, sf_dir)))


@query("text_clean", f"select doc_id, {sql.strip('lower(text)')} as text from documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", clean_text(F.col("text")).alias("text"))


@query("text_normalize", f"""select doc_id,
  regexp_replace({sql.strip('lower(text)')}, '\\s+', ' ', 'g') as text from documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", normalize_text(F.col("text")).alias("text"))


_RAW_NUMBER = """case l_linenumber
  when 1 then concat(' ', cast(cast(l_extendedprice as decimal(18,2)) as {str}), ' ')
  when 2 then replace(cast(cast(l_extendedprice as decimal(18,2)) as {str}), '.', ',')
  when 3 then concat('1,', cast(100 + l_partkey % 900 as {str}), '.25')
  when 4 then concat('2,', cast(100 + l_partkey % 900 as {str}), ',000')
  when 5 then concat('-', cast(l_partkey as {str}))
  when 6 then concat('1', cast(l_suppkey as {str}), case when l_partkey % 2 = 0 then 'd' else 'e345' end)
  else concat(l_returnflag, ' ', l_linestatus, ' nan') end"""
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("normalize_number", f"""with raw as (
  select {', '.join(_LINE_KEY)}, {_RAW_NUMBER.format(str='varchar')} as raw from lineitem),
plain as (select *, {sql.plain_number('raw')} as plain from raw)
select {', '.join(_LINE_KEY)}, {sql.number('plain', MONEY)} as num,
       case when {sql.number('plain', MONEY)} is null then plain end as str from plain""")
def normalize_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_RAW_NUMBER.format(str="string"))
    lines = read_spread(spark, sf_dir, "lineitem", *_LINE_KEY, "l_extendedprice", "l_returnflag", "l_linestatus")
    parts = lines.select(*_LINE_KEY, raw.alias("raw"))
    return parts.select(
        *_LINE_KEY, normalize_number(F.col("raw"), number_type=MONEY).alias("n")
    ).select(*_LINE_KEY, "n.*")


# -- files -----------------------------------------------------------------------------------------

def _recognised(content: bytes) -> str | None:
    """A reader that fails on some contents, returns nothing for others and upper-cases the first word of the rest."""
    if len(content) % 7 == 0:
        raise ValueError(f"length {len(content)}")
    if len(content) % 11 == 0:
        return None
    return content[:len(content) % 5].decode("ascii").lower() + ":" + str(len(content.decode("utf-8")))


@query("file_failures", """select concat('/docs/', doc_id) as path,
  case when n % 7 = 0 or n % 11 = 0 or not regexp_full_match(lead, '[\\x00-\\x7F]*') then null
       else concat(lower(lead), ':', length(text)) end as text,
  case when n % 7 = 0 then 'ValueError' when n % 11 = 0 then null
       when not regexp_full_match(lead, '[\\x00-\\x7F]*') then 'UnicodeDecodeError' end as kind,
  case when n % 7 = 0 then concat('length ', n) end as message,
  1 as tries from (select *, strlen(text) as n,
  left(text, cast(strlen(text) % 5 as int)) as lead from documents)""")
def file_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file contents, a third of which cannot be read: texts, and the errors of the others."""
    files = read_spread(spark, sf_dir, "documents", "doc_id", "text").select(
        F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    tried = try_files(files, _recognised)
    own = F.col("error.kind") == "ValueError"
    return tried.select("path", "text", F.col("error.kind").alias("kind"),
                        F.when(own, F.col("error.message")).alias("message"), F.lit(1).alias("tries"))


# -- catalogue --------------------------------------------------------------------------------------

@query("catalog_flat", """with regexes as (
  select p_partkey, 0 as field_pos, p_name as field, 0 as pattern_pos,
         concat('(?i)', p_type, ':(\\S+)') as regex from part
  union all
  select p_partkey, 0, p_name, 1, concat(p_type, '[ ]*([0-9]+)') from part
  union all
  select p_partkey, 1, 'size', 0, concat('size ', p_size, '(\\d*)') from part)
select p_partkey, p_brand as doc_type, field, field_pos, pattern_pos, regex
from regexes join part using (p_partkey)
union all
select p_partkey, 'words', lower(p_type), 0, 0, concat('(?i)', p_type, '[:\\s-]*(\\S+)') from part
union all
select p_partkey, 'words', lower(p_brand), 1, 0,
       concat('(?i)', replace(p_brand, '#', '\\#'), '[:\\s-]*(\\S+)') from part""")
def catalog_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue documents, one per part, with a mapping, a word list and an invalid entry."""
    regexes = F.create_map(
        F.col("p_name"), F.array(F.concat(F.lit("(?i)"), "p_type", F.lit(r":(\S+)")),
                                 F.concat("p_type", F.lit("[ ]*([0-9]+)"))),
        F.lit("size"), F.array(F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(r"(\d*)"))),
    )
    document = F.concat(
        F.lit("{"), F.to_json(F.array("p_brand")).substr(F.lit(2), F.length(F.to_json(F.array("p_brand"))) - 2),
        F.lit(":"), F.to_json(regexes), F.lit(',"words":'), F.to_json(F.array("p_type", "p_brand")),
        F.lit(',"broken":7}'),
    )
    return explode_catalogs(read(spark, sf_dir, "part").select("p_partkey", document.alias("json")))


@query("catalog_from_words", """select distinct p_type as doc_type, lower(p_brand) as field,
  concat('(?i)', regexp_replace(p_brand, '([#])', '\\\\\\1', 'g'), '[:\\s-]*(\\S+)') as regex from part""")
def catalog_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return words.select(F.col("p_type").alias("doc_type"), F.lower("p_brand").alias("field"),
                        word_pattern_column(F.col("p_brand")).alias("regex"))


@query("term_list", """select p_partkey, cast(term_pos as integer) as term_pos, term from (
  select p_partkey, unnest(range(0, len(terms))) as term_pos, unnest(terms) as term from (
    select p_partkey, [p_type] || [trim(t, ' ') for t in string_split(concat(p_name, ' ,, ', p_brand, ',', p_type), ',')
                                  if trim(t, ' ') <> ''] as terms from part))""")
def term_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.concat("p_name", F.lit(" ,, "), "p_brand", F.lit(","), "p_type")
    terms = F.concat(F.array("p_type"), extra_terms_column(extra))
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(terms).alias("term_pos", "term"))


@query("term_patterns", """with catalog as (
  select distinct lower(p_name) as field, 0 as pattern_pos, concat(p_name, '[:\\s-]*(\\S+)') as regex
  from part)
select p_partkey, case when p_partkey % 3 = 0 then p_type else upper(p_name) end as term, pattern_pos, regex
from part left join catalog on lower(case when p_partkey % 3 = 0 then p_type else upper(p_name) end) = field""")
def term_pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    catalog = part.select(
        F.lower("p_name").alias("field"), F.lit(0).alias("pattern_pos"),
        F.concat("p_name", F.lit(r"[:\s-]*(\S+)")).alias("regex"),
    ).distinct()
    # A third of the terms are types, which no field is named by.
    terms = part.select("p_partkey", F.expr("case when p_partkey % 3 = 0 then p_type else upper(p_name) end").alias("term"))
    return term_patterns(terms, catalog).select("p_partkey", "term", "pattern_pos", "regex")


# -- searching --------------------------------------------------------------------------------------

@query("field_first", f"""with {fm.FORM_PAGES}
select page_id, {", ".join(f"{sql.field_first('text', r)} as {f}" for f, r in PATTERNS.items())}
from form_pages""")
def field_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.form_pages(spark, sf_dir).select(
        "page_id", *[se.field_first(F.col("text"), r).alias(f) for f, r in PATTERNS.items()]
    )


@query("field_all", f"""with {fm.NOTICES}
select page_id, unnest(range(0, len(found))) as pos, unnest(found) as value
from (select page_id, {sql.field_all('text', NOTICE_PATTERNS['license'])} as found from notices)""")
def field_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.field_all(F.col("text"), NOTICE_PATTERNS["license"])
    return fm.notices(spark, sf_dir).select("page_id", F.posexplode(found).alias("pos", "value"))


@query("literal_find", f"""with {fm.NOTICES}
select page_id, {sql.found('text', 'license')} as license, {sql.found('text', 'ÉT')} as accented
from notices""")
def literal_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return fm.notices(spark, sf_dir).select(
        "page_id", se.literal_find(text, "license").alias("license"), se.literal_find(text, "ÉT").alias("accented")
    )


@query("snippet_after", f"""with {fm.NOTICES}
select page_id, {sql.snippet('text', 'Token')} as token, {sql.snippet('text', 'de')} as de from notices""")
def snippet_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return fm.notices(spark, sf_dir).select(
        "page_id", se.snippet_after(text, "Token").alias("token"), se.snippet_after(text, "de").alias("de")
    )


@query("value_cascade", f"""with {fm.NOTICES}
select page_id, {sql.cascade('s')} as value
from (select page_id, {sql.snippet('text', 'en')} as s from notices)""")
def value_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fm.notices(spark, sf_dir).select("page_id", se.snippet_after(F.col("text"), "en").alias("s"))
    return pages.select("page_id", se.value_cascade(F.col("s")).alias("value"))


@query("search_term", f"""with {fm.NOTICES}
{sql.searches('notices', NOTICE_TERMS, NOTICE_PATTERNS)}""")
def search_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fm.notices(spark, sf_dir).select("page_id", "text", fold(F.col("text")).alias("low"))
    hits = F.array(*[
        F.struct(F.lit(i).alias("term_pos"), F.lit(t).alias("term"),
                 se.search_term(F.col("text"), t, NOTICE_PATTERNS, F.col("low")).alias("hit"))
        for i, t in enumerate(NOTICE_TERMS)
    ])
    return pages.select("page_id", F.inline(hits)).select("page_id", "term_pos", "term", "hit.*")


@query("search_all", f"""with {fm.NOTICES}
select page_id, unnest(range(0, len(v))) as pos, 'license' as key, unnest(v) as value
from (select page_id, {sql.field_all('text', NOTICE_PATTERNS['license'])} as v from notices)
union all
select page_id, 0, {sql.found('text', 'license')}, {sql.cascade(sql.snippet('text', 'license'))}
from notices
where len({sql.field_all('text', NOTICE_PATTERNS['license'])}) = 0 and {sql.found('text', 'license')} is not null""")
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.search_all(F.col("text"), "license", NOTICE_PATTERNS)
    return fm.notices(spark, sf_dir).select("page_id", F.posexplode(found).alias("pos", "hit")).select(
        "page_id", "pos", "hit.*"
    )


@query("date_near", f"""with {fm.FORM_PAGES}
select page_id, {sql.date_near('text', 'FECHA')} as fecha, {sql.date_near('text', 'vencimiento')} as vencimiento,
       {sql.date_near('text', 'cliente')} as cliente from form_pages""")
def date_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return fm.form_pages(spark, sf_dir).select(
        "page_id", se.date_near(text, "FECHA").alias("fecha"),
        se.date_near(text, "vencimiento").alias("vencimiento"), se.date_near(text, "cliente").alias("cliente"),
    )


@query("serial_first", f"""with {fm.FORM_PAGES}, {fm.NOTICES}
select page_id, {sql.serial_first('text')} as serial
from (select page_id, text from form_pages union all select page_id, text from notices)""")
def serial_first_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fm.form_pages(spark, sf_dir).select("page_id", "text").unionByName(fm.notices(spark, sf_dir))
    folded = pages.select("page_id", "text", fold(F.col("text")).alias("low"))
    return folded.select("page_id", serial_first(F.col("text"), low=F.col("low")).alias("serial"))


@query("serial_all", f"""with {fm.NOTICES}
select page_id, unnest(range(0, len(s))) as pos, unnest(s) as serial
from (select page_id, {sql.serial_all('text')} as s from notices)""")
def serial_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = fm.notices(spark, sf_dir).select("page_id", "text", fold(F.col("text")).alias("low"))
    return folded.select(
        "page_id", F.posexplode(serial_all(F.col("text"), low=F.col("low"))).alias("pos", "serial")
    )


@query("serial_override", f"""with {fm.FORM_PAGES}
select page_id, {sql.serial_first('text', OVERRIDES)} as serial from form_pages""")
def serial_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = fm.form_pages(spark, sf_dir).select("page_id", "text", fold(F.col("text")).alias("low"))
    return folded.select("page_id", serial_first(F.col("text"), OVERRIDES, F.col("low")).alias("serial"))


# -- chains -----------------------------------------------------------------------------------------

def _chains(pages: DataFrame, terms: list[str], n: int, patterns: dict) -> DataFrame:
    folded = pages.select("page_id", "text", fold(F.col("text")).alias("low"))
    each = F.transform(
        F.array(*[F.lit(t) for t in terms]),
        lambda t, i: F.struct(i.alias("term_pos"), t.alias("initial"),
                              ch.chain(F.col("text"), t, n, patterns, F.col("low")).alias("chain")),
    )
    return folded.select("page_id", F.inline(each)).where(F.size("chain") > 0)


@query("chain_value", f"""with {fm.FORM_PAGES},
{sql.chains('form_pages', CHAIN_TERMS, PATTERNS, 3)}
select page_id, term_pos, initial as key, value from chains""")
def chain_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _chains(fm.form_pages(spark, sf_dir), CHAIN_TERMS, 3, PATTERNS)
    return found.select(
        "page_id", "term_pos", ch.chain_value(F.col("chain"), F.col("initial"), 3).alias("r")
    ).select("page_id", "term_pos", "r.*")


@query("chain_trace", f"""with {fm.NOTICES},
{sql.chains('notices', NOTICE_TERMS, NOTICE_PATTERNS, 3)}
select page_id, term_pos, term as key, value from chains""")
def chain_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _chains(fm.notices(spark, sf_dir), NOTICE_TERMS, 3, NOTICE_PATTERNS)
    return found.select("page_id", "term_pos", ch.chain_trace(F.col("chain")).alias("r")).select(
        "page_id", "term_pos", "r.*"
    )


@query("chain_path", f"""with {fm.FORM_PAGES},
{sql.chains('form_pages', ['detalle', 'concepto', 'copia'], {}, 4)}
select page_id, term_pos, path from chains""")
def chain_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _chains(fm.form_pages(spark, sf_dir), ["detalle", "concepto", "copia"], 4, {})
    return found.select("page_id", "term_pos", ch.chain_path(F.col("chain")).alias("path"))


# -- extraction and roll-up -------------------------------------------------------------------------

_KEPT = "key is not null and key <> '' and value is not null and value <> ''"
_FIELDS = f"""{fm.FORM_PAGES},
found as ({sql.searches('form_pages', TERMS, PATTERNS)}),
results as (select page_id as image, {sql.strip('lower(key)')} as key, value from found where {_KEPT})"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(fm.form_pages(spark, sf_dir), TERMS, PATTERNS, flavors=())


@query("extract_fields", f"with {_FIELDS} select image, key, value from results")
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("image", "key", "value")


def _rollup_sql(results: str) -> str:
    return f"""plain as (select key, {sql.plain_number('value')} as plain from {results}),
numbers as (select key, plain, {sql.number('plain', MONEY)} as num from plain)"""


@query("rollup_sum", f"""with {_FIELDS}, {_rollup_sql('results')}
select key, cast(sum(num) as {TOTAL}) as value from numbers where num is not null group by key""")
def rollup_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed, _ = rollup(_fields(spark, sf_dir), number_type=MONEY)
    return summed.select("key", F.col("value").cast(TOTAL).alias("value"))


@query("rollup_strings", f"""with {_FIELDS}, {_rollup_sql('results')}
select distinct key, plain as value from numbers where num is null""")
def rollup_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, listed = rollup(_fields(spark, sf_dir), number_type=MONEY)
    return listed


@query("rollup_both", f"""with {_FIELDS}, {_rollup_sql('results')}
select key, case when num is null then plain end as text, cast(sum(num) as {TOTAL}) as total
from numbers group by all""")
def rollup_both_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = rollup_both(_fields(spark, sf_dir), number_type=MONEY)
    return both.select("key", "text", F.col("total").cast(TOTAL).alias("total"))


# -- tables -----------------------------------------------------------------------------------------

_STREAM = f"{fm.FORM_PAGES},\n{sql.text_cells('form_pages', 'stream', 'stream')}"
_LATTICE = f"{fm.FORM_PAGES},\n{sql.text_cells('form_pages', 'lattice', 'lattice')}"
_CELLS = "page_id, flavor, flavor_rank, cast(table_idx as integer) as table_idx, " \
         "cast(row_idx as integer) as row_idx, cast(col_idx as integer) as col_idx, header, cell"


@query("table_cells_stream", f"with {_STREAM} select {_CELLS} from stream")
def table_cells_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tables(fm.form_pages(spark, sf_dir), ["stream"])


@query("table_cells_lattice", f"""with {fm.FORM_PAGES}, {fm.NOTICES},
both_pages as (select page_id, text from form_pages union all select page_id, text from notices),
{sql.text_cells('both_pages', 'lattice', 'lattice')}
select {_CELLS} from lattice""")
def table_cells_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fm.form_pages(spark, sf_dir).select("page_id", "text").unionByName(fm.notices(spark, sf_dir))
    return text_tables(pages, ["lattice"])


@query("table_cells_aligned", f"""with {fm.LEDGERS}, {fm.NOTICES},
all_pages as (select page_id, text from ledgers union all select page_id, text from notices),
{sql.text_cells('all_pages', 'aligned', 'aligned')}
select {_CELLS} from aligned""")
def table_cells_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose columns only line up, in ledgers and wherever documents have any."""
    return text_tables(fm.ledgers(spark, sf_dir).unionByName(fm.notices(spark, sf_dir)), ["aligned"])


ALIGNED_TERMS = ["concepto", "cant", "art3", "de metal", "precio", "nota"]


@query("aligned_lookup", f"""with {fm.LEDGERS},
{sql.text_cells('ledgers', 'aligned', 'cells')},
{sql.lookup('cells', ALIGNED_TERMS)}
select page_id, term_pos, term, value from lookup""")
def aligned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup in such tables, an indented copy counted once."""
    return tb.table_lookup(text_tables(fm.ledgers(spark, sf_dir), ["aligned"], whole=True), ALIGNED_TERMS)


@query("table_cell_norm", f"""with raw as (
  select doc_id, row_idx, chr(9) || line || ' ' as cell, ' ' || upper(lang) as header from (
    select doc_id, lang, unnest(string_split(text, chr(10))) as line,
           unnest(range(0, len(string_split(text, chr(10))))) as row_idx from documents))
select doc_id, cast(row_idx as integer) as row_idx, {sql.NORM_HEADER} as header,
       lower({sql.strip("regexp_replace(cell, '\\s+', ' ', 'g')")}) as cell from raw""")
def table_cell_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_spread(spark, sf_dir, "documents", "doc_id", "lang", "text").select(
        "doc_id", F.concat(F.lit(" "), F.upper("lang")).alias("header"),
        F.posexplode(F.split("text", "\n")).alias("row_idx", "line"),
    )
    cell = F.concat(F.lit("\t"), "line", F.lit(" "))
    return lines.select("doc_id", "row_idx", normalize_header(F.col("header")).alias("header"),
                        normalize_cell(cell).alias("cell"))


_PLACED = f"concat(row_idx, chr(1), col_idx, chr(1), {sql.NORM_HEADER}, chr(1), {sql.NORM_CELL})"


_BOTH = f"""{fm.FORM_PAGES},
{sql.text_cells('form_pages', 'lattice', 'lattice')},
{sql.text_cells('form_pages', 'stream', 'stream')},
cells as materialized (select * from lattice union all select * from stream)"""


@query("table_signature", f"""with {_BOTH}
select page_id, flavor, cast(table_idx as integer) as table_idx,
       md5(concat(cast(sum(cast('0x' || substr(md5({_PLACED}), 1, 15) as bigint)) as varchar),
                  chr(1), count(*))) as signature
from cells group by page_id, flavor, table_idx""")
def table_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = text_tables(fm.form_pages(spark, sf_dir))
    return tb.table_signatures(cells).select("page_id", "flavor", "table_idx", "signature")


def _deduped(rows: str = "") -> str:
    return f"""with {_BOTH},
printed as (
  select page_id, flavor, table_idx,
         string_agg({_PLACED}, chr(2) order by row_idx, col_idx) filter (row_idx >= 0 {rows}) as print
  from cells group by all),
kept as (select page_id, flavor, table_idx from printed
         qualify row_number() over (partition by page_id, flavor, print order by table_idx) = 1)
select {_CELLS} from cells join kept using (page_id, flavor, table_idx)"""


@query("table_dedupe", _deduped())
def table_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(tb.dedupe_tables(text_tables(fm.form_pages(spark, sf_dir), whole=True))).select(
        "page_id", "flavor", "flavor_rank", "table_idx", "row_idx", "col_idx", "header", "cell"
    )


@query("table_dedupe_sampled", _deduped("and row_idx < 8"))
def table_dedupe_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are equal in their first eight rows count once; the longer copy of a form's table does not stay."""
    return cells_of(tb.dedupe_tables(text_tables(fm.form_pages(spark, sf_dir), whole=True), sample_rows=8)).select(
        "page_id", "flavor", "flavor_rank", "table_idx", "row_idx", "col_idx", "header", "cell"
    )


_NAMES = ", ".join(f"({i}, {sql.quote(t.lower())})" for i, t in enumerate(TABLE_TERMS))


@query("table_header_hits", f"""with {fm.ORDER_CELLS}, names(term_pos, term) as (values {_NAMES})
select page_id, term_pos, term, flavor_rank, table_idx, row_idx, col_idx, cell
from cells, names where cell <> '' and contains(lower(header), term)""")
def table_header_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.header_hits(fm.order_cells(spark, sf_dir), TABLE_TERMS)


@query("table_cell_hits", f"""with {fm.ORDER_CELLS}, names(term_pos, term) as (values {_NAMES})
select page_id, term_pos, term, flavor_rank, table_idx, row_idx, col_idx, cell
from cells, names where cell <> '' and contains(lower(cell), term)
qualify row_number() over (partition by page_id, term_pos, flavor_rank, table_idx
                           order by row_idx, col_idx, cell) = 1""")
def table_cell_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.cell_hits(fm.order_cells(spark, sf_dir), TABLE_TERMS)


@query("table_lookup", f"""with {fm.ORDER_CELLS}, {sql.lookup('cells', TABLE_TERMS)}
select page_id, term_pos, term, value from lookup""")
def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table_lookup(fm.order_tables(spark, sf_dir), TABLE_TERMS)


SKIPPED = ["lattice"]
_SKIPPING = f"""{_BLANKED},
{sql.text_cells('blank_pages', 'lattice', 'barred')},
{sql.text_cells('blank_pages', 'stream', 'stream')},
skipped as (select page_id from blank_pages join no_layer using (doc_id)),
cells as materialized (select * from barred where page_id not in (select page_id from skipped) union all select * from stream),
{sql.lookup('cells', ['concepto', 'art3', 'precio'])}"""


@query("no_text_lookup", f"with {_SKIPPING} select page_id as image, term as key, value from lookup")
def no_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in the text by terms that patterns never find, without the first layout where a document has no text layer."""
    pages = explode_pages(with_text_layer(_blanked(spark, sf_dir)))
    cells = text_tables(pages, skip_without_text=SKIPPED, whole=True)
    return tb.table_lookup(cells, ["concepto", "art3", "precio"]).select(F.col("page_id").alias("image"), F.col("term").alias("key"), "value")


# -- long term lists --------------------------------------------------------------------------------

_OPENING = "concat_ws(' ', split_part(text, ' ', 1), split_part(text, ' ', 2))"
_LONG_TERMS = f"""select min(term_pos) as term_pos, term from (
  select conv_id * 100 + turn as term_pos, {_OPENING} as term from conversations
  union all select -1 - p_partkey, p_name from part) group by term"""
_CELL_TERMS = """select min(p_partkey) as term_pos, term from (
  select p_partkey, cast(p_size as {str}) as term from part
  union all select p_partkey, p_name from part
  union all select p_partkey, concat('art', cast(p_partkey % 9 as {str})) from part) group by term"""


def _rows_of(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = {name: read(spark, sf_dir, name) for name in ("conversations", "part")}
    return spark.sql(text.replace("from conversations", "from {conversations}").replace("from part", "from {part}"), **tables)


@query("long_terms", f"""with {fm.NOTICES}, terms as materialized ({_LONG_TERMS}),
low as materialized (select page_id, text, lower(text) as low from notices),
lowered as materialized (select term_pos, term, lower(term) as needle from terms),
met as materialized (select page_id, term_pos, term, text from low, lowered where contains(low, needle)),
found as (select page_id, term_pos, term, {sql.found('text', 'term', True)} as key,
                 {sql.cascade(sql.snippet('text', 'term', True))} as value from met)
select page_id, term_pos, term, {sql.strip('lower(key)')} as key, value from found""")
def long_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of conversations and names of parts, as many as there are, in the documents."""
    terms = _rows_of(spark, sf_dir, _LONG_TERMS)
    return long_text_hits(fm.notices(spark, sf_dir), terms).drop("serial")


@query("long_terms_lookup", f"""with {_BOTH},
{sql.lookup('cells', _CELL_TERMS.format(str='varchar'))}
select page_id, term_pos, term, value from lookup""")
def long_terms_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, names and article numbers of parts in the tables of the forms, which have several rows."""
    return tb.table_lookup(text_tables(fm.form_pages(spark, sf_dir), whole=True), _rows_of(spark, sf_dir, _CELL_TERMS.format(str="string")))


_MISSED = f"""{fm.FORM_PAGES},
found as ({sql.searches('form_pages', TABLE_TERMS, PATTERNS)}),
missed as (select page_id, term_pos, term from found where ({_KEPT}) is not true)"""


@query("fallback_pairs", f"with {_MISSED} select page_id, term_pos, term from missed")
def fallback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missed_pairs(text_hits(fm.form_pages(spark, sf_dir), TABLE_TERMS, PATTERNS))


_FALLBACK = f"""{_MISSED}, {fm.ORDER_CELLS},
{sql.lookup('cells', TABLE_TERMS, pairs='(select page_id, term_pos from missed)')},
serials as (select page_id, {sql.serial_first('text')} as serial from form_pages),
results as (
  select page_id as image, serial, {sql.strip('lower(key)')} as key, value
  from found join serials using (page_id) where {_KEPT}
  union all
  select page_id, serial, term, value from lookup join serials using (page_id))"""


def _with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(fm.form_pages(spark, sf_dir), TABLE_TERMS, PATTERNS, serials=True,
                   cells=fm.order_tables(spark, sf_dir))


@query("extract_with_fallback", f"with {_FALLBACK} select image, serial, key, value from results")
def extract_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_fallback(spark, sf_dir).select("image", "serial", "key", "value")


TRACED = ["Cantidad", "copia", "art3", "moneda"]
_TRACED = f"""{fm.FORM_PAGES},
{sql.text_cells('form_pages', 'lattice', 'lattice')},
{sql.text_cells('form_pages', 'stream', 'stream')},
cells as (select * from lattice union all select * from stream),
{sql.chains('form_pages', TRACED, {}, 2)},
recorded as (select page_id, term_pos, {sql.strip('lower(term)')} as key, value, path from chains),
{sql.lookup('cells', TRACED, known='recorded')}"""


@query("extract_trace_in_text", f"""with {_TRACED}
select page_id as image, key, value, path from recorded
union all
select page_id, term, value, null from lookup""")
def extract_trace_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(fm.form_pages(spark, sf_dir), TRACED, {}, n=2, trace=True)
    return found.select("image", "key", "value", "path")


@query("flagship", f"""with {_FALLBACK}, {_rollup_sql('results')}
select key, case when num is null then plain end as text, cast(sum(num) as {TOTAL}) as total
from numbers group by all""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms → pages → text search with table fallback and serials → roll-up."""
    both = rollup_both(_with_fallback(spark, sf_dir), number_type=MONEY)
    return both.select("key", "text", F.col("total").cast(TOTAL).alias("total"))
