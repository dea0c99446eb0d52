"""Documents for the queries, derived from the given tables, for Spark and as DuckDB SQL.

A form has two pages. Page 1 has one label per line, from an order and its customer. Page 2 has tables
laid out with spaces, for some orders also with bars, and for some the first table once more with a
further row.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from docfields.plans.spread import spread, spread_rows
from docfields.sources.pages import explode_pages

PAGE_1_SPARK = """concat(
  'Factura: F-', o_orderkey, '\\n',
  'Fecha: ', date_format(o_orderdate, 'dd/MM/yyyy'), '\\n',
  'Cliente: ', c_name, '\\n',
  'Prioridad ', o_orderpriority, '\\n',
  'Subtotal: ', replace(cast(cast(o_totalprice / 2 as decimal(18,1)) as string), '.', ','), '\\n',
  'Total a pagar: ', cast(cast(o_totalprice as decimal(18,2)) as string), '\\n',
  'Vencimiento = ', date_format(o_orderdate, 'yyyy-MM-dd'), '  Estado: ', o_orderstatus)"""

PAGE_1_DUCKDB = """concat(
  'Factura: F-', o_orderkey, chr(10),
  'Fecha: ', strftime(o_orderdate, '%d/%m/%Y'), chr(10),
  'Cliente: ', c_name, chr(10),
  'Prioridad ', o_orderpriority, chr(10),
  'Subtotal: ', replace(cast(cast(o_totalprice / 2 as decimal(18,1)) as varchar), '.', ','), chr(10),
  'Total a pagar: ', cast(cast(o_totalprice as decimal(18,2)) as varchar), chr(10),
  'Vencimiento = ', strftime(o_orderdate, '%Y-%m-%d'), '  Estado: ', o_orderstatus)"""

_SPARK_ROWS = """array_join(transform(sequence(1, {last}),
  i -> concat({lead}'art', cast((o_orderkey + i) % 7 as string), {sep},
              cast(o_orderkey * i % 50 as string), {sep},
              cast((o_orderkey + i) % 1000 as string), '.50'{tail})), '\\n')"""
_DUCKDB_ROWS = """array_to_string([concat({lead}'art', cast((o_orderkey + i) % 7 as varchar), {sep},
              cast(o_orderkey * i % 50 as varchar), {sep},
              cast((o_orderkey + i) % 1000 as varchar), '.50'{tail})
              for i in range(1, cast({last} as bigint) + 1)], chr(10))"""


def _page_2(rows: str, newline: str) -> str:
    first = rows.format(last="1 + o_orderkey % 12", lead="", sep="'   '", tail="")
    again = rows.format(last="2 + o_orderkey % 12", lead="", sep="'  '", tail="")
    barred = rows.format(last="1 + o_orderkey % 3", lead="'| ', ", sep="' | '", tail=", ' |'")
    return f"""concat(
      'Detalle', {newline}, 'Concepto  Cantidad   Precio', {newline}, {first},
      case when o_orderkey % 3 = 0
           then concat({newline}, '-', {newline}, '| Concepto | Cantidad | Precio |', {newline}, {barred})
           else '' end,
      case when o_orderkey % 5 = 0
           then concat({newline}, 'Copia', {newline}, 'Concepto  Cantidad  Precio', {newline}, {again})
           else '' end)"""


PAGE_2_SPARK = _page_2(_SPARK_ROWS, "'\\n'")
PAGE_2_DUCKDB = _page_2(_DUCKDB_ROWS, "chr(10)")


# A ledger has tables whose columns only line up: fixed widths, empty cells, gaps of one space, an indented copy, prose between.
_LEDGER = """concat(
  'Libro de la orden ', {key}, {newline}, 'nota  breve', {newline}, {newline},
  'Concepto', repeat(' ', 9), 'Cant Precio', {newline}, {rows}, {newline}, 'fin', {newline},
  case when o_orderkey % 4 = 0 then concat('   Concepto', repeat(' ', 9), 'Cant Precio', {newline}, {again}, {newline}) else '' end,
  case when o_orderkey % 6 = 0 then concat({newline}, 'uno  dos', {newline}, 'xx yy  z', {newline}, 'a   b', {newline}) else '' end)"""
_LEDGER_ROW = """concat({lead}rpad(concat('art', {i7}, case when o_orderkey % 3 = 0 then ' de metal' else '' end), 15, ' '),
  case when (o_orderkey + i) % 4 = 0 then repeat(' ', 6) else lpad({qty}, 6, ' ') end, ' ', lpad({price}, 6, ' '))"""


def _ledger(kind: str, newline: str, sequence: str) -> str:
    parts = dict(i7=f"cast((o_orderkey + i) % 7 as {kind})", qty=f"cast(o_orderkey * i % 5000 as {kind})",
                 price=f"concat(cast((o_orderkey + i) % 900 as {kind}), '.5')")
    rows, again = (sequence.format(row=_LEDGER_ROW.format(lead=lead, **parts)) for lead in ("", "'   ', "))
    return _LEDGER.format(key=f"cast(o_orderkey as {kind})", newline=newline, rows=rows, again=again)


LEDGER_SPARK = _ledger("string", "'\\n'", "array_join(transform(sequence(1, 2 + o_orderkey % 5), i -> {row}), '\\n')")
LEDGER_DUCKDB = _ledger("varchar", "chr(10)", "array_to_string([{row} for i in range(1, cast(3 + o_orderkey % 5 as bigint))], chr(10))")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(read(spark, sf_dir, name).select(*columns))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, text` with the pages parted by a form feed."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                  "o_orderdate", "o_orderpriority")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    # A count of a table reads its footers only.
    return spread_rows(joined, orders.count()).select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("cust_id"),
        F.concat(F.expr(PAGE_1_SPARK), F.lit("\f"), F.expr(PAGE_2_SPARK)).alias("text"),
    )


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, page_id, page_no, text`."""
    stem = F.concat(F.lit("form_"), F.col("doc_id").cast("string"))
    return explode_pages(forms(spark, sf_dir).select("doc_id", stem.alias("stem"), "text"))


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`page_id, text`: one page per order."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    return spread_rows(orders, orders.count()).select(
        F.concat(F.lit("ledger_"), F.col("o_orderkey").cast("string")).alias("page_id"), F.expr(LEDGER_SPARK).alias("text"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents as pages: `page_id, text`."""
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("page_id"), "text"
    )


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a table with one row on page 1 of its order's form, the table as one row."""
    headers = {"Cantidad": "cast(cast(l_quantity as int) as string)",
               "Descuento": "concat('0.', lpad(cast(cast(round(l_discount * 100) as int) as string), 2, '0'))",
               "Devuelto": "case when l_returnflag = 'N' then '' else l_returnflag end",
               "Linea estado": "concat('estado ', l_linestatus)"}
    lines = read_spread(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                        "l_discount", "l_returnflag", "l_linestatus")
    return lines.select(
        F.concat(F.lit("form_"), F.col("l_orderkey").cast("string"), F.lit("_page_1.png")).alias("page_id"),
        F.expr("case when l_linestatus = 'F' then 'lattice' else 'stream' end").alias("flavor"),
        F.expr("case when l_linestatus = 'F' then 0 else 1 end").alias("flavor_rank"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("table_idx"),
        F.array(*[F.lit(h) for h in headers]).alias("header"),
        F.array(F.array(*[F.expr(e) for e in headers.values()])).alias("rows"),
    )


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of `order_tables`, one row each."""
    columns = F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.get("header", F.lit(i)).alias("header"), F.get(F.get("rows", F.lit(0)), F.lit(i)).alias("cell"))
        for i in range(4)
    ])
    return order_tables(spark, sf_dir).select(
        "page_id", "flavor", "flavor_rank", "table_idx", F.lit(0).alias("row_idx"), F.inline(columns))


# -- the same in DuckDB, as common table expressions ------------------------------------------------

FORMS = f"""forms as (
  select o_orderkey as doc_id, o_custkey as cust_id,
         concat({PAGE_1_DUCKDB}, chr(12), {PAGE_2_DUCKDB}) as text
  from orders join customer on o_custkey = c_custkey)"""

FORM_PAGES = f"""{FORMS},
form_pages as (
  select doc_id, concat('form_', doc_id, '_page_', page_no, '.png') as page_id, page_no,
         string_split(text, chr(12))[page_no] as text
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(12))) + 1)) as page_no from forms))"""

LEDGERS = f"ledgers as materialized (select concat('ledger_', o_orderkey) as page_id, {LEDGER_DUCKDB} as text from orders)"

NOTICES = "notices as (select concat('doc_', doc_id) as page_id, text from documents)"

ORDER_CELLS = """cells as (
  select concat('form_', l_orderkey, '_page_1.png') as page_id,
         case when l_linestatus = 'F' then 'lattice' else 'stream' end as flavor,
         case when l_linestatus = 'F' then 0 else 1 end as flavor_rank,
         l_partkey * 8 + l_linenumber as table_idx, 0 as row_idx,
         unnest([0, 1, 2, 3]) as col_idx,
         unnest(['Cantidad', 'Descuento', 'Devuelto', 'Linea estado']) as header,
         unnest([cast(cast(l_quantity as integer) as varchar),
                 concat('0.', lpad(cast(cast(round(l_discount * 100) as integer) as varchar), 2, '0')),
                 case when l_returnflag = 'N' then '' else l_returnflag end,
                 concat('estado ', l_linestatus)]) as cell
  from lineitem)"""
