"""Whole tables, one row each, against the same tables as cells, and what the queries on them shuffle."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from docfields.operators.extract import extract
from docfields.operators.tables import dedupe_tables, table_lookup, unique_tables
from docfields.queries.registry import QUERIES
from docfields.sources.text_tables import cells_of, tables_in, text_tables

WORDS = ["Total", "total a", "total  a", " Precio", "precio", "7", "8", "", None, " ", "x total", "iva", "a\u0001b", "b"]
TERMS = ["total", "Total A", "precio", "iva", "TOTAL", "zz", " "]
SCHEMA = "page_id string, flavor string, flavor_rank int, table_idx bigint, header array<string>, rows array<array<string>>"


@pytest.fixture(scope="module")
def whole(spark):
    """Tables that repeat and nearly repeat, ragged or without rows, tables in parts, rows that come twice, null keys."""
    rng, rows = random.Random(3), []
    for _ in range(400):
        width = rng.randint(1, 3)
        flavor, rank = rng.choice([("lattice", 0), ("stream", 1)])
        table = [rng.choice(["p1", "p2", "p3", *[f"q{i}" for i in range(60)], None]), flavor, rank, rng.choice([0, 1, 2, 5, 1 << 40, None]),
                 [rng.choice([w for w in WORDS if w is not None]) for _ in range(width)],
                 [[rng.choice(WORDS) for _ in range(max(1, width + rng.choice([-1, 0, 0, 0, 1])))] for _ in range(rng.choice([0, 1, 1, 3]))]]
        rows.append(tuple(table))
        if rng.random() < 0.5 and table[3] is not None:
            again = [[c if c is None or rng.random() < 0.8 else f" {c.upper()}" for c in row] for row in table[5]]
            rows.append((*table[:3], table[3] + rng.choice([0, 1, 2]), table[4], again))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def found(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*(columns or df.columns)).collect())))


@pytest.mark.parametrize("sample_rows", [None, 1, 0])
def test_whole_tables_give_what_their_cells_give(whole, sample_rows):
    cells = cells_of(whole)
    kept = dedupe_tables(whole, sample_rows)
    assert found(cells_of(kept)) == found(dedupe_tables(cells, sample_rows))
    assert found(unique_tables(whole, sample_rows)) == found(unique_tables(cells, sample_rows))
    values = found(table_lookup(whole, TERMS, sample_rows=sample_rows))
    assert values == found(table_lookup(cells, TERMS, sample_rows=sample_rows)) and (len(values) > 60 or sample_rows == 0)


def test_terms_that_are_rows_in_whole_tables(spark, whole):
    terms = spark.createDataFrame([*enumerate(TERMS), (99, None), (0, "b"), (0, "x"), (1, "7")], "term_pos int, term string")
    values = found(table_lookup(whole, terms))
    assert values == found(table_lookup(cells_of(whole), terms)) and len(values) > 60


def test_extraction_with_whole_tables(spark, whole):
    texts = ["total: 5 iva=", "iva 7 precio", "", None, "serie 4 total 8\nPrecio: x"]
    pages = spark.createDataFrame([(p, texts[i % 5]) for i, p in enumerate(["p1", "p1", "p2", "p3", *[f"q{i}" for i in range(60)], None, "none"])],
                                  "page_id string, text string")
    for options in ({}, {"n": 2}, {"n": 1, "trace": True}):
        ours, theirs = (extract(pages, TERMS, {"total": [r"total: (\d)"]}, serials=True, cells=c, **options) for c in (whole, cells_of(whole)))
        assert found(ours) == found(theirs) and ours.count() > 60


@pytest.fixture(scope="module")
def forms(spark, tmp_path_factory):
    """Some orders, one of them twice, with customers and line items."""
    path = str(tmp_path_factory.mktemp("forms"))
    orders = [(i, i % 3, "OFP"[i % 3], 100.5 * i, datetime.datetime(1998, 1, 1 + i), "5-LOW") for i in range(20)]
    lines = [(i % 20, i % 7, i % 5, i % 4, float(i % 9), 0.01 * (i % 6), "ANR"[i % 3], "FO"[i % 2]) for i in range(90)]
    for name, rows, schema in (
            ("orders", [*orders, orders[4]], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
            ("customer", [(i, f"Customer#{i}") for i in range(3)], "c_custkey bigint, c_name string"),
            ("lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_discount double, l_returnflag string, l_linestatus string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def shuffled_by_key(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


# A join of the orders with their customers may take two more, where it does not send the customers to all.
@pytest.mark.parametrize("name, most", [("table_lookup", 1), ("aligned_lookup", 1), ("no_text_lookup", 3), ("table_dedupe", 3), ("table_dedupe_sampled", 3),
                                        ("extract_with_fallback", 4), ("flagship", 5)])
def test_queries_shuffle_what_is_left_of_tables_once(spark, forms, name, most):
    keys = shuffled_by_key(QUERIES[name](spark, forms))
    assert sum("page_id" in k for k in keys) == (2 if most in (4, 5) else 1) and len(keys) <= most
    assert QUERIES[name](spark, forms).count() > 3


def test_lines_are_cut_into_cells_once_and_without_patterns(each):
    text = "A  B   C\r\n1   2\n\r\nD  E\r\r\n 3  4 \u0000 5  "
    assert [t[1:] for t in each(tables_in(F.col("t"), "stream"), [text])[0]] == [(["A", "B", "C"], [["1", "2"]]), (["D", "E\r"], [["3", "4", "5"]])]


def test_text_tables_as_whole_tables_are_the_same_cells(spark):
    pages = spark.createDataFrame([("p", "A  B\n1  2  3\n\n| x | y |\n| 1 |  |"), ("q", None), ("p", "C  D\n4  5")], "page_id string, text string")
    assert found(cells_of(text_tables(pages, whole=True))) == found(text_tables(pages)) and text_tables(pages, whole=True).count() == 4
