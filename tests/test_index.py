"""Long term lists as rows against the same terms as a list."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docfields.operators.extract import extract, extract_long, text_hits
from docfields.operators.index import contains_pairs, long_text_hits, pages_with_terms
from docfields.operators.tables import cell_hits, header_hits, table_lookup
from docfields.plans.batch import run
from docfields.sources.text_tables import text_tables

WORDS = ["total", "subtotal", "Factura", "nº", "é", "ESTADO", "estado:", "12,5", "a", "ſerie", "total:", "x-1", "İd", "ab", "de la", "\tde"]


def texts(seed, n):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(25))).replace(" ", rnd.choice([" ", "\n", "  "]), 3) for _ in range(n)]


def listed(spark, terms):
    return spark.createDataFrame(list(enumerate(terms)), "term_pos int, term string")


TERMS = ["total", "TOTAL", "sub", "estado: 12", "de la", "de\nla", "é", "a", "b", "ab x", "nothing", "x-1 total", "serie", "id", "n", "12,5", "al", "o", "Factura nº"]


def test_contains_pairs(spark):
    rnd = random.Random(2)
    strings = sorted({"".join(rnd.choice("abcñ ") for _ in range(rnd.randrange(12))) for _ in range(200)}) + [None]
    needles = sorted({"".join(rnd.choice("abcñ ") for _ in range(rnd.randrange(6))) for _ in range(120)})
    got = contains_pairs(spark.createDataFrame([(s,) for s in strings], "s string"), spark.createDataFrame([(x,) for x in needles], "needle string"))
    assert sorted(map(tuple, got.collect())) == sorted((s, x) for s in strings if s for x in needles if x and x in s)


def test_text_hits_are_those_of_the_unrolled_search(spark):
    pages = spark.createDataFrame([*((f"p{i}", t) for i, t in enumerate(texts(1, 120))), ("none", None), ("empty", "")], "page_id string, text string")
    for options in ({}, {"full_numbers": True, "serials": True}):
        ours = long_text_hits(pages, listed(spark, TERMS), **options)
        theirs = text_hits(pages, TERMS, **options)
        names = ["page_id", "serial", "term_pos", "term", "key", "value"]
        # The unrolled form shows a hit without a value like a miss.
        found = sorted(tuple(r) for r in ours.where("value is not null and value <> '' and key <> ''").select(names).collect())
        assert found == sorted(tuple(r) for r in theirs.where("value is not null").select(names).collect()) and len(found) > 200


def test_blank_terms_are_not_looked_for(spark):
    pages = spark.createDataFrame([("p", "a b")], "page_id string, text string")
    assert long_text_hits(pages, listed(spark, ["", " ", None])).count() == 0


@pytest.fixture(scope="module")
def cells(spark):
    rnd = random.Random(4)
    rows = [(f"p{rnd.randrange(12)}", *rnd.choice([("lattice", 0), ("stream", 1)]), rnd.randrange(3), r, c, rnd.choice([*WORDS, None, ""]), rnd.choice([*WORDS, None, ""]))
            for _ in range(60) for r in range(3) for c in range(2)]
    return spark.createDataFrame(rows, "page_id string, flavor string, flavor_rank int, table_idx int, row_idx int, col_idx int, header string, cell string")


def test_table_lookup_by_rows(spark, cells):
    terms = [t.strip() for t in TERMS]
    for search in (header_hits, cell_hits, table_lookup):
        names = search(cells, terms).columns
        ours, theirs = (sorted(map(str, search(cells, t).select(names).collect())) for t in (listed(spark, terms), terms))
        assert ours == theirs and len(ours) > 20


@pytest.mark.parametrize("n", [0, 1])
def test_extraction_with_tables(spark, cells, n):
    pages = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts(6, 12))], "page_id string, text string")
    ours = extract_long(pages, listed(spark, TERMS), {"factura": ["x"]}, n=n, serials=True, cells=cells)
    theirs = extract(pages, [t if t != "Factura" else "-" for t in TERMS], n=n, serials=True, cells=cells)
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    with pytest.raises(ValueError):
        extract_long(pages, listed(spark, TERMS), n=2)


def test_ten_thousand_terms_plan_at_once(spark, cells):
    terms = spark.range(10_000).select(F.col("id").cast("int").alias("term_pos"), F.concat(F.lit("term "), F.col("id").cast("string")).alias("term"))
    pages = spark.createDataFrame([("p0", "a term 77 b"), ("p1", "term 9999: 5")], "page_id string, text string")
    start = time.time()
    df = extract_long(pages, terms, cells=cells)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert time.time() - start < 10
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = sorted((r["image"], r["key"], r["value"]) for r in df.collect())
    # `term 999: 5` isn't there, `term 9`, `term 99` and `term 999` are, each followed by what is left of the number.
    assert got == [("p0", "term 7", "7"), ("p0", "term 77", "b"), ("p1", "term 9", "999"), ("p1", "term 99", "99"), ("p1", "term 999", "9"), ("p1", "term 9999", "5")]


def test_run_with_a_term_list(spark, tmp_path):
    pages = spark.createDataFrame([("a", "total: 5 moneda eur"), ("b", "Codigo  Precio\nx9  7.5")], "page_id string, text string")
    assert run(spark, pages, "t", str(tmp_path), {"t": {"total": [r"total: (\d+)"]}}, term_list=listed(spark, ["moneda", "precio", "Total"]))
    got = sorted((r["image"], r["key"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/results").collect())
    want = run(spark, pages, "t", str(tmp_path / "list"), {"t": {"total": [r"total: (\d+)"]}}, extra_terms="moneda, precio")
    assert want and got == sorted((r["image"], r["key"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/list/results").collect())
    with pytest.raises(ValueError):
        run(spark, pages, "t", str(tmp_path), {"t": {}}, term_list=listed(spark, ["x"]), trace=True)


def test_pages_get_terms_whose_words_end_where_the_term_has_white_space(spark):
    pages = spark.createDataFrame(
        [("in", "xa total"), ("out", "atotal total's a"), ("tab", "b\ttotals"), ("joint", "a subtotal z")], "page_id string, text string")
    got = pages_with_terms(pages, listed(spark, ["total a", "a total", "\ttotal", "total"]))
    met = {r["page_id"]: sorted(t["term"] for t in r["terms"]) for r in got.collect()}
    assert met == {
        "in": ["\ttotal", "a total", "total", "total a"], "out": ["\ttotal", "a total", "total", "total a"],
        "tab": ["\ttotal", "a total", "total"], "joint": ["total", "total a"]}
