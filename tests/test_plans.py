"""The physical plans: what is shuffled, what stays in the JVM, what reaches the scan."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docfields.operators import extract as extract_module, tables as tables_module
from docfields.operators.extract import extract
from docfields.operators.rollup import rollup_both
from docfields.operators.tables import table_lookup, table_signatures
from docfields.plans.materialize import materialize
from docfields.plans.spread import ROWS, spread_rows
from docfields.sources.text_tables import text_tables

FIELDS = {"total": [r"total:\s*(\d+)"], "iva": [r"iva=(\w+)"]}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([("p", "total: 1", "x" * 10)], "page_id string, text string, other string").write.mode(
        "overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("options", [{}, {"flavors": ()}, {"n": 3}, {"n": 2, "trace": True, "serials": True}])
def test_extraction_is_one_stage_in_the_jvm(pages, options):
    text = plan(extract(pages, ["total", "iva", "none"], FIELDS, **options))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<page_id:string,text:string>" in text


@pytest.mark.parametrize("options", [{}, {"flavors": ()}, {"n": 3, "trace": True}])
def test_each_pattern_is_searched_once_whatever_is_filtered(pages, options):
    df = extract(pages, ["total", "iva"], FIELDS, **options).where("value is not null and value <> '' and key = 'iva'")
    # A pattern is named in its guard and its extraction; chains name all patterns once more.
    assert plan(df).count(r"total:\s*(\d+)") == (4 if options.get("n") else 2)


def test_rollup_shuffles_once_and_only_partial_aggregates(pages):
    text = plan(rollup_both(extract(pages, ["total", "iva"], FIELDS)))
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2 and "partial_sum" in text


def test_table_cells_need_no_shuffle(pages):
    assert "Exchange" not in plan(text_tables(pages))


def test_lookup_gathers_no_group(pages, spark):
    cells = text_tables(pages)
    text = plan(table_lookup(cells, ["total"]))
    for gathering in ("collect_", "Window", "SortAggregate", "CartesianProduct", "NestedLoop", "Python"):
        assert gathering not in text
    assert "partial_min" in text and "partial_sum" in text


def test_fallback_searches_the_text_once_and_reads_cells_twice(pages, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cells")
    text_tables(pages.withColumn("text", F.lit("A  Total\n1  2"))).write.parquet(path)
    written = []

    def noted(df):
        written.append(plan(df))
        return materialize(df)

    for module in (extract_module, tables_module):
        monkeypatch.setattr(module, "materialize", noted)
    found = extract(pages, ["total", "iva", "A"], FIELDS, cells=spark.read.parquet(path))
    every = [*written, plan(found)]
    assert [p.count("ReadSchema: struct<page_id:string,text:string>") for p in every] == [1, 0, 0]
    assert [p.count("FileScan parquet") for p in every] == [1, 2, 0]
    assert all("Cartesian" not in p and "NestedLoop" not in p and "Range" not in p for p in every)
    assert {(r["key"], r["value"]) for r in found.collect()} == {("total", "1"), ("a", "1")}


def test_lookup_of_pairs_is_the_lookup_of_all_less_the_others(spark):
    rows = [(f"p{i % 3}", "lattice", 0, i // 3, r, c, h, f"{h}{i * r % 4}") for i in range(9) for r in range(3)
            for c, h in enumerate(["total", "iva"])]
    cells = spark.createDataFrame(
        rows, "page_id string, flavor string, flavor_rank int, table_idx int, row_idx int, col_idx int, header string, cell string")
    pairs = spark.createDataFrame([("p0", 0), ("p0", 0), ("p1", 1), ("p9", 0), (None, 0), ("p2", None)], "page_id string, term_pos int")
    every = {tuple(r) for r in table_lookup(cells, ["Total", "iva"]).collect()}
    some = [tuple(r) for r in table_lookup(cells, ["Total", "iva"], pairs=pairs).collect()]
    assert len(some) == len(set(some)) > 0
    assert set(some) == {r for r in every if r[:2] in {("p0", 0), ("p1", 1)}}
    assert table_lookup(cells, ["Total"], pairs=pairs.limit(0)).count() == 0


def final(df):
    """The plan as it was run."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_lookup_works_out_candidates_and_duplicates_once(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.createDataFrame(
        [("p", "lattice", 0, t, r, 0, "total", f"{r % 2}") for t in range(2) for r in range(4)],
        "page_id string, flavor string, flavor_rank int, table_idx int, row_idx int, col_idx int, header string, cell string",
    ).write.parquet(path)
    found = table_lookup(spark.read.parquet(path), ["total"])
    assert final(found).count("FileScan") == 2 and sorted(r["value"] for r in found.collect()) == ["0", "1"]


def test_tables_in_text_are_read_once_a_layout(pages):
    text = plan(extract(pages, ["total", "iva"], FIELDS))
    assert text.count("\r?\n") == 2


def test_signatures_add_up_machine_numbers(spark):
    cells = spark.createDataFrame(
        [("p", "lattice", 0, 0, r, c, "Total", f" A{r}  {c}") for r in range(50) for c in range(3)],
        "page_id string, flavor string, flavor_rank int, table_idx int, row_idx int, col_idx int, header string, cell string")
    told = [f"{r}\u0001{c}\u0001total\u0001a{r} {c}" for r in range(50) for c in range(3)]
    total = sum(int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in told)
    assert total > 1 << 63
    assert table_signatures(cells).first()["signature"] == hashlib.md5(f"{total}\u0001{len(told)}".encode()).hexdigest()
    assert "decimal(20,0)" not in plan(table_signatures(cells))


def test_rows_that_become_pages_are_dealt_into_bounded_tasks(spark):
    dealt = spread_rows(spark.range(0, 4 * ROWS, 1, 2), 4 * ROWS)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spread_rows(spark.range(0, 20 * ROWS, 1, 2), 20 * ROWS)
    sizes = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= ROWS + 20 and sum(sizes) == 20 * ROWS
