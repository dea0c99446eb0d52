import random

import pytest
from pyspark.sql import functions as F

from docfields.operators.extract import extract, missed_pairs, text_hits
from docfields.operators.tables import (
    dedupe_tables, lookup_in_row, page_tables, table_lookup, table_signatures, unique_tables,
)
from docfields.sources.pages import explode_pages, with_text_layer
from docfields.sources.text_tables import tables_in, text_tables
from tests import model

WORDS = ["Total", "total a", "Precio", "art1", "art2", "7", "8", "", "x total", "iva", "9,5", "a", "b"]
TERMS = ["total", "Precio", "iva", "TOTAL", "zz"]


def random_tables(rng):
    """Tables of two layouts: `[[(header, rows)], [(header, rows)]]`."""
    flavors = []
    for _ in range(2):
        tables = []
        for _ in range(rng.randint(0, 3)):
            width = rng.randint(1, 3)
            rows = [[rng.choice(WORDS) for _ in range(width)] for _ in range(rng.choice([0, 1, 3, 9, 10]))]
            tables.append(([rng.choice(WORDS) for _ in range(width)], rows))
            if rng.random() < 0.4:
                header, rows = tables[-1]
                tables.append((header, rows[:8] + [[rng.choice(WORDS) for _ in range(width)] for _ in rows[8:]]))
        flavors.append(tables)
    return flavors


def cells_of(spark, pages):
    rows = [
        (page, flavor, rank, t, r, c, header[c], cell)
        for page, flavors in pages.items()
        for rank, (flavor, tables) in enumerate(zip(("lattice", "stream"), flavors))
        for t, (header, table) in enumerate(tables)
        for r, row in enumerate(table) for c, cell in enumerate(row)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(
        rows, "page_id string, flavor string, flavor_rank int, table_idx int, row_idx int, col_idx int, "
              "header string, cell string").repartition(5)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_text_tables(each):
    text = "Intro\nA  B\n1   2\n3\n x  y  z \n\n| C | D |\n|5||\n| single |\nE|F"
    tables = each(tables_in(F.col("t"), "stream"), [text])[0]
    assert [t[1:] for t in tables] == [(["A", "B"], [["1", "2"]]), (["x", "y", "z"], [])]
    tables = each(tables_in(F.col("t"), "lattice"), [text])[0]
    assert [t[1:] for t in tables] == [(["C", "D"], [["5", ""]]), (["E", "F"], [])]
    assert each(F.size(tables_in(F.col("t"), "lattice")), ["", "no bars"]) == [0, 0]
    plain = each(tables_in(F.col("t"), "stream", header=False), ["A  B\n1  2  3"])[0]
    assert [t[1:] for t in plain] == [(["0", "1", "2"], [["A", "B"], ["1", "2", "3"]])]


def test_ragged_rows_are_filled_up(spark):
    pages = spark.createDataFrame([("p", "A  B\n1  2  3\n\nC  D  E\n4  5")], "page_id string, text string")
    cells = text_tables(pages, ["stream"]).select("table_idx", "row_idx", "col_idx", "header", "cell")
    assert found(cells) == [(0, 0, 0, "A", "1"), (0, 0, 1, "B", "2"), (0, 0, 2, None, "3"),
                            (1, 0, 0, "C", "4"), (1, 0, 1, "D", "5"), (1, 0, 2, "E", None)]


def test_tables_in_random_text_agree_with_plain_rules(each):
    rng = random.Random(5)
    parts = ["a", "b c", "|", " | ", "  ", "   ", "\n", "\n", "x", "| "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for flavor in ("lattice", "stream"):
        ours = each(tables_in(F.col("t"), flavor), texts)
        assert [[t[1:] for t in tables] for tables in ours] == [
            model.text_tables(t, flavor) for t in texts]


def test_tables_equal_in_the_first_rows_count_as_one(spark):
    rows = [[str(i), " A  b"] for i in range(9)]
    other = [[str(i), "a B "] for i in range(8)] + [["8", "else"]]
    cells = cells_of(spark, {"p": [[(["N", "V"], rows), (["n ", "v"], other)], []]})
    assert unique_tables(cells, sample_rows=8).select("table_idx").collect() == [(0,)]
    assert dedupe_tables(cells, sample_rows=8).count() == 18
    assert unique_tables(cells).count() == 2
    assert {r["value"] for r in table_lookup(cells, ["else"]).collect()} == {"else"}
    assert table_lookup(cells, ["else"], sample_rows=8).count() == 0
    kept = dedupe_tables(cells)
    assert found(dedupe_tables(kept)) == found(kept)
    assert table_signatures(cells, 8).select("signature").distinct().count() == 1


def test_lookup_rules(spark):
    def values(flavors, term):
        return [r["value"] for r in table_lookup(cells_of(spark, {"p": flavors}), [term]).collect()]

    both = (["x", "Total"], [["total here", "5"], ["", "6"], ["", "5"]])
    assert sorted(values([[both], []], "total")) == ["5", "6"]
    assert values([[(["Total"], [["", ]])], [(["a"], [["total 1"]])]], "total") == ["total 1"]
    assert values([[(["Total", "b"], [["", "TOTAL 2"], ["", "total 3"]])], []], "total") == ["TOTAL 2"]
    assert values([[(["a"], [["total l"]])], [(["Total"], [["9"]])]], "total") == ["total l"]
    assert values([[(["a"], [["b"]])], []], "total") == []
    assert values([[(["total", "total b"], [["", "4"]])], []], "total") == ["4"]


def test_random_lookups_agree_with_plain_rules(spark):
    rng = random.Random(17)
    pages = {f"p{i}": random_tables(rng) for i in range(150)}
    known = {page: {w for w in WORDS if rng.random() < 0.2} for page in pages}
    recorded = spark.createDataFrame(
        [(page, 0, term, w) for page, words in known.items() for w in words for term in TERMS],
        "page_id string, term_pos int, key string, value string")
    cells = cells_of(spark, pages)
    terms = {t.lower(): i for i, t in reversed(list(enumerate(TERMS)))}
    for seen, df in ((None, table_lookup(cells, TERMS)), (known, table_lookup(cells, TERMS, recorded))):
        expected = sorted(
            (page, pos, term, v) for page, flavors in pages.items() for term, pos in terms.items()
            for v in model.lookup(flavors, term, seen[page] if seen else ()))
        assert sorted(map(tuple, df.collect())) == expected and expected


def test_lookup_in_row_agrees_with_plain_rules(each):
    rng = random.Random(23)
    texts = []
    for _ in range(150):
        blocks = []
        for rank, tables in enumerate(random_tables(rng)):
            for header, rows in tables:
                sep, lead = (" | ", "| ") if rank == 0 else ("   ", "")
                blocks.append("\n".join(lead + sep.join(c or "-" for c in line) for line in [header, *rows]))
        rng.shuffle(blocks)
        texts.append("\n.\n".join(blocks))
    for term in ("total", "precio", "-"):
        for known in ([], ["7", "total a"]):
            values = F.array(*map(F.lit, known)).cast("array<string>")
            ours = each(lookup_in_row(page_tables(F.col("t")), F.lit(term), values), texts)
            expected = [model.lookup([model.text_tables(t, f) for f in ("lattice", "stream")], term, known)
                        for t in texts]
            assert [v or [] for v in ours] == expected and any(expected)


FIELDS = {"total": [r"total:\s*(\d*)"], "iva": [r"iva=(\w+)"]}


def random_pages(rng, count):
    parts = ["total: 5", "total:  ", "iva=x", "Precio 7", "precio", "\n", "  ", " | ", "| ", "9", "art", "TOTAL", "iva", "\n"]
    return [(f"p{i}", "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))) for i in range(count)]


def results(df):
    return sorted(((r["image"], r["key"], r["value"], r["path"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n, trace", [(0, False), (1, False), (3, False), (0, True), (2, True)])
def test_extraction_agrees_with_plain_rules(spark, n, trace):
    rng = random.Random(100 + n)
    pages = random_pages(rng, 120)
    df = spark.createDataFrame(pages, "page_id string, text string")
    ours = results(extract(df, TERMS, FIELDS, n=n, trace=trace))
    expected = model.extract(pages, TERMS, FIELDS, n, trace, flavors=("lattice", "stream"))
    assert ours == sorted(expected, key=repr)

    tables = {page: random_tables(rng) for page, _ in pages}
    ours = results(extract(df, TERMS, FIELDS, n=n, trace=trace, cells=cells_of(spark, tables)))
    expected = model.extract(pages, TERMS, FIELDS, n, trace, tables=tables)
    assert ours == sorted(expected, key=repr)


def test_extraction_without_tables_terms_or_text(spark):
    df = spark.createDataFrame([("p", "total: 5 serie 9"), ("q", "")], "page_id string, text string")
    hits = extract(df, ["total", "none"], FIELDS, flavors=(), serials=True)
    assert [tuple(r) for r in hits.collect()] == [("p", "9", "total", "5", None)]
    assert extract(df, [], FIELDS).count() == 0
    pairs = missed_pairs(text_hits(df, ["total", "none"], FIELDS))
    assert sorted(map(tuple, pairs.collect())) == [("p", 1, "none"), ("q", 0, "total"), ("q", 1, "none")]
    own = extract(df, ["total"], {**FIELDS, "serial": [r"total: (\d)"]}, serials=True)
    assert own.head()["serial"] == "5"
    with pytest.raises(ValueError):
        extract(df, ["total"], n=-1)


def test_aligned_tables(each):
    text = ("Concepto    Cant Precio\nart1 largo    12    1.5\nart2              20.0\nart3 de  x  5000  300.5\n"
            "prose between\nno  gap here\nxx yy  z\nccc  bbbbbbbbbbbbb\n\na  b\nc  d")
    want = [(0, ["Concepto", "Cant", "Precio"], [["art1 largo", "12", "1.5"], ["art2", "", "20.0"], ["art3 de  x", "5000", "300.5"]])]
    assert each(tables_in(each.text, "aligned"), [text, None, "", "one line"]) == [want, [], [], []]


def test_aligned_tables_in_random_text_agree_with_plain_rules(each):
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        widths = [rng.randint(1, 6) for _ in range(rng.randint(1, 4))]
        lines = []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.1:
                lines.append(rng.choice(["", "prose", "a b c d e f g h", " x"]))
            else:
                words = [rng.choice(["", "a", "b c", "ñ", "é\U0001f600", "12"])[:w] for w in widths]
                lines.append(" " * rng.choice([0, 0, 2]) * (kind < 0.2) + "".join(
                    (x.rjust(w) if kind < 0.5 else x.ljust(w)) + " " * rng.choice([1, 1, 2]) for x, w in zip(words, widths)))
        texts.append("\n".join(lines))
    got = each(tables_in(each.text, "aligned"), texts)
    want = [[(i, h, r) for i, (h, r) in enumerate(model.aligned_tables(t))] for t in texts]
    assert got == want and sum(map(len, want)) > 30


def test_layouts_are_skipped_without_a_text_layer(spark):
    table = "| Total | b |\n| 1 | 2 |\n\nTotal  b\n3  4"
    docs = spark.createDataFrame([("a", f"first\f{table}"), ("b", f" \n\f{table}"), ("c", table), ("d", None)], "stem string, text string")
    pages = explode_pages(with_text_layer(docs))
    assert sorted((r["page_id"], r["no_text"]) for r in pages.collect()) == [
        ("a_page_1.png", False), ("a_page_2.png", False), ("b_page_1.png", True), ("b_page_2.png", True), ("c_page_1.png", False)]
    want = [("a_page_2.png", "1"), ("b_page_2.png", "3"), ("c_page_1.png", "1")]
    in_row = extract(pages, ["TOTAL z", "b"], trace=True, skip_without_text=["lattice"]).where("key = 'b' and path is null")
    assert sorted((r["image"], r["value"]) for r in in_row.collect()) == [(p, {"1": "2", "3": "4"}[v]) for p, v in want]
    cells = text_tables(pages, skip_without_text=["lattice"])
    assert sorted((r["page_id"], r["value"]) for r in table_lookup(cells, ["total"]).collect()) == want
    assert sorted({(r["image"], r["value"]) for r in extract(pages, ["total"], {"total": ["zz"]}, skip_without_text=["lattice", "stream"], n=0).collect()}) == \
        sorted({(r["image"], r["value"]) for r in extract(pages, ["total"], {"total": ["zz"]}, flavors=()).collect()})
