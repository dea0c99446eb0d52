import json
import re

import pytest
from pyspark.sql import functions as F

from docfields.functions import regex
from docfields.functions.regex import CatalogError, field_regex, first_group
from docfields.sources.catalog import (
    catalog_frame, check_doc_type, default_catalog, explode_catalogs, extra_terms_column, load_catalog,
    normalize_catalog, select_terms, term_patterns, word_pattern, word_pattern_column,
)


def test_word_lists_mappings_and_other_shapes():
    catalog = normalize_catalog({"a": ["NIT", "No. x"], "b": {"Total": [r"t(\d)"]}, "c": 7})
    assert catalog == {"a": {"nit": [r"(?i)NIT[:\s-]*(\S+)"], "no. x": [r"(?i)No\.\ x[:\s-]*(\S+)"]},
                       "b": {"Total": [r"t(\d)"]}, "c": {}}


def test_bad_patterns_are_named():
    with pytest.raises(CatalogError, match=r"b\.total"):
        normalize_catalog({"b": {"total": ["(a)(b)"]}})


def test_terms():
    catalog = {"a": {"x": ["(1)"], "y": ["(2)"]}}
    assert select_terms(catalog, "a", " z ,, x,Total ") == ["x", "y", "z", "x", "Total"]
    assert select_terms(catalog, "none") == []
    check_doc_type(catalog, "a")
    with pytest.raises(ValueError):
        check_doc_type(catalog, "none")


def test_loading(spark, tmp_path):
    good, bad, odd = tmp_path / "good.json", tmp_path / "bad.json", tmp_path / "odd.json"
    good.write_text(json.dumps({"a": {"año": [r"año (\d+)"]}}, ensure_ascii=False), encoding="utf-8")
    bad.write_text("{")
    odd.write_text("[1]")
    catalog = load_catalog(spark, str(good))
    assert catalog == {"a": {"año": [r"año (\d+)"]}}
    assert load_catalog(spark, str(bad)) == load_catalog(spark, str(odd)) == {}
    assert load_catalog(spark, str(tmp_path / "missing.json")) == {}
    more = tmp_path / "more.json"
    more.write_text(json.dumps({"a": {"largo": [r"largo (\d+)"]}, "b": [], "b c" * 6_000_000: []}))
    assert more.stat().st_size > 16 << 20
    merged = load_catalog(spark, str(tmp_path / "*.json"))
    assert merged["a"] == {"año": [r"año (\d+)"], "largo": [r"largo (\d+)"]} and merged["b"] == {}
    assert [tuple(r) for r in catalog_frame(spark, catalog).collect()] == [("a", "año", 0, 0, r"año (\d+)")]


def test_default_catalogue():
    catalog = default_catalog()
    assert list(catalog) == ["comprobantes", "movimientos", "acuerdos", "envíos"]
    assert sum(map(len, catalog.values())) == 26
    found = {(t, f): [m for r in rs for m in re.findall(r, (
        "folio: A-12\nreceptor: juan perez\nno a pagar nada\na pagar: 1.120,50\nentre acme s.a. y otros\npeso 12,5 kg\ndesde el 1/2/2024"), re.I)]
        for t, fields in catalog.items() for f, rs in fields.items()}
    assert {k: v for k, v in found.items() if v} == {
        ("comprobantes", "folio"): ["A-12"], ("comprobantes", "receptor"): ["juan perez"], ("comprobantes", "a pagar"): ["1.120,50"],
        ("acuerdos", "partes"): ["acme s.a."], ("acuerdos", "desde"): ["1/2/2024"], ("envíos", "peso"): ["12,5"]}


def test_catalogues_as_data(spark):
    documents = [(1, json.dumps({"a": {"x": ["p1", "p2"], "y": ["p3"]}, "b": ["Wo.rd"], "c": 5})), (2, "{"), (3, None)]
    rows = explode_catalogs(spark.createDataFrame(documents, "id int, json string"))
    assert sorted(map(tuple, rows.collect())) == [
        (1, "a", "x", 0, 0, "p1"), (1, "a", "x", 0, 1, "p2"), (1, "a", "y", 1, 0, "p3"),
        (1, "b", "wo.rd", 0, 0, r"(?i)Wo\.rd[:\s-]*(\S+)")]


def test_catalogue_columns(each):
    assert each(extra_terms_column(F.col("t")), [" a ,, b,c d", None, " "]) == [["a", "b", "c d"], None, []]
    words = ["a+b", "año (x)", "no_1"]
    for word, pattern in zip(words, each(word_pattern_column(F.col("t")), words)):
        text = f"{word.upper()}: v1"
        assert re.findall(pattern, text) == re.findall(word_pattern(word), text) == ["v1"]


def test_terms_with_their_patterns(spark):
    catalog = spark.createDataFrame([("a", 0, "p"), ("a", 1, "q")], "field string, pattern_pos int, regex string")
    terms = spark.createDataFrame([("A",), ("b",)], "term string")
    rows = term_patterns(terms, catalog).select("term", "regex").collect()
    assert sorted(map(tuple, rows), key=str) == [("A", "p"), ("A", "q"), ("b", None)]


@pytest.mark.parametrize("pattern", [
    r"a{,3}b(\d)", r"(?a)x(\w)", r"x{y(\d)", r"(\U0001F600)", r"a{2}(b{1,}c{,})", r"x{}(y)", r"[{,3}](a)", r"[\b](x)", r"\v(x)",
    r"\N{DIGIT ONE}(x)", r"\0(x)", r"\101(x)", r"(?ai:x)(é)", r"(?u)(x)", r"[]a](x)", r"[^]a](x)", r"[(?:](x)", r"}(x)", r"(?P<n_1>x)(?P=n_1)",
    r"[a&b](x)", r"(?-i:x)(y)"])
def test_patterns_mean_what_they_mean_in_python(spark, each, pattern):
    texts = ["aaab7", "b7", "ab7", "xé", "xa", "xx", "x{y5", "x{y", "😀", "aabc", "aabbbccc", "x{}y", "{a", ",a", "3a", "\x08x", "\x0bx",
             "\nx", "1x", "\x00x", "Ax", "Xé", "xÉ", "x", "ac", "]x", "ax", "(x", ":x", "?x", "}x", "&x", "bx", "xy", "XY", "Xy"]
    found = [re.search(pattern, t, re.IGNORECASE | re.DOTALL) for t in texts]
    assert each(first_group(each.text, field_regex(pattern)), texts) == [m and m.group(1) for m in found]


def test_what_the_engine_refuses_is_refused_by_name(spark, monkeypatch):
    assert regex.engine_error(r"(?isUd)a{2}(b)") is None and "near index" in regex.engine_error("a(b")
    monkeypatch.setattr(regex, "engine_error", lambda java: "no good near index 7" if "zz" in java else None)
    with pytest.raises(CatalogError, match="t.f: .*zz.*no good near index 7"):
        normalize_catalog({"t": {"g": ["a"], "f": [r"(zz)"]}})
