import random

import pytest
from pyspark.sql import functions as F

from docfields.fixed import SERIAL_CUES
from docfields.functions import chain as ch
from docfields.functions.casing import fold, fold_str
from docfields.functions.numbers import normalize_number
from docfields.functions.regex import CatalogError, escape, to_java
from docfields.functions.search import (
    date_near, field_all, field_first, literal_find, search_all, search_term, snippet_after, value_cascade,
)
from docfields.functions.serials import serial_all, serial_first
from docfields.functions.text import clean_text, normalize_cell, normalize_key, normalize_text
from tests import model

TOTAL = [r"(?i)total(?: a pagar)?:? *(\d[\d.,]*)"]
T = lambda: F.col("t")


def test_first_pattern_match_is_not_word_bounded_unless_asked(each):
    text = ["subtotal: 100 total: 120"]
    assert each(field_first(T(), TOTAL), text) == ["100"]
    assert each(field_first(T(), TOTAL, word_boundary=True), text) == ["120"]
    assert each(field_all(T(), TOTAL), text) == [["100", "120"]]


def test_patterns_are_tried_in_order(each):
    assert each(field_first(T(), [r"b(\d)", r"a(\d)"]), ["a1 b2", "a1", "c"]) == ["2", "1", None]
    assert each(field_all(T(), [r"b(\d)", r"a(\d)"]), ["a1 b2 a3", "c"]) == [["2", "1", "3"], None]


def test_value_classes_with_white_space_run_over_lines(each):
    assert each(field_first(T(), [r"cliente: ([a-z\s]+)"]), ["cliente: juan perez\nnit: 1"]) == [
        "juan perez\nnit"]


def test_python_semantics_of_patterns(each):
    assert each(field_first(T(), [r"a\s(\w+)"]), ["A\u00a0ñandú!"]) == ["ñandú"]
    assert each(field_first(T(), [r"x.y"]), ["X\nY"]) == ["X\nY"]
    assert each(field_first(T(), [r"(?P<v>\d+)\Z"]), ["a 12"]) == ["12"]
    assert each(field_first(T(), [r"([[&&]+)"]), ["a [&[ b"]) == ["[&["]
    assert each(field_first(T(), [r"([]x^-]+)"]), ["a ]^x- b"]) == ["]^x-"]
    assert each(field_first(T(), [r"(\d+)$"]), ["12\r", "12\n"]) == [None, "12"]


@pytest.mark.parametrize("bad", [r"(a)(b)", r"(a", r"(a)?(?(1)b|c)"])
def test_unusable_patterns_are_refused(bad):
    with pytest.raises(CatalogError):
        to_java(bad)


def test_literal_search(each):
    assert each(search_term(T(), "ref"), ["ref = 12345", "ref abc 7", "x REF", "none", "ref: año", "ref: -5"]) == [
        ("ref", "123"), ("ref", "7"), ("REF", None), (None, None), ("ref", "a"), ("ref", "5")]
    assert each(search_term(T(), "ref", full_numbers=True), ["ref = 12345", "ref 1,234.5"]) == [
        ("ref", "12345"), ("ref", "1,234.5")]
    assert each(snippet_after(T(), "a.b"), ["x A.B :=- \n\u00a0 tail", "aXb"]) == ["tail", None]
    assert each(F.length(snippet_after(T(), "a")), ["a " + "é" * 300]) == [100]
    assert each(value_cascade(T()), ["ab 1.234,56 x", "ñab cd", "ñab", "¿?", "x -12"]) == [
        "1.234,56", "cd", "ab", None, "-12"]


def test_pattern_that_matches_nothing_counts_as_found(each):
    hit = search_term(T(), "nota", {"nota": [r"nota:([ ]*)"]})
    assert each(hit, ["nota:  7", "nota 7"]) == [("nota", ""), ("nota", "7")]


def test_upper_case_fields_are_never_reached(each):
    assert each(search_term(T(), "Nota", {"Nota": [r"nota: (x)"]}), ["nota: x 5"]) == [("nota", "5")]


def test_search_all(each):
    hits = search_all(T(), "total", {"total": TOTAL})
    assert each(hits, ["total 1 total 2", "total x", "none"]) == [
        [("total", "1"), ("total", "2")], [("total", "x")], []]


def test_dates(each):
    texts = ["fecha: 12/10/2024", "FECHA=2024-10-12", "fecha 1-2-24", "fecha: hoy"]
    expected = ["12/10/2024", "2024-10-12", "1-2-24", None]
    assert each(date_near(T(), "fecha"), texts) == expected
    assert each(date_near(T(), F.lit("fecha")), texts) == expected


def test_serial_numbers(each):
    assert each(serial_first(T()), ["identificación: 44", "factura 9 serie 7", "nada"]) == ["entificaci", "7", None]
    assert each(serial_first(T(), word_boundary=True), ["identificación: 44", "id: 44"]) == [None, "44"]
    assert each(serial_all(T()), ["factura 9 serie 7 serie 8", "nada"]) == [["7", "8", "9"], None]
    own = [r"caja (\w+)"]
    assert each(serial_first(T(), own), ["serie 7 caja x", "serie 7"]) == ["x", "7"]
    assert each(serial_all(T(), own), ["serie 7 caja x caja y", "serie 7"]) == [["x", "y"], ["7"]]


def test_chains(each):
    text = ["ref: 12 34 56"]
    values = [each(ch.chain_value(ch.chain(T(), "ref", n), "ref", n), text)[0][1] for n in range(5)]
    assert values == ["12", "12", "34", "56", "56"]
    traced = ch.chain(T(), "ref", 3)
    assert each(ch.chain_trace(traced), text) == [("34", "56")]
    assert each(ch.chain_path(traced), text) == ["ref:12 -> 12:34 -> 34:56"]
    fields = {"a": [r"a: (\w+)"], "b": [r"b: (\w+)"]}
    assert each(ch.chain_value(ch.chain(T(), "a", 2, fields), "a", 2), ["a: b b: c"]) == [("a", "c")]
    assert each(ch.chain_value(ch.chain(T(), "a", 2), "a", 2), ["a: b b: c", "x"]) == [("a", "b"), (None, None)]
    assert each(ch.chain(T(), "ref", 0), ["REF 1", "x"]) == [[("REF", "1")], []]
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            ch.chain(T(), "ref", bad)


def test_numbers(each):
    cases = {
        "1,234.50": (1234.5, None), "12,5": (12.5, None), "1.234,56": (1.23456, None),
        "1,234,567": (None, "1.234.567"), "juan perez": (None, "juanperez"), "5d": (None, "5d"),
        "nan": (None, "nan"), "inf": (None, "inf"), "1_000": (None, "1_000"), " 7 ": (7.0, None), "": (None, ""),
        "\t8\n": (8.0, None), "-.5e3": (-500.0, None),
    }
    assert each(normalize_number(T()), list(cases)) == list(cases.values())
    assert each(normalize_number(T(), locale="es"), ["1.234,56", "1.234"]) == [(1234.56, None), (1.234, None)]
    assert each(normalize_number(F.lit(None).cast("string")), ["x"]) == [(None, None)]


def test_text_clean_up(each):
    assert each(clean_text(T()), ["\u00a0\x1c Ab\tC \u2003\n", None]) == ["ab\tc", ""]
    assert each(normalize_text(T()), ["  A\u00a0 \n B  c "]) == ["a b c"]
    assert each(normalize_key(T()), ["\tKeY "]) == ["key"]
    assert each(normalize_cell(T()), [" A \u2003 b\n", None]) == ["a b", ""]


def test_folding_keeps_length_and_equates_letters(each):
    texts = ["İSTANBUL ıſΣς", "ΣΑΣ", "Kelvin K", "straße"]
    folded = each(fold(T()), texts)
    assert folded == [fold_str(t) for t in texts] and [len(f) for f in folded] == [len(t) for t in texts]
    assert each(literal_find(T(), "sas"), ["xſAſx"]) == ["ſAſ"]
    assert each(literal_find(T(), "ΣΑΣ"), ["x σας y"]) == ["σας"]


def test_escape(each):
    assert each(escape(T()), ["a+b.c", r"\E[x]"]) == [r"a\+b\.c", r"\\E\[x\]"]
    assert escape("a+b.c") == r"a\+b\.c"


def _random_texts(rng, count):
    words = ["ref", "Ref:", "total", "12", "1,234.5", "id", "serie", "FACTURA", "-", "=", "x9", "año", "ñ", "\n",
             "\u00a0", "a", "b", "código: 7/8", "pedido#4", "34", "orden", "?", "#", "  ", "ſerie", "İd", "número de serie"]
    return ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14)))
            for _ in range(count)]


def test_random_texts_agree_with_plain_rules(each):
    texts = _random_texts(random.Random(7), 400)
    fields = {"a": [r"a\s+(\w+)"], "12": [r"12[\s:]*([a-z]*)"], "ref": [r"ref:\s*(\d+)", r"id\s(\S*)"]}
    for term in ("ref", "a", "TOTAL", "serie", "ñ"):
        assert each(search_term(T(), term, fields), texts) == [model.search(t, term, fields) for t in texts]
        for n in (1, 2, 4):
            assert each(ch.chain(T(), term, n, fields), texts) == [model.chain(t, term, n, fields) for t in texts]
    found = [model.serials(t, SERIAL_CUES) for t in texts]
    assert each(serial_first(T()), texts) == [next((m[0] for m in f if m), None) for f in found]
    assert each(serial_all(T()), texts) == [sum(f, []) or None for f in found]


def test_random_numbers_agree_with_plain_rules(each):
    rng = random.Random(3)
    values = ["".join(rng.choice("0123456789.,- e+x") for _ in range(rng.randint(0, 8))) for _ in range(600)]
    assert each(normalize_number(T()), values) == [model.number(v) for v in values]


def test_longer_chains_start_with_shorter_ones(each):
    texts = _random_texts(random.Random(11), 100)
    chains = [each(ch.chain(T(), "ref", n), texts) for n in (1, 2, 3, 4)]
    for shorter, longer in zip(chains, chains[1:]):
        assert all(b[:len(a)] == a for a, b in zip(shorter, longer))
