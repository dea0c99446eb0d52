import hashlib
import math
import random
import re

import numpy as np
import pytest

from docfields.llm import pieces
from docfields.llm.pieces import MODEL, Lattices, decode_pieces, sample_pieces, segmentations, vocabulary

TEXTS = ["the cat", "a", " two  spaces ", "líne\nbreak\t", "▁mark ▁▁", "漢字 😀 ß", "x" * 300, "", None, "word " * 400]


def every(text, alpha=1.0):
    """All segmentations with their log weights, by plain recursion over one text without odd characters."""
    known, _, _ = vocabulary(MODEL)
    marked = "▁" + text.replace(" ", "▁")

    def ways(rest):
        if not rest:
            return [((), 0.0)]
        out = []
        for j in range(1, len(rest) + 1):
            if rest[:j] in known:
                i, w = known[rest[:j]]
                out += [((i, *ids), alpha * w + more) for ids, more in ways(rest[j:])]
        return out

    found = dict(ways(marked))
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: w - total for ids, w in found.items()}


def test_round_trip_distinct_and_ordered(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    encoded = sample_pieces(docs, samples=4)
    rows = decode_pieces(encoded).collect()
    by = {}
    for r in rows:
        assert r["text"] == (TEXTS[r["doc_id"]] or "")
        assert 0 < r["inclusion"] <= 1
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(range(len(TEXTS)))
    for own in by.values():
        own.sort(key=lambda r: r["sample"])
        assert len({tuple(r["ids"]) for r in own}) == len(own)
        assert [r["perturbed"] for r in own] == sorted((r["perturbed"] for r in own), reverse=True)
    again = sample_pieces(docs.repartition(5), samples=4).collect()
    assert {(r["doc_id"], r["sample"]): r["ids"] for r in again} == {(r["doc_id"], r["sample"]): r["ids"] for r in rows}


def test_units_are_those_of_a_pattern():
    draw = random.Random(3)
    texts = ["".join(draw.choices(" \n▁aé漢😀", k=draw.randrange(12))) for _ in range(2_000)] + [None, "", " ", *TEXTS]
    distinct, units, size = pieces.units_of(texts)
    truth = [re.findall(r"\n|▁| +[^ \n▁]*|[^ \n▁]+", " " + t) if t else [] for t in texts]
    assert [distinct[u] for u in units] == [u for own in truth for u in own] and size.tolist() == list(map(len, truth))
    assert len(set(distinct)) == len(distinct) and pieces.units_of([None])[2].tolist() == [0]


def test_all_segmentations_of_a_short_text():
    truth = every("at on")
    rounds, left = segmentations(["at on"], np.array([7]), len(truth) + 5, Lattices(MODEL, 1.0))
    assert len(rounds) == len(truth) and left[0] == -np.inf
    lattices = Lattices(MODEL, 1.0)
    rounds, _ = segmentations(["at on"], np.array([7]), len(truth), lattices)
    found = {tuple(lattices.piece[r.edge].tolist()): r.log_prob[0] for r in rounds}
    assert found.keys() == truth.keys()
    assert all(math.isclose(found[k], truth[k], abs_tol=1e-9) for k in truth)


def test_frequencies_are_those_of_draws_without_replacement():
    truth = every("to", alpha=0.3)
    n, lattices = 20_000, Lattices(MODEL, 0.3)
    rounds, left = segmentations(["to"] * n, np.arange(n) * 7919 + 1, 2, lattices)
    ids = [[tuple(lattices.piece[r.edge[r.ends[i]:r.ends[i + 1]]].tolist()) for i in range(n)] for r in rounds]
    p = {k: math.exp(v) for k, v in truth.items()}
    for k in p:
        first = ids[0].count(k) / n
        assert abs(first - p[k]) < 0.015
        second = sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k)
        assert abs(ids[1].count(k) / n - second) < 0.015
    # Weighting by inclusion gives unbiased sums: here the probability of all paths, 1.
    weights = sum(np.exp(r.log_prob) / -np.expm1(-np.exp(r.log_prob - left)) for r in rounds)
    assert abs(weights.mean() - 1) < 0.03


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CHARACTERS", 5)
    empty = spark.createDataFrame([], "doc_id long, text string, ids int, sample int")
    assert sample_pieces(empty).count() == 0
    rows = sample_pieces(spark.createDataFrame([(1, None), (1, None), (None, "ab c"), (None, "ab c")],
                                               "doc_id long, text string"), samples=3).collect()
    assert [(r["ids"], r["log_prob"], r["inclusion"]) for r in rows if r["doc_id"] == 1] == [([], 0.0, 1.0)] * 2
    assert len([r for r in rows if r["doc_id"] is None]) == 6


def test_decoding_of_odd_ids(spark):
    known, bytes_, _ = vocabulary(MODEL)
    some = known["▁the"][0]
    rows = [(0, None), (1, []), (2, [some, some]), (3, [-5, some, 10 ** 8, None, some]), (4, [bytes_[0xC3], bytes_[0xA9]]),
            (5, [bytes_[0xC3]])]
    found = decode_pieces(spark.createDataFrame(rows, "i int, ids array<int>").repartition(1)).collect()
    assert {r["i"]: r["text"] for r in found} == {0: None, 1: "", 2: "the the", 3: "the the", 4: "é", 5: "�"}
    assert decode_pieces(spark.createDataFrame([], "i int, ids array<int>")).count() == 0


def test_query_decodes_all_samples(spark, tmp_path):
    from docfields.llm.queries import QUERIES

    spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "the cat"])] + [(None, "no id")],
                          "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op6_sentencepiece"](spark, str(tmp_path)).collect()
    assert {r["decoded_sha256"] for r in rows} == {hashlib.sha256((t or "").encode()).hexdigest() for t in [*TEXTS, "no id"]}
    assert all(r["round_trip"] for r in rows) and len({r["doc_id"] for r in rows}) == len(TEXTS) + 2
