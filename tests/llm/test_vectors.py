import math
import random

import pytest

from docfields.llm import neighbours, topk

VECTOR = "vec_id long, embedding array<float>, rank int, score int, part int, id int"


def vectors(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(60)]  # copies of a query
    rows += [(1000, None), (1001, [0.0] * 6), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6)]
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTOR)


def plain(df, need_length):
    out = {r["vec_id"]: r["embedding"] for r in df.collect()}
    return {i: v for i, v in out.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)
            and (not need_length or any(v))}


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    df = vectors(spark)
    rows = {i: [math.floor(64 * x) for x in v] for i, v in plain(df, False).items()}
    want = set()
    for q, w in rows.items():
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in rows.items() if i != q)[:20]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(found, 1)}
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 20).collect()]
    assert len(got) == len(want) and set(got) == want


def test_neighbours_with_all_parts_are_exact_and_recall_is_high(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    df = vectors(spark)
    rows = plain(df, True)
    want = {}
    for q in (i for i in rows if i % 20 == 0):
        found = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(rows[q], v))), i) for i, v in rows.items() if i != q)[:10]
        want |= {(q, k): (i, s) for k, (s, i) in enumerate(found, 1)}
    for mass, least in ((1.1, 1.0), (neighbours.MASS, 0.9)):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"])
               for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 10, mass=mass).collect()}
        assert got.keys() == want.keys()
        hits = sum((k[0], got[k][0]) in {(q, i) for (q, _), (i, _) in want.items()} for k in got)
        assert hits >= least * len(want)
        if mass > 1:
            assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-12) for k in want)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, None)], [(0, [1.0]), (0, [1.0])]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.top_k(df, df, 3).count() == 0
    assert neighbours.nearest(df, df, 3).count() == 0
