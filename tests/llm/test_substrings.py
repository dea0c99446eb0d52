import hashlib
import random
from collections import Counter

import pytest

from docfields.llm import substrings
from docfields.llm.substrings import decoded, digest, front_coded, merged, remove_repeats, shared_prefix


def slow(rows, length):
    datas = [(t or "").encode() for _, t in rows]
    seen = Counter(d[s:s + length] for d in datas for s in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, datas):
        gone = [False] * len(d)
        for s in range(len(d) - length + 1):
            if seen[d[s:s + length]] > 1:
                gone[s:s + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def rows_of(seed, length):
    rnd = random.Random(seed)
    letters = "abcé "

    def noise(n):
        return "".join(rnd.choices(letters, k=n))

    passages = [noise(rnd.choice([length - 1, length, length + 1, 2 * length, 3 * length])) for _ in range(8)]
    out = [None, "", "x" * 5 * length, "x" * (length + 3), "ab" * 2 * length, noise(3) * length]
    for _ in range(60):
        text = "".join(p for _ in range(rnd.randrange(4)) for p in (noise(rnd.randrange(2 * length)), rnd.choice(passages)))
        out += [text] * rnd.choice([1, 1, 1, 2])
        if rnd.random() < 0.4 and text:
            k = rnd.randrange(len(text))
            out.append(text[:k] + "!" + text[k + 1:])
    return list(enumerate(out))


@pytest.mark.parametrize("large, merged_rows", [(20_000, 40_000), (3, 30), (0, 10)])
def test_against_brute_force(spark, monkeypatch, large, merged_rows):
    monkeypatch.setattr(substrings, "LARGE", large)
    monkeypatch.setattr(substrings, "MERGED", merged_rows)
    rows = rows_of(merged_rows, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = digest(remove_repeats(docs, length=20, reach=10))
    assert Counter(tuple(r) for r in found.collect()) == slow(rows, 20)


def test_whole_length(spark):
    rows = rows_of(1, 200)[:60] + [(None, "q" * 50 + "end" * 100), (None, "q" * 50 + "end" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as spans")
    assert Counter(tuple(r) for r in digest(remove_repeats(docs)).collect()) == slow(rows, 200)


def test_empty(spark):
    assert digest(remove_repeats(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_merge_yields_order_and_shared_prefixes():
    rnd = random.Random(2)
    runs = [sorted((bytes(rnd.choices(b"ab", k=rnd.randrange(9))), b"x") for _ in range(rnd.randrange(30))) for _ in range(7)]
    assert [(s, e) for _, s, e in decoded(front_coded(runs[0]))] == runs[0]
    out = list(merged([front_coded(r) for r in runs]))
    assert [s for _, s, _ in out] == sorted(s for r in runs for s, _ in r)
    assert [h for h, _, _ in out][1:] == [shared_prefix(a[1], b[1], 0) for a, b in zip(out, out[1:])]
