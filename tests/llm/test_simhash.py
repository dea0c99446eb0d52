import random
import re

import pytest
import xxhash

from docfields.llm.simhash import digest, fingerprint, near_duplicates, one_of_each


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow(rows):
    fps = {i: slow_fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (f"{fps[i]:016x}", top(i)) for i in ids}


def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    out = [None, "", " \n", "One", "one two", "ONE two", "É one two three", "x" * 5000]
    for _ in range(25):
        base = rnd.choices(words, k=rnd.choice([5, 60, 400]))
        for _ in range(rnd.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy))
    return list(enumerate(out))


def test_against_brute_force(spark):
    rows = texts()
    found = digest(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == slow(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr("docfields.llm.simhash.BLOCK", 5)
    rows = texts()
    found = digest(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == slow(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as id")
    assert near_duplicates(docs).count() == len(rows)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == ({1, 2} if rows else set())


def test_similar_texts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("docfields.llm.simhash.MET", 8)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    rows = [None, "", "one", "One", "a b c d e f"]
    for _ in range(15):
        base = rnd.choices(words, k=rnd.choice([20, 80, 300]))
        for _ in range(rnd.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, len(base) // 60, len(base) // 25])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, fps = {i: shingles(t) for i, t in rows}, {i: fingerprint(t, 5) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            either = len(sets[a] | sets[b])
            if (fps[a] ^ fps[b]).bit_count() <= 3 or either and len(sets[a] & sets[b]) / either >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = one_of_each(docs.union(docs.where("doc_id in (1, 7)")), width=5, similarity=0.8)
    assert sorted(r[0] for r in kept.collect()) == sorted(set(root.values()))
    assert one_of_each(docs.limit(0), width=5, similarity=0.8).count() == 0


def test_pairs_among_siblings_of_one_template(spark, monkeypatch):
    monkeypatch.setattr("docfields.llm.simhash.MET", 8)
    template = [f"t{i}" for i in range(174)]
    own = [[f"o{i}x{k}" for k in range(34)] for i in range(240)]
    rows = [" ".join(template + o) for o in own]
    # Two texts share 12 or 13 shingles besides the template: 182 of 226 or more, siblings 170 of 238.
    rows += [" ".join(template + own[i][:13] + [f"p{i}x{k}" for k in range(21)]) for i in range(80)]
    rows = list(enumerate(rows))
    sets, fps = [], [fingerprint(t, 5) for _, t in rows]
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3 or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert len(set(root)) > 200
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=0.8)
    assert sorted(r[0] for r in kept.collect()) == sorted(set(root))


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_distinct_texts_under_null_and_repeated_ids(spark, similarity):
    words = [[f"w{i}x{k}" for k in range(200)] for i in range(8)]
    text = [" ".join(w) for w in words]
    near = [" ".join(w[:-10] + ["x"] * 10) for w in words]
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (7, text[3]), (7, text[4]), (7, text[4]),
            (3, text[5]), (8, near[5]), (8, text[6]), (None, near[6]), (None, text[7]), (None, near[7])]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=similarity)
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == len(set(found))
    if similarity is None:
        assert set(found) == set(rows)
    else:
        last = set(found) & {(None, text[7]), (None, near[7])}
        assert len(last) == 1
        assert set(found) == last | {*rows[:7], (3, text[5]), (8, text[6])}
