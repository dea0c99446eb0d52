"""Periodic runs, phrases and the n-gram join, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docfields.llm import jaccard, periodic, phrases
from docfields.llm.queries import ORACLE, QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SPACE = "\x20\x09-\x0d"
ODD = "key string, TEXT string, lang string, node long, runs long, seg long, text_ string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- periodic runs ----------------------------------------------------------------------------------

def slow_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            t = w[s:i + q]
            if len(t) >= max(6, 4 * q) and not any(t[p:] == t[:-p] for p in range(1, q)):
                out.append((s, len(t), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_digest(key, text):
    w = re.findall(f"[^{SPACE}]+", text or "")
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = slow_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in found), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{size},{q}\n" for s, size, q in found), " ".join(x for i, x in enumerate(w) if i not in gone))]
    told = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (key, len(found), *told, *sha)


def test_runs_of_random_words():
    rnd = random.Random(1)
    for _ in range(1500):
        n, a = rnd.randrange(70), rnd.choice([1, 2, 2, 3, 5])
        w = [rnd.randrange(a) for _ in range(n)]
        if n and rnd.random() < 0.6:
            s, p = rnd.randrange(n), rnd.randrange(1, max(2, n // 4 + 1))
            w = [w[i] if i < s else w[min(n - 1, s + (i - s) % p)] for i in range(n)] + [9] * rnd.randrange(9)
        assert [tuple(r) for r in periodic.runs(np.array(w, np.int64)).tolist()] == slow_runs(w)


def test_successors():
    rnd = np.random.default_rng(5)
    values = rnd.permutation(300)
    tree = periodic.WaveletTree(values, 9)
    left = rnd.integers(0, 300, 500)
    right = np.minimum(300, left + rnd.integers(0, 200, 500))
    asked = rnd.integers(0, 300, 500)
    for a, b, x, got in zip(left, right, asked, tree.successor(left, right, asked)):
        assert got == min((v for v in values[a:b] if v > x), default=-1)


def test_periodic_runs_of_the_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    assert got.keys() == texts.keys() and sum(r[1] > 0 for r in got.values()) > 3
    for key, text in texts.items():
        if len(text) < 6000:
            assert got[key] == slow_digest(key, text)


def test_periodic_edges(spark):
    long = " ".join(f"w{i % 1500}" for i in range(9000)) + " " + "x " * 40000
    rows = [("a", None), ("b", ""), ("c", " \t\n"), ("d", "a b " * 4), ("d", "a b " * 4), (None, "é é é é é é"), ("e", long), ("f", "a b c")]
    df = spark.createDataFrame([(k, t, None, 1, 2, 3, "z") for k, t in rows], ODD)
    got = sorted((tuple(r) for r in periodic.periodic_runs(df, "key", "TEXT").collect()), key=str)
    want = sorted([("a", [], ""), ("b", [], ""), ("c", [], ""), ("f", [], "a b c"), ("d", [(0, 8, 2)], "a b"), ("d", [(0, 8, 2)], "a b"),
                   (None, [(0, 6, 1)], "é"),
                   ("e", [(0, 9000, 1500), (9000, 40000, 1)], " ".join(f"w{i}" for i in range(1500)) + " x")], key=str)
    assert [(k, [tuple(r) for r in runs], text) for k, runs, text in got] == want
    assert periodic.digest(periodic.periodic_runs(df.where("false"), "key", "TEXT"), "key").count() == 0
    # A missing id counts as an empty text, whose checksum plants a period.
    assert periodic.cycled(None, [b"a", b"b", b"c", b"d", b"e", b"f"]) == [b"a", b"b", b"c"] * 2


# -- phrases ----------------------------------------------------------------------------------------

def slow_phrases(rows, least=30, limit=2000):
    pieces, n, out = defaultdict(list), Counter(), []
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            pieces[lang or "und"].append(w)
            n[lang or "und"] += len(w)
    for lang, each in pieces.items():
        f = Counter(tuple(w[i:i + k]) for w in each for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
        c = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for q, b in c.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i:i + k]] = max(inside[q[i:i + k]], b)
        best = []
        for p, a in c.items():
            if 100 * inside[p] < 80 * a:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("tile", [2, 1024])
def test_tiles(tile):
    rnd = np.random.default_rng(2)
    u, v = rnd.zipf(1.4, 5000) % 40, rnd.zipf(1.4, 5000) % 30
    got = {(a, b): c for a, b, c in zip(*(x.tolist() for x in phrases.counted(u, v, tile)))}
    assert got == Counter(zip(u.tolist(), v.tolist()))


def test_phrases_of_the_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")
    want = slow_phrases([tuple(r) for r in rows.collect()])
    assert len(want) > 200
    for options in ({}, {"segment": 20_000, "tile": 64}):
        assert sorted(tuple(r) for r in phrases.top_phrases(rows, **options).collect()) == want


@pytest.mark.parametrize("name", ["op12_collocations", "op13_jaccard_join"])
def test_sql(spark, name):
    ours, theirs, left, right, _ = difference(spark, connect(SF_DIR), QUERIES[name], ORACLE[name], SF_DIR)
    assert ours == theirs and not left and not right


def test_phrase_edges(spark):
    texts = [(None, "en"), ("", "en"), ("A b\tC d. a b\x0bc, É\xa0x é\xa0x", None), ("a b c d", "en")] * 20 + [
        ("a b c d " * 3000, "xx"), ("one", "yy"), ("p q " * 100 + "퟿ p", "zz")]
    rows = [("k", t, lang, 1, 2, 3, "z") for t, lang in texts]
    df = spark.createDataFrame(rows, ODD)
    for limit, least in ((2000, 20), (2, 5)):
        got = sorted(tuple(r) for r in phrases.top_phrases(df, "TEXT", least=least, limit=limit, segment=100).collect())
        assert got == slow_phrases(texts, least, limit) and got
    assert phrases.top_phrases(df.where("false"), "TEXT").count() == 0
    assert phrases.top_phrases(df.where("lang = 'yy'"), "TEXT").count() == 0


# -- n-gram join ------------------------------------------------------------------------------------

def slow_join(rows, width=5):
    sets = []
    for _, t in rows:
        w = re.findall(f"[^{SPACE}]+", lower(t))
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    having, root = defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, s in enumerate(sets):
        for b, n in Counter(b for g in s for b in having[g]).items():
            if 100 * n >= 80 * (len(s) + len(sets[b]) - n):
                root[find(a)] = find(b)
        for g in s:
            having[g].append(a)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(s), least.get(find(a))) for a, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def varied(seed, groups, vocabulary=400):
    rnd, rows = random.Random(seed), []
    for _ in range(groups):
        w = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.choice([0, 1, 3, 4, 5, 7, 8, 9, 10, 12, 15, 20, 30, 40, 60, 100, 130]))]
        for _ in range(rnd.randrange(1, 6)):
            v = list(w)
            for _ in range(rnd.randrange(4) if v else 0):
                j, kind = rnd.randrange(len(v)), rnd.random()
                if kind < 0.4:
                    v[j] = f"w{rnd.randrange(vocabulary)}"
                elif kind < 0.7 and len(v) > 1:
                    del v[j]
                else:
                    v.append(f"w{rnd.randrange(vocabulary)}")
            rows.append((len(rows), " ".join(v)))
    return rows


@pytest.mark.parametrize("met, block", [(1024, 2048), (3, 2)])
def test_join_of_random_texts(spark, monkeypatch, met, block):
    """Also with so small pieces and blocks that most groups are cut."""
    monkeypatch.setattr(jaccard, "MET", met)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = varied(met, 300)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = slow_join(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and sum(a != c for a, _, c in want) > 100


def test_join_of_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_jaccard_join"](spark, SF_DIR).collect()), key=str) == slow_join(rows)


def test_sketches_bound_differences():
    rnd, bands = np.random.default_rng(3), jaccard.Bands(80)
    for size in (4, 7, 13, 25, 60, 127, 128, 300, 1000):
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.9], rnd.integers(0, 1 << 63, max(1, size // 15), np.uint64)]))
            apart = len(np.setxor1d(a, b))
            for band in set(bands.of(len(a))) & set(bands.of(len(b))):
                x, y = (np.frombuffer(jaccard.dense(s, band, bands), np.uint8) for s in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= apart
                if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                    shared = np.intersect1d(*(jaccard.part_keys(s, band, bands) for s in (a, b)))
                    assert len(shared) >= bands.shared_parts(band)


def test_join_edges(spark):
    base = " ".join(f"w{i}" for i in range(300))
    long = " ".join(f"v{i % 7001}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a b c"), (9, "A  B\tc"), (None, base), (3, base.upper()), (3, base + " end"), (None, "x y"), (None, "x Y"),
            (1, long), (2, long + " end"), (4, base.replace("w150 ", "q ")), (12, "a b c d e f g h i"), (11, "a b c d e f g h")]
    df = spark.createDataFrame([(None if k is None else str(k), t, "en", 1, 2, 3, "z") for k, t in rows], ODD)
    got = sorted((tuple(r) for r in jaccard.jaccard_join(df, "key", "TEXT").collect()), key=str)
    assert got == slow_join([(None if k is None else str(k), t) for k, t in rows])
    assert jaccard.jaccard_join(df.where("false"), "key", "TEXT").count() == 0
