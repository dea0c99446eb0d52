"""Repeated passages: every byte of a string of `LENGTH` bytes that starts anywhere else as well is removed.

Every such string is anchored: among the first `REACH` places in it, at the one whose next eight bytes hash lowest.
Equal strings have their anchors at equal places, so only suffixes at anchors are sorted, one in fifty or so.
Anchors whose next bytes are nowhere else fall out by a count of hashes; anchors whose whole surroundings, all
their strings, are elsewhere too are settled by a second hash of 128 bits. What is left are the anchors near the
edges of repeated passages. Their suffixes are sorted by a distributed merge sort:

* a task sorts its suffixes into a run and cuts it at splitters; each piece is front-coded, every suffix without
  the prefix it shares with the one before;
* a task merges its pieces with a loser tree that knows, for each waiting suffix, the length of the prefix shared
  with the last winner, and compares bytes behind that prefix only;
* the lengths of shared prefixes that the merge yields, and those of the bytes to the left, tell for each place of the
  anchor in the string which strings are equal.

Bytes that many documents share are settled by counts in Spark; a class of suffixes too large for one task (an
anchor with more than `LARGE` different surroundings) has its strings counted one by one instead of being sorted.

Defined results: a null text is empty; a text shorter than the string has nothing removed; repeated rows repeat each
other, so long ones lose all; a null id is an id like any other; an empty table gives an empty one.
"""

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import by_batch, settled

LENGTH = 200
REACH = 100
LARGE = 20_000
# Suffixes merged in one task, and suffixes looked at to place each splitter.
MERGED = 40_000
LOOKED = 64


def anchors(data: bytes, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, and the first and last string start that each anchors."""
    n = len(data)
    if n < length:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    size = n - length + reach
    words = np.ndarray(size, "<u8", data, strides=(1,)) if size + 7 <= n else words_of(data, size)
    key = words * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    # The higher bits are the hash, the lower ones the place, so that the first of equal hashes wins.
    shift = np.uint64(max(1, (size - 1).bit_length()))
    key = key >> shift << shift | np.arange(size, dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if reach > span:
        key = np.minimum(key[:len(key) - (reach - span)], key[reach - span:])
    place = (key & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, np.append(first[1:], len(place)) - 1


def words_of(data: bytes, size: int) -> np.ndarray:
    return np.ndarray(size, "<u8", data + bytes(8), strides=(1,))


ANCHOR = "id_key long, text_key long, place int, low int, high int, head long, around long, around2 long"


def anchored(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """One row for each anchor of each text: hashes of its next bytes and of all strings it anchors."""
    tail = length - reach + 1

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [[] for _ in range(8)]
        keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        head, around = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
        low64 = (1 << 64) - 1
        for i, text in enumerate(batch.column(2).to_pylist()):
            data = (text or "").encode()
            place, low, high = anchors(data, length, reach)
            m = len(place)
            if m:
                view = memoryview(data)
                wide = [around(view[a:b + length], p - a) for p, a, b in zip(place.tolist(), low.tolist(), high.tolist())]
                for column, values in zip(rows, (
                        np.full(m, keys[0][i]), np.full(m, keys[1][i]), place, low, high,
                        np.fromiter((head(view[p:p + tail]) for p in place.tolist()), np.uint64, m).view(np.int64),
                        np.fromiter((w & low64 for w in wide), np.uint64, m).view(np.int64),
                        np.fromiter((w >> 64 for w in wide), np.uint64, m).view(np.int64))):
                    column.append(values)
        if rows[0]:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(r)).cast(k) for r, k in zip(rows, kinds)],
                names=[c.split()[0] for c in ANCHOR.split(", ")])

    return by_batch(texts, run, ANCHOR)


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, of which `at` bytes are known to agree."""
    n = min(len(a), len(b))
    while at < n:
        step = min(16, n - at)
        if a[at:at + step] == b[at:at + step]:
            at += step
        else:
            while a[at] == b[at]:
                at += 1
            return at
    return at


def front_coded(run: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run: for each entry the shared prefix with the one before, the rest, and what goes with it."""
    out, before = [], b""
    for suffix, extra in run:
        h = shared_prefix(before, suffix, 0)
        rest = suffix[h:]
        out += [h.to_bytes(2, "little"), len(rest).to_bytes(2, "little"), len(extra).to_bytes(2, "little"), rest, extra]
        before = suffix
    return b"".join(out)


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """`(shared prefix with the entry before, suffix, extra)` of a front-coded run."""
    at, before = 0, b""
    while at < len(blob):
        h, rest, more = (int.from_bytes(blob[at + k:at + k + 2], "little") for k in (0, 2, 4))
        at += 6
        before = before[:h] + blob[at:at + rest]
        yield h, before, blob[at + rest:at + rest + more]
        at += rest + more


def merged(blobs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """All entries of some runs in order, each with the length of the prefix it shares with the one before.

    A loser tree. Every waiting suffix knows the prefix it shares with the last winner that passed its node:
    of two, the one that shares more is smaller; only if both share the same are bytes compared, behind that prefix. A run's next
    entry knows its own from the front coding.
    """
    runs = [decoded(b) for b in blobs if b]
    if not runs:
        return
    size = 1 << (len(runs) - 1).bit_length()
    heads: list[tuple[int, bytes, bytes] | None] = [next(r) for r in runs] + [None] * (size - len(runs))
    lcp = [0] * size
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """`(winner, loser)` of two runs; the loser then knows the prefix it shares with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        h = shared_prefix(x, y, lcp[a])
        first = len(x) == h or (len(y) > h and x[h] < y[h])
        winner, loser = (a, b) if first else (b, a)
        lcp[loser] = h
        return winner, loser

    winners = list(range(size))
    level = size
    while level > 1:
        half = level // 2
        for k in range(half):
            winners[k], losers[half + k] = play(winners[2 * k], winners[2 * k + 1])
        level = half
    winner = winners[0]
    while heads[winner] is not None:
        yield lcp[winner], heads[winner][1], heads[winner][2]
        heads[winner] = next(runs[winner], None)
        if heads[winner] is not None:
            lcp[winner] = heads[winner][0]
        node = (size + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated(prefixes: np.ndarray, lefts: list[bytes], spans: np.ndarray, length: int) -> np.ndarray:
    """For sorted suffixes, which strings are found at another suffix too: row x place of the anchor in the string.

    `prefixes` are the shared prefixes with the suffix before, `lefts` the bytes before the anchors, nearest
    first, `spans` the first and last place of the anchor in the strings of each row.
    """
    n, top = len(lefts), int(spans[:, 1].max()) + 1
    order = sorted(range(n), key=lefts.__getitem__)
    shared = np.zeros(n, np.int64)
    for k in range(1, n):
        shared[k] = shared_prefix(lefts[order[k - 1]], lefts[order[k]], 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    out = np.zeros((n, top), bool)
    for o in range(top):
        rows = np.flatnonzero((spans[:, 0] <= o) & (o <= spans[:, 1]))
        if len(rows) < 2:
            continue
        right = np.cumsum(prefixes < length - o)[rows]
        left = np.cumsum(shared < o)[rank[rows]]
        key = right * np.int64(n + 1) + left
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(rows), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        out[rows[hit], o] = True
    return out


MEMBER = "id_key long, text_key long, place int, suffix binary, before binary, low int, high int, many boolean"


def surroundings(texts: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """Suffix and left bytes of each of the `members`, cut from the texts."""
    listed = members.groupBy("id_key", "text_key").agg(
        F.collect_list(F.struct("place", "low", "high", "many")).alias("held"))
    joined = texts.join(listed, ["id_key", "text_key"]).dropDuplicates(["id_key", "text_key"]).select(
        "id_key", "text_key", "text", "held")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for i, t, text, held in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode()
            for m in held:
                p, low, high = m["place"], m["low"], m["high"]
                rows.append((i, t, p, data[p:high + length], data[low:p][::-1], p - high, p - low, m["many"]))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=[c.split()[0] for c in MEMBER.split(", ")])

    return by_batch(joined, run, MEMBER)


def sorted_apart(cut: DataFrame, length: int, reach: int, rows: int) -> DataFrame:
    """`id_key, text_key, start, stop`: the strings that the merge sort finds at another anchor too."""
    head = length - reach + 1
    tasks = -(-rows // MERGED)
    looked = cut.select(F.substring("suffix", 1, head).alias("s")).where(
        F.pmod(F.xxhash64("s"), F.lit(max(1, rows // (LOOKED * tasks)))) == 0) if tasks > 1 else None
    # Splitters are as many as tasks; suffixes that agree as far as all anchors of a class do stay together.
    splitters: list[bytes] = []
    if looked is not None:
        every = looked.selectExpr("s", "ntile({}) over (order by s) as t".format(tasks)).groupBy("t").agg(F.min("s").alias("s"))
        splitters = sorted({bytes(r["s"]) for r in every.collect()})[1:]

    def runs(batches):
        held: list[list[tuple[bytes, bytes]]] = [[] for _ in range(len(splitters) + 1)]

        def emptied():
            number, blobs = [], []
            for k, run in enumerate(held):
                if run:
                    run.sort()
                    number.append(k)
                    blobs.append(front_coded(run))
                    run.clear()
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(blobs, pa.binary())],
                                              names=["piece", "run"])

        n = 0
        for batch in batches:
            for i, t, p, suffix, before, low, high, _ in zip(*(c.to_pylist() for c in batch.columns)):
                extra = np.array([i, t], "<i8").tobytes() + np.array([p, low, high], "<i4").tobytes() + before
                held[bisect_right(splitters, suffix[:head])].append((suffix, extra))
            n += batch.num_rows
            if n >= MERGED:
                yield emptied()
                n = 0
        yield emptied()

    def merge(table: pa.Table) -> pa.Table:
        entries = list(merged(table.column("run").to_pylist()))
        prefixes = np.array([e[0] for e in entries], np.int64)
        extras = [e[2] for e in entries]
        keys = np.array([np.frombuffer(e[:16], "<i8") for e in extras])
        places = np.array([np.frombuffer(e[16:28], "<i4") for e in extras], np.int64)
        hits = repeated(prefixes, [e[28:] for e in extras], places[:, 1:], length)
        # Runs of places become stretches of text.
        edges = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edges == 1)
        _, last = np.nonzero(edges == -1)
        anchor = places[row, 0]
        return pa.table({"id_key": keys[row, 0], "text_key": keys[row, 1],
                         "start": pa.array(anchor - last + 1, pa.int32()),
                         "stop": pa.array(anchor - first + length, pa.int32())})

    pieces = cut.mapInArrow(runs, "piece int, run binary")
    return pieces.groupBy("piece").applyInArrow(merge, "id_key long, text_key long, start int, stop int")


def counted(cut: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many surroundings: each string is a row, and equal ones are counted."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for i, t, p, suffix, before, low, high, _ in zip(*(c.to_pylist() for c in batch.columns)):
            around = before[::-1] + suffix
            for o in range(low, high + 1):
                s = len(before) - o
                rows.append((i, t, p - o, hashlib.blake2b(around[s:s + length], digest_size=16).digest()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["id_key", "text_key", "start", "string"])

    strings = by_batch(cut, run, "id_key long, text_key long, start int, string binary")
    twice = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    return strings.join(twice, "string").selectExpr("id_key", "text_key", "start", f"start + {length} as stop")


def repeats(texts: DataFrame, length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """`id_key, text_key, start, stop`: stretches of `texts(id_key, text_key, text)` to remove; they may overlap."""
    found = anchored(texts, length, reach)
    groups = found.groupBy("head", "around", "around2").agg(F.count(F.lit(1)).alias("n"))
    heads = groups.groupBy("head").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kinds"),
                                       F.sum((F.col("n") == 1).cast("long")).alias("single")).where("rows > 1")
    # Of surroundings that are found more than once, one anchor stands for all where others of the class are open.
    kinds = settled(groups.join(heads, "head").where((F.col("n") > 1) | (F.col("kinds") > 1)).select(
        "head", "around", "around2", "n", ((F.col("kinds") > 1) & (F.col("single") > 0)).alias("open"),
        (F.col("kinds") > LARGE).alias("many")))
    known = settled(found.join(kinds, ["head", "around", "around2"]))
    plain = known.where("n > 1").selectExpr("id_key", "text_key", "low as start", f"high + {length} as stop")
    one = F.struct("id_key", "text_key", "place", "low", "high", "many")
    stands = known.where("n > 1 and open").groupBy("head", "around", "around2").agg(F.min(one).alias("m")).select("m.*")
    members = settled(known.where("n = 1").select("id_key", "text_key", "place", "low", "high", "many").union(stands))
    sizes = {r["many"]: r["count"] for r in members.groupBy("many").count().collect()}
    cut = settled(surroundings(texts, members, length)) if sizes else None
    out = plain
    if sizes.get(False):
        out = out.union(sorted_apart(cut.where("not many"), length, reach, sizes[False]))
    if sizes.get(True):
        out = out.union(counted(cut.where("many"), length))
    return out


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, length: int = LENGTH,
                   reach: int = REACH) -> DataFrame:
    """`id, kept binary, n_bytes, removed array<struct<start, stop>>`: what is left, and the maximal runs that went."""
    texts = docs.select(
        F.xxhash64(id_column).alias("id_key"), F.xxhash64(text_column, F.lit(1)).alias("text_key"),
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # Runs of one text are joined where they touch; a text's own length bounds their number.
    spans = repeats(texts.select("id_key", "text_key", "text"), length, reach).groupBy("id_key", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept, sizes, gone = [], [], []
        for text, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data, runs = text.encode(), []
            for s in spans_ or ():
                if runs and s["start"] <= runs[-1]["stop"]:
                    runs[-1]["stop"] = max(runs[-1]["stop"], s["stop"])
                else:
                    runs.append(dict(s))
            cuts = [0, *(x for r in runs for x in (r["start"], r["stop"])), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            sizes.append(len(data))
            gone.append(runs)
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()),
                                          pa.array(gone, span)], names=[id_column, "kept", "n_bytes", "removed"])

    joined = texts.join(spans, ["id_key", "text_key"], "left").select("id", "text", "spans")
    return by_batch(joined, run, f"`{id_column}` {kind}, kept binary, n_bytes long, "
                                 "removed array<struct<start:int,stop:int>>")


def digest(removed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's columns, made from `remove_repeats`."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return removed.select(id_column, "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))
