"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most `distance` bits agree, in at least one group of bits, up to that group's
own threshold, whenever the thresholds plus one add up to `distance` + 1. Bits that go together share a group;
the thresholds are chosen by dynamic programming on estimated candidate counts and signature costs. Each
fingerprint is filed under its own bits of a group and probes the values within the group's threshold; what
meets is verified on all 64 bits. The links found join documents into components.

Copies are one fingerprint each from the start. A bucket yields links from its members to one of each local
component, never all pairs; a large bucket is compared in pairs of blocks.

Defined results: a null text counts as an empty one; texts without words have fingerprint zero and link like
any other; a null id has a row but names no component unless all its ids are null; repeated rows keep their
rows; an empty table gives an empty one.
"""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import by_batch, fresh, written
from docfields.llm.components import components

BITS = 64
SEED = 42
WIDTH = 3
DISTANCE = 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Fingerprints that estimates are made from, and members of a bucket that are compared in one piece.
ESTIMATE_ROWS = 2048
BLOCK = 4096
# What a signature costs, measured in candidate pairs.
SIGNATURE_COST = 4.0
# Bands of least hashes that candidates of a given similarity agree in, and texts of a bucket that are compared in one piece.
BANDS, ROWS = 20, 5
ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)
MET = 1024


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every shingle of the whole text, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    seeded = xxhash.xxh64_intdigest
    return np.fromiter((seeded(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    return folded(shingle_hashes(text, width))


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of a text with these shingles."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start:start + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str, text_column: str, width: int = WIDTH) -> DataFrame:
    """`id, fp`: the fingerprint of every whole text, as a signed 64-bit number."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
        fps = np.array(values, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return by_batch(docs.select(id_column, text_column), run, f"id {kind}, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlation(nodes: DataFrame) -> np.ndarray:
    """Correlations of the 64 bits over all fingerprints; each task adds up its own 64 x 64 counts."""
    def run(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            b = bits_of(batch.column(0).to_numpy()).astype(np.float32)
            both += np.rint(b.T @ b).astype(np.int64)
            n += len(b)
        i, j = np.divmod(np.arange(BITS * BITS + 1), BITS)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "n": np.append(both.ravel(), n)})

    counts = np.zeros(BITS * BITS + 1)
    summed = nodes.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for row in summed.collect():
        counts[row["i"] * BITS + row["j"]] = row["n"]
    n = max(counts[-1], 1)
    both = counts[:-1].reshape(BITS, BITS) / n
    p = both.diagonal()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return (both - np.outer(p, p)) / np.outer(spread, spread)


def grouped(correlations: np.ndarray, groups: int) -> list[list[int]]:
    """The bits in groups of near-equal size, each grown by the free bit that goes best with it."""
    strength = np.abs(correlations) - 2 * np.eye(BITS)
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = BITS // groups + (g < BITS % groups)
        rest = sorted(free)
        first = max(rest, key=lambda b: strength[b, rest].max())
        chosen = [first]
        free.remove(first)
        while len(chosen) < size:
            best = max(sorted(free), key=lambda b: strength[b, chosen].mean())
            chosen.append(best)
            free.remove(best)
        out.append(sorted(chosen))
    return out


def masked(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    mask = np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0]
    return fps & mask


def planned(sample: np.ndarray, rows: int, correlations: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """`(bits, threshold)` of the groups that are probed, at the least estimated cost over all splits."""
    best, plan = float("inf"), []
    for m in range(1, distance + 2):
        groups = grouped(correlations, m)
        cost = [[estimate(masked(sample, bits), len(bits), t, rows) for t in range(distance + 1)] for bits in groups]
        # least[j]: the least cost of the groups so far with thresholds plus one adding up to j.
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for own in cost:
            grown: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (spent, chosen) in least.items():
                for t in range(-1, distance + 1 - used):
                    entry = (spent + (own[t] if t >= 0 else 0.0), (*chosen, t))
                    if used + t + 1 not in grown or entry < grown[used + t + 1]:
                        grown[used + t + 1] = entry
            least = grown
        total, chosen = least[distance + 1]
        if total < best:
            best, plan = total, [(bits, t) for bits, t in zip(groups, chosen) if t >= 0]
    return plan


def estimate(values: np.ndarray, width: int, threshold: int, rows: int) -> float:
    """Candidate pairs of one group at a threshold, seen in a sample but at least those of random bits, and signatures."""
    ball = sum(comb(width, i) for i in range(threshold + 1))
    near, n = 0, len(values)
    for start in range(0, n, 256):
        near += int((np.bitwise_count(values[start:start + 256, None] ^ values) <= threshold).sum())
    share = max((near - n) / max(n * (n - 1), 1), ball / 2.0 ** width)
    return rows * (rows - 1) / 2 * share + SIGNATURE_COST * rows * ball


def signatures(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """`part, key, fp, own`: the value each fingerprint is filed under, and those it probes."""
    flips = []
    for bits, threshold in plan:
        masks = [sum(1 << b for b in c) for t in range(threshold + 1) for c in combinations(bits, t)]
        flips.append(np.array(masks, np.uint64).view(np.int64))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = batch.column(0).to_numpy()
        for part, (bits, _) in enumerate(plan):
            keys = (masked(fps, bits)[:, None] ^ flips[part]).ravel()
            own = np.zeros((len(fps), len(flips[part])), bool)
            own[:, 0] = True
            yield pa.RecordBatch.from_pydict({
                "part": np.full(len(keys), part, np.int8), "key": keys,
                "fp": np.repeat(fps, len(flips[part])), "own": own.ravel()})

    return by_batch(nodes.select("fp"), run, "part byte, key long, fp long, own boolean", rows=4096)


def linked(starts: np.ndarray, fps: np.ndarray, own: np.ndarray, side: np.ndarray, distance: int) -> np.ndarray:
    """For each row the row that stands for its local component, within runs of rows that begin at `starts`.

    Rows i and i + d of one run are compared for d = 1, 2, …; only runs longer than d are left each time.
    Sides 0 and 1 meet each other only; rows of side 2 meet all.
    """
    n = len(fps)
    run = np.zeros(n, np.int64)
    run[starts] = 1
    run = np.cumsum(run)
    label = np.arange(n)
    while True:
        before = label.copy()
        i, d = np.arange(n), 1
        while True:
            i = i[:np.searchsorted(i, n - d)]
            i = i[run[i] == run[i + d]]
            if not len(i):
                break
            j = i + d
            near = (np.bitwise_count(fps[i] ^ fps[j]) <= distance) & (own[i] | own[j])
            near &= (side[i] != side[j]) | (side[i] == 2)
            a, b = i[near], j[near]
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            d += 1
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return label


def links(nodes: DataFrame, plan: list[tuple[list[int], int]], distance: int = DISTANCE) -> DataFrame:
    """`u, v`: verified links that join all fingerprints of a bucket that reach each other within it."""
    filed = signatures(nodes, plan)
    sizes = filed.groupBy("part", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("held")).where("held and n > 1").select(
        "part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = filed.join(sizes, ["part", "key"])
    block = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("block", block).withColumn("other", other).select(
        "part", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))
        .cast("byte").alias("side"), "fp", "own")
    keys = ["part", "key", "low", "high"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = changed(table, keys)[-1]
            if last:
                yield from compared(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    def compared(table: pa.Table):
        fps = table.column("fp").to_numpy()
        label = linked(changed(table, keys), fps, table.column("own").to_numpy(zero_copy_only=False),
                       table.column("side").to_numpy(), distance)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        if len(moved):
            yield pa.RecordBatch.from_pydict({"u": fps[moved], "v": fps[label[moved]]})

    dealt = met.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                    distance: int = DISTANCE, width: int = WIDTH) -> DataFrame:
    """`id, fp, component_id`: the smallest id that each document reaches over links."""
    found = written(fingerprints(docs, id_column, text_column, width))
    rooted = grown(found, distance)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def grown(found: DataFrame, distance: int, more: DataFrame | None = None) -> DataFrame:
    """`fp, id, root`: every fingerprint of `found(id, fp)`, its smallest id and its component; `more(u, v)` links fingerprints too."""
    nodes = written(found.groupBy("fp").agg(F.min("id").alias("id")))
    rows = nodes.count()
    # Estimates need a sample only; any fingerprints do, so those first in a hashed order are taken.
    sample = np.array([r["fp"] for r in nodes.orderBy(F.xxhash64("fp")).select("fp").limit(ESTIMATE_ROWS).collect()],
                      np.int64)
    plan = planned(sample, rows, correlation(nodes), distance)
    edges = links(nodes, plan, distance)
    roots = components(edges if more is None else edges.union(more))
    return written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root")))


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's columns, made from `near_duplicates`."""
    return found.select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, distance: int = DISTANCE,
                width: int = WIDTH, similarity: float | None = None) -> DataFrame:
    """One document of each component: of the texts with the smallest id (a null one only if there is no other), the one
    whose hash is least. Of rows that repeat an id and its text, one stays; a null text counts as an empty one.

    With `similarity`, texts whose sets of shingles have at least that Jaccard similarity are linked as well.
    """
    marks = text_marks(F.col(text_column))
    rows = docs.select(F.col(id_column).alias("id"), *marks, F.coalesce(F.col(text_column), F.lit("")).alias("body"))
    texts = described(rows, width, similarity is not None)
    more = None if similarity is None else similar(texts, rows, width=width, similarity=similarity)
    rooted = grown(texts.select("id", "fp"), distance, more).select("fp", "root")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text", "more")).alias("k")
    kept = texts.join(rooted, "fp").groupBy("root").agg(first).select("k.id", "k.text", "k.more")
    counts = rows.groupBy("id", "text", "more").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = written(kept.alias("k").join(counts.alias("c"), [F.col("k.id").eqNullSafe(F.col("c.id")), F.col("k.text") == F.col("c.text"),
                                                            F.col("k.more") == F.col("c.more")], "left").select("k.*", "n"))

    def of(some: DataFrame) -> DataFrame:
        # The rows have no bound, so they aren't broadcast at any size.
        text, more = text_marks(F.col(f"d.{text_column}"))
        return docs.alias("d").join(some.alias("k").hint("merge"), [
            F.col(f"d.{id_column}").eqNullSafe(F.col("k.id")), text == F.col("k.text"), more == F.col("k.more")], "left_semi")

    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return of(kept)
    mark = fresh(docs, "mark")
    one = of(repeated).withColumn(mark, F.struct(*marks)).dropDuplicates([id_column, mark]).drop(mark)
    return of(kept.where("n is null")).union(one)


def text_marks(text: Column) -> list[Column]:
    """`text, more`: 128 bits of hash that name a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("text"), F.xxhash64(F.lit(1), text).alias("more")]


def described(rows: DataFrame, width: int, banded: bool) -> DataFrame:
    """`text, more, id, fp, keys`: of every different text the smallest id, the fingerprint and the band keys."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes = [shingle_hashes(t, width) for t in batch.column(3).to_pylist()]
        fps = np.array([folded(h) for h in hashes], np.uint64).view(np.int64)
        keys = [band_keys(h) if banded and len(h) else [] for h in hashes]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps), pa.array(keys, pa.list_(pa.int64()))],
                                         names=["id", "text", "more", "fp", "keys"])

    kind = rows.schema["id"].dataType.simpleString()
    found = by_batch(rows.select("id", "text", "more", "body"), run, f"id {kind}, text long, more long, fp long, keys array<long>")
    return written(found.groupBy("text", "more").agg(
        F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))


def similar(texts: DataFrame, rows: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """`u, v`: fingerprints of texts whose shingle sets are similar enough, joined within their buckets.

    No 64 bits tell such texts apart at a bearable number of candidates: at a similarity of 0.8 they differ in 10 bits
    on average. So candidates are texts that agree in all `ROWS` least hashes of one of `BANDS` bands; a pair of
    similarity 0.8 does with a probability of 0.9997. What meets is compared by its whole sets.
    Buckets with the same members are looked at once. A bucket of more than `MET` texts is first cut by a hash that
    differs from band to band, with its least text mark in every piece; this joins a group of near copies at a cost
    that grows with its size. What these links leave apart is then compared whole, in pairs of blocks (`crossed`).
    """
    filed = texts.select("text", F.posexplode("keys").alias("band", "key"))
    buckets = filed.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("text")).alias("members"), F.min("text").alias("pivot")).where("n > 1")
    once = buckets.groupBy("n", "members").agg(F.min(F.struct("band", "key", "pivot")).alias("b")).select("n", "b.*")
    pieces = F.ceil(F.col("n") / MET).cast("int")
    met = filed.join(once, ["band", "key"]).select("text", "band", "key", F.explode(
        F.when(F.col("text") == F.col("pivot"), F.sequence(F.lit(0), pieces - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("text", "band"), pieces).cast("int")))).alias("piece"))
    met = written(met)

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
        fps = np.array([folded(h) for h in hashes], np.uint64).view(np.int64)
        found = [np.unique(h).view(np.int64) for h in hashes]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array(found, pa.list_(pa.int64()))],
                                         names=["text", "fp", "shingles"])

    # These texts have no bound either. Copies are put together before they are dealt; a second text of one mark only adds comparisons.
    asked = texts.select("text", "more").join(met.select("text").distinct(), "text", "left_semi")
    bodies = rows.groupBy("text", "more").agg(F.first("body").alias("body")).join(asked.hint("merge"), ["text", "more"])
    wanted = by_batch(bodies.select("text", "body"), sets, "text long, fp long, shingles array<long>")
    dealt = met.join(wanted, "text").select("band", "key", "piece", "fp", "shingles")
    pairs = reaching(dealt, ["band", "key", "piece"], similarity)
    large = once.where(F.col("n") > MET).select("band", "key")
    if large.isEmpty():
        return pairs
    roots = components(pairs)
    named = texts.select("text", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "text", "fp", F.coalesce("root", "fp").alias("joined"))
    dealt = crossed(written(filed.join(large, ["band", "key"]).join(named, "text"))).join(wanted, ["text", "fp"])
    return roots.union(reaching(dealt, ["band", "key", "low", "high"], similarity)).toDF("u", "v")


def crossed(held: DataFrame) -> DataFrame:
    """`band, key, low, high, side, text, fp, joined`: the pairs of blocks in which all of a bucket meet that aren't joined.

    A component with more members in a bucket than a block holds has blocks of its own, which don't meet each other.
    """
    keys, most = ["band", "key"], max(MET // 2, 1)
    wide = held.groupBy(*keys, "joined").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).drop("m")
    pooled = held.join(wide.withColumn("wide", F.lit(True)), [*keys, "joined"], "left").withColumn(
        "pool", F.when(F.col("wide"), F.col("joined"))).drop("wide")
    counts = pooled.groupBy(*keys, "pool").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    # One row per pool of a bucket, numbered on from the blocks of the pools before it.
    before = Window.partitionBy(*keys).orderBy("pool").rowsBetween(Window.unboundedPreceding, -1)
    pools = written(counts.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int")))
    named = pooled.alias("h").join(pools.alias("p"), [F.col("h.band") == F.col("p.band"), F.col("h.key") == F.col("p.key"),
                                                      F.col("h.pool").eqNullSafe(F.col("p.pool"))]).select(
        "h.band", "h.key", "h.text", "h.fp", "h.joined", (F.col("first") + F.pmod(F.xxhash64("text"), "blocks")).cast("int").alias("block"))
    blocks = pools.select(*keys, "pool", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block"))
    a, b = (blocks.select(*keys, F.col("pool").alias(f"pool_{x}"), F.col("block").alias(x)) for x in ("low", "high"))
    meeting = a.join(b, keys).where("low <= high and not coalesce(pool_low = pool_high, false)")
    sides = F.when(F.col("low") == F.col("high"), F.expr("array(struct(low as block, 2 as side))")).otherwise(
        F.expr("array(struct(low as block, 0 as side), struct(high as block, 1 as side))"))
    met = meeting.select(*keys, "low", "high", F.inline(sides))
    return named.join(met, [*keys, "block"]).select(*keys, "low", "high", "side", "text", "fp", "joined")


def reaching(dealt: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """`u, v`: links that join all of one run of `keys` that reach each other; with `side, joined`, those not joined yet."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = changed(table, keys)[-1]
            if last:
                yield from compared(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    def compared(table: pa.Table):
        table = table.combine_chunks()
        starts = np.append(changed(table, keys), table.num_rows)
        lists = table.column("shingles").chunk(0)
        flat, ends = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        names = table.column("joined" if crossing else "fp")
        side = table.column("side").to_numpy() if crossing else np.full(table.num_rows, 2)
        group = names.chunk(0).dictionary_encode().indices.to_numpy() if crossing else np.arange(table.num_rows)
        label = np.arange(table.num_rows)
        for a, b in zip(starts[:-1], starts[1:]):
            sets = [flat[ends[i]:ends[i + 1]] for i in range(a, b)]
            label[a:b] = a + reached(sets, side[a:b], group[a:b], similarity)
        moved = np.flatnonzero(group != group[label])
        if len(moved):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x)).combine_chunks() for x in (moved, label[moved])],
                                             names=["u", "v"])

    crossing = "side" in dealt.columns
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u long, v long")


def band_keys(hashes: np.ndarray) -> list[int]:
    """One hash per band, of the least hashes of its `ROWS` orders."""
    hashes = np.unique(hashes)
    least = np.array([(hashes * a + b).min() for a, b in ORDERS], np.uint64)
    return [xxhash.xxh64_intdigest(part.tobytes(), SEED) - (1 << 63) for part in least.reshape(BANDS, ROWS)]


def changed(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows at which one of `keys` takes a new value, the first one included."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in keys:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def reached(sets: list[np.ndarray], side: np.ndarray, group: np.ndarray, similarity: float) -> np.ndarray:
    """For each sorted set the first one that reaches it over similar ones and over rows of one group.

    Sides 0 and 1 meet each other only; rows of side 2 meet all.
    """
    lengths = np.array([len(s) for s in sets])
    _, group, counts = np.unique(group, return_inverse=True, return_counts=True)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(counts)[:-1])
    label, free = np.arange(len(sets)), np.ones(len(sets), bool)

    def taken(rows: np.ndarray, root: int) -> list[int]:
        whole = np.concatenate([members[g] for g in np.unique(group[rows])])
        free[whole], label[whole] = False, root
        return whole.tolist()

    for root in range(len(sets)):
        if not free[root]:
            continue
        waiting = taken(np.array([root]), root)
        while waiting:
            a = waiting.pop()
            n = lengths[a]
            rest = np.flatnonzero(free & (lengths >= similarity * n) & (lengths * similarity <= n)
                                  & ((side != side[a]) | (side == 2)))
            if not len(rest):
                continue
            flat = np.concatenate([sets[i] for i in rest])
            at = np.minimum(np.searchsorted(sets[a], flat), n - 1)
            shared = np.bincount(np.repeat(np.arange(len(rest)), lengths[rest]), sets[a][at] == flat, len(rest))
            near = rest[shared / (n + lengths[rest] - shared) >= similarity]
            if len(near):
                waiting.extend(taken(near, root))
    return label
