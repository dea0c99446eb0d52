"""Texts whose sets of word n-grams have a Jaccard similarity of at least `percent`, joined by parity sketches.

Every n-gram of a text flips one bit of a long sketch, so two sketches differ in no more bits than their sets do in
n-grams. At a similarity of 80 % sets of a and b n-grams differ in at most (a + b) / 9, so a set of s differs from any
partner in at most D = (s + 5 s / 4) / 9.

* Sketches are cut into G parts, G fixed for a band of sizes (a power of two up to the next; sets that may have a partner in the
  band above are filed there too). Two similar sketches agree in G - D parts or more: the pigeonhole principle.
* Of a list of G parts, put in one order for all sketches, the first D + e hold at least e of those in which a similar sketch
  agrees. Parts with more bits come first, so what is filed is telling, and parts without bits are hardly ever filed.
* Parts that no other sketch has are dropped. A sketch with fewer than e parts left has no partner at all, and of the others the
  e - 1 parts that most sketches share need not be looked at.
* Sketches that meet in a part are compared as short dense sketches, folded to one bit for each n-gram, which rules out what is
  below a similarity of 0.7 or so. What may link forms clusters, and within these whole sets are compared.

Sets that are equal are one from the start. A part or cluster yields links from its members to one of each local component, never
all pairs; large ones are compared in pairs of blocks, so nothing is left out.

An n-gram is its 64-bit hash here, and a set is named by a hash of 64 bits over all of them.

Defined results: a text without words, or null, has an empty set and links with nothing; a text with fewer words than `width`
has its whole sequence as one n-gram; a null id has a row, but names a component only if there is no other id; repeated rows
keep their rows; other columns are not looked at, whatever their names; an empty table gives an empty one.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import by_bytes, written
from docfields.llm.components import components
from docfields.llm.simhash import changed, crossed, shingle_hashes

WIDTH = 5
PERCENT = 80
# Sketches of a part that are compared in one piece.
BLOCK = 2048
# Sets of a cluster that are compared in one piece, and n-grams in them.
MET = 1024
MET_GRAMS = 1 << 20
EMPTY = np.uint64(0x5851F42D4C957F2D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bands:
    """Sizes, differences and parts for a similarity in percent."""

    def __init__(self, percent: int):
        self.percent = percent

    def largest(self, size: int) -> int:
        """The largest set that may be similar to one of `size`."""
        return size * 100 // self.percent

    def most_apart(self, size: int) -> int:
        """The most n-grams by which a set of `size` and one similar to it differ."""
        # shared >= p (a + b) / (100 + p), and they differ in a + b - 2 shared.
        return (100 - self.percent) * (size + self.largest(size)) // (100 + self.percent)

    def of(self, size: int) -> list[int]:
        """The bands a set is filed in: its own, and the one above if a partner may be there."""
        band = size.bit_length() - 1
        return [band, band + 1] if self.largest(size) >= 2 << band else [band]

    def shared_parts(self, band: int) -> int:
        """How many of the filed parts similar sketches have in common at least (e)."""
        return 1 + ((2 << band) - 1) // 50

    def parts(self, band: int) -> int:
        top = (2 << band) - 1
        return self.most_apart(top) + max(self.shared_parts(band) + 1, -(-top // 20))

    def words(self, band: int) -> int:
        """64-bit words of the dense sketch."""
        return max(1, (1 << band) * 2 // 64)


def part_keys(grams: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """The parts that a set files in a band, as hashes whose lowest six bits are the band."""
    count, filed = np.uint64(bands.parts(band)), bands.most_apart(len(grams)) + bands.shared_parts(band)
    # Place in the sketch: the part, and one of 2^32 bits in it. A bit that is flipped twice is not set.
    place = ((grams >> np.uint64(32)) * count >> np.uint64(32)) << np.uint64(32) | grams & np.uint64(0xFFFFFFFF)
    place, flips = np.unique(place, return_counts=True)
    place = place[flips % 2 == 1]
    part = place >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    keys = np.add.reduceat(mixed(place + np.uint64(band)), first) if len(first) else np.empty(0, np.uint64)
    bits = np.diff(np.append(first, len(part)))
    if len(keys) < filed:
        free = np.setdiff1d(np.arange(count, dtype=np.uint64), part[first])[:filed - len(keys)]
        keys = np.append(keys, free * EMPTY)
        bits = np.append(bits, np.zeros(len(free), np.int64))
    keys = mixed(keys ^ mixed(np.full(1, band, np.uint64)))
    keys = keys >> np.uint64(6) << np.uint64(6) | np.uint64(band)
    return keys[np.lexsort((keys, -bits))[:filed]].view(np.int64)


def dense(grams: np.ndarray, band: int, bands: Bands) -> bytes:
    """The sketch of a set folded to the band's number of bits."""
    words = bands.words(band)
    bit = np.bincount((grams % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bit.astype(np.uint8)).tobytes()


def gram_sets(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def name_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else 0


def described(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """`id, mark, node, size`: a hash of the text, the name of its set, and the size of that."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [gram_sets(t, width) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
            names=["id", "mark", "node", "size"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("mark"), F.col(text_column).alias("text"))
    return by_bytes(rows, run, f"id {kind}, mark long, node long, size long", "text")


def filed_keys(docs: DataFrame, text_column: str, width: int, bands: Bands) -> DataFrame:
    """`key, node`: the parts that each set is filed under; a task files a set once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, total = [], [], 0
            for text in batch.column(0):
                grams = gram_sets(text.as_py(), width)
                node = name_of(grams)
                if bands.most_apart(len(grams)) == 0 or node in seen:
                    continue
                seen.add(node)
                for band in bands.of(len(grams)):
                    keys.append(part_keys(grams, band, bands))
                    nodes.append(np.full(len(keys[-1]), node, np.int64))
                    total += len(keys[-1])
                if total > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])
                    keys, nodes, total = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return docs.select(text_column).mapInArrow(run, "key long, node long")


def by_run(dealt: DataFrame, keys: list[str], function: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str,
           *order: str) -> DataFrame:
    """`function` over whole runs of rows with the same `keys`, and where they start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            # A run that goes on through the whole batch is only put by.
            if not changes(held[0], batch):
                continue
            table = pa.Table.from_batches(held)
            last = int(changed(table, keys)[-1])
            if last:
                yield from whole(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from whole(pa.Table.from_batches(held))

    def changes(first: pa.RecordBatch, last: pa.RecordBatch) -> bool:
        ends = first.slice(0, 1), last.slice(last.num_rows - 1, 1)
        return last.num_rows > 0 and any(ends[0].column(k)[0] != ends[1].column(k)[0] for k in keys)

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            table = table.combine_chunks()
            yield from function(table, np.append(changed(table, keys), table.num_rows))

    return dealt.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def shared_keys(filed: DataFrame) -> DataFrame:
    """`key, node, n`: the parts that two or more sets have, with their number."""
    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, node = (table.column(c).to_numpy() for c in ("key", "node"))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        n = np.repeat(n, n)
        yield pa.RecordBatch.from_arrays([pa.array(x[n > 1]) for x in (key, node, n)], names=["key", "node", "n"])

    return by_run(filed, ["key"], run, "key long, node long, n long", "node")


def band_of(key: Column) -> Column:
    return key.bitwiseAND(F.lit(63))


def candidates(filed: DataFrame) -> DataFrame:
    """`key, node`: the parts to look at, those with the same sets once."""
    shared = written(shared_keys(filed)).withColumn("band", band_of(F.col("key")))
    # Counts and places within one set's parts, of which there are fewer than it has n-grams.
    least = F.expr("1 + ((shiftleft(2L, cast(band as int)) - 1) div 50)")
    ordered = shared.selectExpr("key", "node", "band", "count(1) over (partition by node, band) as held",
                                "row_number() over (partition by node, band order by n, key) as place")
    kept = written(ordered.where((F.col("held") >= least) & (F.col("place") <= F.col("held") - least + 1)).select("key", "node"))
    parts = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    once = parts.groupBy("n", "members", band_of(F.col("key")).alias("band")).agg(F.min("key").alias("key")).select("key", "n")
    return written(kept.join(once, "key"))


def grams_of(docs: DataFrame, id_column: str, text_column: str, asked: DataFrame, width: int) -> DataFrame:
    """`node, size, grams binary`: the sets that `asked(id, mark)` name, one row each but for equal rows in different tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, sets = [], [], []
            for text in batch.column(0):
                grams = gram_sets(text.as_py(), width)
                node = name_of(grams)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(grams))
                    sets.append(grams.astype("<u8").tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())],
                                                 names=["node", "size", "grams"])

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("mark"), F.col(text_column).alias("text"))
    # Neither side has a bound, so neither is broadcast.
    asked = asked.hint("merge")
    met = rows.join(asked, (rows["mark"] == asked["mark"]) & rows["id"].eqNullSafe(asked["id"]), "left_semi")
    return written(met.select("text").mapInArrow(run, "node long, size long, grams binary"))


def spread_out(side: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], group: np.ndarray | None = None) -> np.ndarray:
    """For each row the first one that it reaches over near rows and rows of its group.

    Sides 0 and 1 meet each other only, rows of side 2 meet all. `near(a, rest)` tells which of the rows `rest` link with row a.
    """
    n = len(side)
    label, free = np.arange(n), np.ones(n, bool)
    members: list[np.ndarray] = []
    if group is not None:
        _, group, counts = np.unique(group, return_inverse=True, return_counts=True)
        members = np.split(np.argsort(group, kind="stable"), np.cumsum(counts)[:-1])

    def taken(rows: np.ndarray, root: int) -> list[int]:
        whole = rows if group is None else np.concatenate([members[g] for g in np.unique(group[rows])])
        free[whole], label[whole] = False, root
        return whole.tolist()

    for root in range(n):
        if not free[root]:
            continue
        waiting = taken(np.array([root]), root)
        while waiting:
            a = waiting.pop()
            rest = np.flatnonzero(free & ((side != side[a]) | (side == 2)))
            if len(rest):
                linked = rest[near(a, rest)]
                if len(linked):
                    waiting.extend(taken(linked, root))
    return label


def blocked(met: DataFrame, blocks: Column) -> DataFrame:
    """Rows of `met(key, node, …)` once for every pair of blocks they are in: `key, low, high, side, node`."""
    own = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int")
    dealt = met.withColumn("blocks", blocks.cast("int")).withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))
    return dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), side.alias("side"), "node")


def may_link(met: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """`u, v`: links that join all sets of a part whose dense sketches let them be similar."""
    def sketches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for node, size, grams in zip(*(c.to_pylist() for c in batch.columns)):
            grams = np.frombuffer(grams, "<u8")
            rows += [(node, band, size, dense(grams, band, bands)) for band in bands.of(size)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["node", "band", "size", "sketch"])

    def compared(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, size, side = (table.column(c).to_numpy() for c in ("node", "size", "side"))
        sketch = table.column("sketch").to_pylist()
        label = np.arange(len(node))
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1:
                bits = np.frombuffer(b"".join(sketch[a:b]), "<u8").reshape(b - a, -1)
                own = size[a:b]

                def near(i: int, rest: np.ndarray) -> np.ndarray:
                    both = own[rest] + own[i]
                    least = np.minimum(own[rest], own[i])
                    apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    return (apart * (100 + bands.percent) <= (100 - bands.percent) * both) & (100 * least >= bands.percent * (both - least))

                label[a:b] = a + spread_out(side[a:b], near)
        moved = np.flatnonzero(label != np.arange(len(node)))
        moved = moved[node[moved] != node[label[moved]]]
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["u", "v"])

    found = by_bytes(sets, sketches, "node long, band long, size long, sketch binary", "grams")
    dealt = blocked(met, F.ceil(F.col("n") / BLOCK)).withColumn("band", band_of(F.col("key"))).join(found.hint("merge"), ["node", "band"])
    return by_run(dealt.select("key", "low", "high", "side", "node", "size", "sketch"), ["key", "low", "high"], compared, "u long, v long")


def similar(dealt: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """`u, v`: links that join all sets of a run that reach each other; with `side, joined`, those that aren't joined yet."""
    crossing = "side" in dealt.columns

    def compared(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = table.column("joined" if crossing else "node").to_numpy()
        side = table.column("side").to_numpy() if crossing else np.full(table.num_rows, 2)
        grams = table.column("grams").to_pylist()
        label = np.arange(table.num_rows)
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1:
                sets = [np.frombuffer(g, "<u8") for g in grams[a:b]]
                size = np.array([len(s) for s in sets])

                def near(i: int, rest: np.ndarray) -> np.ndarray:
                    out = np.zeros(len(rest), bool)
                    least = np.minimum(size[rest], size[i])
                    fits = np.flatnonzero(100 * least >= percent * np.maximum(size[rest], size[i]))
                    if len(fits):
                        some = rest[fits]
                        flat = np.concatenate([sets[k] for k in some])
                        at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
                        shared = np.bincount(np.repeat(np.arange(len(some)), size[some]), sets[i][at] == flat, len(some)).astype(np.int64)
                        out[fits] = 100 * shared >= percent * (size[some] + size[i] - shared)
                    return out

                label[a:b] = a + spread_out(side[a:b], near, names[a:b] if crossing else None)
        moved = np.flatnonzero(names != names[label])
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], names=["u", "v"])

    return by_run(dealt, keys, compared, "u long, v long")


def verified(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`u, v`: links within `clusters(node, root)` that join what similar sets join.

    A large cluster is first cut into pieces, each with the cluster's least set: this joins a large group of near copies at a cost
    that grows with its size. What is apart after that is compared whole, in pairs of blocks.
    """
    sized = clusters.join(sets.select("node", "size"), "node")
    counts = sized.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"), F.greatest(
        F.ceil(F.count(F.lit(1)) / MET), F.ceil(F.sum("size") / MET_GRAMS)).cast("int").alias("pieces"))
    counts = written(counts)
    piece = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")))
    met = clusters.join(counts, "root").select("root", "node", F.explode(piece).alias("piece"))
    pairs = written(similar(met.join(sets.select("node", "grams").hint("merge"), "node").select("root", "piece", "node", "grams"),
                            ["root", "piece"], percent))
    large = counts.where("pieces > 1").select("root")
    if large.isEmpty():
        return pairs
    joined = components(pairs).withColumnRenamed("root", "joined")
    held = clusters.join(large, "root").join(joined, "node", "left").select(
        F.lit(0).alias("band"), F.col("root").alias("key"), F.col("node").alias("text"), F.col("node").alias("fp"),
        F.coalesce("joined", "node").alias("joined"))
    apart = held.groupBy("key").agg(F.min("joined").alias("x"), F.max("joined").alias("y")).where("x <> y").select("key")
    dealt = crossed(written(held.join(apart, "key"))).select("key", "low", "high", "side", "joined", F.col("text").alias("node"))
    return pairs.union(similar(dealt.join(sets.select("node", "grams").hint("merge"), "node").select(
        "key", "low", "high", "side", "joined", "grams"), ["key", "low", "high"], percent))


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, width: int = WIDTH,
                 percent: int = PERCENT) -> DataFrame:
    """`id, n_shingles, component_id`: the size of each document's set, and the smallest id that it reaches over links."""
    bands = Bands(percent)
    rows = written(described(docs, id_column, text_column, width))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("k")
    nodes = rows.where("size > 0").groupBy("node").agg(first).select("node", "k.id", "k.mark")
    met = candidates(filed_keys(docs, text_column, width, bands))
    asked = nodes.join(met.select("node").distinct(), "node", "left_semi").select("id", "mark")
    sets = grams_of(docs, id_column, text_column, asked, width).dropDuplicates(["node"])
    near = components(may_link(met, sets, bands))
    roots = near.select("root").distinct().select(F.col("root").alias("node"), "root")
    links = verified(written(near.select("node", "root").union(roots)), sets, percent)
    rooted = nodes.select("node", "id").join(components(links), "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    # Sets are named by hashes; an empty one has a name that no join finds.
    return rows.join(named.withColumnRenamed("node", "named"), (F.col("node") == F.col("named")) & (F.col("size") > 0), "left").select(
        F.col("id").alias(id_column), F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
