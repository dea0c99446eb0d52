"""Phrases of two to four words that go together, per language, counted in tiles.

* Texts become segments: up to `SEGMENT` words of one language, with the segment's own word numbers.
* Words are counted over all segments. Those that occur often enough are numbered by rank, the most frequent first, and
  the segments are written once more with these numbers.
* Pairs of numbers fall into square tiles of `TILE` x `TILE`. Frequent words have small numbers, so a few tiles hold much of a
  segment's pairs: these are counted in a dense array with one address per pair, `bincount`. Pairs of the other
  tiles are sorted and counted as coordinates. Counts of segments are added up by Spark.
* Frequent pairs go back to the segments they came from and get ranks of their own, and the same tiles count again: a pair
  and a word make three words, a pair and a pair make four.

A phrase occurs no more often than any part of it, so nothing that is left out on the way can be frequent. A count has one
row per segment and phrase, so no phrase, however common, is many rows, and no segment is more than its bound (one longer
text is a segment of its own).

Scores are exact: products are decimals of 38 digits. Ties are broken as stated by `top_phrases`.

Defined results: a null text counts as an empty one, a null language as `und`; repeated rows count as often as they occur;
a language without candidates has no rows, as has an empty table; other columns are not looked at, whatever their names.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import fresh, written

LEAST = 30
UNKNOWN = "und"
SEGMENT = 2_000_000
TILE = 1024
# A tile with fewer pairs than this share of its cells is counted as coordinates.
DENSE = 0.125
SPLIT = b"\xff"
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + SPLIT * 10)
SALTS = 64


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, with `SPLIT`, which no UTF-8 text has, between its pieces."""
    return (text or "").encode().translate(TABLE).replace(SPLIT, b" \xff ").split()


def counted(u: np.ndarray, v: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every different pair of ranks with its count."""
    if not len(u):
        return u, v, np.empty(0, np.int64)
    across, wide = int(v.max()) // tile + 1, int(v.max()) + 1
    tiles = (u // tile) * across + v // tile
    order = np.argsort(tiles, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(tiles[order]) != 0, [True]]))
    full = np.flatnonzero(np.diff(edges) >= DENSE * tile * tile)
    sparse = np.ones(len(u), bool)
    parts = []
    for k in full.tolist():
        rows = order[edges[k]:edges[k + 1]]
        sparse[rows] = False
        counts = np.bincount((u[rows] % tile) * tile + v[rows] % tile, minlength=tile * tile)
        cells = np.flatnonzero(counts)
        first = rows[0]
        parts.append((u[first] // tile * tile + cells // tile, v[first] // tile * tile + cells % tile, counts[cells]))
    codes, counts = np.unique(u[sparse] * np.int64(wide) + v[sparse], return_counts=True)
    parts.append((codes // wide, codes % wide, counts))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts))


def segments(docs: DataFrame, text_column: str, lang_column: str, size: int) -> DataFrame:
    """`seg, lang, words array<string>, counts array<long>, tokens binary`: -1 parts pieces, other numbers index `words`."""
    rows = docs.select(F.coalesce(F.col(lang_column), F.lit(UNKNOWN)).alias("lang"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, total = TaskContext.get().partitionId(), 0, 0
        open_: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made, total
            numbered, held = open_.pop(lang)
            numbers = np.concatenate(held)
            total -= len(numbers)
            made += 1
            words = [w.decode() for w in numbered if w != SPLIT]
            # The mark has a number too; it becomes -1 and those behind it move down.
            mark = numbered.get(SPLIT, len(numbered))
            numbers = np.where(numbers == mark, -1, numbers - (numbers > mark))
            counts = np.bincount(numbers[numbers >= 0], minlength=len(words))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), pa.array([lang]), pa.array([words], pa.list_(pa.string())),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([numbers.astype("<i4").tobytes()], pa.binary())],
                names=["seg", "lang", "words", "counts", "tokens"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, found = lang.as_py(), tokens(text.as_py())
                if lang not in open_:
                    numbered: defaultdict[bytes, int] = defaultdict()
                    numbered.default_factory = numbered.__len__
                    open_[lang] = numbered, []
                numbered, held = open_[lang]
                found.append(SPLIT)
                held.append(np.fromiter(map(numbered.__getitem__, found), np.int32, len(found)))
                total += len(found)
                # The largest part of what a task holds is closed first.
                if total >= size:
                    yield closed(max(open_, key=lambda x: sum(map(len, open_[x][1]))))
        for lang in list(open_):
            yield closed(lang)

    return rows.mapInArrow(run, "seg long, lang string, words array<string>, counts array<long>, tokens binary")


def ranked(words: DataFrame) -> DataFrame:
    """`words(lang, word, f)` with a dense `id` by language, then the most frequent first."""
    held = written(words.repartitionByRange("lang", F.col("f").desc(), "word").sortWithinPartitions("lang", F.col("f").desc(), "word")
                   .select("lang", "word", "f", F.spark_partition_id().alias("part"),
                           F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    # One row per partition, so the sums are over a number that doesn't depend on the words.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return written(held.join(starts, "part").select("lang", "word", "f", (F.col("start") + F.col("at")).alias("id")))


def coded(segs: DataFrame, ranks: DataFrame) -> DataFrame:
    """`seg, ids binary`: the tokens of each segment as ranks; -1 for words that aren't ranked and between pieces."""
    seen = segs.select("seg", "lang", F.posexplode("words").alias("pos", "word"))
    known = seen.join(ranks, ["lang", "word"]).groupBy("seg").agg(F.collect_list(F.struct("pos", "id")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                numbers = np.frombuffer(batch.column(1)[i].as_buffer(), "<i4")
                entries = batch.column(2)[i].values
                names = np.full(int(numbers.max(initial=-1)) + 2, -1, np.int64)
                names[entries.field("pos").to_numpy()] = entries.field("id").to_numpy()
                # The last entry is what -1 finds.
                names[-1] = -1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([names[numbers].astype("<i4").tobytes()], pa.binary())],
                                                 names=["seg", "ids"])

    return segs.select("seg", "tokens").join(known, "seg").select("seg", "tokens", "known").mapInArrow(run, "seg long, ids binary")


def pair_counts(codes: DataFrame, tile: int) -> DataFrame:
    """`seg, u, v, c`: the pairs of ranks that follow each other in each segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[i].as_buffer(), "<i4")
                named, local = local_ranks(ids)
                both = (local[:-1] >= 0) & (local[1:] >= 0)
                u, v, c = counted(local[:-1][both], local[1:][both], tile)
                yield from rows_of(batch.column(0)[i].as_py(), [named[u], named[v]], c)

    return codes.mapInArrow(run, "seg long, u int, v int, c long")


def local_ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks found, in order, and each rank's place among them; -1 stays."""
    named, local = np.unique(ids, return_inverse=True)
    skipped = int(len(named) > 0 and named[0] < 0)
    return named[skipped:], local - skipped


def rows_of(seg: int, columns: list[np.ndarray], counts: np.ndarray, names: str = "uvwx") -> Iterator[pa.RecordBatch]:
    for start in range(0, len(counts), 1 << 16):
        part = slice(start, start + (1 << 16))
        size = len(counts[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, seg, np.int64)), *(pa.array(c[part].astype(np.int32)) for c in columns), pa.array(counts[part])],
            names=["seg", *names[:len(columns)], "c"])


def longer_counts(codes: DataFrame, often: DataFrame, tile: int) -> DataFrame:
    """`seg, u, v, w, x, c`: what follows the frequent pairs `often(seg, u, v, f)`, a word (`x` is -1) or another frequent pair."""
    listed = often.groupBy("seg").agg(F.collect_list(F.struct("u", "v", "f")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[i].as_buffer(), "<i4").astype(np.int64)
                pairs = batch.column(2)[i].values
                u, v, f = (pairs.field(x).to_numpy().astype(np.int64) for x in "uvf")
                # Ranks of the pairs: the most frequent first.
                by = np.lexsort((v, u, -f))
                u, v = u[by], v[by]
                key = u << 32 | v
                sort = np.argsort(key)
                here = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << 32 | ids[1:], -1)
                at = np.minimum(np.searchsorted(key[sort], here), len(key) - 1)
                rank = np.where(key[sort][at] == here, sort[at], -1)
                seg = batch.column(0)[i].as_py()
                # A pair and the next word. The word and the one before it must be a frequent pair too.
                named, local = local_ranks(ids)
                some = (rank[:-1] >= 0) & (rank[1:] >= 0)
                p, w, c = counted(rank[:-1][some], local[2:][some], tile)
                yield from rows_of(seg, [u[p], v[p], named[w], np.full(len(c), -1)], c)
                some = (rank[:-2] >= 0) & (rank[1:-1] >= 0) & (rank[2:] >= 0)
                p, q, c = counted(rank[:-2][some], rank[2:][some], tile)
                yield from rows_of(seg, [u[p], v[p], u[q], v[q]], c)

    joined = codes.join(listed, "seg").select("seg", "ids", "pairs")
    return joined.mapInArrow(run, "seg long, u int, v int, w int, x int, c long")


def phrase_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", *, least: int = LEAST,
                  segment: int = SEGMENT, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All words with at least `least` occurrences, all longer phrases with as many, and the words of each language.

    `lang, word, f, id`; `ids array<int>, f` of two to four words; `lang, n`.
    """
    segs = written(segments(docs, text_column, lang_column, segment), compression="zstd")
    totals = segs.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    each = segs.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("lang", "e.words", "e.counts")
    words = ranked(each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least))
    codes = written(coded(segs, words), compression="zstd")
    over = Window.partitionBy("u", "v")
    often = written(pair_counts(codes, tile).withColumn("f", F.sum("c").over(over)).where(F.col("f") >= least).select("seg", "u", "v", "f"))
    pairs = often.groupBy("u", "v").agg(F.max("f").alias("f")).select(F.array("u", "v").alias("ids"), "f")
    longer = longer_counts(codes, often, tile).groupBy("u", "v", "w", "x").agg(F.sum("c").alias("f")).where(F.col("f") >= least).select(
        F.when(F.col("x") < 0, F.array("u", "v", "w")).otherwise(F.array("u", "v", "w", "x")).alias("ids"), "f")
    return words, written(pairs.union(longer)), written(totals)


def gram(ids: Column) -> Column:
    return F.array_join(ids, " ")


def cut_scores(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """`ids, a, l, r, score` of every phrase: the cut with the lowest score, the first of equal ones."""
    parts = phrases.select(gram(F.col("ids")).alias("part"), "f").union(words.select(F.col("id").cast("string"), "f"))
    size = F.size("ids")
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "ids", "a", "k", gram(F.slice("ids", F.lit(1), F.col("k"))).alias("first"),
        gram(F.slice("ids", F.col("k") + 1, size - F.col("k"))).alias("rest"))
    joined = cuts.join(parts.toDF("first", "l"), "first").join(parts.toDF("rest", "r"), "rest")
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    scored = joined.select("ids", "a", "k", "l", "r", score.alias("score"))
    return scored.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("ids", "a", "m.l", "m.r", "m.score")


def not_held(phrases: DataFrame) -> DataFrame:
    """`ids` of the phrases of which no longer one holds four fifths of the occurrences.

    A phrase in one that is longer by more words is in one that is longer by one word and occurs at least as often.
    """
    longer = phrases.where(F.size("ids") > 2)
    inner = longer.select(F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), F.col("f").alias("g"))
    held = inner.groupBy("ids").agg(F.max("g").alias("g"))
    share = F.lit(100).cast("decimal(3,0)") * F.col("g").cast("decimal(19,0)") >= F.lit(80).cast("decimal(2,0)") * F.col("f").cast("decimal(19,0)")
    return phrases.join(held, "ids", "left").where(~F.coalesce(share, F.lit(False))).select("ids")


def top_phrases(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", *, least: int = LEAST, limit: int = 2000,
                segment: int = SEGMENT, tile: int = TILE) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the `limit` best phrases of each language, by score, then count, then phrase."""
    words, phrases, totals = phrase_counts(docs, text_column, lang_column, least=least, segment=segment, tile=tile)
    kept = cut_scores(words, phrases).join(not_held(phrases), "ids")
    spelled = kept.select("*", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "lang", "word"), "id")
    named = spelled.groupBy("ids").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("phrase"),
        *[F.first(c).alias(c) for c in ("a", "l", "r", "score")])
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # A language may hold most phrases: each salt keeps its best, of which there are few.
    salt = fresh(named, "salt")
    best = named.withColumn(salt, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= limit).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
