"""Runs: stretches of words that repeat with a period, found by internal pattern matching.

Words are numbers here, and the words of different texts are different numbers, so many texts are searched at once
and no match crosses a text.

* Prefix doubling names all stretches of 1, 2, 4, … words and leaves a suffix array in which every name is an interval;
  it goes on only where stretches occur again.
* Blocks of `2^k` words, at every multiple of half their length, ask for their next occurrence in the window of their
  own length to their right: a range successor over the suffix array's interval, answered by a wavelet tree. The
  occurrences of a block in such a window form a progression, and its difference is a candidate for the period.
* Two places that are a candidate apart are extended in both directions by the names, from long to short. A stretch
  that is long enough is a run.

Nothing is missed: let a run have the smallest period q and at least 4q words, and let B be the least power of two with
B >= q and B >= 4. Any 3B/2 - 1 words hold a block of length B, and 3B/2 - 1 + q <= max(6, 4q), so some block and its
copy q further on lie in the run. An earlier occurrence, q' < q further on, would give the stretch of B + q' >= q + q'
words the period gcd(q, q') and the run a smaller one. In the same way the period of whatever is found is the smallest.

Defined results: a null text has no words; equal rows give equal results; very long texts are searched whole, in memory
that grows with their length alone; a null id is an id like any other, and its decimal text is empty; other columns are not
looked at, whatever their names; an empty table gives an empty one.
"""

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import by_bytes

# A run has at least this many words, and at least this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
# The shortest block.
SHORTEST = 4

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class Names:
    """Names of all stretches of `2^k` words: `ranks[k][i]` is where the suffixes that begin like `i` begin in the suffix array.

    `queries` holds, for blocks that occur again, their place, length and interval in `slots`, the part of the suffix array whose
    first `SHORTEST` words occur again; `held` are the places there.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        array = np.argsort(words, kind="stable")
        ranks = np.empty(n, np.int64)
        slots, length = np.arange(n), 1
        self.ranks: list[np.ndarray] = []
        asked, kept = [], None
        keys = words[array]
        while True:
            # Equal keys of neighbouring slots are one group, named by its first slot.
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.append(first, len(keys)))
            ranks = ranks.copy()
            ranks[array[slots]] = np.repeat(slots[first], sizes)
            self.ranks.append(ranks)
            again = np.repeat(sizes > 1, sizes)
            width = np.repeat(sizes, sizes)[again]
            slots = slots[again]
            if length == SHORTEST:
                kept = slots
            if length >= SHORTEST and len(slots):
                places = array[slots]
                block = np.flatnonzero(places % (length // 2) == 0)
                asked.append(np.stack([places[block], np.full(len(block), length), ranks[places[block]], width[block]]))
            if not len(slots):
                break
            places = array[slots]
            after = places + length
            follow = np.where(after < n, ranks[np.minimum(after, n - 1)], -1)
            keys = ranks[places] * np.int64(n + 1) + follow + 1
            order = np.argsort(keys, kind="stable")
            array[slots], keys = places[order], keys[order]
            length *= 2
        self.words = n
        self.held = array[kept] if kept is not None else np.empty(0, np.int64)
        self.queries = np.concatenate(asked, axis=1) if asked else np.empty((4, 0), np.int64)
        if kept is not None:
            self.queries[2] = np.searchsorted(kept, self.queries[2])

    def common(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many words agree from `i` and `j` on (`step` 1), or before them (`step` -1), `i < j`."""
        i, j, n = i.copy(), j.copy(), self.words
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            length, ranks = 1 << k, self.ranks[k]
            a, b = (i, j) if step > 0 else (i - length, j - length)
            inside = (a >= 0) & (b < n)
            same = inside & (ranks[np.clip(a, 0, n - 1)] == ranks[np.clip(b, 0, n - 1)])
            moved = np.where(same, length, 0)
            found += moved
            i += step * moved
            j += step * moved
        return found


class WaveletTree:
    """Numbers below `2^bits`, level by level from the highest bit, each level stably parted by its bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.zeros: list[np.ndarray] = []
        for bit in range(bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers of each interval are smaller than its value."""
        count = np.zeros(len(left), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            a, b = zeros[left], zeros[right]
            up = (value >> bit) & 1 == 1
            count += np.where(up, b - a, 0)
            left, right = np.where(up, zeros[-1] + left - a, a), np.where(up, zeros[-1] + right - b, b)
        return count

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest number of each interval, from 0."""
        value = np.zeros(len(left), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            a, b = zeros[left], zeros[right]
            up = n >= b - a
            n = np.where(up, n - (b - a), n)
            value |= np.where(up, np.int64(1) << bit, 0)
            left, right = np.where(up, zeros[-1] + left - a, a), np.where(up, zeros[-1] + right - b, b)
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The smallest number of each interval above the value, -1 without one."""
        passed = self.below(left, right, value + 1)
        some = passed < right - left
        out = np.full(len(left), -1, np.int64)
        out[some] = self.nth(left[some], right[some], passed[some])
        return out


def runs(words: np.ndarray) -> np.ndarray:
    """`start, length, period` of all runs, as rows in order of start and period."""
    names = Names(words)
    place, length, left, width = names.queries
    if not len(place):
        return np.empty((0, 3), np.int64)
    tree = WaveletTree(names.held, max(1, (len(words)).bit_length()))
    period = tree.successor(left, left + width, place) - place
    near = (period > 0) & (period <= length)
    # Neighbouring blocks of one length and period lie in one run; extending one of them is enough.
    place, period, length = place[near], period[near], length[near]
    order = np.lexsort((place, period, length))
    place, period, length = place[order], period[order], length[order]
    linked = (period[1:] == period[:-1]) & (length[1:] == length[:-1]) & (place[1:] - place[:-1] <= length[1:] // 2)
    alone = np.concatenate([[True], ~linked])[:len(place)]
    place, period = place[alone], period[alone]
    start = place - names.common(place, place + period, -1)
    size = place + period + names.common(place, place + period, 1) - start
    long = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    found = np.unique(np.stack([start, period, size], axis=1)[long], axis=0)
    return found[:, [0, 2, 1]]


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                  rewrite: Rewrite | None = None) -> DataFrame:
    """`id, runs array<struct<start, length, period>>, collapsed`: the runs of each text, in words, by start and period.

    `collapsed` are the words that no run contains after its first period, joined by one space. `rewrite(id, words)`
    gives other words to search than the text's own.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, numbers, total = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").encode().split()
            if rewrite is not None:
                words = rewrite(key, words)
            numbered: defaultdict[bytes, int] = defaultdict()
            numbered.default_factory = numbered.__len__
            numbers.append(np.fromiter(map(numbered.__getitem__, words), np.int64, len(words)) + total)
            total += len(numbered)
            texts.append(words)
        ends = np.cumsum([0, *map(len, texts)])
        found = runs(np.concatenate(numbers))
        marks = np.zeros(ends[-1] + 1, np.int64)
        np.add.at(marks, found[:, 0] + found[:, 2], 1)
        np.add.at(marks, found[:, 0] + found[:, 1], -1)
        dropped = np.cumsum(marks)[:-1] > 0
        offsets = np.searchsorted(found[:, 0], ends)
        collapsed = []
        for words, a, b, x, y in zip(texts, ends[:-1], ends[1:], offsets[:-1], offsets[1:]):
            if x < y:
                words = [words[i] for i in np.flatnonzero(~dropped[a:b])]
            collapsed.append(b" ".join(words).decode())
        start = found[:, 0] - np.repeat(ends[:-1], np.diff(offsets))
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(start), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), listed, pa.array(collapsed, pa.string())],
                                         names=[id_column, "runs", "collapsed"])

    schema = f"`{id_column}` {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return by_bytes(docs.select(id_column, text_column), search, schema, text_column)


def cycled(key: int | None, words: list[bytes]) -> list[bytes]:
    """In one text of ten, chosen by its id, words from a place on that repeat its words from there on."""
    h = zlib.crc32(b"" if key is None else str(key).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return words[:first] + (words[first:first + period] * -(-(n - first) // period))[:n - first]


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's columns, made from `periodic_runs`."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("negative"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    told = found.select(id_column, F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select(
        id_column, "n_runs", F.expr("-best.back").alias("start"), F.col("best.length").alias("length"),
        F.expr("-best.negative").alias("period"), F.expr("1000 * best.length div -best.negative").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
