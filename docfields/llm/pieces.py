"""Sampled segmentations into the pieces of a public SentencePiece vocabulary, and back to text.

Segmentations of a text are the paths of a lattice of vocabulary pieces. Path probabilities come from Zipf
weights of the pieces' merge ranks, to the power `alpha`. The `samples` distinct segmentations of a row are
those with the highest Gumbel-perturbed log-probabilities, found best first as in A* search: the agenda holds
sets of paths that leave a found path at one node, each with the exact log of its summed probability as the
heuristic and a Gumbel maximum below that of the path it leaves. The highest set is opened, a path in it
is drawn, and what is left of it goes back to the agenda. Randomness is a hash of the row's key, so a row's samples
depend on nothing else.

`log_prob` is a segmentation's log-probability; `perturbed` its Gumbel value; `inclusion` the probability
that a segmentation as likely beats the first one left out, the denominator of unbiased estimates.

Spaces are pieces' word marks, one more stands before the text, and characters without a piece become byte
pieces, so decoding gives every text back, a literal word mark included.

Defined results: null and empty texts have one segmentation, the empty one, with log-probability 0 and
inclusion 1; a text with fewer segmentations than asked for gives all it has; repeated rows repeat their
samples; an empty table gives an empty one.
"""

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docfields.llm.common import by_batch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
ALPHA = 1.0
# Lattice nodes a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
# Texts whose lattices are searched together, and their characters at most (one longer text goes alone).
TEXTS = 300
CHARACTERS = 1_000_000


@cache
def vocabulary(model: str) -> tuple[dict[str, tuple[int, float]], list[int], float]:
    """Pieces with id and log weight, ids of the 256 bytes, a byte's log weight."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    size = processor.get_piece_size()
    pieces, bytes_ = {}, [0] * 256
    total = sum(1.0 / (rank + 1) for rank in range(size))
    for i in range(size):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
        elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
            pieces[piece] = (i, -math.log((len(pieces) + 1) * total))
    for piece in pieces:
        if "\n" in piece or MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} crosses a word border")
    return pieces, bytes_, -math.log(size * total)


def units_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of some texts with a space before each, the unit at every place, and each text's number of units.

    A unit is a line feed, a word mark, or spaces and what follows them up to the next of these; no piece of the
    vocabulary crosses their borders. They are cut and told apart as bytes, all texts at once.
    """
    parts = [(" " + text).encode() if text else b"" for text in texts]
    blob = b"".join(parts)
    data = np.frombuffer(blob, np.uint8)
    begin = np.cumsum(np.append(0, np.fromiter(map(len, parts), np.int64, len(parts))))
    line, space = data == 0x0A, data == 0x20
    mark = np.zeros(len(data), bool)
    mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    cut = line | mark | space
    cut[1:] &= ~(space[1:] & space[:-1])
    cut[1:] |= line[:-1]
    cut[3:] |= mark[:-3]
    cut[begin[:-1][np.diff(begin) > 0]] = True
    bounds = np.flatnonzero(cut)
    units = pa.LargeStringArray.from_buffers(
        len(bounds), pa.py_buffer(np.append(bounds, len(data)).astype(np.int64)), pa.py_buffer(blob)).dictionary_encode()
    return units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy(), np.diff(np.searchsorted(bounds, begin))


class Trie:
    """The pieces as a tree of characters, followed from many places of a text at once."""

    def __init__(self, model: str):
        pieces, _, _ = vocabulary(model)
        child: dict[tuple[int, int], int] = {}
        piece, weight = [-1], [0.0]
        for text, (i, w) in pieces.items():
            node = 0
            for c in map(ord, text):
                follow = child.get((node, c))
                if follow is None:
                    follow = child[node, c] = len(piece)
                    piece.append(-1)
                    weight.append(0.0)
                node = follow
            piece[node], weight[node] = i, w
        self.piece, self.weight = np.array(piece, np.int32), np.array(weight)
        # Characters that most branches use have a column of a dense table, the others a sorted list.
        uses = Counter(c for _, c in child)
        self.column = np.full(0x110000, -1, np.int16)
        for k, (c, _) in enumerate(uses.most_common(128)):
            self.column[c] = k
        self.row = np.full(len(piece), 0, np.int32)
        inner = sorted({node for node, _ in child})
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.dense = np.zeros((len(inner) + 1, 128), np.int32)
        rare = []
        for (node, c), follow in child.items():
            if self.column[c] >= 0:
                self.dense[self.row[node], self.column[c]] = follow
            else:
                rare.append(((node << 21) + c, follow))
        rare.sort()
        self.keys = np.array([k for k, _ in rare] + [1 << 62], np.int64)
        self.follows = np.array([f for _, f in rare] + [0], np.int32)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node at each character; 0 for none."""
        column = self.column[code]
        out = self.dense[self.row[node], column]
        rare = np.flatnonzero(column < 0)
        if len(rare):
            key = (node[rare].astype(np.int64) << 21) + code[rare]
            at = np.searchsorted(self.keys, key)
            out[rare] = np.where(self.keys[at] == key, self.follows[at], 0)
        return out


class Lattices:
    """The lattices of all units seen so far, as flat arrays of nodes and edges.

    An edge has a piece, the node it leads to (-1: the unit ends), its probability among all ways from its
    node to the unit's end, and the running sum of these in its node.
    """

    def __init__(self, model: str, alpha: float):
        _, self.bytes, self.byte_weight = vocabulary(model)
        self.trie, self.alpha = Trie(model), alpha
        self.space: dict[str, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.piece = np.empty(0, np.int32)
        self.follow = np.empty(0, np.int32)
        self.origin = np.empty(0, np.int32)
        self.log = np.empty(0)
        self.upto = np.empty(0)
        self.first = np.zeros(1, np.int64)

    def grow(self, **more: np.ndarray) -> None:
        """Append to the arrays of these names, in space that is kept and doubled when it is full."""
        for name, values in more.items():
            old, space = getattr(self, name), self.space.get(name)
            size = len(old) + len(values)
            if space is None or len(space) < size:
                space = self.space[name] = np.empty(max(size, 2 * len(old)), old.dtype)
                space[:len(old)] = old
            elif not len(old) or old.base is not space:
                space[:len(old)] = old
            space[len(old):size] = values
            setattr(self, name, space[:size])

    def nodes_of(self, units: list[str]) -> np.ndarray:
        """The first nodes of different units."""
        new = [u for u in units if u not in self.start]
        if new:
            self.build(new)
        return np.fromiter(map(self.start.__getitem__, units), np.int32, len(units))

    def build(self, units: list[str]) -> None:
        text = "".join(units).replace(" ", MARK)
        code = np.frombuffer(text.encode("utf-32-le"), np.int32)
        n = len(code)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(lengths) - lengths
        rest = np.repeat(begin + lengths, lengths) - np.arange(n)  # characters to the unit's end
        literal = [int(begin[k]) for k, u in enumerate(units) if u == MARK]
        # Nodes are places in text, ordered by what is left of their unit: what they lead to comes first.
        order = np.argsort(rest, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        at, node, length = np.arange(n), np.zeros(n, np.int32), 0
        if literal:
            at = np.setdiff1d(at, literal)
            node = node[:len(at)]
        bare = np.ones(n, bool)
        while len(at):
            node = self.trie.step(node, code[at + length])
            length += 1
            held = node > 0
            at, node = at[held], node[held]
            whole = self.trie.piece[node] >= 0
            ends = at[whole]
            if length == 1:
                bare[ends] = False
            found.append((ends, self.trie.piece[node[whole]], self.alpha * self.trie.weight[node[whole]],
                          np.full(len(ends), length)))
            held = rest[at] > length
            at, node = at[held], node[held]
        lone = np.flatnonzero(bare)
        widths = 1 + (code[lone] > 0x7F) + (code[lone] > 0x7FF) + (code[lone] > 0xFFFF)
        found.append((lone, np.full(len(lone), -1, np.int32), self.alpha * self.byte_weight * widths,
                      np.ones(len(lone), np.int64)))
        degree = np.zeros(n, np.int64)
        for ends, *_ in found:
            degree[ends] += 1
        stop = np.cumsum(degree[order])
        first = np.concatenate([[0], stop])
        fill = stop[rank]
        total = int(first[-1])
        piece, weight, target = np.empty(total, np.int32), np.empty(total), np.empty(total, np.int64)
        for ends, pieces, weights, lengths_ in found:  # filled from behind: long pieces, mostly likely, come first
            fill[ends] -= 1
            slot = fill[ends]
            piece[slot], weight[slot] = pieces, weights
            target[slot] = np.where(rest[ends] == lengths_, n, rank[np.minimum(ends + lengths_, n - 1)])
        after = np.zeros(n + 1)
        log, share = np.empty(total), np.empty(total)
        levels = np.concatenate([[0], np.flatnonzero(np.diff(rest[order])) + 1, [n]])
        for low, high in zip(levels[:-1].tolist(), levels[1:].tolist()):
            if low == high:
                continue
            e0, e1 = first[low], first[high]
            value = weight[e0:e1] + after[target[e0:e1]]
            starts, counts = first[low:high] - e0, np.diff(first[low:high + 1])
            top = np.maximum.reduceat(value, starts)
            part = np.exp(value - np.repeat(top, counts))
            mass = np.add.reduceat(part, starts)
            after[low:high] = top + np.log(mass)
            share[e0:e1] = part / np.repeat(mass, counts)
            log[e0:e1] = value - np.repeat(after[low:high], counts)
        counts = np.diff(first)
        running = np.cumsum(share)
        upto = running - np.repeat(running[first[:-1]] - share[first[:-1]], counts)
        upto[first[1:] - 1] = 1.0
        base = len(self.first) - 1
        follow = np.where(target == n, -1, target + base).astype(np.int32)
        origin = np.repeat(np.arange(base, base + n, dtype=np.int32), counts)
        piece, follow, log, upto, origin, first = self.chained(
            code, order, piece, follow, log, upto, origin, first, base + n)
        self.grow(piece=piece, follow=follow, log=log, upto=upto, origin=origin, first=first[1:] + self.first[-1])
        self.start.update(zip(units, (rank[begin] + base).tolist()))

    def chained(self, code, order, piece, follow, log, upto, origin, first, free):
        """Characters without a piece become their bytes; later bytes get nodes of their own, from `free` on."""
        odd = np.flatnonzero(piece < 0)
        more: list[tuple[int, int]] = []
        for e in odd.tolist():
            data = chr(code[order[origin[e] - (free - len(order))]]).encode()
            piece[e] = self.bytes[data[0]]
            last, at = follow[e], free + len(more)
            for m, byte in enumerate(data[1:], 1):
                more.append((self.bytes[byte], at + m if m < len(data) - 1 else last))
            if len(data) > 1:
                follow[e] = at
        if more:
            k = len(more)
            extra = np.array(more, np.int32)
            piece, follow = np.append(piece, extra[:, 0]), np.append(follow, extra[:, 1])
            log, upto = np.append(log, np.zeros(k)), np.append(upto, np.ones(k))
            origin = np.append(origin, np.arange(free, free + k, dtype=np.int32))
            first = np.append(first, first[-1] + np.arange(1, k + 1))
        return piece, follow, log, upto, origin, first


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def seeded(keys: np.ndarray, *parts) -> np.ndarray:
    """64-bit hashes of keys and further numbers."""
    x = keys
    for part in parts:
        x = stirred((x + np.asarray(part).astype(np.uint64)) * GOLDEN + GOLDEN)
    return x


def chances(hashes: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1, in steps of 2^-53."""
    return ((hashes >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


# No Gumbel value of location 0 made from such a number is higher.
HIGHEST = -math.log(-math.log1p(-(2.0 ** -54)))


def drawn(lattices: Lattices, node: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each starting node a path to its unit's end, by its seed: edges in order, and edges per start."""
    first, upto, follow = lattices.first, lattices.upto, lattices.follow
    at, rounds = np.arange(len(node)), []
    counts = np.zeros(len(node), np.int64)
    step = np.uint64(0)
    while len(at):
        u = chances(stirred(seeds[at] + np.array([step]) * GOLDEN))
        edge = first[node]
        short = np.flatnonzero(u >= upto[edge])
        while len(short):
            edge[short] += 1
            short = short[u[short] >= upto[edge[short]]]
        rounds.append((at, edge))
        counts[at] += 1
        node = follow[edge]
        going = node >= 0
        at, node = at[going], node[going]
        step += np.uint64(1)
    out = np.empty(int(counts.sum()), np.int64)
    where = np.cumsum(counts) - counts
    for k, (at, edge) in enumerate(rounds):
        out[where[at] + k] = edge
    return out, counts


def below(phi: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of location `phi`, given that they are below `most`."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = phi - np.log(np.exp(phi - most) - np.log(u))
    return np.where(np.isneginf(phi), -np.inf, out)


class Found:
    """The paths of one round for some texts, and the open sets of paths that leave them.

    `edge` holds all steps of all texts, text by text, `ends` where each begins; `units` the steps of each
    unit. Sets are looked at for the first `HEAD` steps of a text. A set at a later step cannot be higher than its
    shared path's log-probability plus `HIGHEST`; where that might be the best, the steps that might are looked at too.
    """

    HEAD = 48

    def __init__(self, edge, ends, unit_ends, value, turn, begin, taken, keys, lattices):
        self.edge, self.ends, self.unit_ends = edge, ends, unit_ends
        self.value, self.turn, self.begin, self.taken = value, turn, begin, taken
        self.keys, self.lattices = keys, lattices
        self.size = np.diff(ends)
        self.texts = np.flatnonzero(self.size)
        n, log = len(value), lattices.log[edge]
        self.log_prob = np.zeros(n)
        if len(edge):
            self.log_prob[self.texts] = np.add.reduceat(log, ends[:-1][self.texts])
        # Running sums of all steps, and those before each text.
        self.upto = np.append(0.0, np.cumsum(log))
        self.seen = np.zeros(n, np.int64)
        self.top, self.step = np.full(n, -np.inf), np.zeros(n, np.int64)
        # Runs of steps looked at so far: their texts, the first step of each, where its values begin, the values.
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.open_sets(self.texts, np.minimum(self.size, np.maximum(self.HEAD, begin + 1))[self.texts])
        self.look_on(self.texts)

    def open_sets(self, texts: np.ndarray, stop: np.ndarray) -> None:
        """Look at the steps of these texts from those seen up to `stop`."""
        if not len(texts):
            return
        first, start = self.lattices.first, self.seen[texts]
        low = np.cumsum(np.append(0, stop - start))
        text = np.repeat(texts, stop - start)
        place = np.arange(low[-1]) + np.repeat(start - low[:-1], stop - start)
        at = self.ends[text] + place
        edge = self.edge[at]
        before = self.upto[at] - self.upto[self.ends[text]]
        node = self.lattices.origin[edge]
        with np.errstate(divide="ignore"):
            rest = np.where(first[node + 1] - first[node] > 1,
                            np.log(np.maximum(-np.expm1(self.lattices.log[edge]), 1e-300)), -np.inf)
        for k in np.flatnonzero((start <= self.begin[texts]) & (self.begin[texts] < stop)).tolist() if self.taken else ():
            i = int(texts[k])
            if i in self.taken:
                own = low[k] + self.begin[i] - start[k]
                left = [self.lattices.log[e] for e in edges_of(first, node[own]) if e not in self.taken[i]]
                rest[own] = np.logaddexp.reduce(left) if left else -np.inf
        u = chances(seeded(self.keys[text], place, (self.turn << 32) + (1 << 31)))
        values = below(before + rest, self.value[text], u)
        values[place < self.begin[text]] = -np.inf
        self.runs.append((texts, start, low, values))
        self.seen[texts] = stop
        self.improve(texts, start, low, values)

    def improve(self, texts: np.ndarray, start: np.ndarray, low: np.ndarray, values: np.ndarray) -> None:
        """Take over the best of some steps where it is the best so far."""
        most = np.maximum.reduceat(values, low[:-1])
        own = np.repeat(np.arange(len(texts)), np.diff(low))
        hit = np.flatnonzero(values == most[own])[::-1]
        where = np.zeros(len(texts), np.int64)
        where[own[hit]] = hit - low[own[hit]]
        better = most > self.top[texts]
        self.top[texts[better]] = most[better]
        self.step[texts[better]] = (start + where)[better]

    def look_on(self, texts: np.ndarray) -> None:
        """Look at all later steps of these texts that could exceed the best so far."""
        texts = texts[self.seen[texts] < self.size[texts]]
        # Running sums fall from step to step; the bound allows for their rounding.
        until = self.upto[self.ends[:-1][texts]] + self.top[texts] - HIGHEST - 1e-6
        stop = np.fromiter((np.searchsorted(-self.upto[a:b], -x, "right") for a, b, x in zip(
            self.ends[:-1][texts].tolist(), self.ends[1:][texts].tolist(), until.tolist())), np.int64, len(texts))
        more = stop > self.seen[texts]
        self.open_sets(texts[more], stop[more])

    def close(self, texts: np.ndarray) -> None:
        """Take the best sets of these texts away and find the next best."""
        steps = self.step[texts]
        self.top[texts] = -np.inf
        closed = np.full(len(self.value), -1, np.int64)
        closed[texts] = steps
        for own, start, low, values in self.runs:
            gone = np.flatnonzero((closed[own] >= start) & (closed[own] < start + np.diff(low)))
            values[low[gone] + closed[own[gone]] - start[gone]] = -np.inf
            self.improve(own, start, low, values)
        self.look_on(texts)


def edges_of(first: np.ndarray, node: int) -> range:
    return range(int(first[node]), int(first[node + 1]))


def segmentations(texts: list[str | None], keys: np.ndarray, samples: int, lattices: Lattices) -> tuple[list, np.ndarray]:
    """The rounds' found paths, best first for each text, and the value of the best set left unopened."""
    n = len(texts)
    distinct, units, size = units_of(texts)
    start = lattices.nodes_of(distinct)[units]
    first, log, follow = lattices.first, lattices.log, lattices.follow
    owner = np.repeat(np.arange(n), size)
    unit_low = np.cumsum(np.append(0, size))
    number = np.arange(len(units)) - unit_low[owner]
    keys = keys.astype(np.int64).view(np.uint64)
    value = -np.log(-np.log(chances(seeded(keys, 1 << 40))))
    edge, counts = drawn(lattices, start, seeded(keys[owner], number, 0))
    unit_ends = np.cumsum(np.append(0, counts))
    rounds = [Found(edge, unit_ends[unit_low], unit_ends, value, 0, np.zeros(n, np.int64), {}, keys, lattices)]
    while True:
        tops = np.stack([r.top for r in rounds])
        which = tops.argmax(axis=0)
        value = tops[which, np.arange(n)]
        live = np.flatnonzero(np.isfinite(value))
        if len(rounds) == samples or not len(live):
            return rounds, value
        turn = len(rounds)
        u = chances(seeded(keys, (turn << 32) + (1 << 30)))
        begin, taken = np.zeros(n, np.int64), {}
        left = np.full(n, len(units))  # the unit in which a text's new path leaves the old one
        heads, head_texts, again = [], [], []
        for i in live.tolist():
            old = rounds[which[i]]
            step, low = int(old.step[i]), int(old.ends[i])
            node = int(lattices.origin[old.edge[low + step]])
            gone = set(old.taken.get(i, ())) if step == old.begin[i] else set()
            gone.add(int(old.edge[low + step]))
            free = [e for e in edges_of(first, node) if e not in gone]
            weights = np.cumsum(np.exp(log[free] - log[free].max()))
            chosen = free[int(np.searchsorted(weights, u[i] * weights[-1]))]
            begin[i], taken[i] = step, gone | {chosen}
            # The last unit of this text that begins at or before the step.
            left[i] = np.searchsorted(old.unit_ends[unit_low[i]:unit_low[i + 1]], low + step, "right") - 1 + unit_low[i]
            head = old.edge[low:low + step + 1].copy()
            head[-1] = chosen
            heads.append((head, old.unit_ends[unit_low[i]:left[i] + 1] - low))
            again.append(int(follow[chosen]))
        for r in set(which[live].tolist()):
            rounds[r].close(live[which[live] == r])
        # The rest of the unit that was left, and all later units, are drawn anew.
        again = np.array(again, np.int64)
        later = np.flatnonzero(np.arange(len(units)) > left[owner])
        going = live[again >= 0]
        at = np.concatenate([left[going], later])
        node = np.concatenate([again[again >= 0], start[later]])
        order = np.argsort(at, kind="stable")
        at, node = at[order], node[order].astype(np.int64)
        edge, counts = drawn(lattices, node, seeded(keys[owner[at]], number[at], turn))
        # Steps of each unit: shared ones, those up to the chosen edge, and drawn ones.
        per_unit = np.zeros(len(units), np.int64)
        per_unit[at] = counts
        for i, (head, ends) in zip(live.tolist(), heads):
            per_unit[unit_low[i]:left[i]] = np.diff(ends)
            per_unit[left[i]] += len(head) - ends[-1]
        unit_ends = np.cumsum(np.append(0, per_unit))
        path = np.empty(int(unit_ends[-1]), np.int64)
        is_fresh = np.ones(len(path), bool)
        for i, (head, _) in zip(live.tolist(), heads):
            low = unit_ends[unit_low[i]]
            path[low:low + len(head)] = head
            is_fresh[low:low + len(head)] = False
        path[is_fresh] = edge
        rounds.append(Found(path, unit_ends[unit_low], unit_ends, value, turn, begin, taken, keys, lattices))


def sample_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, samples: int = 2,
                  alpha: float = ALPHA, model: str = MODEL, decode: bool = False) -> DataFrame:
    """`id, sample (from 1), ids, log_prob, perturbed, inclusion`: distinct segmentations of every whole text.

    With `decode`, every sample's ids are decoded at once, as `decode_pieces` does, next to the text they were made of:
    `decoded_sha256` of the decoded text's UTF-8 bytes, and `round_trip`, whether it is the text (null: empty).
    """
    holder: list[Lattices] = []
    names = [id_column, "sample", "ids", "log_prob", "perturbed", "inclusion", *(["decoded_sha256", "round_trip"] if decode else [])]
    known: list[pa.LargeBinaryArray] = []

    def told(ids: pa.ListArray, texts: list[str]) -> list[pa.Array]:
        if not known:
            known.append(piece_bytes(model))
        decoded = texts_of(ids, known[0])
        return [pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                pa.array([d == t for d, t in zip(decoded, texts)], pa.bool_())]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not holder:
            holder.append(Lattices(model, alpha))
        lattices = holder[0]
        texts, keys = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        low = 0
        while low < len(texts):
            high, held = low, 0
            while high < len(texts) and (high == low or held + len(texts[high] or "") <= CHARACTERS):
                held += len(texts[high] or "")
                high += 1
            if len(lattices.first) > REMEMBERED:
                lattices.clear()
            rounds, left = segmentations(texts[low:high], keys[low:high], samples, lattices)
            pieces = lattices.piece
            for turn, r in enumerate(rounds):
                rows = np.arange(high - low) if turn == 0 else r.texts
                with np.errstate(over="ignore"):
                    inclusion = -np.expm1(-np.exp(r.log_prob - left))
                ends = np.append(r.ends[:-1][rows], len(r.edge)).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(pieces[r.edge]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low).take(pa.array(rows)),
                    pa.array(np.full(len(rows), turn + 1, np.int32)),
                    ids, pa.array(r.log_prob[rows]), pa.array(r.value[rows]), pa.array(inclusion[rows]),
                    *(told(ids, [texts[low + i] or "" for i in rows.tolist()]) if decode else []),
                ], names=names)
            low = high

    kind = docs.schema[id_column].dataType.simpleString()
    keyed = docs.select(F.col(id_column), F.col(text_column), F.xxhash64(id_column).alias("row_key"))
    return by_batch(keyed, run, f"`{id_column}` {kind}, sample int, ids array<int>, log_prob double, "
                                "perturbed double, inclusion double" + (", decoded_sha256 string, round_trip boolean" if decode else ""), rows=TEXTS)


def decode_pieces(encoded: DataFrame, ids_column: str = "ids", text_column: str = "text", *,
                  model: str = MODEL) -> DataFrame:
    """`encoded` with the text of its piece ids; ids without a text of their own give none, null lists a null text.

    The bytes of all pieces of a run of rows are gathered at once, at most `CHARACTERS` pieces or one longer row at a time.
    """
    held: list[pa.Array] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not held:
                held.append(piece_bytes(model))
            lists = batch.column(batch.schema.get_field_index(ids_column))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = (np.flatnonzero(np.diff(ends // CHARACTERS)) + 1).tolist()
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                texts = texts_of(lists.slice(start, stop - start), held[0])
                yield batch.slice(start, stop - start).append_column(text_column, pa.array(texts, pa.string()))

    rest = encoded.drop(text_column)
    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(text_column, StringType())]))


def piece_bytes(model: str) -> pa.LargeBinaryArray:
    """The bytes of each piece by its id, and an empty entry at the end."""
    pieces, bytes_, _ = vocabulary(model)
    known = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(bytes_)}
    return pa.array([known.get(i, b"") for i in range(max(known) + 2)], pa.large_binary())


def texts_of(lists: pa.ListArray, known: pa.LargeBinaryArray) -> list[str | None]:
    """The text of each list of piece ids; the last entry of `known`, which is empty, stands for all ids it does not hold."""
    ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
    ids = np.where((ids < 0) | (ids >= len(known)), len(known) - 1, ids)
    gathered = known.take(pa.array(ids))
    offsets = np.frombuffer(gathered.buffers()[1], np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = memoryview(gathered.buffers()[2] or b"")
    sizes = pc.list_value_length(lists).to_pylist()
    out, at = [], 0
    for n in sizes:
        if n is None:
            out.append(None)
            continue
        piece = bytes(data[offsets[at]:offsets[at + n]])
        out.append(piece.decode("utf-8", "replace").removeprefix(" "))
        at += n
    return out
