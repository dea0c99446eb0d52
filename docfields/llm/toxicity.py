"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is an embedding of the word and the mean embedding of its character n-grams, both from hashed
tables, with the most telling n-gram's evidence beside them. The tables start from how much more often a bucket
is found in toxic documents, and are trained with the network. Each document is scored over all windows of
`WINDOW` words, each overlapping the next by half; its score is a logistic function of the highest window and the number
of windows.

Documents have labels, windows have none: a toxic document is represented by the window with the most evidence,
others by that and a random one.

The network is trained on a bounded sample: about `PER_CLASS` documents of either label, by a hash of the id.
Only text is an input of a score.

Defined results: null texts and texts without words have the score of no evidence, the calibrated one at the
lowest window score; with no documents of both labels to learn from, every score is 0; a document with several
labels is toxic if one says so; repeated rows get equal scores; an empty table gives an empty one.
"""

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import by_batch

WINDOW, STRIDE = 80, 40
WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 17
DIMENSION, HIDDEN = 4, 8
ORDERS = (3, 4, 5)
PER_CLASS = 2500
EPOCHS, BATCH, RATE = 4, 128, 0.02
WORD = re.compile(r"\w+")
# Words whose features a worker remembers.
REMEMBERED = 300_000


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of `<word>`, word by word, and where each word's begin (and the end)."""
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    counts = sum(np.maximum(lengths - n + 1, 0) for n in ORDERS)
    starts = np.concatenate([[0], np.cumsum(counts)])
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))
    word = np.repeat(np.arange(len(words)), lengths)
    out, fill, rolled = np.empty(starts[-1], np.int64), starts[:-1].copy(), np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        size = max(len(code) - n + 1, 0)
        rolled = rolled[:size] * np.uint32(0x01000193) ^ code[n - 1:]
        if n in ORDERS:
            at = np.flatnonzero(rest[:size] >= n)
            mixed = (rolled[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
            owner = word[at]
            per = np.bincount(owner, minlength=len(words))
            place = np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per)
            out[fill[owner] + place] = mixed >> np.uint32(15) & np.uint32(GRAM_BUCKETS - 1)
            fill += per
    return out, starts


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters; `p` holds both directions' gates (0: forward, 1: backward), the attention and the output."""

    words: np.ndarray
    grams: np.ndarray
    evidence: np.ndarray
    p: dict[str, np.ndarray]
    calibration: tuple[float, float, float] = (1.0, 0.0, 0.0)
    memory: dict[str, int] = field(default_factory=dict)
    inputs: np.ndarray | None = None

    def features(self, words: list[str]) -> np.ndarray:
        """The network's input of each word."""
        buckets, starts = gram_buckets(words)
        counts = np.maximum(np.diff(starts), 1)[:, None]
        mean = np.add.reduceat(np.vstack([self.grams[buckets], np.zeros((1, DIMENSION), np.float32)]), starts[:-1]) / counts
        most = np.maximum.reduceat(np.append(self.evidence[buckets], 0), starts[:-1])
        own = self.words[[word_bucket(w) for w in words]]
        return np.hstack([own, mean, most[:, None]]).astype(np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray) -> dict:
        """Window scores from inputs `x` (window, place, input); what training needs is kept."""
        kept = {"x": x, "mask": mask}
        hs = []
        for d in (0, 1):
            gates = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
            hs.append(self.recur(gates, mask, d, kept))
        h = np.concatenate(hs, axis=2)
        t = np.tanh(h @ self.p["A"])
        score = t @ self.p["a"] + np.where(mask, 0, -1e9)
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (weight[:, :, None] * h).sum(axis=1)
        kept |= {"h": h, "t": t, "weight": weight, "pooled": pooled}
        kept["logit"] = pooled @ self.p["o"] + self.p["c"]
        return kept

    def recur(self, gates: np.ndarray, mask: np.ndarray, d: int, kept: dict | None,
              words: np.ndarray | None = None) -> np.ndarray:
        """States of one direction; `gates` of all places, or of the `words` that stand in them."""
        n, steps = mask.shape
        u, hidden = self.p[f"U{d}"], HIDDEN
        h, out, states = np.zeros((n, hidden), np.float32), np.zeros((n, steps, hidden), np.float32), {}
        for s in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g = gates[:, s] if words is None else gates[words[:, s]]
            zr = sigmoid(g[:, :2 * hidden] + h @ u[:, :2 * hidden])
            z, r = zr[:, :hidden], zr[:, hidden:]
            c = np.tanh(g[:, 2 * hidden:] + (r * h) @ u[:, 2 * hidden:])
            new = h + z * (c - h)
            live = mask[:, s, None]
            if kept is not None:
                states[s] = (h, z, r, c)
            h = np.where(live, new, h)
            out[:, s] = h
        if kept is not None:
            kept[f"states{d}"] = states
        return out

    def gradients(self, kept: dict, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all parameters and of the inputs, given those of the window scores."""
        p, x, mask, h, t, weight = self.p, kept["x"], kept["mask"], kept["h"], kept["t"], kept["weight"]
        g = {"o": kept["pooled"].T @ error, "c": error.sum(keepdims=True)}
        d_pool = error[:, None] * p["o"]
        d_h = weight[:, :, None] * d_pool[:, None, :]
        d_weight = (h * d_pool[:, None, :]).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["a"] = np.einsum("ns,nsk->k", d_score, t)
        d_t = d_score[:, :, None] * p["a"] * (1 - t * t)
        g["A"] = np.einsum("nsh,nsk->hk", h, d_t)
        d_h = d_h + d_t @ p["A"].T
        d_x = np.zeros_like(x)
        for d in (0, 1):
            u, hd = p[f"U{d}"], HIDDEN
            d_u, d_gates = np.zeros_like(u), np.zeros((*x.shape[:2], 3 * hd), np.float32)
            back = np.zeros((len(x), hd), np.float32)
            for s in range(x.shape[1] - 1, -1, -1) if d == 0 else range(x.shape[1]):
                before, z, r, c = kept[f"states{d}"][s]
                live = mask[:, s, None]
                total = back + d_h[:, s, d * hd:(d + 1) * hd]
                d_new = total * live
                d_c = d_new * z * (1 - c * c)
                d_z = d_new * (c - before) * z * (1 - z)
                d_rh = d_c @ u[:, 2 * hd:].T
                d_r = d_rh * before * r * (1 - r)
                d_zr = np.hstack([d_z, d_r])
                d_u[:, :2 * hd] += before.T @ d_zr
                d_u[:, 2 * hd:] += (r * before).T @ d_c
                back = total * ~live + d_new * (1 - z) + d_rh * r + d_zr @ u[:, :2 * hd].T
                d_gates[:, s] = np.hstack([d_zr, d_c])
            g[f"U{d}"], g[f"b{d}"] = d_u, d_gates.sum(axis=(0, 1))
            g[f"W{d}"] = np.einsum("nsi,nsk->ik", x, d_gates)
            d_x += d_gates @ p[f"W{d}"].T
        return g, d_x

    def best_windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its highest window score (that of no window: the output's bias) and its windows."""
        ids, starts = self.numbered(texts)
        windows, owner = windows_of(starts)
        best = np.full(len(texts), float(self.p["c"][0]))
        count = np.bincount(owner, minlength=len(texts))
        # Words recur, so their part of the gates is worked out once.
        gates = [(self.inputs @ self.p[f"W{d}"] + self.p[f"b{d}"]).astype(np.float32) for d in (0, 1)]
        for low in range(0, len(windows), 2048):
            at = windows[low:low + 2048]
            places = np.minimum(at[:, :1] + np.arange(WINDOW), len(ids) - 1)
            mask = np.arange(WINDOW) < at[:, 1:]
            words = ids[places]
            h = np.concatenate([self.recur(gates[d], mask, d, None, words) for d in (0, 1)], axis=2)
            score = np.tanh(h @ self.p["A"]) @ self.p["a"] + np.where(mask, 0, -1e9)
            weight = np.exp(score - score.max(axis=1, keepdims=True))
            weight /= weight.sum(axis=1, keepdims=True)
            logit = np.einsum("ns,nsh->nh", weight, h) @ self.p["o"] + self.p["c"]
            part = owner[low:low + 2048]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            high = np.maximum.reduceat(logit, first)
            whole = part[first]
            fresh = np.ones(len(first), bool)
            fresh[0] = low == 0 or owner[low - 1] != whole[0]  # a text's windows may go on from the piece before
            best[whole] = np.where(fresh, high, np.maximum(best[whole], high))
        return best, count

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words as rows of `inputs`, and where each text's begin (and the end)."""
        if len(self.memory) > REMEMBERED:
            self.memory, self.inputs = {}, None
        lists = [WORD.findall(t.lower()) if t else [] for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        every = [w for own in lists for w in own]
        new = [w for w in dict.fromkeys(every) if w not in self.memory]
        if new or self.inputs is None:
            rows = self.features(new) if new else np.zeros((0, INPUTS), np.float32)
            held = self.inputs if self.inputs is not None else np.zeros((0, INPUTS), np.float32)
            self.memory.update(zip(new, range(len(held), len(held) + len(new))))
            self.inputs = np.vstack([held, rows])
        return np.fromiter(map(self.memory.__getitem__, every), np.int64, len(every)), starts

    def score(self, texts: list[str | None]) -> np.ndarray:
        best, count = self.best_windows(texts)
        a, b, c = self.calibration
        return sigmoid(a * best + b * np.log1p(count) + c)


INPUTS = 2 * DIMENSION + 1
# The inputs that start from evidence: of the word, the mean and the most of its n-grams.
MOVED = (0, DIMENSION, 2 * DIMENSION)
# One text of so many calibrates.
ASIDE = 5


def windows_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`(start, length)` of all windows and their texts; the last window of a text ends with it."""
    sizes = np.diff(starts)
    count = np.where(sizes > 0, np.maximum(-(-(sizes - WINDOW) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(place * STRIDE, np.maximum(sizes[owner] - WINDOW, 0))
    return np.stack([starts[:-1][owner] + begin, np.minimum(sizes[owner], WINDOW)], axis=1), owner


def odds(held: np.ndarray, total: tuple[int, int], prior: float = 1.0) -> np.ndarray:
    """Log ratio of the shares of toxic and other documents that hold a bucket, drawn to 0 where few do."""
    base = held.sum(axis=0) / sum(total)
    share = [(held[k] + prior * base) / (total[k] + prior) for k in (0, 1)]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(base > 0, np.log(share[1]) - np.log(share[0]), 0.0).clip(-4, 6)


def without_one(held: tuple[np.ndarray, ...], total: tuple[int, int], label: int) -> list[np.ndarray]:
    """The `odds` of each table as a document with this label sees them: without itself."""
    rest = tuple(n - (k == label) for k, n in enumerate(total))
    own = np.array([[1.0 if k == label else 0.0] for k in (0, 1)])
    return [odds(np.maximum(h - own, 0), rest) for h in held]


def trained(texts: list[str], labels: list[int], shift: float = 0.0, seed: int = 0) -> Network | None:
    """The network of some texts. `shift` moves the scores from the sample's share of labels to that of all rows.

    A fifth of the texts is held aside and calibrates the scores, if it has both labels; the others train the network. What a text
    being learned from is told of its own words is counted without it, as it is for texts that come later.
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    aside = rng.permutation(len(y)) % ASIDE == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    every_text, every_y = texts, y
    texts, y = [t for t, a in zip(texts, aside) if not a], y[~aside]
    lists = [WORD.findall((t or "").lower()) for t in texts]
    known = {w: k for k, w in enumerate(dict.fromkeys(w for own in lists for w in own))}
    vocabulary = list(known)
    buckets, starts = gram_buckets(vocabulary)
    owns = np.array([word_bucket(w) for w in vocabulary], np.int64)
    ids = [np.fromiter((known[w] for w in own), np.int64, len(own)) for own in lists]
    held = np.zeros((2, WORD_BUCKETS)), np.zeros((2, GRAM_BUCKETS))
    for own, label in zip(ids, y):
        distinct = np.unique(own)
        held[0][label, np.unique(owns[distinct])] += 1
        spans = [buckets[starts[w]:starts[w + 1]] for w in distinct]
        if spans:
            held[1][label, np.unique(np.concatenate(spans))] += 1
    total = int((y == 0).sum()), int((y == 1).sum())
    word_odds, gram_odds = (odds(h, total) for h in held)
    scale = 0.1
    net = Network(
        np.hstack([word_odds[:, None], scale * rng.standard_normal((WORD_BUCKETS, DIMENSION - 1))]).astype(np.float32),
        np.hstack([gram_odds[:, None], scale * rng.standard_normal((GRAM_BUCKETS, DIMENSION - 1))]).astype(np.float32),
        gram_odds.astype(np.float32), {})
    for d in (0, 1):
        net.p[f"W{d}"] = (rng.standard_normal((INPUTS, 3 * HIDDEN)) / np.sqrt(INPUTS)).astype(np.float32)
        net.p[f"U{d}"] = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        net.p[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
    net.p["A"] = (rng.standard_normal((2 * HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
    net.p["a"] = (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
    net.p["o"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
    net.p["c"] = np.zeros(1, np.float32)
    # The strongest words of a window are its evidence.
    counts = np.maximum(np.diff(starts), 1)
    evidence, moved = [], []
    for label in (0, 1):
        words_, grams_ = without_one(held, total, label)
        most = np.maximum.reduceat(np.append(grams_[buckets], 0), starts[:-1])
        evidence.append(np.maximum(words_[owns], most))
        # What is taken from each input of a word: its own odds, the mean and the most of its n-grams.
        mean = np.add.reduceat(np.append((grams_ - gram_odds)[buckets], 0), starts[:-1]) / counts
        before = np.maximum.reduceat(np.append(gram_odds[buckets], 0), starts[:-1])
        moved.append(np.stack([(words_ - word_odds)[owns], mean, most - before], axis=1).astype(np.float32))
    moved = np.stack(moved)
    examples, targets = [], []
    for own, label in zip(ids, y):
        at, _ = windows_of(np.array([0, len(own)]))
        if not len(at):
            continue
        sums = [np.sort(evidence[label][own[s:s + n]])[-3:].sum() for s, n in at]
        picks = {int(np.argmax(sums))} | (set() if label else {int(rng.integers(len(at)))})
        for k in picks:
            s, n = at[k]
            examples.append(np.pad(own[s:s + n], (0, WINDOW - n), constant_values=-1))
            targets.append(label)
    examples, targets = np.array(examples), np.array(targets, np.float32)
    balance = np.where(targets == 1, len(targets) / 2 / max(targets.sum(), 1), len(targets) / 2 / max((1 - targets).sum(), 1))
    squares = {k: np.full_like(v, 1e-8) for k, v in net.p.items()}
    table_squares = np.full_like(net.words, 1e-8), np.full_like(net.grams, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for low in range(0, len(order), BATCH):
            rows = order[low:low + BATCH]
            mask = examples[rows] >= 0
            used, back = np.unique(examples[rows][mask], return_inverse=True)
            x = np.zeros((*mask.shape, INPUTS), np.float32)
            x[mask] = net.features([vocabulary[w] for w in used])[back]
            x[np.nonzero(mask) + (np.array(MOVED)[:, None],)] += moved[np.repeat(targets[rows].astype(int), mask.sum(axis=1)), used[back]].T
            kept = net.run(x, mask)
            error = ((sigmoid(kept["logit"]) - targets[rows]) * balance[rows] / len(rows)).astype(np.float32)
            g, d_x = net.gradients(kept, error)
            for k, v in g.items():
                squares[k] += v * v
                net.p[k] -= RATE * v / np.sqrt(squares[k])
            per_word = np.zeros((len(used), INPUTS), np.float32)
            np.add.at(per_word, back, d_x[mask])
            counts = np.diff(starts)[used]
            at = np.concatenate([buckets[starts[w]:starts[w + 1]] for w in used]) if len(used) else np.empty(0, np.int64)
            shares = per_word[:, DIMENSION:2 * DIMENSION] / np.maximum(counts, 1)[:, None]
            for table, square, place, gradient in (
                    (net.words, table_squares[0], owns[used], per_word[:, :DIMENSION]),
                    (net.grams, table_squares[1], at, np.repeat(shares, counts, axis=0))):
                touched, to = np.unique(place, return_inverse=True)
                total_g = np.zeros((len(touched), DIMENSION), np.float32)
                np.add.at(total_g, to, gradient)
                square[touched] += total_g * total_g
                table[touched] -= RATE * total_g / np.sqrt(square[touched])
    a, b, c = calibrated(net, [t for t, k in zip(every_text, aside) if k], every_y[aside]) if aside.any() else calibrated(net, texts, y)
    net.calibration = a, b, c + shift
    net.memory, net.inputs = {}, None
    return net


def calibrated(net: Network, texts: list[str], y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the labels on the highest window and the number of windows, by Newton steps."""
    best, count = [], []
    for low in range(0, len(texts), 500):
        b, n = net.best_windows(texts[low:low + 500])
        best.append(b)
        count.append(n)
    x = np.stack([np.concatenate(best), np.log1p(np.concatenate(count)), np.ones(len(y))], axis=1)
    # Features of unit spread; a small penalty keeps separable labels finite.
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[2], spread[2] = 0.0, 1.0
    x = (x - mean) / spread

    def loss(w):
        return np.logaddexp(0, x @ w).sum() - (y * (x @ w)).sum() + 0.5 * (w[:2] ** 2).sum()

    w = np.zeros(3)
    for _ in range(50):
        p = sigmoid(x @ w)
        penalty = np.array([1.0, 1.0, 1e-6])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    w = w / spread
    w[2] -= (w[:2] * mean[:2]).sum()
    return tuple(w.tolist())


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "toxic", *, per_class: int = PER_CLASS) -> Network | None:
    """The network of the documents that have a label."""
    marked = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(
        F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    shares = [min(1.0, per_class / max(sizes.get(k, 0), 1)) for k in (0, 1)]
    share = F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])
    chance = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # The sample's ids are bounded by `per_class`, so they go to the texts.
    sample = texts.join(F.broadcast(marked.where(chance < share)), "id").collect()
    sample.sort(key=lambda r: (r["id"], r["text"] or ""))
    return trained([r["text"] for r in sample], [r["label"] for r in sample], math.log(shares[0] / shares[1]))


def score(docs: DataFrame, network: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id, score`: how probably each whole text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # tables of a fixed size
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        net, texts = shared.value, batch.column(1).to_pylist()
        scores = np.zeros(len(texts)) if net is None else net.score(texts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[id_column, "score"])

    return by_batch(docs.select(id_column, text_column), run, f"`{id_column}` {kind}, score double", rows=400)
