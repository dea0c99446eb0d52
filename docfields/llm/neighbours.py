"""Approximate nearest neighbours over learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced parts by recursive bisection: a smoothed
random vector splits a part at its median, and swaps that cut fewer edges refine it. A small classifier
learns, from a vector, how its neighbours spread over the parts. Every row is filed under its most probable
part; a query is routed to its most probable parts until they hold `mass` of the probability and more rows than asked
for, and the rows there are reranked by their exact distances.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of
another length than most of the sample's do not either; ties go to the smaller id; a query never meets a row with
its own id; repeated rows are rows of their own; an empty table gives an empty one.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import by_batch, written
from docfields.llm.topk import ranked, usable

SAMPLE = 4096
PARTS = 16
GRAPH = 10
MASS = 0.97
HIDDEN = 64
CANDIDATES = 16384
QUERIES = 2048


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The `k` nearest others of each sampled row."""
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for low in range(0, len(x), 512):
        d = square[low:low + 512, None] + square - 2 * x[low:low + 512] @ x.T
        d[np.arange(len(d)), low + np.arange(len(d))] = np.inf
        out[low:low + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisected(members: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A balanced split of `members` that cuts few edges: True for one half."""
    n = len(members)
    where = np.full(len(graph), -1)
    where[members] = np.arange(n)
    source, target = np.repeat(np.arange(n), graph.shape[1]), where[graph[members]].ravel()
    held = target >= 0
    source, target = np.append(source[held], target[held]), np.append(target[held], source[held])
    degree = np.bincount(source, minlength=n) + 1e-9
    value = rng.standard_normal(n)
    for _ in range(60):
        value = (value + np.bincount(source, value[target], minlength=n) / degree) / 2
        value -= value.mean()
        value /= np.abs(value).max() + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(value, kind="stable")[n // 2:]] = True
    for _ in range(20):
        cut = np.bincount(source, side[source] != side[target], minlength=n)
        gain = 2 * cut - degree
        a, b = (np.flatnonzero(side == s) for s in (False, True))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        worth = np.flatnonzero(gain[a[:m]] + gain[b[:m]] > 0)[:max(1, n // 50)]
        if not len(worth):
            break
        moved = side.copy()
        moved[a[worth]], moved[b[worth]] = True, False
        if (moved[source] != moved[target]).sum() >= (side[source] != side[target]).sum():
            break
        side = moved
    return side


def partitioned(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """The part of each sampled row; `parts` is a power of two."""
    part, split = np.zeros(len(graph), np.int64), 1
    while split < parts:
        for p in range(split):
            members = np.flatnonzero(part == p)
            if len(members) > 1:
                part[members[bisected(members, graph, rng)]] += split
        split *= 2
    return part


@dataclass
class Router:
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.spread)[1]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.layers
        h = np.maximum(x @ w + b, 0)
        s = h @ v + c
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return h, e / e.sum(axis=1, keepdims=True)


def trained(x: np.ndarray, parts: int = PARTS, seed: int = 0) -> Router:
    """The classifier of a sample: cross-entropy against the spread of each row's neighbours, by Adam."""
    rng = np.random.default_rng(seed)
    k = min(GRAPH, len(x) - 1)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-12
    layers = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN),
              rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
    router = Router(mean, spread, layers)
    if k < 1:
        return router
    graph = neighbour_graph(x, k)
    part = partitioned(graph, parts, rng)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x)), part), 1)
    np.add.at(goal, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 1)
    goal /= goal.sum(axis=1, keepdims=True)
    z = (x - mean) / spread
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    step = 0
    for _ in range(30):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 128):
            rows = order[low:low + 128]
            h, p = router.forward(z[rows])
            error = (p - goal[rows]) / len(rows)
            d_h = error @ layers[2].T * (h > 0)
            step += 1
            for p_, m, g in zip(layers, moments, (z[rows].T @ d_h, d_h.sum(axis=0), h.T @ error, error.sum(axis=0))):
                m[0][...] = 0.9 * m[0] + 0.1 * g
                m[1][...] = 0.999 * m[1] + 0.001 * g * g
                p_ -= 0.003 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)
    return router


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def nearest_of_block(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("id", kind="stable")
            ids, c = candidates["id"].to_numpy(), np.stack(candidates["vector"])
            q, owns = np.stack(queries["vector"]), queries["id"].to_numpy()
            square = (c * c).sum(axis=1)
            for low in range(0, len(q), 256):
                part = q[low:low + 256]
                rough = square + (part * part).sum(axis=1)[:, None] - 2 * part @ c.T
                # Rounding moves a squared distance by less than this.
                slack = 1e-10 * (square.max() + (part * part).sum(axis=1)) + 1e-300
                for own, vector, d, s in zip(owns[low:low + 256], part, rough, slack):
                    d[ids == own] = np.inf
                    reach = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                    rows = np.flatnonzero((d <= reach + 2 * s) & (ids != own))
                    exact = np.sqrt(((c[rows] - vector) ** 2).sum(axis=1))
                    order = np.argsort(exact, kind="stable")[:k]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[rows[order]], "score": exact[order]}))
        if not out:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        return pd.concat(out)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id",
            vector_column: str = "embedding", *, sample: int = SAMPLE, parts: int = PARTS,
            mass: float = MASS) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` nearest rows found for each query."""
    spark = vectors.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        vector = F.transform(F.col(vector_column), lambda x: x.cast("double"))
        return df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("raw"), vector.alias("vector")).where(
            F.col("id").isNotNull() & usable(F.col("raw")) & F.exists("vector", lambda x: x != 0)).drop("raw")

    rows, asked = prepared(vectors), prepared(queries)
    picked = rows.orderBy(F.xxhash64("id", F.lit("sample"))).limit(sample).collect()
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = Counter(len(r["vector"]) for r in picked).most_common(1)[0][0]
    picked = sorted((r["id"], r["vector"]) for r in picked if len(r["vector"]) == width)
    router = spark.sparkContext.broadcast(trained(np.array([v for _, v in picked]), parts))
    of_width = F.size("vector") == width

    def file(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        part = router.value.probabilities(matrix(batch.column(1), width)).argmax(axis=1).astype(np.int32)
        yield batch.append_column("part", pa.array(part))

    index = written(by_batch(rows.where(of_width), file, "id long, vector array<double>, part int", rows=4096))
    held = np.zeros(parts, np.int64)
    for r in index.groupBy("part").count().collect():
        held[r["part"]] = r["count"]
    need = k + 1

    def route(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = router.value.probabilities(matrix(batch.column(1), width))
        order = np.argsort(-p, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        count = np.cumsum(held[order], axis=1)
        # A part is taken if those before it hold too little probability or too few rows.
        taken = np.ones_like(order, bool)
        taken[:, 1:] = (sums[:, :-1] < mass) | (count[:, :-1] < need)
        at, place = np.nonzero(taken)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                                          pa.array(order[at, place].astype(np.int32))], names=["id", "vector", "part"])

    routed = written(by_batch(asked.where(of_width), route, "id long, vector array<double>, part int", rows=4096))
    came = np.zeros(parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        came[r["part"]] = r["count"]
    # Large parts are searched in blocks of rows and of queries.
    down, across = np.maximum(-(-held // CANDIDATES), 1), np.maximum(-(-came // QUERIES), 1)
    counts = [F.array(*[F.lit(int(n)) for n in x]) for x in (down, across)]

    def blocks(df: DataFrame, own: str, other: str, own_count, other_count) -> DataFrame:
        of_part = lambda c: F.element_at(c, F.col("part") + 1)
        return df.withColumn(own, F.pmod(F.xxhash64("id"), of_part(own_count)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), of_part(other_count) - 1)))

    left = blocks(routed, "q", "c", counts[1], counts[0])
    right = blocks(index, "c", "q", counts[0], counts[1])
    keys = ["part", "q", "c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        nearest_of_block(k), "query_id long, vec_id long, score double")
    return ranked(found, k, F.col("score"))
