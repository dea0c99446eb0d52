"""Exact highest inner products: term-at-a-time accumulation in blocks.

A vector is a sparse row of terms (its dimensions) and whole-number weights. Candidates are dealt into blocks
that hold a postings list per term; queries are dealt into blocks as well. For each query, term after term,
the query's weight times the postings' weights is scattered into a dense array of scores; a partition
selection takes the block's best, and the blocks' best are merged. No candidate is left out.

Defined results: vectors that are null or hold null or non-finite components take no part; an empty vector
scores 0 with everything; missing dimensions count as 0; ties go to the smaller id; repeated rows are rows of
their own, but a query never meets a row with its own id. Scores are 64-bit and wrap as longs do.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 1024


def usable(vector: Column) -> Column:
    """Whether a vector takes part. Nulls, NaN and infinities in it are all caught by one test per component."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))


def whole_weights(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def postings(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each term, the rows that hold it and their weights."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    weights = np.concatenate([np.asarray(v, np.int64) for v in vectors]) if len(vectors) else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(vectors)), lengths)
    terms = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held = weights != 0
    rows, terms, weights = rows[held], terms[held], weights[held]
    order = np.argsort(terms, kind="stable")
    rows, terms, weights = rows[order], terms[order], weights[order]
    cuts = np.flatnonzero(np.diff(terms)) + 1
    starts = np.concatenate([[0], cuts])
    return {int(terms[s]): (r, w) for s, r, w in zip(starts, np.split(rows, cuts), np.split(weights, cuts)) if len(r)}


def best_of_block(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("id", kind="stable")
            lists, ids = postings(list(candidates["weights"])), candidates["id"].to_numpy()
            for own, vector in zip(queries["id"].to_numpy(), queries["weights"]):
                scores = np.zeros(len(ids), np.int64)
                for term, weight in enumerate(vector):
                    if weight and term in lists:
                        rows, weights = lists[term]
                        scores[rows] += weight * weights
                rows = np.flatnonzero(ids != own)
                held = scores[rows]
                if len(rows) > k:
                    least = np.partition(held, len(held) - k)[len(held) - k]
                    rows = rows[held >= least]
                    held = scores[rows]
                order = np.argsort(-held, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[rows[order]], "score": held[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id",
          vector_column: str = "embedding", *, scale: int = 64) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` best rows of `vectors` for each row of `queries`."""
    def prepared(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).where(
            F.col("id").isNotNull() & usable(F.col("vector"))).select(
            "id", whole_weights(F.col("vector"), scale).alias("weights"))

    left, right = prepared(queries), prepared(vectors)
    # Block counts follow the tables' sizes, so the work in one task does not.
    across = -(-left.count() // QUERIES) or 1
    down = -(-right.count() // CANDIDATES) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = left.withColumn("q", block(across)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = right.withColumn("c", block(down)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(
        best_of_block(k), "query_id long, vec_id long, score long")
    return ranked(found, k, F.col("score").desc())


def ranked(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first `k` per query over all blocks; Spark cuts to `k` per partition before the shuffle."""
    from pyspark.sql import Window

    window = Window.partitionBy("query_id").orderBy(*order, "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
