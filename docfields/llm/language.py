"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

Inverse document frequencies are counted over all training documents by Spark. The regression is trained with
follow-the-regularised-leader and elastic-net penalties on a bounded sample: about `PER_LANGUAGE` documents
of each language, chosen by a hash of their ids. A temperature, fitted on a part of the sample that training
left out, scales the class scores before they become probabilities.

Only text is an input of a prediction. Texts are read whole.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text when nothing
can be learned; with one language to learn, all others are that language with score 1; rows without a language are
not learned from; repeated rows get equal results; an empty table gives an empty one.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from docfields.llm.common import by_batch

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
# TF-IDF weights are shares of all n-grams of a text; this brings them near 1.
SCALE = 10.0
UNDETERMINED = "und"


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of the lower-cased text, one after the other."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, rolled = [], np.zeros(len(code), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        size = len(code) - order + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint32(0x01000193) ^ code[order - 1:]
        if order in ORDERS:
            mixed = (rolled + np.uint32(order)) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(16) & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


def document_counts(texts: DataFrame, text_column: str) -> np.ndarray:
    """Documents that hold each bucket, and all documents last; every task adds up its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + 1, np.int64)
        held = np.zeros(BUCKETS, bool)
        for batch in batches:
            for text in batch.column(0):
                held[:] = False
                held[grams(text.as_py())] = True
                counts[:-1] += held
                counts[-1] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": counts[at]})

    counts = np.zeros(BUCKETS + 1, np.int64)
    rows = texts.select(text_column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in rows.collect():  # as many rows as there are buckets at most
        counts[row["bucket"]] = row["n"]
    return counts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language, inverse document frequencies included
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The most probable language of each text, by number, and its probability."""
        scores = np.stack([self.weights[g].sum(axis=0) / len(g) for g in map(grams, texts)]) + self.bias
        p = softmax(scores / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def trained(texts: list[str], labels: list[str], counts: np.ndarray, seed: int = 0) -> Model | None:
    """Follow the regularised leader over the sample, one document at a time; then the temperature."""
    if not texts:
        return None
    languages = sorted(set(labels))
    y = np.array([languages.index(label) for label in labels])
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 1
    rows = []
    for text in texts:
        bucket, n = np.unique(grams(text), return_counts=True)
        rows.append((bucket, SCALE * n / n.sum() * idf[bucket]))
    order = np.random.default_rng(seed).permutation(len(rows))
    aside = order[:len(order) // 5]
    fitted = order[len(order) // 5:] if len(order) >= 20 else order
    z = np.zeros((BUCKETS + 1, len(languages)))
    n = np.zeros_like(z)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for i in fitted:
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[y[i]] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    chosen = aside if len(aside) else fitted
    scores = np.stack([x @ w[at] + w[-1] for at, x in (rows[i] for i in chosen)])
    options = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(scores / t)[np.arange(len(chosen)), y[chosen]] + 1e-12).mean() for t in options]
    return Model(languages, (SCALE * idf[:, None] * w[:-1]).astype(np.float32), w[-1].astype(np.float32),
                 float(options[int(np.argmin(loss))]))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", *,
          per_language: int = PER_LANGUAGE) -> Model | None:
    """The model of `labelled` rows that have a language and a letter."""
    usable = labelled.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"),
                             F.col(label_column).alias("label")).where(F.col("label").isNotNull() & has_letter(F.col("text")))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not sizes:
        return None
    chance = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, per_language / n))])
    sample = usable.where(chance < share[F.col("label")]).select("text", "label").collect()
    sample.sort(key=lambda r: (r["label"], r["text"]))
    return trained([r["text"] for r in sample], [r["label"] for r in sample], document_counts(usable, "text"))


def identify(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`; columns of these names are replaced."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    flagged = docs.select(*names, has_letter(F.col(text_column)).alias("score"))
    at = names.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = batch.column(len(names)).to_numpy(zero_copy_only=False) & (model is not None)
        lang, score = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
        rows = np.flatnonzero(known)
        if len(rows):
            texts = batch.column(at).take(pa.array(rows)).to_pylist()
            best, probability = model.predict(texts)
            lang[rows] = np.array(model.languages, object)[best]
            score[rows] = probability
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)],
                                         names=[*names, "lang_pred", "score"])

    schema = docs.select(*names).schema
    return by_batch(flagged, run, StructType([*schema.fields, StructField("lang_pred", StringType()),
                                              StructField("score", DoubleType())]))
