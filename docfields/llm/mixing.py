"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is the rows it should have by the rows it has. Each document's count is the
inverse of the Poisson distribution with that mean at a number hashed from seed and id, so a document's
copies do not depend on the other rows or on partitioning. Copies are then put in the order of a second hash,
over all partitions.

Defined results: a null source is a source of its own; a null id hashes as the word null; repeated rows get
equal counts; a source without a given weight gets none; an empty table gives an empty one. A column of the
input with the name of an added one is replaced.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import fresh, written

POWER = 0.5
SEED = 20240


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of MD5 as a number from 0 to below 1."""
    return number(seed, 13, *parts) / F.lit(float(1 << 52))


def number(seed: int, digits: int, *parts: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def distribution(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, … copies, as far as they differ from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.array(F.exp(-rate)).alias("sums"), (-rate).alias("log"))
    def add(acc, k):
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + F.exp(log))).alias("sums"),
                        log.alias("log"))
    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda acc: acc["sums"])


def rates(docs: DataFrame, source_column: str, weights: Mapping[str, float] | None = None,
          rows: int | None = None, power: float = POWER) -> DataFrame:
    """`source, rate, sums`, one row per source. Without `weights`, a source's weight is its rows to `power`."""
    counts = docs.groupBy(F.col(source_column).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        weighted = counts.join(given, "source")
    weighted = written(weighted)
    total = weighted.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()
    target = F.lit(total["rows"] if rows is None else rows)
    rate = target * F.col("weight") / F.lit(total["weights"]) / F.col("n")
    found = weighted.where("weight > 0").select("source", rate.alias("rate"))
    return written(found.withColumn("sums", distribution(F.col("rate"))))


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", *,
        weights: Mapping[str, float] | None = None, rows: int | None = None, power: float = POWER,
        seed: int = SEED) -> DataFrame:
    """Every document as often as drawn, in hashed order, with `rate`, `copy_no` (from 1) and `mix_key`."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("rate", "copy_no", "mix_key")])
    source, sums, copies = (fresh(docs, n) for n in ("mix_source", "mix_sums", "mix_copies"))
    table = rates(docs, source_column, weights, rows, power).select(
        F.col("source").alias(source), "rate", F.col("sums").alias(sums))
    u = uniform(seed, F.col(id_column))
    counted = docs.join(table, F.col(source_column).eqNullSafe(F.col(source))).withColumn(
        copies, F.size(F.filter(sums, lambda p: p <= u)))
    repeated = counted.where(F.col(copies) > 0).withColumn(
        "copy_no", F.explode(F.sequence(F.lit(1), F.col(copies))))
    keyed = repeated.drop(source, sums, copies).withColumn(
        "mix_key", number(seed + 1, 15, F.col(id_column), F.col("copy_no")))
    return keyed.repartitionByRange("mix_key").sortWithinPartitions("mix_key")
