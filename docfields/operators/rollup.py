"""Roll-up of results: numbers are summed per key, other values listed once per key.

Sums of doubles do not depend on the order of the rows. A double is cut at fixed powers of two into whole numbers of 40 bits,
which add up exactly as decimals, before the shuffle and after it; the sums of the parts become one double in the end, off by a
unit or two in the last place at most, and by nothing if the sum needs no more bits than a double has. What lies
beyond the parts, numbers from 2^160 on and bits below 2^-120, is added up as doubles are.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docfields.functions.numbers import number_or_null, plain_number


PART_BITS = 40
# The units of the parts, the smallest first.
_UNITS = [2.0 ** (PART_BITS * k) for k in range(-3, 4)]


def _parts(number: Column) -> list[Column]:
    """How often each unit is in a double, with its sign. The remainder of a division of doubles is exact."""
    size, sign = F.abs(number), F.signum(number)
    over = _UNITS[-1] * 2.0 ** PART_BITS
    within = F.when(size < over, size).otherwise(F.lit(0.0))
    return [
        (sign * F.floor((within % F.lit(unit * 2.0 ** PART_BITS)) / F.lit(unit))).cast("decimal(13,0)") for unit in _UNITS
    ]


def _beyond(number: Column) -> Column:
    size = F.abs(number)
    over = F.lit(_UNITS[-1] * 2.0 ** PART_BITS)
    return F.when(size < over, F.signum(number) * (size % F.lit(_UNITS[0]))).otherwise(number)


def _whole(sums_: list[Column], beyond: Column) -> Column:
    """The double that the sums of the parts make, carried over from the smallest on."""
    entry = F.array(*[F.struct(s.cast("decimal(38,0)").alias("s"), F.lit(u).alias("u")) for s, u in zip(sums_, _UNITS)])
    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("carry"), F.lit(0.0).alias("total"))
    width = F.lit(2 ** PART_BITS).cast("decimal(38,0)")

    def add(acc: Column, e: Column) -> Column:
        here = (e["s"] + acc["carry"]).cast("decimal(38,0)")
        left = here % width
        return F.struct(
            ((here - left) / width).cast("decimal(38,0)").alias("carry"),
            (acc["total"] + left.cast("double") * e["u"]).alias("total"),
        )

    def end(acc: Column) -> Column:
        return acc["total"] + acc["carry"].cast("double") * F.lit(_UNITS[-1] * 2.0 ** PART_BITS) + beyond

    return F.aggregate(entry, start, add, end)


def exact_sum(df: DataFrame, keys: Sequence[str | Column], number: str, name: str) -> DataFrame:
    """`df.groupBy(keys)` with the sum of a double column that is the same for any order and partitioning of the rows."""
    parts = [f"_part{i}" for i in range(len(_UNITS))]
    cut = df.select(*keys, *[p.alias(n) for p, n in zip(_parts(F.col(number)), parts)], _beyond(F.col(number)).alias("_beyond"))
    names = cut.columns[:len(keys)]
    summed = cut.groupBy(*names).agg(*[F.sum(p).alias(p) for p in parts], F.sum("_beyond").alias("_beyond"))
    return summed.select(*names, _whole([F.col(p) for p in parts], F.col("_beyond")).alias(name))


def rollup_both(results: DataFrame, by: Sequence[str] = (), locale: str | None = None,
                number_type: str = "double") -> DataFrame:
    """Sums and distinct strings in one pass: `[by…], key, text, total`.

    A row with NULL `text` holds the sum of a key's numbers; each other row is one distinct string.
    Strings are rows and not an array per key, so a key with very many values stays spread out, and
    both parts combine before the only shuffle. `by` adds grouping columns.
    """
    keys = [*by, "key"]
    plain = (
        results.where(F.col("key").isNotNull() & F.col("value").isNotNull())
        .select(*keys, plain_number(F.col("value"), locale).alias("_plain"))
        .select(*keys, "_plain", number_or_null(F.col("_plain"), number_type).alias("_num"))
    )
    text = F.when(F.col("_num").isNull(), F.col("_plain")).alias("text")
    if number_type == "double":
        return exact_sum(plain, [*keys, text], "_num", "total")
    return plain.groupBy(*keys, text).agg(F.sum("_num").alias("total"))


def sums(both: DataFrame) -> DataFrame:
    """The sums in a `rollup_both`, as `[by…], key, value`."""
    return both.where(F.col("text").isNull()).drop("text").withColumnRenamed("total", "value")


def strings(both: DataFrame) -> DataFrame:
    """The distinct strings in a `rollup_both`, one row each, as `[by…], key, value`."""
    return both.where(F.col("text").isNotNull()).drop("total").withColumnRenamed("text", "value")


def rollup(results: DataFrame, by: Sequence[str] = (), locale: str | None = None,
           number_type: str = "double") -> tuple[DataFrame, DataFrame]:
    """`(sums, strings)` of `results(key, value)`."""
    both = rollup_both(results, by, locale, number_type)
    return sums(both), strings(both)
