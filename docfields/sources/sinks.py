"""Result datasets.

A job computes its results once: they are written to a staging folder beside the target, counted on the way, rolled up from
there in one aggregate, and put in place. The marker `_COMPLETE` is taken away first and written last, so a reader that
heeds it never takes part of a job for a whole one. The staging folder is removed in every case.
"""

import logging
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from docfields.operators.rollup import rollup_both, strings, sums

log = logging.getLogger(__name__)
MARKER = "_COMPLETE"


class Folder:
    """A folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = self._of("")
        self._files = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str = "") -> bool:
        return self._files.exists(self._of(name))

    def remove(self, name: str = "") -> None:
        self._files.delete(self._of(name), True)

    def touch(self, name: str) -> None:
        self._files.create(self._of(name), True).close()

    def take(self, other: "Folder", name: str) -> bool:
        """Move a folder of the same file system here in place of what is there; False if that can't be done."""
        if self._files.getUri() != other._files.getUri():
            return False
        self._files.mkdirs(self._path)
        self.remove(name)
        return self._files.rename(other._of(name), self._of(name))


@contextmanager
def staging(spark: SparkSession, out: str) -> Iterator[Folder]:
    """A folder beside `out` that is gone in the end."""
    folder = Folder(spark, f"{out.rstrip('/')}.staging-{uuid.uuid4().hex}")
    try:
        yield folder
    finally:
        folder.remove()


def save_datasets(spark: SparkSession, datasets: Mapping[str, DataFrame | Mapping], out: str,
                  format: str = "parquet", mode: str = "overwrite") -> None:
    """Write each named dataset to its own folder below `out`.

    A plain mapping becomes a dataset with the columns `Key` and `Value`.
    """
    for name, data in datasets.items():
        if isinstance(data, Mapping):
            value_type = "double" if all(isinstance(v, (int, float)) for v in data.values()) else "string"
            rows = [(k, float(v) if value_type == "double" else str(v)) for k, v in data.items()]
            data = spark.createDataFrame(rows, f"Key string, Value {value_type}")
        writer = data.write.mode(mode)
        if format == "csv":
            writer = writer.option("header", True)
        writer.format(format).save(f"{out.rstrip('/')}/{name}")


def is_complete(spark: SparkSession, out: str) -> bool:
    """Whether the last job that wrote to `out` came to its end."""
    return Folder(spark, out).has(MARKER)


def write_results(results: DataFrame, out: str, format: str = "parquet", mode: str = "overwrite",
                  number_type: str = "double", locale: str | None = None, by: Sequence[str] = (),
                  failed: DataFrame | None = None) -> bool:
    """Write `results`, `summed` and `strings` below `out` if there is any result.

    Returns whether anything was written; without a sum or string, `out` is not touched. `by` names columns of the results
    that sums and strings are kept apart by. `failed` becomes the dataset `errors` if it has rows, whatever the results.
    """
    spark = results.sparkSession
    found = Observation()
    filled = F.col("key").isNotNull() & F.col("value").isNotNull()
    with staging(spark, out) as stage:
        results.observe(found, F.count(F.when(filled, 1)).alias("n")).write.parquet(f"{stage.path}/results")
        lost = Observation()
        if failed is not None:
            failed.observe(lost, F.count(F.lit(1)).alias("n")).write.parquet(f"{stage.path}/errors")
        errors = {}
        if failed is not None and lost.get["n"]:
            log.warning("%d files could not be read, see %s/errors", lost.get["n"], out)
            errors = {"errors": spark.read.schema(failed.schema).parquet(f"{stage.path}/errors")}
        if found.get["n"] == 0:
            save_datasets(spark, errors, out, format, mode)
            return False
        staged = spark.read.schema(results.schema).parquet(f"{stage.path}/results")
        # The roll-up has one row for a key and a string; it is computed once for both datasets.
        both = rollup_both(staged, by, locale, number_type)
        both.write.parquet(f"{stage.path}/both")
        both = spark.read.schema(both.schema).parquet(f"{stage.path}/both")
        target = Folder(spark, out)
        target.remove(MARKER)
        save_datasets(spark, {**errors, "summed": sums(both), "strings": strings(both)}, out, format, mode)
        moved = format == "parquet" and mode == "overwrite" and target.take(stage, "results")
        if not moved:
            save_datasets(spark, {"results": staged}, out, format, mode)
        target.touch(MARKER)
    return True
