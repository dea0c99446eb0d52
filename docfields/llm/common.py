"""Helpers shared by the operators of this subpackage."""

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows in one Arrow batch of whole texts; texts of some kilobytes keep a batch at a few megabytes.
TEXT_BATCH = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of text in one run of rows where rows are bounded by bytes.
TEXT_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docfields-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, **options: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, no lineage, its size known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, **options: str) -> DataFrame:
    """`written`, after which the files of the shuffles that led there are removed; they are of no more use."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return written(df, **options)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
             schema: str, rows: int = TEXT_BATCH) -> DataFrame:
    """`function` over the Arrow batches of `df`, at most `rows` rows each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield from function(batch.slice(start, rows))

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH * 10))
    return df.mapInArrow(run, schema)


def by_bytes(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, column: str,
             size: int = TEXT_BYTES) -> DataFrame:
    """`function` over runs of rows of `df` whose `column` holds about `size` bytes; at most one longer value is in a run.

    No setting of the session is changed.
    """
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            starts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(starts[:-1], starts[1:]):
                yield from function(batch.slice(start, stop - start))

    return df.mapInArrow(run, schema)


def remainder(doc_id: Column | str, by: int) -> Column:
    """CRC-32 of the id's decimal text modulo `by`; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % by


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

