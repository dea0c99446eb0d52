"""Parallelism of a scan."""

from pyspark.sql import DataFrame

# Rows of which each makes pages of its own, at most in one task: half a minute of search or so.
ROWS = 50_000


def spread(scan: DataFrame) -> DataFrame:
    """`scan` in at least as many partitions as there are cores.

    Searching costs far more per byte than reading, so a few files or row groups must not keep most
    cores idle. A scan that already has enough partitions, as any large one does, is left alone and not
    shuffled. Only file listing is needed to know; no job runs.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.rdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def spread_rows(rows: DataFrame, count: int) -> DataFrame:
    """`count` narrow rows, each of which is still to become much text, in tasks of at most `ROWS` and on all cores.

    Bytes say little here: a split or a joined partition of 64 MB holds millions of such rows, so tasks would grow with the input
    until then. What is shuffled is the narrow rows, never text, and adaptive execution does not put these partitions together.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-count // ROWS)))
