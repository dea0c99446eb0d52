"""Cutting lineage where a result is used more than once."""

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder of the session and go on from there.

    The folder is the cluster's `spark.checkpoint.dir`, which survives lost executors. Only a local
    session without one gets a temporary folder.
    """
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df` as files in the same folder, packed by column: the planner then knows its size, and sends it to all if it is small."""
    path = f"{_folder(df).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="docfields-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
