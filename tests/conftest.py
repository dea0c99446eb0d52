import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def each(spark):
    """`each(column, texts)`: the value of a column of `t` for each text, in order."""
    from pyspark.sql import functions as F

    def run(column, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        found = rows.select("i", column.alias("v")).collect()
        return [plain(r["v"]) for r in sorted(found, key=lambda r: r["i"])]

    def plain(value):
        if isinstance(value, list):
            return [plain(v) for v in value]
        return tuple(value) if isinstance(value, tuple) else value

    run.text = F.col("t")
    return run
