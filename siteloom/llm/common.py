"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.operators.staging import checkpoint_folder

#: Rows of one Arrow batch. Texts may be long, so batches are kept small.
ARROW_ROWS = 1000

_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and make sure that a checkpoint folder is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    checkpoint_folder(spark)


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, every other character as it is."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_limit(sample: int, n: int) -> int:
    """The signed 64-bit hash up to which about ``sample`` of ``n`` rows lie: all
    rows where ``n`` is no more, and still ``sample`` where ``n`` is huge."""
    return min((sample << 64) // max(n, 1), (1 << 64) - 1) - (1 << 63)
