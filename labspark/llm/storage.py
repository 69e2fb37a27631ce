"""Tables written to the shared folder, where a lost executor cannot take them along."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

from labspark.session import checkpoint_dir

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def python_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks that are planned inside get at most ``rows`` rows at once, which bounds their memory and the JVM's."""
    before = spark.conf.get(_BATCH_ROWS)
    if not 0 < int(before) <= rows:
        spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which also cuts its lineage.

    Python tasks of ``df`` get ``batch_rows`` rows at once, where that is less than the session says.
    """
    path = new_folder(df.sparkSession, name)
    with python_batches(df.sparkSession, batch_rows) if batch_rows else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
