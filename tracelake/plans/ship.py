"""Makes this package importable in the cluster's Python workers, and keeps those workers small."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to a worker; without a bound a batch has 10 000 rows, however long.
BATCH_BYTES = "4m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors and bounds batches, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tracelake-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(path))
    if not sc.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    _shipped.add(sc.applicationId)


def _give_back() -> None:
    """Workers live on after a task: what it has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow for a function of this package, with batches bounded by bytes."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)
