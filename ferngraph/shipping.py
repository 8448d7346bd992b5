"""Making this package importable in the Python workers of every executor."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to a Python worker, whatever the rows' lengths.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package along with the application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ship-")  # of the driver, from which Spark copies it
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"{top.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def give_back() -> None:
    """Return freed memory of this Python worker to the system: allocators keep
    it otherwise, for a worker that may lie idle for the rest of a stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)
