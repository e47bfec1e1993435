"""Makes the package importable on executors, whatever the driver's working folder is."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: What Spark sends to a Python worker at once where the session doesn't say otherwise, and what it sends then.
BATCH_SETTING, USUAL, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends a zip of this package to the executors, once per application, and makes batches small.

    A batch stands in the JVM, in the worker and in what kernels make of it at the same time, for every core;
    a setting of the session that isn't Spark's default stays.

    Python kernels are pickled by reference, so workers need the package on their path.
    ``addPyFile`` serves it from the driver; late or replaced executors fetch it too.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_SETTING).rstrip("b") == USUAL:
        spark.conf.set(BATCH_SETTING, str(BATCH))
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or ".zip" in str(root):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    folder = tempfile.mkdtemp(prefix="grainmill-")
    out = os.path.join(folder, "grainmill-src.zip")
    Path(out).write_bytes(data.getvalue())
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)
