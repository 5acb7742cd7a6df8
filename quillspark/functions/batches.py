"""Arrow batches of texts, of a bounded size."""

from __future__ import annotations

from pyspark.sql import SparkSession

PART_BYTES = 4 << 20
_KEY, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


def bounded(spark: SparkSession) -> None:
    """Python workers get batches of about ``PART_BYTES``, so that what they hold
    doesn't depend on how long the texts are.  A session's own setting stays."""
    if spark.conf.get(_KEY, _DEFAULT).rstrip("b") == _DEFAULT:
        spark.conf.set(_KEY, str(PART_BYTES))
