"""The helpers of the session that the operators of this package share, and the size of the batches in which texts go to Python."""

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.session import BROADCAST_ROWS, plain_names, small_side, table, work_dir, written

__all__ = ["BROADCAST_ROWS", "CACHES", "in_small_batches", "make_room", "plain_names", "small_side", "table", "work_dir", "written"]

#: Rows of a batch at most. Spark's own 10,000 rows of whole documents are tens of MB, held several times over by each task.
BATCH_ROWS = 512
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches were limited to BATCH_ROWS rows; a smaller setting stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_SETTING)) <= BATCH_ROWS:
        conf.set(_SETTING, str(BATCH_ROWS))
    return df


#: What operators keep in a Python worker from task to task, such as tokenizers.
CACHES: list[dict] = []


def make_room() -> None:
    """For tasks that need memory themselves: empties CACHES and returns what this worker's allocators have free to the machine."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass
