"""What Python workers hold between stages, given back.

Spark reuses its Python workers, so a stage starts with the caches, the Arrow buffers and the free heap of all stages before
it. Each worker gives them back in a short task; several tasks for a core, each with a short wait, reach all workers.
"""

import ctypes
import gc
import time

import pyarrow as pa
from pyspark.sql import SparkSession

from kindred.llm import hashing, packing

TASKS_PER_CORE = 4
WAIT = 0.05


def release() -> None:
    """Empties this process's caches and returns free memory to the system, as far as the platform can."""
    packing.encoder_of.cache_clear()
    hashing._powers.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def give_back(spark: SparkSession) -> None:
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism

    def work(batches):
        for batch in batches:
            release()
            time.sleep(WAIT)
            yield batch

    spark.range(0, tasks, 1, tasks).mapInArrow(work, "id long").count()
