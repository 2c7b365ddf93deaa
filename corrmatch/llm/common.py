"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, shared_folder

__all__ = ["ARROW", "column", "cut", "documents", "groups_for", "partitions", "per_batch", "read", "release", "shared_folder", "texts_of"]

#: Spark SQL names of the Arrow types that the operators return.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(*(cols or ("doc_id", "text")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of (compressed) input for each group of a shuffle, about.
GROUP = 32 << 20
#: Spark's own answer where it does not know a size.
_UNKNOWN = 1 << 60


def groups_for(docs: DataFrame, least: int, each: int = GROUP) -> int:
    """Groups into which a shuffle of all texts is dealt: by their bytes, ``least`` at least.

    The bytes are those that the plan of a plain scan states, or else those of the texts, summed.
    """
    plan, size = docs._jdf.queryExecution().optimizedPlan(), _UNKNOWN
    leaf = plan
    while leaf.children().size() == 1:
        leaf = leaf.children().apply(0)
    if leaf.children().isEmpty():  # estimates of joins are no measure
        size = int(str(plan.stats().sizeInBytes()))
    if size >= _UNKNOWN:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-size // each))


def release() -> None:
    """Give freed memory back to the system: a worker outlives the task that needed it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str, rows: int = 2_500) -> DataFrame:
    """Run ``fn`` on batches of at most ``rows`` rows; it returns columns by name.

    ``schema`` is "name type, name type"; array types are not needed here.  A task's
    memory depends on the size of a batch, not of its partition.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [ARROW[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = fn(batch.slice(at, rows))
                for cols in [] if got is None else [got] if isinstance(got, dict) else got:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[n], k) for n, k in zip(names, kinds)], names)
                release()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; a null is an empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

