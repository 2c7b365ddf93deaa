"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only in local mode may it be unset (tests, a laptop): a temporary folder serves then.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corrmatch-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` in the order of ``keys`` with a column of running numbers from 0.

    Rows are sorted by ranges; one count a range, as many as shuffle partitions, goes
    through the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("_range", F.shiftright("_at", 33)))
    counts = sorted(tuple(r) for r in rows.groupBy("_range").count().collect())
    offsets, total = {}, 0
    for part, n in counts:
        offsets[part], total = total, total + n
    base = F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair])[F.col("_range").cast("long")] if offsets else F.lit(0).cast("long")
    return rows.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + base).drop("_at", "_range")
