"""A workspace made from the documents table by a fixed formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same workspace in DuckDB: views f (all files), l and r (sides).
SQL = """WITH f AS (
  SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, 'n' || ((doc_id // 2) % 61) || '.' || lang AS filename,
    (CASE WHEN doc_id % 2 = 1 AND (doc_id // 2) % 3 <> 0 THEN 'main/' ELSE '' END) || 'd' || (doc_id // 122) AS relative_dir, '.' || lang AS extension, text FROM documents),
l AS (SELECT * FROM f WHERE side = 'left'), r AS (SELECT * FROM f WHERE side = 'right')"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: even ids on the left, odd ones on the right."""
    k = F.expr("doc_id div 2")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 2 == 0, "left").otherwise("right").alias("side"), F.concat(F.lit("n"), k % 61, F.lit("."), "lang").alias("filename"),
        F.concat(F.when((F.col("doc_id") % 2 == 1) & (k % 3 != 0), "main/").otherwise(""), F.lit("d"), F.expr("doc_id div 122")).alias("relative_dir"),
        F.concat(F.lit("."), "lang").alias("extension"), "text",
    )
    fixed = {"is_binary": F.lit(False), "ignored": F.lit(False), "ignored_reason": F.lit(""), "text_encoding": F.lit("utf-8"), "full_path": F.concat_ws("/", "side", "relative_dir", "filename"), "content": F.col("text").cast("binary")}
    return rows.withColumns(fixed)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_ = files(spark, sf_dir)
    return all_.where("side = 'left'"), all_.where("side = 'right'")
