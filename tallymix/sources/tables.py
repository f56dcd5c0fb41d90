"""Count matrices out of the relational tables, and factors in and out of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import CountMatrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supplier(spark: SparkSession, sf_dir: str) -> CountMatrix:
    """Parts as genes, suppliers as cells, ordered quantities as counts."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene_id"), F.col("l_suppkey").alias("cell_id"), F.col("l_quantity").alias("value"))
    genes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"))
    return CountMatrix.of(rows, genes, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id")))


def event_user(spark: SparkSession, sf_dir: str) -> CountMatrix:
    """Event types (in order of name) as genes, users as cells, numbers of events as counts."""
    events = table(spark, sf_dir, "events")
    names = events.select("event_type").distinct().collect()  # a handful of types
    place = {r.event_type: j for j, r in enumerate(sorted(names, key=lambda r: r.event_type))}
    gene = F.coalesce(*(F.when(F.col("event_type") == n, F.lit(j)) for n, j in place.items()))
    return CountMatrix.of(events.select(gene.alias("gene_id"), F.col("user_id").alias("cell_id"), F.lit(1.0).alias("value")))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, vec, label)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def save_factors(means: DataFrame, weights: DataFrame, path: str) -> None:
    means.write.mode("overwrite").parquet(f"{path}/means")
    weights.write.mode("overwrite").parquet(f"{path}/weights")


def load_factors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/means"), spark.read.parquet(f"{path}/weights")
