"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemark.scratch import discard, join_hot, materialise, scratch_path, scratch_root, with_rank

__all__ = ["discard", "join_hot", "materialise", "scratch_path", "scratch_root", "table", "with_rank", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, whatever their case: an operator's own columns replace them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])
