"""Saved features and models: one parquet table per part, each loadable on its own."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def save(path: str, parts: dict[str, DataFrame]):
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The named parts; a part that cannot be read is an error that says which."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            raise FileNotFoundError(f"saved part {name!r} cannot be read from {path}") from error
    return out
