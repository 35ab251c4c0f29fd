"""Hand-made labels: text lines of ``path,label``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.operators.classify import truth_from_lines


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, label) of a label file."""
    return truth_from_lines(spark.read.text(path))
