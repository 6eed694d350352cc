"""Feature windows -> z-scores -> sequences -> chronological split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.operators import features as ft


def feature_dataset(events: DataFrame, seq_len: int = ft.SEQUENCE_LENGTH, train_ratio: float = 0.8) -> DataFrame:
    """Sequences (x, y) with their part; gaps between windows are reported, not filled."""
    windows = ft.feature_windows(events)
    z = ft.normalise(windows, ft.normalisation(windows))
    counted = windows.agg(F.count(F.lit(1)).alias("n_windows"))
    sequences = ft.sliding_sequences(ft.vectors(z), seq_len)
    joined = sequences.crossJoin(F.broadcast(counted)).withColumn("n_sequences", F.col("n_windows") - seq_len)
    return ft.chronological_split(joined, F.col("n_sequences"), train_ratio).drop("n_windows")
