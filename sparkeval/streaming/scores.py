"""Scores of a stream of responses: the row metrics are stateless and need no more than a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import with_bleu


def windowed_bleu(stream: DataFrame, time: str, reference: str, prediction: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean overall BLEU and the number of rows by event-time window; later rows than ``late`` go."""
    rows = with_bleu(stream.withWatermark(time, late), reference, prediction)
    return rows.groupBy(F.window(time, window).alias("window")).agg(F.avg("bleu_overall").alias("bleu"), F.count("*").alias("n"))
