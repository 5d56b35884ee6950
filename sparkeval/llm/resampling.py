"""Importance resampling towards a target (Xie et al., 2023): hashed n-gram features of whole texts.

A document's weight is the sum, over its features, of the log ratio of the feature's bucket in the
target to that in the documents; the highest of weights plus Gumbel noise from the document's id are
a draw without replacement.  Words and their CRC-32 buckets come from :mod:`automaton`, a batch of
texts at a time.  The texts are read twice and never shuffled: first for the counts of a fixed number
of buckets, then for the weights.  Numbers alone are sorted, by ranges, for the ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import with_ordinal
from . import automaton
from .common import columns, map_batches, slices, stage, text_bytes
from .words import LOWER

#: Classes of bytes: digits, small letters and all of other scripts make words.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
SPACE = 0x20


def features(data: np.ndarray, offsets: np.ndarray, most: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``most``: the CRC-32 of every run of n words joined by a space, and the offset
    of each document's first run (one more at the end)."""
    low = LOWER[data]
    starts, ends = automaton.runs(WORD[low], offsets)
    lengths, first = ends - starts, np.searchsorted(starts, offsets)
    words = np.diff(first)
    states = automaton.advance(np.full(len(starts), automaton.START), low, starts, lengths)
    own = np.arange(len(starts))  # the words at which runs start
    left = np.repeat(first[1:], words) - own  # words from there to the document's end
    for n in range(1, most + 1):
        if n > 1:
            some = left[own] >= n
            own, states = own[some], automaton.step(states[some], SPACE)
            states = automaton.advance(states, low, starts[own + n - 1], lengths[own + n - 1])
        yield states ^ automaton.START, np.searchsorted(own, first)


def bucket_counts(df: DataFrame, buckets: int, most: int = 1, text: str = "text") -> DataFrame:
    """bucket and n: the features of all texts by bucket; a task sends its sums, at most ``buckets`` rows.

    Null texts have no features; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for i, j in slices(b.column(0)):
                for crc, _ in features(*text_bytes(b.column(0).slice(i, j - i)), most):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return map_batches(df.select(*columns([text])), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down; counts of a fixed number of buckets reach the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, df in ((s, source), (t, target)):
        for bucket, n in df.collect():
            counts[bucket] = n
    of_s, of_t = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * of_s / ((a + 1.0) * of_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, most: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features and weight of each row."""
    kind = df.select(*columns([key])).schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                n, weight, words = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), None
                for crc, first in features(*text_bytes(b.column(1).slice(i, j - i)), most):
                    words = np.diff(first) if words is None else words
                    n += np.diff(first)
                    weight += np.diff(np.append(0, np.cumsum(gain[crc % np.uint32(len(gain))]))[first])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, (words, n, weight))], names=["key", "n_words", "n_features", "weight"])

    out = map_batches(df.select(*columns([key, text])), run, f"key {kind}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("key", key)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, most: int = 1, buckets: int = 10_000, seed: str = "2024", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_features, weight, score and rank of every row of ``docs``; rank is null where undrawn.

    Of the N rows with at least ``least`` words, the floor(percent * N / 100) highest scores are
    drawn, ties to the smaller key, then to fewer features and less weight.  Rows are told apart by
    nothing else: a repeated row is drawn for itself.  A null key counts as the empty string in the
    noise and comes first among ties; null and empty texts weigh 0.  Without target texts every gain
    stems from the documents alone; without documents there are no rows.  Other columns are not used.
    """
    gain = gains(bucket_counts(docs, buckets, most, text), bucket_counts(target, buckets, most), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stage(weights(docs.select(*[c.alias(n) for c, n in zip(columns([key, text]), ("key", "text"), strict=True)]), gain, most, "key").withColumn("score", F.col("weight") + noise), "weights")
    n = rows.where(F.col("n_words") >= least).count() * percent // 100
    able = with_ordinal(rows.where(F.col("n_words") >= least).withColumn("low", -F.col("score")), "low", "key", "n_features", "weight", name="place")
    able = able.withColumn("rank", F.when(F.col("place") < n, F.col("place") + 1)).drop("low", "place")
    out = able.unionByName(rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
