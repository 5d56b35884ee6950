"""Shared helpers of the training-data operators: tables, staging, slices of Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one slice of an Arrow batch holds; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, as ten thousand long documents do not fit a
    Python worker; a worker gives back the memory that a finished partition leaves unused.

    The bound is a setting of the session, read when the query runs, so it stays set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    names = df.columns  # some that tables may have, Spark does not pass on to Python

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where it is unset, and the session runs in one process, a temporary folder stands in.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(own, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive a lost executor, and computes ``df`` once.
    """
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`stage`, and where the files are, for :func:`discard`."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged files that no table reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def columns(names: list[str]) -> list[Column]:
    """Columns of these very names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out


def with_texts(batch: pa.RecordBatch, names: list[str], texts: list[str | None]) -> pa.RecordBatch:
    """The columns ``names`` of a batch with other texts; ``n_chars``, if there, is counted anew."""
    columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
    if "n_chars" in names:
        k = names.index("n_chars")
        columns[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[k].type)
    return pa.RecordBatch.from_arrays(columns, names=names)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes together, or one row."""
    sizes = np.diff(text_bytes(column)[1])
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs to (node, component), the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step groups by node
    and sends only minima, so no task gathers a component.  Each round is written to the shared
    folder; the number of rounds is logarithmic in practice.  The minima are tables too, so that
    both sides of a join are plain exchanges, of which Spark can split the one with a node of many
    links.  Self links and repeats are harmless.
    """
    e, at = stage_at(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_at = stage_at(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large, large_at = stage_at(e.select(F.col("b").alias("a"), F.col("a").alias("b")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least, least_at = stage_at(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, (e, at) = at, stage_at(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(e.sparkSession, before, low_at, large_at, least_at)  # each round needs the last one's links alone
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
