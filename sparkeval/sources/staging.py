"""Tables written to the folder that all executors share, and read back."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of more bytes is shuffled, not broadcast.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a session of one process may go without it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(own, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df``, computed once, in files that outlive a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """As many partitions as the session shuffles to, or has cores."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes from fewer files than there are: a small file is one task.

    Asks for the names of files, which runs no job, and never for partitions, which runs all
    shuffles below.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or len(df.inputFiles()) >= cores else df.repartition(cores)


def small(df: DataFrame) -> bool:
    """Whether a written table may be broadcast: counts its rows and the bytes of its strings."""
    strings = [F.octet_length(F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"]
    n, size = df.agg(F.count("*"), sum((F.coalesce(F.sum(s), F.lit(0)) for s in strings), F.lit(0))).first()
    return n * 8 * len(df.columns) + size <= BROADCAST_BYTES


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out
