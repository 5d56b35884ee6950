"""Ordinals, heads, tails and splits by an explicit key: files have no order of their own."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged, unused

#: Bits of a row's number within its partition.
WITHIN = 33
#: Rows that one task may number.
FEW = 100_000


def with_ordinal(df: DataFrame, *keys: str, name: str = "instance_idx") -> DataFrame:
    """Number rows from 0 in the order of ``keys``, of any kind that sorts; nulls come first.

    Rows are dealt by ranges of all keys, and of a hash of the whole row among equal keys, so that
    later keys and then rows split a frequent first one; as many ranges as the session shuffles to.
    They are sorted within, and written once to the shared folder.  Each range then adds the rows of
    those before it.  Nothing is sorted in one task but rows that are equal in every column.
    """
    part, at, base, tie = unused(df, "part", "at", "base", "tie")
    order = list(keys)
    if rest := [c for c, t in df.dtypes if c not in keys and "map<" not in t]:
        df, order = df.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in rest])), [*keys, tie]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
    rows = staged(rows.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << WITHIN) - 1)), "ordinals")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    sizes = rows.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    return rows.join(F.broadcast(sizes), part).withColumn(name, F.col(base) + F.col(at)).drop(part, base, at)


def with_few_ordinals(df: DataFrame, n: int, *keys: str, name: str = "instance_idx") -> DataFrame:
    """:func:`with_ordinal` of a table known to have ``n`` rows or hardly more: a few are numbered in
    one task, without a job of their own and without being written."""
    if n > FEW:
        return with_ordinal(df, *keys, name=name)
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))


def head(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def tail(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n)


def _from(keys: tuple[str, ...], values: tuple) -> tuple[Column, Column]:
    """Whether a row's keys are at or after ``values`` in their order, nulls first, and whether they
    are before: plain comparisons, which reach the scan."""
    after, before, equal = [], [], []
    for i, (k, v) in enumerate(zip(keys, values, strict=True)):
        c, value = F.col(k), F.lit(v)
        if i + 1 == len(keys):
            above = F.lit(True) if v is None else c >= value
        else:
            above = c.isNotNull() if v is None else c > value
        after.append(reduce(and_, [*equal, above]))
        before.append(reduce(and_, [*equal, F.lit(False) if v is None else c.isNull() | (c < value)]))
        equal.append(c.isNull() if v is None else c == value)
    return reduce(or_, after), reduce(or_, before)


def nth_last(df: DataFrame, n: int, *keys: str) -> tuple[Any, ...] | None:
    """The keys of the ``n``-th last row, or None of a smaller table: a bounded top-n of keys alone."""
    names = [f"k{i}" for i in range(len(keys))]
    last = df.select(*[F.col(k).alias(c) for k, c in zip(keys, names, strict=True)]).orderBy(*[F.desc(c) for c in names]).limit(n)
    size, least = last.agg(F.count("*"), F.min(F.struct(*names))).first()
    return tuple(least) if size == n and n else None


def split(df: DataFrame, test_size: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Test and pool: the last ``test_size`` rows, or all if there are fewer, and the others.

    One job finds the key that parts them; both are then filters on the keys of the table as it is,
    so that no row is moved or written, and a scan skips what lies on the other side.  ``keys`` tell
    rows apart; of rows that share the parting key all are test, so the two never share one.
    """
    if test_size <= 0:
        return df.where(F.lit(False)), df
    parting = nth_last(df, test_size, *keys)
    if parting is None:
        return df, df.where(F.lit(False))
    after, before = _from(keys, parting)
    return df.where(after), df.where(before)


def without(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not in ``other``."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where no column is null; blank text passes."""
    return df.dropna(subset=list(columns))
