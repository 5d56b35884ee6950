"""Repeatable few-shot examples for each test row.

Row ``i`` draws positions of the pool from hashes of ``base_seed + i``, by Floyd's method: each set
of ``k`` positions may occur, and none occurs twice in a row's draw.  With ``exact`` the positions
are those that the standard library's generator draws, worked out in tasks.  Only the pool's keys
are numbered; draws find keys by position and then texts by key, so the work is the number of draws
and one scan of the pool, never test rows times pool rows.  The pool's texts are neither written nor,
if the drawn keys are few, shuffled.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .ordinals import with_ordinal
from ..functions.text import is_blank, usable
from ..sources.staging import parts, small, staged, unused


def hashed(*parts: Column) -> Column:
    """A number below 2**32 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def draws(test: DataFrame, size: Column, base_seed: int, k: int = 3) -> DataFrame:
    """(instance_idx, slot, position) with ``size`` the pool's row count, at most ``k`` and ``size`` each."""
    seed = F.col("instance_idx") + base_seed
    rows = test.select("instance_idx", size.alias("__n"), F.least(F.lit(k), size).cast("int").alias("__k"), seed.alias("__seed"))

    def next_one(found: Column, i: Column) -> Column:
        last = F.col("__n") - F.col("__k") + i
        drawn = F.pmod(hashed(F.col("__seed"), i), last + 1)
        return F.concat(found, F.array(F.when(F.array_contains(found, drawn), last).otherwise(drawn)))

    found = F.aggregate(F.sequence(F.lit(0), F.col("__k") - 1), F.array().cast("array<long>"), next_one)
    rows = rows.where(F.col("__k") > 0).select("instance_idx", F.posexplode(found).alias("slot", "position"))
    return rows


def exact_draws(test: DataFrame, size: Column, base_seed: int, k: int = 3) -> DataFrame:
    """As :func:`draws`, but the positions that ``random.Random(base_seed + instance_idx).sample`` gives."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, s, p) for i, n in zip(b["instance_idx"], b["n"], strict=True) for s, p in enumerate(exact_positions(int(n), int(i), base_seed, k))]
            yield pd.DataFrame(rows, columns=["instance_idx", "slot", "position"])

    return test.select(F.col("instance_idx").cast("long").alias("instance_idx"), size.cast("long").alias("n")).mapInPandas(draw, "instance_idx long, slot int, position long")


def exact_positions(size: int, instance: int, base_seed: int = 42, k: int = 3) -> list[int]:
    return random.Random(base_seed + instance).sample(range(size), min(k, size))


#: Names of what a draw adds; the pool's own columns of these names give way.
DRAWN = ("instance_idx", "slot", "position")


def _numbered(pool: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The pool's keys, and what else is asked for, by position; no other column is moved or written.

    They are written before they are dealt by ranges, which looks at them twice: the pool's texts, which
    what is asked for or the pool's filters may need, are read once."""
    return with_ordinal(_written(pool, keys, *more), *keys, name="position")


def _written(pool: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return staged(pool.select(*keys, *more), "keys")


def _fetched(drawn: DataFrame, pool: DataFrame, keys: list[str], numbered: DataFrame, *more: str) -> DataFrame:
    """The pool's columns of drawn positions: their keys are found and written first, and if they are
    few, the pool is filtered where it is; if they are many, it is joined."""
    own = dict(zip(keys, unused(pool, *[f"key{i}" for i in range(len(keys))]), strict=True))
    found = drawn.join(numbered.select(*keys, "position").withColumnsRenamed(own), "position")
    found = staged(found.select(*DRAWN, *own.values(), *more), "drawn")
    same = reduce(and_, (F.col(mine).eqNullSafe(F.col(key)) for key, mine in own.items()))
    return (F.broadcast(found) if small(found) else found).join(pool, same).drop(*own.values())


def sample(test: DataFrame, pool: DataFrame, keys: list[str], base_seed: int = 42, k: int = 3, exact: bool = False) -> DataFrame:
    """The pool's rows drawn for each row of ``test`` (instance_idx): instance_idx, slot, position and
    the pool's columns.  ``keys`` tell the pool's rows apart, and order them."""
    pool = pool.drop("is_test", *DRAWN)
    written = _written(pool, keys)
    numbered = with_ordinal(written, *keys, name="position")
    counted = test.select("instance_idx").join(F.broadcast(written.agg(F.count("*").alias("__size"))))  # as many as are numbered
    return _fetched((exact_draws if exact else draws)(counted, F.col("__size"), base_seed, k), pool, keys, numbered)


def sample_then_filter(test: DataFrame, pool: DataFrame, keys: list[str], columns: list[str], base_seed: int = 42, k: int = 3, exact: bool = False) -> DataFrame:
    """Draw ``k``, then drop examples with a blank column: fewer may remain."""
    drawn = sample(test, pool, keys, base_seed, k, exact)
    for c in columns:
        drawn = drawn.where(~is_blank(c))
    return drawn


def filter_then_sample(test: DataFrame, pool: DataFrame, keys: list[str], columns: list[str], base_seed: int = 42, k: int = 3) -> DataFrame:
    """Draw ``k`` of the pool's usable rows."""
    for c in columns:
        pool = pool.where(~is_blank(c))
    return sample(test, pool, keys, base_seed, k)


def shuffled_then_filled(test: DataFrame, pool: DataFrame, keys: list[str], columns: list[str], base_seed: int = 42, k: int = 3) -> DataFrame:
    """The first ``k`` usable rows of the pool in the order in which the standard library's generator
    shuffles it, for each row of ``test``: the exact form of :func:`filter_then_sample`.

    A task shuffles the pool's positions for each test row, eight bytes each, and gives the first
    few; rows that too few usable ones are among ask for four times as many, until all are filled.
    """
    pool = pool.drop("is_test", *DRAWN)
    numbered = _numbered(pool, keys, reduce(and_, (~is_blank(c) for c in columns)).alias("__usable"))
    return _fetched(_filled(test, numbered, base_seed, k)[0], pool, keys, numbered)


def _filled(test: DataFrame, numbered: DataFrame, base_seed: int, k: int) -> tuple[DataFrame, DataFrame]:
    """instance_idx, slot and position of the first ``k`` usable rows in shuffled order; and by
    instance_idx the generator's state after the shuffle."""
    size, fill = numbered.agg(F.count("*"), F.coalesce(F.sum(F.col("__usable").cast("long")), F.lit(0))).first()
    todo, most, found, states = test.select(F.col("instance_idx").cast("long").alias("instance_idx")), 4 * k, None, None
    while True:
        drawn = todo.repartition(parts(todo.sparkSession)).mapInPandas(_shuffled(size, base_seed, most), "instance_idx long, slot int, position long, state binary")
        drawn = staged(drawn, "shuffled")
        after = drawn.where("state is not null").select("instance_idx", "state")
        states = after if states is None else states  # the first round has all instances
        good = drawn.join(numbered.where("__usable").select("position"), "position")
        turn = F.row_number().over(Window.partitionBy("instance_idx").orderBy("slot"))
        good = staged(good.withColumn("slot", turn - 1).where(F.col("slot") < k).select("instance_idx", "slot", "position"), "drawn")
        full = good.groupBy("instance_idx").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, fill))
        found = good if found is None else found.union(good)
        if most >= size or fill == 0:
            break
        found = found.join(full, "instance_idx", "left_semi")
        todo = todo.join(full, "instance_idx", "left_anti")
        if not todo.limit(1).count():
            break
        most *= 4
    return found, states


def sampled_and_picked(test: DataFrame, pool: DataFrame, keys: list[str], references: list[str], base_seed: int = 42, k: int = 3, fill: bool = False, name: str = "reference") -> DataFrame:
    """Rows drawn for each row of ``test`` as the standard library's generator draws them, and ``name``:
    one usable reference of each, as the same generator chooses it after the draw, in drawn order.

    ``fill`` shuffles the pool and takes the first ``k`` rows with a usable reference; without it,
    ``k`` rows are sampled, and those without one go and take no choice.  Drawn positions fetch the
    number of usable references by position; then the generator chooses on from where the draw left it:
    from its state after a shuffle, which is kept, or else after it has sampled again from its seed.
    """
    pool = pool.drop("is_test", name, *DRAWN)
    (pick_name,) = unused(pool, "pick")
    usable_ones = usable(*[F.col(f"`{c}`") for c in references])
    numbered = _numbered(pool, keys, F.size(usable_ones).alias("__choices"), (F.size(usable_ones) > 0).alias("__usable"))
    size = F.broadcast(numbered.agg(F.count("*").alias("__size")))
    states = None
    if fill:
        drawn, states = _filled(test, numbered, base_seed, k)
    else:
        drawn = exact_draws(test.select("instance_idx").join(size), F.col("__size"), base_seed, k)
    drawn = drawn.join(numbered.select("position", "__choices"), "position")
    rows = drawn.groupBy("instance_idx").agg(F.sort_array(F.collect_list(F.struct("slot", "position", "__choices"))).alias("rows"))  # k at most
    rows = rows.join(size).withColumn("state", F.lit(None).cast("binary")) if states is None else rows.join(size).join(states, "instance_idx")
    rows = rows.select("instance_idx", "rows", _choices(base_seed)("instance_idx", "__size", F.transform("rows", lambda x: x["__choices"]), "state").alias("picks"))
    one = rows.select("instance_idx", F.explode(F.arrays_zip("rows", "picks")).alias("x")).where("x.picks >= 0")
    got = _fetched(one.select("instance_idx", "x.rows.slot", "x.rows.position", F.col("x.picks").alias(pick_name)), pool, keys, numbered, pick_name)
    return got.withColumn(name, F.get(usable_ones, F.col(pick_name))).drop(pick_name)


def _choices(base_seed: int) -> Callable[..., Column]:
    """Where the generator's choices fall, of so many items each, from its state, or if that is null after
    its sample; -1 of no items."""

    @F.pandas_udf("array<int>")
    def picks(instances: pd.Series, sizes: pd.Series, counts: pd.Series, states: pd.Series) -> pd.Series:
        out = []
        for i, size, each, state in zip(instances, sizes, counts, states, strict=True):
            r = random.Random(base_seed + int(i))
            if state is not None:
                r.setstate((r.VERSION, tuple(array("Q", state)), None))
            else:
                r.sample(range(int(size)), len(each))
            out.append([r.choice(range(int(n))) if n else -1 for n in each])
        return pd.Series(out)

    return picks


def _shuffled(size: int, base_seed: int, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The first positions of each row's shuffled pool, and a row at slot -1 with the generator's state."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["instance_idx"].tolist():
                order, r = array("q", range(size)), random.Random(base_seed + i)
                r.shuffle(order)
                rows += [(i, s, p, None) for s, p in enumerate(order[:most])]
                rows.append((i, -1, -1, array("Q", r.getstate()[1]).tobytes()))
            yield pd.DataFrame(rows, columns=["instance_idx", "slot", "position", "state"])

    return draw


def pick(references: Column, seed: Column) -> Column:
    """One of an array's items, by hash; null of none."""
    n = F.size(references)
    return F.when(n > 0, F.get(references, F.pmod(hashed(seed, F.lit("pick")), F.greatest(n, F.lit(1))).cast("int")))


def exact_pick(references: Column, seed: Column) -> Column:
    """One of an array's items as ``random.Random(seed).choice`` picks it; null of none."""
    return F.get(references, _choice(F.size(references), seed.cast("long")))


@F.pandas_udf(IntegerType())
def _choice(sizes: pd.Series, seeds: pd.Series) -> pd.Series:
    return pd.Series([random.Random(int(s)).choice(range(int(n))) if n > 0 else 0 for n, s in zip(sizes, seeds, strict=True)], dtype="int32")


def gathered(drawn: DataFrame, source: str, target: str) -> DataFrame:
    """instance_idx and its examples (input, output) in the order drawn; at most k, so one small array."""
    items = F.sort_array(F.collect_list(F.struct("slot", F.col(source).alias("input"), F.col(target).alias("output"))))
    return drawn.groupBy("instance_idx").agg(F.transform(items, lambda x: F.struct(x["input"], x["output"])).alias("examples"))
