"""N-grams as arrays of strings or as rows, and counts of what two texts share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between the tokens of a gram.
JOINT = "\x01"
#: Tokens of both sides that are numbered at once; a longer document is on its own.
TOKENS = 1 << 20


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, with repeats."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), JOINT))


def count_in(array: Column, value: Column) -> Column:
    return F.size(array) - F.size(F.array_remove(array, value))


def repeated(grams: Column) -> Column:
    """Distinct grams that an ascending array has more than once."""
    return F.array_distinct(F.filter(grams, lambda g, i: (i > 0) & (F.get(grams, i - 1) == g)))


def clipped_matches(prediction: Column, reference: Column) -> Column:
    """Sum over distinct grams of the lesser of their counts, of two ascending arrays (columns, not
    expressions, so that nothing is computed anew for each gram).

    Shared grams count once; only those that both repeat are counted one by one.  Texts that repeat
    thousands of grams go through :func:`batched_matches`.
    """
    more = F.transform(F.array_intersect(repeated(prediction), repeated(reference)), lambda g: F.least(count_in(prediction, g), count_in(reference, g)) - 1)
    return F.size(F.array_intersect(prediction, reference)) + F.aggregate(more, F.lit(0), lambda a, x: a + x)


def gram_counts(df: DataFrame, keys: list[str], tokens: str, n: int) -> DataFrame:
    """A row for each key and distinct gram with its count: linear in the text, whatever its length."""
    grams = df.select(*keys, F.explode(ngrams(F.col(tokens), n)).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def _span(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and where each list's begin, with the end; a null list is empty."""
    lists = lists.cast(pa.large_list(pa.large_string()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.append(0, np.cumsum(sizes))


def matches_of(one: pa.Array, two: pa.Array, orders: tuple[int, ...]) -> np.ndarray:
    """Clipped matches of two columns of token lists, a column for each order.

    Tokens are numbered by document; a gram's number is that of its first tokens together with its
    last token, numbered anew for each order.  Numbers stand for grams without collisions, as they
    are ranks and no hashes.  Counts of both sides then merge by number.
    """
    (a, at_a), (b, at_b) = _span(one), _span(two)
    n, size = len(at_a) - 1, len(a) + len(b)
    out = np.zeros((n, len(orders)), np.int64)
    if not size:
        return out
    token = pa.chunked_array([a, b]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    row = np.concatenate([np.repeat(np.arange(n), np.diff(at_a)), np.repeat(np.arange(n), np.diff(at_b))])
    left = np.concatenate([np.repeat(at_a[1:], np.diff(at_a)) - np.arange(len(a)), np.repeat(at_b[1:], np.diff(at_b)) - np.arange(len(b))])
    at, gram, kinds = np.arange(size), row, int(token.max()) + 1
    for k in range(1, max(orders) + 1):
        some = left[at] >= k
        at = at[some]
        gram, names = pd.factorize(gram[some] * kinds + token[at + k - 1])
        if k in orders:
            first = np.bincount(gram[at < len(a)], minlength=len(names))
            least = np.minimum(first, np.bincount(gram, minlength=len(names)) - first)
            owner = np.zeros(len(names), np.int64)
            owner[gram] = row[at]
            out[:, orders.index(k)] = np.bincount(owner, least, n)
    return out


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def set_counts(source: pa.Array, prediction: pa.Array, references: pa.Array, orders: tuple[int, ...]) -> np.ndarray:
    """Distinct grams of each row by order and by who has them, the sum of 1 (source), 2 (prediction)
    and 4 (any reference): an array of rows by orders by 8.  ``references`` are lists of token lists.

    Grams are numbered as in :func:`matches_of`, so numbers stand for them without collisions.
    """
    references = references.cast(pa.large_list(pa.large_list(pa.large_string())))
    texts = [source, prediction, references.flatten()]
    n, sizes = len(source), [_lengths(x) for x in texts]
    rows = [np.arange(n), np.arange(n), np.repeat(np.arange(n), _lengths(references))]
    out = np.zeros((n, len(orders), 8), np.int64)
    row, has = (np.repeat(np.concatenate(x), np.concatenate(sizes)) for x in (rows, [np.full(len(s), 1 << i, np.int64) for i, s in enumerate(sizes)]))
    if not len(row):
        return out
    tokens = pa.chunked_array([x.cast(pa.large_list(pa.large_string())).flatten() for x in texts])
    token = tokens.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    every = np.concatenate(sizes)
    left = np.repeat(np.cumsum(every), every) - np.arange(len(token))
    at, gram, kinds = np.arange(len(token)), row, int(token.max()) + 1
    for k in range(1, max(orders) + 1):
        some = left[at] >= k
        at = at[some]
        gram, names = pd.factorize(gram[some] * kinds + token[at + k - 1])
        if k in orders:
            owner, who = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            owner[gram] = row[at]
            for bit in (1, 2, 4):
                mine = np.zeros(len(names), bool)
                mine[gram[has[at] == bit]] = True
                who += bit * mine
            out[:, orders.index(k)] = np.bincount(owner * 8 + who, minlength=8 * n).reshape(n, 8)
    return out


def in_slices(f: Callable[..., np.ndarray], *columns: pa.Array) -> np.ndarray | None:
    """``f`` of slices of the columns with at most ``TOKENS`` tokens together, or one row; None of no rows."""
    sizes = np.zeros(len(columns[0]), np.int64)
    for x in columns:
        each = _lengths(x)
        if pa.types.is_nested(x.type.value_type):
            each = np.add.reduceat(np.append(_lengths(x.flatten()), 0), np.append(0, np.cumsum(each))[:-1]) * (each > 0) if len(x) else each
        sizes += each
    ends, out, i = np.cumsum(sizes), [], 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOKENS, "right")))
        out.append(f(*[x.slice(i, j - i) for x in columns]))
        i = j
    return np.concatenate(out) if out else None


def batched_matches(orders: tuple[int, ...]) -> Callable[..., Column]:
    """:func:`clipped_matches` of two token arrays for every order at once, as an array: for texts of
    any length, in Arrow batches, without a shuffle."""

    @F.arrow_udf("array<long>")
    def matches(one: pa.Array, two: pa.Array) -> pa.Array:
        found = in_slices(lambda a, b: matches_of(a, b, orders), one, two)
        found = np.zeros((0, len(orders)), np.int64) if found is None else found
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(orders)), pa.int32()), pa.array(found.ravel()))

    return matches
