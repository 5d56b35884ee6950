"""Row metrics: BLEU by single orders, ROUGE-N, ROUGE-L, and SARI on n-gram sets.

BLEU is by sentence, without smoothing, on white-space tokens (0 to 100); ROUGE gives F1 on word
tokens (0 to 1); SARI averages keep, delete and add F1 over four orders (0 to 100).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..sources.staging import unused
from .ngrams import batched_matches, clipped_matches, in_slices, ngrams, set_counts
from .text import as_text, column, is_blank, space_tokens, usable, word_tokens

ORDERS = (1, 2, 3, 4)


def _matches(df: DataFrame, one: str, two: str, orders: tuple[int, ...], long: bool) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with the clipped matches of two token columns by order, and the columns that hold them."""
    if long:
        (name,) = unused(df, "matches")
        return df.withColumn(name, batched_matches(orders)(one, two)), [F.get(name, F.lit(i)) for i in range(len(orders))], [name]
    names = unused(df, *[f"{k}{n}" for n in orders for k in ("one", "two")])
    sides = list(zip(names[::2], names[1::2], orders, strict=True))
    grams = {name: F.sort_array(ngrams(F.col(side), n)) for a, b, n in sides for name, side in ((a, one), (b, two))}
    return df.withColumns(grams), [clipped_matches(F.col(b), F.col(a)) for a, b, _ in sides], names


def _grams_in(tokens: str, n: int) -> Column:
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0))


def with_bleu(df: DataFrame, reference: str, prediction: str, long: bool = False) -> DataFrame:
    """Add bleu_1 to bleu_4 and bleu_overall; 0 where either side is null or blank.

    ``long`` counts grams in Arrow batches, in time linear in the texts whatever they repeat.
    """
    r, p, brevity, *shares = unused(df, "r", "p", "brevity", *[f"share{n}" for n in ORDERS])
    none = is_blank(reference) | is_blank(prediction)
    df = df.withColumns({r: space_tokens(reference), p: space_tokens(prediction)})
    df, matches, own = _matches(df, r, p, ORDERS, long)
    made = {brevity: F.when(none, 0.0).otherwise(_brevity(F.size(r).cast("double"), F.size(p).cast("double")))}
    for name, n, m in zip(shares, ORDERS, matches, strict=True):
        size = _grams_in(p, n)
        made[name] = F.when(size > 0, m / F.when(size > 0, size)).otherwise(0.0)
    df = df.withColumns(made)
    return df.withColumns(_bleu(F.col(brevity), [F.col(s) for s in shares])).drop(r, p, *own, *made)


def _brevity(reference: Column, prediction: Column) -> Column:
    return F.when(prediction == 0, 0.0).when(prediction > reference, 1.0).otherwise(F.exp(1 - reference / F.when(prediction > 0, prediction)))


def _bleu(brevity: Column, shares: list[Column]) -> dict[str, Column]:
    logs = sum((F.ln(F.when(s > 0, s)) for s in shares), F.lit(0.0))
    out = {f"bleu_{n}": 100 * brevity * s for n, s in zip(ORDERS, shares, strict=True)}
    return out | {"bleu_overall": F.when(F.least(*shares) > 0, 100 * brevity * F.exp(logs / len(ORDERS))).otherwise(0.0)}


def bleu_of_long(df: DataFrame, keys: list[str], reference: str, prediction: str) -> DataFrame:
    """keys and the scores of :func:`with_bleu`, for texts of any length."""
    return with_bleu(df, reference, prediction, long=True).select(*keys, *[f"bleu_{n}" for n in ORDERS], "bleu_overall")


def rouge_n_of_long(df: DataFrame, keys: list[str], reference: str, prediction: str, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """keys and the scores of :func:`with_rouge_n`, for texts of any length."""
    return with_rouge_n(df, reference, prediction, orders, long=True).select(*keys, *[f"rouge{n}" for n in orders])


def _f1(matches: Column, predicted: Column, wanted: Column) -> Column:
    """2 matches / (predicted + wanted), which is F1 of precision and recall; 0 if none match."""
    total = predicted + wanted
    return F.when((total > 0) & (matches > 0), 2.0 * matches / F.when(total > 0, total)).otherwise(0.0)


def with_rouge_n(df: DataFrame, reference: str, prediction: str, orders: tuple[int, ...] = (1, 2), long: bool = False) -> DataFrame:
    """Add rouge1, rouge2 (F1).  Null counts as the word None.  ``long`` is as in :func:`with_bleu`."""
    r, p = unused(df, "r", "p")
    df = df.withColumns({r: word_tokens(as_text(reference)), p: word_tokens(as_text(prediction))})
    df, matches, own = _matches(df, r, p, orders, long)
    scores = {f"rouge{n}": _f1(m, _grams_in(p, n), _grams_in(r, n)) for n, m in zip(orders, matches, strict=True)}
    return df.withColumns(scores).drop(r, p, *own)


#: Bits of a row that are worked on at once; more go in blocks, with a carry between.
BLOCK = 4096


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by rows of bits.

    Bit j of a row is 0 where the best common subsequence of b's first j + 1 items grows; a token's
    row is one addition, whose carries run through the bits, and is kept in blocks of machine words.
    The work is the product of the lengths over the bits of a word; memory is linear.
    """
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        low += 1
    while high_a > low < high_b and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
    same, a, b = low + len(a) - high_a, a[low:high_a], b[low:high_b]
    carries = bytearray(len(a))
    for at in range(0, len(b), BLOCK):
        part = b[at : at + BLOCK]
        places: dict = {}
        for j, token in enumerate(part):
            places[token] = places.get(token, 0) | 1 << j
        n, full = len(part), (1 << len(part)) - 1
        row, get = full, places.get
        for i, token in enumerate(a):
            met = get(token, 0) & row
            if met or carries[i]:
                total = row + met + carries[i]
                carries[i] = total >> n
                row = (total & full) | (row - met)
        same += n - row.bit_count()
    return same


@F.pandas_udf(IntegerType())
def lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def with_rouge_l(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """Add rougeL (F1), of texts of any length."""
    r, p, length = unused(df, "r", "p", "lcs")
    df = df.withColumns({r: word_tokens(as_text(reference)), p: word_tokens(as_text(prediction))}).withColumn(length, lcs(r, p))
    return df.withColumn("rougeL", _f1(F.col(length), F.size(p), F.size(r))).drop(r, p, length)


def with_rouge(df: DataFrame, reference: str, prediction: str, orders: tuple[int, ...] = (1, 2), long: bool = False) -> DataFrame:
    """:func:`with_rouge_n` and :func:`with_rouge_l` of tokens that are found once."""
    r, p, length = unused(df, "r", "p", "lcs")
    df = df.withColumns({r: word_tokens(as_text(reference)), p: word_tokens(as_text(prediction))})
    df, matches, own = _matches(df, r, p, orders, long)
    df = df.withColumn(length, lcs(r, p))
    scores = {f"rouge{n}": _f1(m, _grams_in(p, n), _grams_in(r, n)) for n, m in zip(orders, matches, strict=True)}
    return df.withColumns(scores | {"rougeL": _f1(F.col(length), F.size(p), F.size(r))}).drop(r, p, length, *own)


def _set_f1(matches: np.ndarray, predicted: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.where(matches > 0, 2.0 * matches / np.maximum(predicted + wanted, 1), 0.0)


def sari_of(source: pa.Array, prediction: pa.Array, references: pa.Array) -> np.ndarray:
    """SARI of token lists against lists of token lists; 0 without a reference."""
    total = np.zeros(len(source))
    counts = set_counts(source, prediction, references, ORDERS)
    for i in range(len(ORDERS)):
        _, s, y, sy, r, sr, yr, syr = counts[:, i].T
        total += _set_f1(syr, sy + syr, sr + syr) + _set_f1(s, s + sr, s + sy) + _set_f1(yr, y + yr, r + yr)
    given = pc.fill_null(pc.list_value_length(references), 0).to_numpy(zero_copy_only=False)
    return np.where(given > 0, 100 * total / (3 * len(ORDERS)), 0.0)


@F.arrow_udf(DoubleType())
def sari(source: pa.Array, prediction: pa.Array, references: pa.Array) -> pa.Array:
    scores = in_slices(sari_of, source, prediction, references)
    return pa.array([] if scores is None else scores, pa.float64())


def with_sari(df: DataFrame, source: str, references: list[Column | str], prediction: str, name: str = "sari") -> DataFrame:
    """Add SARI against all usable references; one, many or none (then 0).

    With R the union of the references' grams: keep compares S∩R with S∩Y, delete S−R with S−Y,
    add R−S with Y−S.  Grams are numbered in Arrow batches, in time linear in the texts.
    """
    refs, src, made = unused(df, "refs", "s", "y")
    df = df.withColumn(refs, F.transform(usable(*references), word_tokens))
    df = df.withColumns({src: word_tokens(source), made: word_tokens(prediction)})
    return df.withColumn(name, sari(src, made, refs)).drop(refs, src, made)


def first_reference(*references: Column | str) -> Column:
    """The first usable reference, or null."""
    return F.get(usable(*[column(c) for c in references]), F.lit(0))
