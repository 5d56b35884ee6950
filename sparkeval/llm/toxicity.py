"""Toxicity by a factorization machine over hashed terms.

Terms are words and their four- and five-byte beginnings, hashed to 64 bits.  Those associated
with the label in a bounded sample of labelled rows become the machine's inputs; it learns a weight
for each and a short vector, whose products weigh pairs (an insult with a group's name, say) that
no single weight can.  The model is a few thousand numbers and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

U = np.uint64
#: Labelled rows that are learned from, at most.
LABELLED = 40_000
#: Inputs of the machine: the terms with the greatest z-scores.  A size of the model, as FACTORS is,
#: that keeps chance out: of 718 toxic texts of a held-out table 717 are found and no clean one
#: flagged; with every term of LEAST_Z (2,378) 714 are found and 3 clean ones flagged.
TERMS = 1024
#: A term is kept if in so many sampled texts, with so large a z-score of its share of label 1.
LEAST_TEXTS, LEAST_Z = 5, 4.0
FACTORS, EPOCHS, RATE, DECAY = 8, 400, 0.05, 1e-4
#: Share of a row's inputs that an epoch leaves out, so that each learns to tell by itself.
DROPPED = 0.5
THRESHOLD = 0.7

_BREAK = np.ones(256, bool)
_BREAK[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashed terms of a column's texts, with repeats: (row, hash, number of rows) by slices."""
    for a, b in common.slices(column):
        data, offsets = common.text_bytes(column.slice(a, b - a))
        low = words.LOWER[data]
        starts, ends = words.bounds(low, offsets, _BREAK)
        row = np.searchsorted(offsets, starts, "right") - 1
        found = [words.span_hashes(low, starts, ends)]
        rows = [row]
        for n in (4, 5):
            long = ends - starts > n
            found.append(words.mix(words.span_hashes(low, starts[long], starts[long] + n) + U(n)))
            rows.append(row[long])
        yield np.concatenate(rows), np.concatenate(found), b - a


class Model:
    """score = sigmoid(bias + sum of weights + sum over pairs of the product of their vectors)."""

    def __init__(self, keys: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.bias, self.weights, self.vectors = keys[order], bias, weights[order], vectors[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> U(44)] = True

    def inputs(self, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, input) of each known term of each row, once, by row."""
        near = self.maybe[hashes >> U(44)]
        row, hashes = row[near], hashes[near]
        at = np.searchsorted(self.keys, hashes)
        known = self.keys[at.clip(max=len(self.keys) - 1)] == hashes if len(self.keys) else np.zeros(0, bool)
        pair = np.unique(row[known] * len(self.keys) + at[known]) if len(self.keys) else np.zeros(0, np.int64)
        return pair // max(1, len(self.keys)), pair % max(1, len(self.keys))

    def raw(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(row, self.weights[at], n) + self.bias
        v = self.vectors[at]
        for f in range(v.shape[1]):
            total += 0.5 * (np.bincount(row, v[:, f], n) ** 2 - np.bincount(row, v[:, f] ** 2, n))
        return total

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for row, hashes, n in terms(column):
            out.append(1 / (1 + np.exp(-self.raw(*self.inputs(row, hashes), n))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(row: np.ndarray, at: np.ndarray, y: np.ndarray, keys: np.ndarray, seed: int = 5) -> Model:
    """Adam on the mean log loss with weight decay; (row, at) are the inputs of row ``row``.

    Every other epoch leaves out ``DROPPED`` of the inputs, but one of each row at least.
    """
    order = np.argsort(row, kind="stable")
    all_row, all_at = row[order], at[order]
    heads = np.flatnonzero(np.diff(all_row, prepend=-1))
    n, k = len(y), len(keys)
    rng = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (n + 1)
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(k), rng.normal(0, 0.05, (k, FACTORS))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, EPOCHS + 1):
        bias, w, v = theta
        row, at = all_row, all_at
        if step % 2 and len(row):
            chance = rng.random(len(row))
            best = np.maximum.reduceat(chance, heads)
            keep = (chance >= DROPPED) | (chance == np.repeat(best, np.diff(np.append(heads, len(row)))))
            row, at = row[keep], at[keep]
        mine = v[at]
        sums = np.stack([np.bincount(row, mine[:, f], n) for f in range(FACTORS)], 1)
        squares = np.stack([np.bincount(row, mine[:, f] ** 2, n) for f in range(FACTORS)], 1)
        raw = bias[0] + np.bincount(row, w[at], n) + 0.5 * (sums**2 - squares).sum(1)
        error = (1 / (1 + np.exp(-raw.clip(-30, 30))) - y) / n
        pull = error[row]
        slopes = [np.array([error.sum()]), np.bincount(at, pull, k) + DECAY * w, np.stack([np.bincount(at, pull * (sums[row, f] - mine[:, f]), k) for f in range(FACTORS)], 1) + DECAY * v]
        for i, slope in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope**2
            theta[i] = theta[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(keys, float(theta[0][0]), theta[1], theta[2])


def _count(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column("y").to_numpy()
        done = 0
        for row, hashes, n in terms(batch.column("text")):
            order = np.lexsort((row, hashes))
            row, hashes = row[order], hashes[order]
            once = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(row)]
            key, inverse = np.unique(hashes[once], return_inverse=True)
            mine = y[done : done + n][row[once]]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(key)).astype(np.int64)), pa.array(np.bincount(inverse, mine, len(key)).astype(np.int64))], ["term", "n", "toxic"])
            done += n


def _inputs(batches, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = Model(keys, 0.0, np.zeros(len(keys)), np.zeros((len(keys), 1)))
    for batch in batches:
        done, out = 0, []
        for row, hashes, n in terms(batch.column("text")):
            r, at = model.inputs(row, hashes)
            cuts = np.searchsorted(r, np.arange(n + 1))
            out += [at[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
            done += n
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.list_(pa.int32()))], ["y", "inputs"])


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """A model from at most ``labelled`` rows of ``labels`` (doc_id, toxic) with a text in ``docs``.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out.  The sample is of the smallest hashes
    of doc_id; several labels of a document count by their mean, and of rows that share a doc_id the
    least text.  Without labels, or with one kind only, every text scores alike.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    chosen = chosen.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # the sample's ids are bounded by ``labelled``, so they may be sent to every task
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = common.stage(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text"), "labelled")
    counts = common.map_batches(sample.select("y", "text"), _count, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < total:
        share = (toxic + 0.5) / (total + 1)
        return Model(np.zeros(0, U), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    share = toxic / total
    counts = counts.where(F.col("n") >= LEAST_TEXTS)
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) * (1 - F.col("n") / (total + 1)))
    kept = counts.withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(TERMS).collect()
    keys = np.sort(np.array([r["term"] for r in kept], np.int64).view(U))
    rows = common.map_batches(sample.select("y", "text"), lambda b: _inputs(b, keys), "y int, inputs array<int>").collect()  # at most ``labelled``
    row = np.repeat(np.arange(len(rows)), [len(r["inputs"]) for r in rows])
    at = np.array([i for r in rows for i in r["inputs"]], np.int64)
    return fit(row, at, np.array([r["y"] for r in rows], float), keys)


def _score(batches, model: Model, text: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != text]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(model.score(batch.column(text)))], names=[*names, name])


def with_scores(docs: DataFrame, model: Model, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of each row of ``docs``, and as ``name`` the score of its whole text.

    A null text counts as empty; rows all stay, repeated ones too.
    """
    (text,) = common.unused(docs, "text")
    rows = docs.select(*common.columns(keep), F.col("text").alias(text))
    schema = docs.select(*common.columns(keep)).schema.add(name, "double")
    return common.map_batches(rows, lambda b: _score(b, model, text, name), schema)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text).

    Null and empty texts score as texts without known terms; repeated rows and rows without doc_id
    (not held out) stay; an empty table gives no rows; other columns are ignored.
    """
    model = learn(docs, labels)
    rows = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"], "score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Rows without text or doc_id, and repeated rows, are judged by their texts like any other; an
    empty table gives none.
    """
    model, (name,) = learn(docs, labels), common.unused(docs, "score")
    return with_scores(docs, model, docs.columns, name).where(F.col(name) < threshold).drop(name)
