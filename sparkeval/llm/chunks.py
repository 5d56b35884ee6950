"""Substring deduplication by content-defined chunks.

A gear hash rolls over the last ``WINDOW`` bytes; a word that follows a hash with ``CUT_BITS`` zero
bits opens a chunk, so chunks (about ``2**CUT_BITS`` words) depend on nearby text alone and an
insertion moves no boundary but its neighbours.  Chunks are told apart by digest and length.  A
chunk whose first occurrence (by doc_id, then place) lies in another document is a repeat; repeats
in a row of at least ``MIN_WORDS`` words or ``MIN_CHARS`` signs (chunks met again within the row
not counted) are a repeated passage, if half of that lies in one document at the same distances.
So no single digest decides: a passage of more than one chunk takes as many chance agreements, of
64 bits each, in a row and at the same distances.

Chunks meet once, dealt by digest.  Those that make up a 512th of all chunks or more are found
beforehand (Misra and Gries' summary of each partition) and dealt evenly; their first occurrences,
1,024 at most, are sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

U = np.uint64
WINDOW, CUT_BITS = 12, 2
MIN_WORDS, MIN_CHARS = 20, 200
#: A word of more bytes is cut inside, at characters, with six zero bits.
LONG_WORD, LONG_BITS = 256, 6

GEAR = words.mix(np.arange(7001, 7257, dtype=U)).astype(np.uint32)
#: Every byte counts in a digest, white space too.
_BYTE = words.mix(np.arange(9001, 9257, dtype=U)) | U(1)

CHUNK = "digest long, salt int, doc_id long, tie long, at long, size long"
#: Counters of a partition's summary of frequent digests; of its chunks, the least share that it
#: reports; of all chunks, the least share (by reports) that makes a digest frequent.
COUNTERS, REPORTED, FREQUENT = 8192, 1 / 8192, 1 / 1024


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the ``WINDOW`` bytes that end at each byte."""

    def later(x: np.ndarray, n: int, shift: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[n:] = x[:-n] << np.uint32(shift)
        return out

    if len(data) <= WINDOW:
        data = np.concatenate([data, np.zeros(WINDOW + 1 - len(data), np.uint8)])
    one = GEAR[data]
    two = one + later(one, 1, 1)
    four = two + later(two, 2, 2)
    eight = four + later(four, 4, 4)
    return eight + later(four, 8, 8)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of the chunks of all documents, ascending; each text has one at its start."""
    starts, ends = words.bounds(data, offsets)
    if not len(starts):
        return np.unique(offsets[:-1][np.diff(offsets) > 0])
    hashes = gear(data) >> np.uint32(WINDOW - 1 - LONG_BITS)  # its top bits see the whole window
    begin = offsets[np.searchsorted(offsets, starts, "right") - 1]
    full = starts - begin >= WINDOW  # before that, the window would reach into another document
    cut = starts[full & (hashes[starts - 1] >> np.uint32(LONG_BITS - CUT_BITS) & np.uint32((1 << CUT_BITS) - 1) == 0)]
    more = [cut, offsets[:-1][np.diff(offsets) > 0]]
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        inner = np.arange(starts[k] + WINDOW, ends[k])
        inner = inner[(hashes[inner - 1] & np.uint32((1 << LONG_BITS) - 1) == 0) & (data[inner] & 0xC0 != 0x80)]
        more.append(inner)
    return np.unique(np.concatenate(more))


def _cut_up(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of the texts, by slices: batch, row in it, digest, at = index << 32 | start, size = signs << 32 | words."""
    for batch in batches:
        column = batch.column("text")
        for a, b in common.slices(column):
            data, offsets = common.text_bytes(column.slice(a, b - a))
            if not len(data):
                continue
            at = boundaries(data, offsets)
            to = np.append(at[1:], len(data))
            of = np.searchsorted(offsets, at, "right") - 1
            signs = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            begun = np.searchsorted(words.bounds(data, offsets)[0], np.append(at, len(data)))
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            index = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            # trailing white space does not count in a digest, so that a passage may end a document
            stop = to - _trailing(data, at, to)
            digest = words.span_hashes(data, at, stop, _BYTE).view(np.int64)
            yield batch, a + of, digest, index << 32 | (signs[at] - signs[offsets[of]]), (signs[to] - signs[at]) << 32 | np.diff(begun)


def _trailing(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """White bytes at the end of each span, but not the whole span."""
    black = np.flatnonzero(~words.WHITE[data])
    if not len(black):
        return np.zeros(len(at), np.int64)
    last = black[(np.searchsorted(black, to) - 1).clip(0)] + 1
    return np.where((last > at) & (last <= to), to - last, 0)


def _within(digests: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which digests are among ``some``, which ascend."""
    return some[np.searchsorted(some, digests).clip(max=len(some) - 1)] == digests if len(some) else np.zeros(len(digests), bool)


def _chunks(batches, frequent: np.ndarray, salts: int, only: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of ``CHUNK``: a frequent digest has one of ``salts`` salts by document, others have 0.
    Frequent ones alone, if ``only``."""
    for batch, row, digest, at, size in _cut_up(batches):
        often = _within(digest, frequent)
        if only:
            row, digest, at, size, often = (x[often] for x in (row, digest, at, size, often))
        doc_id, tie = (batch.column(n).to_numpy(zero_copy_only=False)[row] for n in ("doc_id", "tie"))
        salt = np.where(often, words.mix(doc_id.view(U) + tie.view(U)) % U(salts) + U(1), U(0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest, salt, doc_id, tie, at, size)], ["digest", "salt", "doc_id", "tie", "at", "size"])


def _summary(batches) -> Iterator[pa.RecordBatch]:
    """The frequent digests of a partition and how often each comes, less an error of at most one in
    ``COUNTERS`` chunks; the number of all chunks has no digest."""
    keys, counts, total = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for _, _, digest, _, _ in _cut_up(batches):
        total += len(digest)
        keys, place = np.unique(np.concatenate([keys, digest]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, np.ones(len(digest), np.int64)]), len(keys)).astype(np.int64)
        if (more := len(keys) - COUNTERS) > 0:
            counts -= np.partition(counts, more - 1)[more - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
    often = counts >= total * REPORTED
    yield pa.RecordBatch.from_arrays([pa.array([*keys[often].tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), total], pa.int64())], ["digest", "n"])


def _tie(docs: DataFrame) -> Column:
    """What tells apart rows that share a doc_id but not a text: 0 where no doc_id repeats."""
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return F.xxhash64("text") if again else F.lit(0).cast("long")


def _keyed(docs: DataFrame, tie: Column) -> DataFrame:
    """doc_id, tie and text of the rows that have an id and a text."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"), "text")


def frequent_digests(rows: DataFrame) -> np.ndarray:
    """Every digest that is a 512th of all chunks or more, ascending; 1,024 at most, as each is about a 1,024th."""
    counts = common.map_batches(rows.select("text"), _summary, "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    counts = common.stage(counts, "frequent")
    total = counts.where("digest is null").agg(F.sum("n")).first()[0] or 0
    # a digest loses at most a COUNTERS-th of the chunks to error, and two where it is not reported
    found = counts.where(F.col("digest").isNotNull() & (F.col("n") >= max(2.0, total * FREQUENT))).select("digest").collect()
    return np.sort(np.array([r["digest"] for r in found], np.int64))


def chunk_table(docs: DataFrame) -> DataFrame:
    """A row for each chunk: digest, doc_id, at = index << 32 | start, size = signs << 32 | words."""
    return common.map_batches(_keyed(docs, _tie(docs)), lambda b: _chunks(b, np.empty(0, np.int64), 1), CHUNK)


def repeats(docs: DataFrame, tie: Column) -> DataFrame:
    """Chunks that an earlier document has: doc_id, tie, at, size, source_doc_id and source_k, where it has them first."""
    rows = _keyed(docs, tie)
    frequent, salts = frequent_digests(rows), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = common.map_batches(rows, lambda b: _chunks(b, frequent, salts), CHUNK)
    # the first of each digest leads its rows; what follows from other documents is a repeat
    order = Window.partitionBy("digest", "salt").orderBy("doc_id", "tie", "at")
    chunks = chunks.withColumns({f"first_{c}": F.first(c).over(order) for c in ("doc_id", "tie", "at")})
    if len(frequent):
        first = common.map_batches(rows, lambda b: _chunks(b, frequent, salts, only=True), CHUNK).groupBy("digest").agg(F.min(F.struct("doc_id", "tie", "at")).alias("first"))
        first = first.collect()  # 1,024 at most
        first = docs.sparkSession.createDataFrame([(r["digest"], *r["first"]) for r in first], "digest long, of_doc_id long, of_tie long, of_at long")
        chunks = chunks.join(F.broadcast(first), "digest", "left").withColumns({f"first_{c}": F.coalesce(f"of_{c}", f"first_{c}") for c in ("doc_id", "tie", "at")})
    again = chunks.where("doc_id <> first_doc_id or tie <> first_tie")
    return again.select("doc_id", "tie", "at", "size", F.col("first_doc_id").alias("source_doc_id"), F.shiftright("first_at", 32).cast("int").alias("source_k"))


def _passages(docs: DataFrame, tie: Column, min_words: int, min_chars: int) -> DataFrame:
    """:func:`repeated_passages` with ``tie``."""
    k = F.shiftright("at", 32)
    again = repeats(docs, tie).repartition("doc_id", "tie").distinct()
    again = again.select("doc_id", "tie", k.alias("k"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("start"), F.shiftright("size", 32).alias("n"), F.col("size").bitwiseAND(0xFFFFFFFF).alias("w"), "source_doc_id", "source_k", (k - F.col("source_k")).alias("shift"))
    runs = again.withColumn("run", F.col("k") - F.dense_rank().over(Window.partitionBy("doc_id", "tie").orderBy("k")))
    # what a run says over and over counts once: a word that fills a page is no passage, a passage met again is
    runs = runs.withColumn("new", (F.col("k") == F.min("k").over(Window.partitionBy("doc_id", "tie", "run", "source_doc_id", "source_k"))).cast("long"))
    # chunks that one document has at the same distance from each other, each digest once: chance puts few words there
    same = runs.groupBy("doc_id", "tie", "run", "source_doc_id", "shift").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.sum("w").alias("w"), F.sum("n").alias("chars"), F.count("*").alias("n"), F.sum(F.col("new") * F.col("w")).alias("new_w"), F.sum(F.col("new") * F.col("n")).alias("new_n")
    )
    runs = same.groupBy("doc_id", "tie", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("w").alias("n_words"), F.sum("n").alias("n_chunks"), F.sum("new_w").alias("new_words"), F.sum("new_n").alias("new_chars"),
        F.max("w").alias("same_words"), F.max("chars").alias("same_chars"), F.max(F.struct("chars", -F.col("source_doc_id"))).alias("most"),
    )
    kept = runs.where((F.col("new_words") >= min_words) | (F.col("new_chars") >= min_chars))
    kept = kept.where((F.col("same_words") >= min_words / 2) | (F.col("same_chars") >= min_chars / 2)).withColumn("source_doc_id", -F.col("most.col2"))
    return kept.select("doc_id", "tie", "start", "end", "n_words", "n_chunks", "source_doc_id")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that an earlier document has too.

    A row for each: doc_id, start and end (code points, end exclusive), n_words, n_chunks and
    source_doc_id, the document that holds most of it first.  A document's first occurrences are
    no repeats, and what only one document says twice (a refrain, a table's header) is its own
    wording and stays.  Null and empty texts, and rows without doc_id, have none.  Rows that share
    a doc_id are documents of their own, told apart and ordered by their texts' hashes, and copies
    of each other if their texts are equal: such rows give equal passages, once.  An empty table
    gives no rows; other columns are ignored.
    """
    return _passages(docs, _tie(docs), min_words, min_chars).drop("tie")


def _cut(batches, names: list[str], spans: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True):
            if text is not None and cuts:
                at, kept = 0, []
                for s in sorted(cuts, key=lambda s: s["start"]):
                    kept.append(text[at : s["start"]])
                    at = max(at, s["end"])
                text = "".join([*kept, text[at:]])
            out.append(text)
        yield common.with_texts(batch, names, out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with each repeated passage cut from all documents but its first; rows all stay.

    ``n_chars``, where there is one, is counted anew.  Rows that share a doc_id are cut each by its
    own text; rows without text or doc_id, and an empty table, come back as they are; other
    columns are kept, whatever their names.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    names, own_tie = docs.columns, _tie(docs)
    spans, of, tie, row_tie = common.unused(docs, "spans", "of", "tie", "row_tie")
    cuts = _passages(docs, own_tie, MIN_WORDS, MIN_CHARS).groupBy(F.col("doc_id").alias(of), F.col("tie").alias(tie)).agg(F.collect_list(F.struct("start", "end")).alias(spans))
    both = docs.withColumn(row_tie, own_tie).join(cuts, (F.col("doc_id") == F.col(of)) & (F.col(row_tie) == F.col(tie)), "left").select(*common.columns(names), spans)
    return common.map_batches(both, lambda b: _cut(b, names, spans), docs.schema)
