"""Token-id files with Elias-Fano document boundaries.

A file row is a shard: the ids of consecutive documents in one array, and the ends of the
documents as an Elias-Fano sequence (about 2 + log2(mean length) bits a document in place of 64).
Shards hold at most ``SHARD_IDS`` ids, or one document; files are Parquet, so that any store that
Spark reads and writes will do.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

SHARD_IDS = 1 << 21
#: Every so many ones of the upper bits, select() and decode() find a sample of where they are.
SAMPLE = 256
#: Documents that are encoded or decoded at once.
BLOCK = 1 << 14

SHARD = "part int, shard int, n_docs long, n_ids long, width int, ids binary, ends binary, n_null long, least long, doc_ids binary"


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers from 0 up."""

    n: int
    low_bits: int
    low: np.ndarray  # uint8, ``low_bits`` bits of each value
    high: np.ndarray  # uint8, the rest in unary
    samples: np.ndarray  # where in ``high`` every SAMPLE-th one is

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        k = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        low = [np.packbits(((values[i : i + BLOCK, None] >> np.arange(k)) & 1).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, BLOCK)]
        ones = (values >> k) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, k, np.concatenate([np.empty(0, np.uint8), *low]), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, k, a, b = np.frombuffer(data, "<i8", 4).tolist()
        body = np.frombuffer(data, np.uint8)[32:]
        return cls(n, k, body[:a], body[a : a + b], np.frombuffer(body[a + b :].tobytes(), "<u4"))

    def select(self, i: int) -> int:
        """Value ``i``, from its sample on."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        # the sampled one is the first counted; ones before it in its byte do not count
        left += int(np.bitwise_count(self.high[byte] & np.uint8((1 << at % 8) - 1)))
        while (ones := int(np.bitwise_count(self.high[byte]))) <= left:
            left, byte = left - ones, byte + 1
        place = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left]
        upper = byte * 8 + int(place) - i
        bits = np.arange(i * self.low_bits, (i + 1) * self.low_bits)
        lower = sum(int(self.low[b // 8] >> (b % 8) & 1) << j for j, b in enumerate(bits.tolist()))
        return upper << self.low_bits | lower

    def decode(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last``, without the last, from the sample before them on."""
        if first >= last:
            return np.empty(0, np.int64)
        s, e, k = first // SAMPLE, (last - 1) // SAMPLE + 1, self.low_bits
        at = int(self.samples[s])
        to = int(self.samples[e]) // 8 + 1 if e < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[at // 8 : to], bitorder="little")
        bits[: at % 8] = 0
        ones = np.flatnonzero(bits)[first - s * SAMPLE : last - s * SAMPLE] + at // 8 * 8
        low = np.unpackbits(self.low[first * k // 8 : -(-last * k // 8)], bitorder="little")[first * k % 8 :][: (last - first) * k]
        return (ones - np.arange(first, last)) << k | (low.reshape(-1, k).astype(np.int64) << np.arange(k)).sum(1) if k else ones - np.arange(first, last)

    def index(self, value: int) -> tuple[int, int]:
        """Where values equal to ``value`` start and end, by select."""
        return bisect_left(range(self.n), value, key=self.select), bisect_right(range(self.n), value, key=self.select)


def _shards(batches, tokenizer: str, blank: str, end_id: int, special: bool):
    """Shard rows of one partition, whose documents come in order."""
    tokens, part, number = encoder(tokenizer, blank, special), TaskContext.get().partitionId(), 0
    kind = tokens.kind if end_id <= np.iinfo(tokens.kind).max else np.dtype("<u4")
    end = np.array([end_id], kind)
    ids, doc_ids, held = [], [], 0

    def row():
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
        known = np.array([x for x in doc_ids if x is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        return {
            "part": part, "shard": number, "n_docs": len(ids), "n_ids": held, "width": kind.itemsize,
            "ids": np.concatenate(ids).tobytes(), "ends": EliasFano.of(ends).to_bytes(),
            "n_null": len(doc_ids) - len(known), "least": least, "doc_ids": EliasFano.of(known - least).to_bytes(),
        }

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()), ("n_null", pa.int64()), ("least", pa.int64()), ("doc_ids", pa.binary())])
    for batch in batches:
        texts, numbers = batch.column("text"), batch.column("doc_id").to_pylist()
        for a, b in common.slices(texts, common.BATCH_BYTES):
            for doc_id, x in zip(numbers[a:b], tokens.encode(common.texts_of(texts.slice(a, b - a))), strict=True):
                if ids and held + len(x) + 1 > SHARD_IDS:
                    yield pa.RecordBatch.from_pylist([row()], schema)
                    ids, doc_ids, held, number = [], [], 0, number + 1
                ids.append(np.concatenate([x.astype(kind, copy=False), end]))
                doc_ids.append(doc_id)
                held += len(x) + 1
    if ids:
        yield pa.RecordBatch.from_pylist([row()], schema)
    tokens.rest()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, blank: str = "dropped", special: bool = True) -> None:
    """Write the ids of ``docs`` (doc_id, text) with ``end_id`` after each document, by doc_id.

    Null texts count as empty, a null doc_id comes first, rows that share a doc_id are documents
    of their own in the order of their texts' hashes; other columns are ignored.  An empty table
    writes no shard.  Special tokens' strings in a text get their ids, as the library has it, unless
    ``special`` is false.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    common.map_batches(rows, lambda b: _shards(b, tokenizer, blank, end_id, special), SHARD).write.parquet(path)


def _blocks(row: dict, chosen: list[int] | None) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, starts and ends of a shard's documents, by blocks; of the ``chosen`` ones each by select."""
    ends, doc_ids, nulls = EliasFano.from_bytes(row["ends"]), EliasFano.from_bytes(row["doc_ids"]), row["n_null"]
    if chosen is not None:
        for doc_id in chosen:
            a, b = doc_ids.index(doc_id - row["least"])
            for i in range(a + nulls, b + nulls):
                yield [doc_id], np.array([ends.select(i - 1) if i else 0]), np.array([ends.select(i)])
        return
    start = 0
    for i in range(0, ends.n, BLOCK):
        to = ends.decode(i, min(i + BLOCK, ends.n))
        known = doc_ids.decode(max(0, i - nulls), max(0, i + len(to) - nulls)) + row["least"]
        yield [None] * (len(to) - len(known)) + known.tolist(), np.append(start, to[:-1]), to
        start = int(to[-1])


def _documents(batches, with_ids: bool, chosen: list[int] | None):
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], f"<u{row['width']}")
            for doc_ids, starts, ends in _blocks(row, chosen):
                mine, first = ids[starts[0] : ends[-1]].astype("<u4"), int(starts[0])
                out = {
                    "part": pa.array([row["part"]] * len(ends), pa.int32()), "shard": pa.array([row["shard"]] * len(ends), pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()), "at": pa.array(starts), "n_tokens": pa.array(ends - starts),
                    "ids_crc32": pa.array([zlib.crc32(mine[a:b]) for a, b in zip((starts - first).tolist(), (ends - first).tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts - first, ends[-1] - first).astype(np.int32)), pa.array(mine.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)


def read(spark: SparkSession, path: str, with_ids: bool = False, chosen: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in the files at ``path``, or of
    the ``chosen`` doc_ids, whose places are found by select without decoding the rest."""
    shards = spark.read.schema(SHARD).parquet(path)
    counts = shards.select("part", "shard", "n_ids")
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # one row for each partition that wrote
    of_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(of_part), F.lit(0)).alias("base"))
    bases = counts.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("base") + F.col("before")).alias("base"))
    schema = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = common.map_batches(shards, lambda b: _documents(b, with_ids, chosen), schema)
    return docs.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
