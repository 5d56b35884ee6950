"""Best-fit packing of tokenised documents into sequences, then a local search over bins.

Pieces are dealt at random to blocks of about ``BLOCK`` pieces.  Each block is packed best-fit in
descending length; underfull bins then trade pieces (one for one, one for two, two for one, or a
plain move) whenever that raises the sum of squared fills, so that fuller bins close up and
emptier ones drain until they are gone.  A block leaves at most about one bin of slack, whatever
the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import REMEMBERED, encoder

CAPACITY = 1024
#: Pieces packed together, about.
BLOCK = 20_000

PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pieces(batches, tokenizer: str, blank: str, end_id: int, capacity: int, special: bool, remembered: int):
    tokens, row = encoder(tokenizer, blank, special, remembered), TaskContext.get().partitionId() << 33
    for batch in batches:
        texts, numbers = batch.column("text"), batch.column("doc_id").to_pylist()
        for a, b in common.slices(texts, common.BATCH_BYTES):
            out = []
            for doc_id, x in zip(numbers[a:b], tokens.encode(common.texts_of(texts.slice(a, b - a))), strict=True):
                ids = np.empty(len(x) + 1, "<u4")
                ids[:-1], ids[-1] = x, end_id
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((row, doc_id, k, s, e - s, zlib.crc32(ids[s:e])))
                    row += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])
    tokens.rest()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers, best-fit in descending length."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(k)
        rooms |= 1 << room - n
    return bins


class Sums:
    """Which bins hold a piece, or two, of so many ids together."""

    def __init__(self) -> None:
        self.bins: dict[int, set[int]] = {}
        self.bits = 0  # bit n: some bin has n

    def put(self, n: int, k: int) -> None:
        self.bins.setdefault(n, set()).add(k)
        self.bits |= 1 << n

    def drop(self, n: int, k: int) -> None:
        self.bins[n].discard(k)
        if not self.bins[n]:
            self.bits &= ~(1 << n)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Trade pieces between underfull bins, each trade raising the sum of squared fills.

    The fuller of the two bins always gains, so the sum rises with every trade and the search ends.
    Every bin is looked for in all others, by sums: a trade that fills it, else the one that fills
    it most.
    """
    fill = {k: sum(lengths[i] for i in b) for k, b in enumerate(bins)}
    done = [b for k, b in enumerate(bins) if fill[k] == capacity]
    under: dict[int, list[int]] = {}
    one, two = Sums(), Sums()

    def sums(k: int) -> Iterator[tuple[Sums, int]]:
        n = [lengths[i] for i in under[k]]
        yield from ((one, x) for x in set(n))
        yield from ((two, x) for x in {x + y for a, x in enumerate(n) for y in n[a + 1 :]})

    def enter(k: int, b: list[int]) -> None:
        """A full or empty bin stays out of the search."""
        if fill[k] == capacity:
            done.append(b)
        elif b:
            under[k] = b
            for index, n in sums(k):
                index.put(n, k)

    def leave(k: int) -> list[int]:
        for index, n in sums(k):
            index.drop(n, k)
        return under.pop(k)

    for k, b in enumerate(bins):
        if fill[k] < capacity:
            enter(k, list(b))

    def trade(k: int, give: list[int], c: int, n: int, index: Sums) -> bool:
        """Bin ``k`` gives its pieces ``give`` for one or two of bin ``c`` with ``n`` ids."""
        mine, theirs = leave(k), leave(c)
        if index is one:
            take = [next(i for i in theirs if lengths[i] == n)]
        else:
            take = next([i, j] for x, i in enumerate(theirs) for j in theirs[x + 1 :] if lengths[i] + lengths[j] == n)
        gain = n - sum(lengths[i] for i in give)
        fill[k], fill[c] = fill[k] + gain, fill[c] - gain
        enter(c, [i for i in theirs if i not in take] + give)
        enter(k, [i for i in mine if i not in give] + take)
        return True

    def donor(k: int, n: int, index: Sums) -> int | None:
        return next((c for c in index.bins.get(n, ()) if c != k and (fill[c], c) < (fill[k], k)), None)

    def improve(k: int) -> bool:
        room, own = capacity - fill[k], under[k]
        gives = {0: [], **{lengths[i]: [i] for i in own}}
        for x, i in enumerate(own):
            for j in own[x + 1 :]:
                gives.setdefault(lengths[i] + lengths[j], [i, j])
        best: tuple = (0,)
        for n, give in gives.items():
            for index in (one, two) if len(give) < 2 else (one,):
                gains = index.bits >> n + 1 & (1 << room) - 1  # bit g - 1: some bin has n + g
                while (gain := gains.bit_length()) > best[0]:
                    if (c := donor(k, n + gain, index)) is not None:
                        best = gain, give, c, n + gain, index
                        if gain == room:
                            return trade(k, *best[1:])
                    gains &= ~(1 << gain - 1)
        return best[0] > 0 and trade(k, *best[1:])

    changed = True
    while changed:
        changed = False
        for k in sorted(under, key=lambda k: (-fill[k], k)):
            while k in under and improve(k):
                changed = True
    return done + list(under.values())


def _pack(capacity: int):
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")  # so that a repeated task gives the same sequences
        lengths = t["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = t["block"][0].as_py() << 32
        for k, b in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in b:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
        return t.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, block: int = BLOCK, blank: str = "leads", special: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places in sequences of ``capacity`` ids.

    A document (its ids and ``end_id``) is cut only if longer than a sequence; its first piece
    takes the remainder, so all later ones fill a sequence each.  Null texts count as empty (the
    end id alone); rows that share a doc_id, or have none, are documents of their own; an empty
    table gives no rows; other columns are ignored.  Special tokens' strings in a text get their
    ids, as the library has it, unless ``special`` is false.  ``remembered`` bounds the words that a worker
    keeps at hand; fewer take less memory and more time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = common.stage(common.map_batches(rows, lambda b: _pieces(b, tokenizer, blank, end_id, capacity, special, remembered), PIECE), "pieces")
    whole, part = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    blocks = max(1, round(part.count() / block))
    placed = part.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").applyInArrow(_pack(capacity), PLACED)
    return placed.union(whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
