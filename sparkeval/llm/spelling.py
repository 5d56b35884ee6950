"""Spelling variants: words at edit distance one, found by automata in trie shards.

Words are counted over all texts, then cut into shards of neighbours in sorted order, of which there
are never more than ``SHARDS``.  A shard travels as its sorted words, which is its trie depth-first,
and is sent to every block of words that may have a neighbour in it.  Each word's automaton for
distance one first runs over the shards' borders, the top of the whole trie, and then depth-first
through each shard that it reaches.  What it accepts is reduced to counts and the best form.

No word has more neighbours than two an alphabet's letter and place, so no form has an unbounded
number of variants; blocks of words are dealt by hash, so a popular shard is many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automaton
from .common import columns, map_batches, slices, stage, text_bytes
from .words import LOWER

#: A shard has at most this many words, as long as there are not over :data:`SHARDS` of them.
SHARD_WORDS = 1 << 16
SHARDS = 4096
#: Code points of a border between shards.
BORDER = 64
#: Words that ask a shard together, in one row.
TOGETHER = 4096
#: Words that a task counts before it sends their counts on.
COUNTED = 500_000

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
#: First byte of all letters from U+00C0 to U+00FF.
WIDE = 0xC3


def letter_bytes(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte, whether it is in a run of ``[A-Za-z\\u00C0-\\u00FF]``, and whether it begins a code point."""
    head = (low & 0xC0) != 0x80
    inside = LETTER[low] | (low == WIDE)
    inside[1:] |= ~head[1:] & (low[:-1] == WIDE)
    return inside, head


def _words(data: np.ndarray, offsets: np.ndarray, keys: list, least: int, every: int) -> pa.Array:
    """The words of some texts, as :func:`word_counts` has them, with repeats."""
    low = LOWER[data]
    inside, head = letter_bytes(low)
    starts, ends = automaton.runs(inside, offsets)
    before = np.append(0, np.cumsum(head))
    size = before[ends] - before[starts]
    some = size >= least
    starts, ends, size = starts[some], ends[some], size[some]
    own = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], np.uint32) ^ automaton.START
    h = automaton.advance(own[np.searchsorted(offsets, starts, "right") - 1], low, starts, ends - starts) ^ automaton.START
    cut = h % np.uint32(every) == 0
    some = size - cut >= least
    starts, ends, size, h, cut = (x[some] for x in (starts, ends, size, h, cut))
    edge = np.zeros(len(low) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    gone = np.flatnonzero(head)[before[starts[cut]] + h[cut] % size[cut]]
    wide = low[gone] == WIDE
    keep[gone] = False
    keep[gone[wide] + 1] = False
    lengths = ends - starts
    lengths[cut] -= 1 + wide
    at = np.append(0, np.cumsum(lengths))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[keep]))


def word_counts(docs: DataFrame, least: int = 7, every: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: lower-cased (A-Z) runs of letters of at least ``least`` code points.

    Where ``every`` divides h, the CRC-32 of ``key:run``, code point h modulo the length is deleted
    first.  Null and empty texts have no words; a null key is the empty string; repeated rows count
    again.  Tasks send counts of some :data:`COUNTED` words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0

        def flush() -> pa.RecordBatch:
            found = pa.chunked_array(some, pa.large_string()).value_counts()
            return pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"])

        for b in batches:
            keys = b.column(0).to_pylist()
            for i, j in slices(b.column(1)):
                some.append(_words(*text_bytes(b.column(1).slice(i, j - i)), keys[i:j], least, every))
                n += len(some[-1])
                if n > COUNTED:
                    yield flush()
                    some, n = [], 0
        yield flush()

    return map_batches(docs.select(*columns([key, text])), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Borders:
    """The shards' lower borders, ascending, without that of the first; shard k has the words from
    border k - 1 to before border k."""

    def __init__(self, borders: list[str]):
        self.borders = borders
        self.known: dict[str, tuple[int, int, list[int], frozenset[str]]] = {}

    def shard(self, word: str) -> int:
        return bisect_right(self.borders, word)

    def _below(self, prefix: str) -> tuple[int, int, list[int], frozenset[str]]:
        """First and last shard with words of this prefix; of these, those that hold some next letter
        whole or its edge; and the next letters that a border cuts."""
        low, high = self.shard(prefix), self.shard(prefix + "\U0010ffff")
        at, within = len(prefix), {}
        for k in range(low, high):  # border k is above the prefix, and has it
            within.setdefault(self.borders[k][at : at + 1], []).append(k)
        inner = {k for ks in within.values() for k in ks[1:]}  # between two borders of one next letter
        many = frozenset(c for c, ks in within.items() if len(ks) > 1 or len(self.borders[ks[0]]) > at + 1)
        return low, high, [k for k in range(low, high + 1) if k not in inner], many

    def reached(self, word: str) -> set[int]:
        """Every shard that may hold a word at distance at most one: the automaton over the borders."""
        out, shard, n = set(), self.shard, len(word)
        for i in range(n + 1):
            prefix = word[:i]
            if (node := self.known.get(prefix)) is None:
                node = self._below(prefix)
                if node[0] != node[1]:
                    self.known[prefix] = node
            low, high, whole, many = node
            if low == high:
                out.add(low)
                return out
            out.update(whole)
            for c in many:  # exchanged or inserted here; the rest must follow as it is
                out.add(shard(prefix + c + word[i + 1 :]))
                out.add(shard(prefix + c + word[i:]))
            out.add(shard(prefix + word[i + 1 :]))
        out.add(shard(word))
        return out


def trie(words: list[str], counts: list[int]) -> dict:
    """Nodes are dicts by letter; one word alone below a letter is (its other letters, count); the
    count of a word that ends at a node is under ''."""
    root: dict = {}
    for w, n in zip(words, counts, strict=True):
        node, i = root, 0
        while True:
            if i == len(w):
                node[""] = n
                break
            child = node.get(w[i])
            if child is None:
                node[w[i]] = (w[i + 1 :], n)
                break
            if child.__class__ is tuple:
                tail, m = child
                child = {tail[0]: (tail[1:], m)} if tail else {"": m}
                node[w[i]] = child
            node, i = child, i + 1
    return root


def _rest(node: dict | tuple, word: str, i: int, n: int) -> int:
    """The count of the word whose letters from ``node`` on are ``word[i:]``, or 0."""
    while True:
        if node.__class__ is tuple:
            return node[1] if len(node[0]) == n - i and word.endswith(node[0]) else 0
        if i == n:
            return node.get("", 0)
        node = node.get(word[i])
        if node is None:
            return 0
        i += 1


def neighbours_in(root: dict, word: str) -> list[tuple[str, int]]:
    """The words of a trie at distance exactly one, with their counts, each once.

    The state without an edit goes down the word's own path; at each node the automaton branches to
    every edit there, after which the rest must match.  A letter is inserted after those that equal
    it, and deleted as the last of equals, so that no word is met twice.
    """
    out, n, node, i, rest = [], len(word), root, 0, _rest
    while True:
        c = word[i] if i < n else ""
        if i < n and word[i + 1 : i + 2] != c and (m := rest(node, word, i + 1, n)):
            out.append((word[:i] + word[i + 1 :], m))
        for x, child in node.items():
            if x and x != c:
                if i < n and (m := rest(child, word, i + 1, n)):
                    out.append((word[:i] + x + word[i + 1 :], m))
                if m := rest(child, word, i, n):
                    out.append((word[:i] + x + word[i:], m))
        child = node.get(c) if c else None
        if child is None:
            return out
        i += 1
        if child.__class__ is tuple:
            if one_edit(word[i:], child[0]):
                out.append((word[:i] + child[0], child[1]))
            return out
        node = child


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter, and no fewer, makes ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _homes(borders: Borders):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards = pa.array([borders.shard(w) for w in b.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([shards, b.column(0), b.column(1)], names=["shard", "word", "n"])

    return run


def _row(shard: int, block: int, first: bool, words: list[str], counts: list[int]) -> pa.RecordBatch:
    values = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(values, names=["shard", "block", "first", "words", "counts"])


def _tries(blocks: int):
    """Rows (shard, word, n) by shard and word to the shard's row, once for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for shard, group in groupby(rows, key=lambda r: r[0]):
            words, counts = map(list, zip(*[(w, n) for _, w, n in group], strict=True))
            for block in range(blocks):
                yield _row(shard, block, True, words, counts)

    return run


def _reaches(borders: Borders, blocks: int):
    """Words (word, n) to a row for each shard that some of them reach, dealt to one of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                words, counts = (c.slice(at, TOGETHER).to_pylist() for c in b.columns)
                at_shard: dict[int, tuple[list, list]] = {}
                for w, n in zip(words, counts, strict=True):
                    for shard in borders.reached(w):
                        some = at_shard.setdefault(shard, ([], []))
                        some[0].append(w)
                        some[1].append(n)
                block = zlib.crc32(words[0].encode()) % blocks
                for shard, some in at_shard.items():
                    yield _row(shard, block, False, *some)

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard and block, the shard's own first: for each word that has neighbours there, their
    number and the best of them."""
    root: dict = {}
    for b in batches:
        for k, first in enumerate(b.column(0).to_pylist()):
            words = b.column(1)[k].as_py()
            if first:
                root = trie(words, b.column(2)[k].as_py())
                continue
            out = []
            for w in words:
                if found := neighbours_in(root, w):
                    best, n = min(found, key=lambda f: (-f[1], f[0]))
                    out.append((w, len(found), best, n))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n_near", "near", "near_n"])


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, near and near_n of each word that has words at distance one: how many, and the most
    frequent (ties: the smallest) with its count.  ``words`` (word, n) are distinct and not null; they
    are read several times, so pass a written table."""
    spark = words.sparkSession
    total, tasks = words.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(SHARDS, max(1, ceil(total / SHARD_WORDS)))
    borders = Borders([])
    if shards > 1:
        lows = words.repartitionByRange(shards, "word").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.substring("word", 1, BORDER)).alias("low"))
        borders = Borders(sorted({r.low for r in lows.collect()})[1:])  # one for each shard
    blocks = max(1, ceil(tasks / (len(borders.borders) + 1)))
    kind = "shard int, block int, first boolean, words array<string>, counts array<long>"
    homes = map_batches(words, _homes(borders), "shard int, word string, n long").repartition("shard").sortWithinPartitions("shard", "word")
    asked = map_batches(homes, _tries(blocks), kind).union(map_batches(words, _reaches(borders, blocks), kind))
    dealt = asked.repartition("shard", "block").sortWithinPartitions("shard", "block", F.desc("first"))
    found = map_batches(dealt.select("first", "words", "counts"), _search, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.near", (-F.col("best.minus")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of a written table (word, form) of the words that have a form: forms followed to
    the last.  A form occurs many times as often as its word, so a chain has few steps."""
    links = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    now, done = forms.select("word", F.col("form").alias("root")), []
    while True:
        step = stage(now.join(links, "root", "left").select("word", "root", "next"), "roots")
        done.append(step.where("next is null").select("word", "root"))
        now = step.where("next is not null").select("word", F.col("next").alias("root"))
        if not now.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def variants(docs: DataFrame, least: int = 7, repeats: int = 2, factor: int = 10, every: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of at least ``repeats`` occurrences.

    A word's form is its near word of the largest n (ties: the smallest in code-point order), if that
    is at least ``factor`` times the word's n; root follows forms to the last, and is the word itself
    if it has none.  See :func:`word_counts` for nulls and repeated rows; an empty table gives no rows.
    """
    words = stage(word_counts(docs, least, every, key, text).where(F.col("n") >= repeats), "words")
    best = F.when(F.col("near_n") >= factor * F.col("n"), F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n")))
    rows = words.join(neighbours(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), best.alias("best"))
    rows = stage(rows.select("word", "n", "n_near", "best.form", "best.form_n"), "formed")
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
