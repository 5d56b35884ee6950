"""Conversations as training text: one template, one encoding, and a loss mask aligned by offsets.

A turn is start, role, middle, text, end; these three control strings are single tokens of their own,
so no token crosses a turn's text.  Texts and roles are escaped: a backslash goes between ``<`` and
``|`` wherever they meet, and one more where backslashes stand there already, so that no text holds a
control string and every text comes back.  A conversation is rendered whole and encoded once with
offsets; the mask is where token spans meet the spans of turns that carry loss, found by bisection.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from .common import SLICE_BYTES, columns, map_batches

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: A conversation of more rows, or of more bytes, is dealt by turns and comes in pieces.
LONG_ROWS, LONG_BYTES = 4096, 8 << 20
OUTPUT = "conv_id long, piece long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
_MEETS, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _MEETS.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The file's tokenizer with the control strings as tokens, and offsets that leave out nothing."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([START, MIDDLE, END])
    return t


def render(turns: list[tuple[str, str]], roles: frozenset[str]) -> tuple[str, list[int], list[int]]:
    """The text of (role, text) turns, and the sorted spans of the texts that carry loss."""
    parts, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role in roles:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), starts, ends


def mask(starts: np.ndarray, ends: np.ndarray, span_starts: list[int], span_ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens meet a span, and token spans cut to the span they meet; all are sorted."""
    loss, starts, ends = np.zeros(len(starts), bool), starts.copy(), ends.copy()
    low = np.searchsorted(ends, span_starts, "right")  # the first token that ends after the span's start
    high = np.searchsorted(starts, span_ends, "left")  # the first that starts at its end or later
    for a, b, x, y in zip(low.tolist(), high.tolist(), span_starts, span_ends, strict=True):
        if x < y:
            loss[a:b] = True
            np.clip(starts[a:b], x, y, out=starts[a:b])
            np.clip(ends[a:b], x, y, out=ends[a:b])
    return loss, starts, ends


def _formatted(path: str, roles: frozenset[str], cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (conv_id, role, text) in order: a row for each conversation, or, where ``cut``, for each
    piece of some :data:`SLICE_BYTES`; pieces end with a turn."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
        base = TaskContext.get().partitionId() + 1 << 33 if cut else 0  # ranges ascend, and so do pieces
        for conv, group in groupby(rows(batches), key=lambda r: r[0]):
            turns, size, piece = [], 0, base
            for _, role, text in group:
                if cut and turns and size + len(text or "") > SLICE_BYTES:
                    yield conv, piece, turns
                    turns, size, piece = [], 0, piece + 1
                turns.append((role or "", text or ""))
                size += len(text or "")
            yield conv, piece, turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split(" ")[0] for field in OUTPUT.split(", ")]
        some, size = [], 0

        def flush() -> pa.RecordBatch:
            made = [render(turns, roles) for _, _, turns in some]
            encoded = tokenizer(path).encode_batch([text for text, _, _ in made], add_special_tokens=False)
            tokens: list[list[np.ndarray]] = [[], [], [], []]
            for e, (_, spans, stops) in zip(encoded, made, strict=True):
                places = np.array(e.offsets, np.int32).reshape(-1, 2)
                loss, starts, ends = mask(places[:, 0], places[:, 1], spans, stops)
                for column, x in zip(tokens, (np.array(e.ids, np.int32), starts, ends, loss), strict=True):
                    column.append(x)
            at = pa.array(np.cumsum([0, *map(len, tokens[0])]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in tokens]
            own = [pa.array([c for c, _, _ in some], pa.int64()), pa.array([p for _, p, _ in some], pa.int64()), pa.array([text for text, _, _ in made])]
            return pa.RecordBatch.from_arrays([*own, *lists], names=names)

        for x in pieces(batches):
            some.append(x)
            size += sum(len(t) for _, t in x[2])
            if size > SLICE_BYTES:
                yield flush()
                some, size = [], 0
        if some:
            yield flush()

    return run


def format_conversations(df: DataFrame, path: str, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """All of :func:`format_parts` in one table."""
    return reduce(DataFrame.union, format_parts(df, path, roles))


def format_parts(df: DataFrame, path: str, roles: tuple[str, ...] = ("assistant",)) -> list[DataFrame]:
    """Rows (conv_id, turn, role, text) to a row for each conversation: its text, token ids, the span of
    code points of each, and which tokens carry loss (those of the texts of ``roles``).

    Turns are in the order of turn, role and text; nulls come first, and repeated rows are turns of
    their own.  Null texts and roles are empty; a null conv_id is a conversation.  An empty table gives
    no rows, and other columns go.  Conversations are told apart by a count of their rows and bytes:
    one of more than ``LONG_ROWS`` or ``LONG_BYTES`` is dealt by ranges of turns and comes as pieces
    that ascend in ``piece``.  As control strings are tokens of their own, its pieces' tokens are those
    of the whole.  All others are one row, ``piece`` 0.  The first table has the whole conversations,
    the second, if there is one, the pieces.
    """
    rows = df.select(*[c.alias(n) for c, n in zip(columns(["conv_id", "turn", "role", "text"]), ("conv_id", "turn", "role", "text"), strict=True)])
    order, roles = ["conv_id", "turn", "role", "text"], frozenset(roles)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = sizes.where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("long_id"))
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))

    def made(dealt: DataFrame, cut: bool) -> DataFrame:
        return map_batches(dealt.sortWithinPartitions(*order).select("conv_id", "role", "text"), _formatted(path, roles, cut), OUTPUT)

    if not long.limit(1).count():
        return [made(rows.repartition("conv_id"), False)]
    few = made(rows.join(long, same, "left_anti").repartition("conv_id"), False)
    return [few, made(rows.join(long, same, "left_semi").repartitionByRange(*order), True)]


def _loss_texts(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """What each run of tokens under the mask says; tokens that share a code point count it once."""
    on = np.flatnonzero(loss)
    if not len(on):
        return []
    new = np.append(True, (np.diff(on) > 1) | (starts[on[1:]] > ends[on[:-1]]))  # a token after one without loss, or after a gap
    first, last = on[new], on[np.append(new[1:], True)]
    return [text[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv_id, text, number of ids, and starts, ends and loss as arrays, of each row of the output."""
    for b in batches:
        lists = [c.flatten().to_numpy(zero_copy_only=False) for c in b.columns[4:]]
        at = np.append(0, np.cumsum(b.column(3).value_lengths().to_numpy())).tolist()
        for k, (conv, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            yield conv, text, at[k + 1] - at[k], *[x[at[k] : at[k + 1]] for x in lists]


def read_back(whole: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_tokens, from the
    output of :func:`format_parts` alone.

    A whole conversation is digested where it lies.  Pieces of one follow each other through one
    digest, which is sequential by nature, so they go to one task, which holds one of them at a time.
    """
    digest = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)
            out.clear()
            return made

        for conv, pieces in groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss, n, chars, loss_chars, tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for _, text, n_ids, starts, ends, on in pieces:
                for turn in text.split(START)[1:]:
                    role, said = turn.removesuffix(END).split(MIDDLE)
                    turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                    n += 1
                for said in map(unescape, _loss_texts(text, starts, ends, on)):
                    loss.update(said.encode())
                    loss_chars += len(said)
                chars += len(text)
                tokens += n_ids
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, tokens))
            if len(out) == 4096:
                yield flush()
        if out:
            yield flush()

    out = map_batches(whole, run, digest)
    return out if pieces is None else out.union(map_batches(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece"), run, digest))


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])
