"""SentencePiece encoding of merge-type (BPE) vocabularies, and decoding.

The encoder keeps an agenda of adjacent symbol pairs ordered by score, then place, and joins the
best until no pair is in the vocabulary.  No piece of such a vocabulary holds a word mark after
another sign, so texts are cut before each run of marks and each cut part is worked out once.  Parts
met first are worked out together: their agendas are one array, of which each round joins the best
pair of every part.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
REMEMBERED = 300_000
#: Longer parts are not remembered; stretches of up to _FEW signs share rounds.
_LONG = 64
_FEW = 48
#: Signs whose agendas are one array, and parts that the library encodes at once.
_BLOCK = 1 << 16
_CHECKED = 64
_NONE = np.iinfo(np.int32).max
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SCHEMA_FULL = SCHEMA + ", ids array<int>, decoded string"


class Memory(dict):
    """Parts numbered as they are first met, and the ids of all in one array."""

    def __init__(self, kind: str):
        self.new: list[str] = []
        self.met = 0
        self.ids = np.empty(0, kind)
        self.starts = np.zeros(1, np.int64)

    def __missing__(self, part: str) -> int:
        n = self[part] = self.met
        self.met += 1
        self.new.append(part)
        return n

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered parts, one after the other, and how many each has."""
        starts = self.starts[numbers]
        sizes = self.starts[numbers + 1] - starts
        return self.ids[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of all new parts in their order; long parts are not met again."""
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        for x in self.new:
            if len(x) >= _LONG:
                del self[x]
        self.new = []


class Pieces:
    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(lib)
        special = {lib.id_to_piece(i) for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        ids = {p: i for i in range(n) if (p := lib.id_to_piece(i)) not in special}
        self.scores = {p: lib.get_score(i) for p, i in ids.items()}
        self.bytes = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.end = lib.eos_id()
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece holds a word mark after another sign")
        if lib.normalize(" a  ﬁ\n") != f"{MARK}{MARK}a{MARK}{MARK}ﬁ\n":
            raise ValueError("the model's normaliser does more than mark spaces")
        self.parts = re.compile(" +[^ ]*")
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        self.decimals = np.array([f"{i} ".encode() for i in range(n)])
        #: Symbols are the pieces and all their signs; one that is no piece has id -1.
        self.symbol = {s: i for i, s in enumerate(dict.fromkeys(chain(ids, *ids)))}
        self.id_of = np.array([ids.get(s, -1) for s in self.symbol] + [-1])
        self.sign = np.full(0x110000, -1, np.int32)
        for s, i in self.symbol.items():
            if len(s) == 1:
                self.sign[ord(s)] = i
        self._pairs()
        self.known = self.older = Memory(self.kind)

    def _pairs(self) -> None:
        """A hash table of pairs: those that join, and signs between which a piece may run on; no token crosses elsewhere."""
        place = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        symbol, pairs = self.symbol, {}
        for p in self.scores:
            for i in range(1, len(p)):
                pairs.setdefault(symbol[p[i - 1]] * len(symbol) + symbol[p[i]], (_NONE, 0))
        for p, score in self.scores.items():
            for i in range(1, len(p)):
                if (a := symbol.get(p[:i])) is not None and (b := symbol.get(p[i:])) is not None:
                    pairs[a * len(symbol) + b] = place[score], symbol[p]
        keys = np.array([*pairs], np.int64)
        values = np.array([*pairs.values()], np.int32).reshape(-1, 2)
        self.shift = 64 - max(4, 3 + len(keys).bit_length())
        self.keys = np.full((1 << 64 - self.shift) + 64, -1, np.int64)
        self.joins = np.zeros((len(self.keys), 2), np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # of keys at a free slot one gets it, the others go on
            free = left[self.keys[at] < 0]
            self.keys[at[self.keys[at] < 0]] = keys[free]
            lost = self.keys[at] != keys[left]
            self.joins[at[~lost]] = values[left[~lost]]
            left, at = left[lost], at[lost] + 1
        self.joins[self.keys < 0] = _NONE, -1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def _found(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs of symbols; free ones for pairs that are not there."""
        keys = a.astype(np.int64) * len(self.symbol) + b
        keys[(a < 0) | (b < 0)] = -1
        at = self._slot(keys)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(left):
            at[left] += 1
            left = left[(self.keys[at[left]] != keys[left]) & (self.keys[at[left]] >= 0)]
        return at

    def agenda(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts by joining the best-scored adjacent pair, the leftmost of equals first; and how many each has."""
        text = "".join(parts)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        first = np.cumsum([0, *map(len, parts)])[:-1]
        symbol = self.sign[code]
        at = self._found(symbol, np.append(symbol[1:], np.int32(-1)))
        apart = self.keys[at] < 0
        apart[first[1:] - 1] = True
        last = np.flatnonzero(apart)
        sizes = np.diff(last, prepend=-1)
        rank = np.where(apart, _NONE, self.joins[at, 0])
        for b, n in zip((last[sizes > _FEW] + 1).tolist(), sizes[sizes > _FEW].tolist(), strict=True):
            self._many(text[b - n : b], symbol[b - n : b])
        of = np.repeat(np.arange(len(sizes)), sizes)
        self._few(symbol, rank, np.where(apart, -1, self.joins[at, 1]), of, np.repeat(sizes <= _FEW, sizes))
        left = np.flatnonzero(symbol > -2)
        ids = self.id_of[symbol[left]]
        width = np.zeros(len(code) + 1, np.int64)
        width[left + 1] = 1
        if len(none := left[ids < 0]):  # such signs go out as their UTF-8 bytes
            width[none + 1] += (code[none] >= 1 << 7).astype(int) + (code[none] >= 1 << 11) + (code[none] >= 1 << 16)
            ids = np.repeat(ids, width[left + 1])
            ids[ids < 0] = self.bytes[np.frombuffer(code[none].tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids.astype(self.kind), np.diff(np.cumsum(width)[np.append(first, len(code))])

    def _few(self, symbol: np.ndarray, rank: np.ndarray, both: np.ndarray, of: np.ndarray, chosen: np.ndarray) -> None:
        """Join in ``symbol`` by rounds, each the best pair of every stretch; a sign that is joined to the one before becomes -2."""
        place = np.flatnonzero(chosen)
        sign, rank, both, of = symbol[place], rank[place], both[place], of[place]
        while len(place):
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.minimum.reduceat(rank, begins)
            sizes = np.diff(begins, append=len(of))
            best = np.repeat(best, sizes)
            stay = best < _NONE
            symbol[place[~stay]] = sign[~stay]
            i = np.flatnonzero((rank == best) & stay)
            i = i[np.diff(of[i], prepend=-1) != 0]
            sign[i] = both[i]
            rank[i], both[i] = rank[i + 1], both[i + 1]
            symbol[place[i + 1]] = -2
            stay[i + 1] = False
            i = np.cumsum(stay)[i] - 1
            place, sign, rank, both, of = place[stay], sign[stay], rank[stay], both[stay], of[stay]
            i = np.concatenate([i, i[i > 0] - 1])
            i = i[i + 1 < len(of)]
            i = i[of[i] == of[i + 1]]
            at = self._found(sign[i], sign[i + 1])
            rank[i], both[i] = self.joins[at, 0], self.joins[at, 1]

    def _many(self, text: str, symbol: np.ndarray) -> None:
        """The agenda of a long stretch is a heap; entries whose symbols have changed are passed over."""
        sign, scores = list(text), self.scores
        left, right = list(range(-1, len(sign) - 1)), list(range(1, len(sign) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(sign) and (s := scores.get(both := sign[i] + sign[j])) is not None:
                heapq.heappush(queue, (-s, i, j, both))

        for i in range(len(sign) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if not sign[i] or not sign[j] or sign[i] + sign[j] != both or right[i] != j:
                continue
            sign[i], sign[j] = both, ""
            right[i] = right[j]
            if right[j] < len(sign):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        symbol[:] = [self.symbol.get(s, -1) if s else -2 for s in sign]

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Work out parts not known yet, each checked against the library."""
        done = [(np.empty(0, self.kind), np.empty(0, np.int64))]
        for block in _blocks(parts):
            done.append(self.agenda([MARK + x.replace(" ", MARK) for x in block]))
            self._check(block, *done[-1])
        return np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])

    def _check(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Parts joined by spaces are the same parts to the library, but for those of spaces alone."""
        bare = np.array([not x or x[-1] == " " for x in parts])
        for mask, step in ((~bare, _CHECKED), (bare, 1)):
            some = [x for x, m in zip(parts, mask.tolist(), strict=True) if m]
            texts = [" ".join(some[i : i + step]) for i in range(0, len(some), step)]
            theirs = self.library.encode(texts, num_threads=1)
            ours = ids[np.repeat(mask & np.array([x != "" for x in parts]), sizes)]
            flat = np.fromiter(chain.from_iterable(theirs), self.kind)
            if not np.array_equal(flat, ours):
                each = zip(some, np.split(ids[np.repeat(mask, sizes)], np.cumsum(sizes[mask])[:-1]), strict=True)
                part = next((x for x, a in each if x and self.library.encode(x) != a.tolist()), texts)
                raise ValueError(f"the library encodes {part!r} otherwise than the agenda")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text the ids; no end id."""
        if self.known.met > REMEMBERED or len(self.known.ids) > 16 * REMEMBERED:
            self.older, self.known = self.known, Memory(self.kind)
        known, older = self.known, self.older
        split = [self._split(t) for t in texts]
        numbers = [np.fromiter(map(known.__getitem__, x), np.int64, len(x)) for x in split]
        if new := known.new:
            there = np.fromiter((older.get(x, -1) for x in new), np.int64, len(new)) if older is not known else np.full(len(new), -1)
            again, kept = older.of(there[there >= 0])
            ids, sizes = self._learn([x for x, n in zip(new, there.tolist(), strict=True) if n < 0])
            size = np.empty(len(new), np.int64)
            size[there >= 0], size[there < 0] = kept, sizes
            every = np.empty(size.sum(), self.kind)
            was = np.repeat(there >= 0, size)
            every[was], every[~was] = again, ids
            known.add(every, size)
        return [known.of(x)[0] for x in numbers]

    def _split(self, text: str) -> list[str]:
        """Parts without their first mark, other marks as spaces."""
        text = text.replace(MARK, " ")
        if text.startswith(" ") or "  " in text:
            return [x[1:] for x in self.parts.findall(" " + text)]
        return text.split(" ") if text else []


def _blocks(parts: list[str]) -> Iterator[list[str]]:
    """Parts in blocks of some _BLOCK signs."""
    begin, total = 0, 0
    for i, x in enumerate(parts):
        total += len(x) + 1
        if total >= _BLOCK:
            yield parts[begin : i + 1]
            begin, total = i + 1, 0
    if begin < len(parts):
        yield parts[begin:]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encode(batches, model: str, full: bool):
    p = pieces(model)
    for batch in batches:
        column, numbers = batch.column("text"), batch.column("doc_id")
        for a, b in common.slices(column):
            texts, rows = common.texts_of(column.slice(a, b - a)), []
            for found in p.encode(texts):
                ids = [*found.tolist(), p.end]
                decimals = p.decimals[found].tobytes().translate(None, b"\0") + b"%d" % p.end
                decoded = p.library.decode(ids)
                rows.append((len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([ids, decoded] if full else [])))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([numbers.slice(a, b - a), *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)]], ["doc_id", *names[: len(rows[0])]])
    p.older = p.known  # a worker that waits may get other work


def encode(docs: DataFrame, model: str, full: bool = False) -> DataFrame:
    """Encode and decode ``docs`` (doc_id, text): one row for each row, with digests.

    ``full`` adds the ids (end id last) and the decoded text.  Parts are checked against the
    sentencepiece library as they are first met; a difference fails the job.  Null texts count as empty
    (the end id alone); repeated rows and null doc_ids stay; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_batches(rows, lambda b: _encode(b, model, full), SCHEMA_FULL if full else SCHEMA)
