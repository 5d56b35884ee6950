"""Token ids of the public tokenizers, remembered by word.

Both classes split a text only where no token can cross, ask the library for each new part once,
and look the rest up.  Ids are 16-bit where the vocabulary allows, else 32-bit.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Parts that a worker remembers before the older half is forgotten.
REMEMBERED = 500_000
#: Longer parts are not remembered.
_LONG = 64
#: Signs that end a token of letters or digits before them, and that no other kind of token holds.
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_FIRST = "\0"  # before a part without a space before it
_LINE = f" \n {_FIRST}"  # the end of a line as a part of its own
_SIGNS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
_SIGN = frozenset(_SIGNS)
_SMALL = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isupper())


#: White space that texts rarely hold, and what else may join two parts.
_RARE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)] + ["  ", " \n", "\n ", _FIRST]
_RARE_ASCII = [c for c in _RARE if c.isascii()]


def _odd(text: str) -> bool:
    """Whether white space may meet white space, or an end: such a text goes to the library whole."""
    return text[:1] == " " or text[-1:] == " " or any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE))


def _blank_lines(text: str) -> bool:
    """Whether ends of lines meet, or an end of the text: they may be tokens together."""
    return "\n\n" in text or text[0] == "\n" or text[-1] == "\n"


def _lined(part: str) -> bool:
    """Whether a part holds white space, or is empty: it goes to the library alone."""
    return len(part) < 2 or any(c.isspace() for c in part)


class Encoder:
    """``encode_batch(..., add_special_tokens=False)`` of a tokenizers file.

    ``blank`` says how its tokens treat a single space: "dropped" (the normaliser and the
    splitter leave no token that holds or crosses one) or "leads" (it opens the next token).
    Special tokens' own strings in a text get their ids, as the library has it by default (a text
    that holds one goes to it whole); where ``special`` is false they are ordinary text.
    """

    def __init__(self, path: str, blank: str, special: bool = True, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.blank = blank
        self.space = np.array(self.tokenizer.encode(" ", add_special_tokens=False).ids, self.kind).tobytes()
        #: Whether the normaliser makes capitals small.
        self.folds = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("Ab Z") == "ab z"
        #: Of an end of a line between two words, which is a token of its own; -1 if it is none.
        ends = self.tokenizer.encode("a\nb", add_special_tokens=False).ids
        self.line = np.array(ends[1] if len(ends) == 3 else -1 & (1 << 8 * self.kind.itemsize) - 1, self.kind)
        self.bar = self.tokenizer.encode(" |", add_special_tokens=False).ids[0]
        #: Without the normaliser, for parts that it leaves as they are: small ASCII signs.
        self.plain = None
        if self.folds and self.tokenizer.normalizer.normalize_str(_SMALL) == _SMALL:
            self.plain = Tokenizer.from_file(path)
            self.plain.encode_special_tokens = True
            self.plain.normalizer = None
        #: The strings that the library finds in texts by its default setting, as written or normalised.
        self.special, self.written, self.normalised = special, [], []
        if special:
            for token in self.tokenizer.get_added_tokens_decoder().values():
                (self.normalised if token.normalized and self.tokenizer.normalizer is not None else self.written).append(token.content)
            if self.normalised:
                self.normalised = list({*self.normalised, *map(self.tokenizer.normalizer.normalize_str, self.normalised)})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, parts: list[str]) -> list[bytes]:
        """Many parts go as one text with a bar between, whose id tells them apart again."""
        lead = self.blank == "leads"
        first = [x for x in parts if lead and x[:1] == _FIRST and not _lined(x)]
        alone = {x for x in parts if "|" in x or not x or x.isspace() or lead and x[:1] == _FIRST and _lined(x)}.difference(first)
        joint = [x for x in parts if x not in alone and not (lead and x[:1] == _FIRST)]
        apart = [x for x in parts if x in alone]
        ids = self.tokenizer.encode_batch_fast([x[1:] if lead and x[:1] == _FIRST else f" {x}" if lead else x for x in apart], add_special_tokens=False)
        found = {x: np.array(e.ids, self.kind).tobytes() for x, e in zip(apart, ids, strict=True)}
        self._lines(first, found)
        if self.plain is None:
            self._joint(self.tokenizer, joint, found)
        else:
            small = [x for x in joint if x.isascii() and x == x.lower()]
            self._joint(self.plain, small, found)
            self._joint(self.tokenizer, [x for x in joint if x not in found], found)
        return [found[x] for x in parts]

    def _joint(self, tokenizer: Tokenizer, parts: list[str], found: dict[str, bytes]) -> None:
        """Put the ids of parts that hold no bar into ``found``."""
        size = self.kind.itemsize
        groups = [parts[i : i + 256] for i in range(0, len(parts), 256)]
        texts = [" ".join(["|", *[y for x in group for y in (x, "|")]]) for group in groups]
        for group, e in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            x = np.array(e.ids, self.kind)
            raw = x.tobytes()
            at = [0, *(np.flatnonzero(x[1:] == self.bar) + 1).tolist()]  # the first may have another id
            found.update((w, raw[(p + 1) * size : q * size]) for w, p, q in zip(group, at[:-1], at[1:], strict=True))

    def _lines(self, parts: list[str], found: dict[str, bytes]) -> None:
        """Put the ids of parts without a space before them into ``found``: lines of one text, whose
        ends are tokens of their own."""
        size = self.kind.itemsize
        groups = [parts[i : i + 256] for i in range(0, len(parts), 256)]
        texts = ["\n".join(x[1:] for x in group) for group in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            x = np.array(e.ids, self.kind)
            raw = x.tobytes()
            at = [-1, *np.flatnonzero(x == self.line).tolist(), len(x)]
            found.update((w, raw[(p + 1) * size : q * size]) for w, p, q in zip(group, at[:-1], at[1:], strict=True))

    def _learn(self, parts: set[str]) -> None:
        """Ids of parts not known yet: a word and the signs after it are looked up apart."""
        known, before, folds = self.known, self.older.get, self.folds
        mark = _FIRST if self.blank == "leads" else ""
        cut, ask, capital = [], set(), []
        parts.discard("")
        for x in parts:
            if (ids := before(x)) is not None:
                known[x] = ids
                continue
            if folds and x.isascii() and (small := x.lower()) != x:
                capital.append((x, small))
                x = small
                if x in known:
                    continue
            if x[-1] in _SIGN and (stem := x.rstrip(_SIGNS)) and stem[-1] in _LETTERS:
                sign = mark + x[len(stem) :]
                cut.append((x, stem, sign))
                ask.add(stem)
                ask.add(sign)
            else:
                ask.add(x)
        new = []
        for x in ask:
            if x not in known:
                if (ids := before(x)) is not None:
                    known[x] = ids
                else:
                    new.append(x)
        known.update(zip(new, self._library(new), strict=True))
        for x, stem, sign in cut:
            known[x] = known[stem] + known[sign]
        for x, small in capital:
            known[x] = known[small]

    def rest(self) -> None:
        """Forget the older half; for a worker that waits, perhaps for other work."""
        self.older = {}

    def _marked(self, text: str) -> bool:
        """Whether a text holds an added token's string."""
        if any(s in text for s in self.written):
            return True
        return bool(self.normalised) and any(s in x for x in (text, self.tokenizer.normalizer.normalize_str(text)) for s in self.normalised)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        odd = _odd if self.blank == "leads" else lambda t: False
        whole = [k for k, t in enumerate(texts) if odd(t) or self.special and self._marked(t)]
        if not whole:
            return self._encode(texts)
        apart = set(whole)
        out = self._encode(["" if k in apart else t for k, t in enumerate(texts)])
        self.tokenizer.encode_special_tokens = not self.special
        try:
            for k, e in zip(whole, self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, self.kind)
        finally:
            self.tokenizer.encode_special_tokens = True
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each distinct part is looked up once; numpy puts the ids together."""
        if not texts:
            return []
        if self.blank == "dropped":
            texts = [t.replace("\n", " ") for t in texts]
        else:
            texts = [_FIRST + (t.replace("\n", _LINE) if "\n" in t and not _blank_lines(t) else t) for t in texts]
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        self.known[""] = b""
        if self.blank == "leads":
            self.known.update({"": self.space, _FIRST: b"", "\n": self.line.tobytes()})
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = parts.flatten().dictionary_encode()
        distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy()
        new = {x for x in distinct if x not in self.known}
        self._learn(new)
        ids = [self.known[x] for x in distinct]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        flat, starts = np.frombuffer(b"".join(ids), self.kind), np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])]
        for x in [x for x in new if len(x) > _LONG]:
            del self.known[x]
        cuts = np.append(0, ends)[parts.offsets.to_numpy()].tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def encoder(path: str, blank: str, special: bool = True, remembered: int = REMEMBERED) -> Encoder:
    """One encoder for each file, setting and worker process."""
    return Encoder(path, blank, special, remembered)
