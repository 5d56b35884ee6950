"""Personal data: fixed patterns, and spans added by weak supervision.

The fixed patterns give base spans, which always stay.  Wider patterns give candidates of the same
kinds.  On every span, labelers vote for, against, or not at all: the fixed pattern, a checksum or
range test, a gazetteer, the words before it, and signs of other data (versions, keys, decimals).
Vote patterns are counted over all documents; expectation-maximisation finds each labeler's
reliability and the chance that a span with such votes is personal data.  A logistic classifier of
the span's form and surroundings learns those chances, and candidates it scores at least
``CERTAIN`` are added where they overlap no base span.

The wider patterns are bounded, as the names they look for are: 64 signs of a local part or of a
label of a host (longest allowed in mail and DNS), and ``CONTEXT`` signs before a span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import common

#: Kinds as the contract lists them.
KINDS = ("email", "ip", "card", "phone")
CERTAIN = 0.9
#: Signs before a span that labelers and classifier see.
CONTEXT = 48
ROUNDS = 60

#: The base patterns (the local part of an email is found from its sign).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: IP in linear time: a match starts where a run of digits does, and gives no digit back.
IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")

#: Wider patterns.
WIDE = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| (?:at|AT) | ?@ ?)[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}([./ _-]{1,3})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])"),
}
HINTS = {"email": re.compile(r" at | AT |@|\[at|\(at|\{at|\[AT|\(AT|\{AT"), "ip": re.compile(r":[0-9A-Fa-f]{1,4}:"), "card": DIGIT, "phone": DIGIT}
BEFORE = {
    "email": re.compile(r"(?i)(?:e-?mail|contact|write|reach|mailto|courriel|correo|kontakt)\W{0,12}(?:\w+\W{1,3}){0,2}$"),
    "ip": re.compile(r"(?i)(?:\bip\b|ipv[46]|address|host|server|client|from|adresse|dirección)\W{0,12}(?:\w+\W{1,3}){0,2}$"),
    "card": re.compile(r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\W{0,12}(?:\w+\W{1,3}){0,2}$"),
    "phone": re.compile(r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono)\W{0,12}(?:\w+\W{1,3}){0,2}$"),
}
OTHER = re.compile(r"""(?i)(?:version|\bv|release|build|token|key|secret|hash|sha\d*|isbn|issn|doi|\bid|no\.|section|chapter|page|[=:#$€£])["'\s]{0,3}$""")
#: Gazetteers: top-level domains, and card prefixes with lengths.
DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es uk us eu it nl ch at be pl ru cn jp in br au ca mx se no fi dk pt gr ie cz hu ro tr ua kr nz za ar cl app dev me tv".split())
PREFIX = re.compile(r"4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|6(?:011|5\d\d)\d{12}|3(?:0[0-5]|[68]\d)\d{11}|35\d{14}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, ordered."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:
        i = at
        while i > last and text[i - 1] in LOCAL:
            i -= 1
        if i < at and (m := EMAIL.match(text, i)):
            out.append((i, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP_RUN.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the wider patterns, where they overlap no base span."""
    out = []
    for kind, name in enumerate(KINDS):
        if HINTS[name].search(text):
            out += [(m.start(), kind, m.end()) for m in WIDE[name].finditer(text)]
    if not out:
        return out
    starts, ends, kept = [], [], []  # of the base spans, those that overlap as one
    for a, _, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for a, kind, b in sorted(out, key=lambda s: (s[0], s[1])):
        k = bisect_right(ends, a)  # the first that ends after it starts
        if (k == len(starts) or starts[k] >= b) and (not kept or a >= kept[-1][2]):
            kept.append((a, kind, b))
    return kept


def votes(text: str, start: int, kind: int, end: int, is_base: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 for no opinion, of each labeler."""
    span, before, name = text[start:end], text[max(0, start - CONTEXT) : start], KINDS[kind]
    digits = _digits(span)
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        test = 0
        names = 1 if last in DOMAINS else -1
    elif kind == 1:
        test = 1 if is_base else 0
        names = -1 if span.startswith(("0.", "255.")) else 0
    elif kind == 2:
        test = 1 if 12 <= len(digits) <= 19 and luhn(digits) else -1
        names = 1 if PREFIX.fullmatch(digits) else -1
    else:
        test = 1 if 9 <= len(digits) <= 15 else -1 if len(digits) < 7 or len(digits) > 15 else 0
        names = 1 if "(" in span or span[:1] == "+" or span.startswith("00") else 0
    return 1 if is_base else 0, test, names, 1 if BEFORE[name].search(before) else 0, -1 if OTHER.search(before) else 0


def form(text: str, start: int, kind: int, end: int, is_base: bool) -> tuple[int, ...]:
    """The classifier's inputs, each of few values."""
    span, before, after, context = text[start:end], text[max(0, start - 1) : start], text[end : end + 1], text[max(0, start - CONTEXT) : start]
    return (
        kind, min(9, len(_digits(span)) // 2), int(" " in span), int("-" in span), int("." in span), int("(" in span), int("@" in span), int("+" in span),
        int(before.isalnum() or after.isalnum()), int(bool(BEFORE[KINDS[kind]].search(context))), int(bool(OTHER.search(context))),
    )


SPANS = ArrayType(StructType().add("start", "integer").add("kind", "integer").add("end", "integer").add("votes", "string").add("form", "string"))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("form", pa.string())]))


def _find(batches, text_name: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(text_name).to_pylist():
            found = []
            if text:
                base = base_spans(text)
                for spans, is_base in ((base, True), (candidates(text, base), False)):
                    for a, kind, b in spans:
                        v, x = votes(text, a, kind, b, is_base), form(text, a, kind, b, is_base)
                        found.append({"start": a, "kind": kind, "end": b, "votes": ",".join(map(str, v)), "form": ",".join(map(str, x))})
            out.append(found)
        names = [n for n in batch.schema.names if n != text_name]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, _SPAN)], names=[*names, name])


def find(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of each row of ``docs``, and as ``name`` the base spans and candidates of its text.

    Null and empty texts have none; rows all stay, repeated ones too.
    """
    (text,) = common.unused(docs, "text")
    rows = docs.select(*common.columns(keep), F.col("text").alias(text))
    schema = docs.select(*common.columns(keep)).schema.add(name, SPANS)
    return common.map_batches(rows, lambda b: _find(b, text, name), schema)


def reliabilities(counts: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each vote pattern, and P(vote | class) of each labeler, by expectation-maximisation.

    ``counts`` holds (kind, votes...) patterns; each kind has its own share of true spans.  The
    first guess is the majority of the votes.
    """
    patterns = np.array([p for p, _ in counts])
    n = np.array([c for _, c in counts], float)
    kinds, v = patterns[:, 0], patterns[:, 1:] + 1
    chance = 1 / (1 + np.exp(-patterns[:, 1:].sum(1).astype(float)))
    table = np.zeros((2, v.shape[1], 3))
    for _ in range(ROUNDS):
        share = np.full(len(KINDS), 0.5)
        for k in range(len(KINDS)):
            if (kinds == k).any():
                share[k] = ((n * chance)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2)
        for y, weight in ((0, n * (1 - chance)), (1, n * chance)):
            for j in range(v.shape[1]):
                table[y, j] = np.bincount(v[:, j], weight, 3) + (0.5, 0.5, 0.5)
                # a vote for may not count against, nor one against for
                table[y, j] /= table[y, j].sum()
        low = np.minimum(table[0, :, 2], table[1, :, 2])
        table[0, :, 2], table[1, :, 2] = low, np.maximum(table[0, :, 2], table[1, :, 2])
        high = np.maximum(table[0, :, 0], table[1, :, 0])
        table[1, :, 0], table[0, :, 0] = np.minimum(table[0, :, 0], table[1, :, 0]), high
        logs = np.log(table)
        odds = np.log(share / (1 - share))[kinds] + sum(logs[1, j, v[:, j]] - logs[0, j, v[:, j]] for j in range(v.shape[1]))
        chance = 1 / (1 + np.exp(-odds.clip(-30, 30)))
    return chance, table


def _inputs(forms: np.ndarray) -> np.ndarray:
    """One column for each kind, and for each kind's digit count and flags."""
    kind = np.eye(len(KINDS))[forms[:, 0]]
    digits = np.eye(10)[forms[:, 1]]
    rest = np.concatenate([digits, forms[:, 2:]], 1)
    return np.concatenate([kind, (kind[:, :, None] * rest[:, None, :]).reshape(len(forms), -1)], 1)


def classifier(counts: list[tuple[tuple[int, ...], tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Scores of span forms: a logistic model of the chances that the votes give."""
    if not counts:
        return {}
    by_votes: Counter = Counter()
    for v, x, n in counts:
        by_votes[x[0], *v] += n
    patterns = sorted(by_votes.items())
    chance = dict(zip([p for p, _ in patterns], reliabilities(patterns)[0].tolist(), strict=True))
    forms = np.array([x for _, x, _ in counts])
    y = np.array([chance[x[0], *v] for v, x, _ in counts])
    n = np.array([c for _, _, c in counts], float)
    a, w = _inputs(forms), np.zeros(_inputs(forms).shape[1])
    for _ in range(30):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
        slope = a.T @ (n * (p - y)) + 0.1 * w
        bend = (a * (n * p * (1 - p) + 1e-9)[:, None]).T @ a + 0.1 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    scores = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
    return {x: float(s) for (_, x, _), s in zip(counts, scores, strict=True)}


def learn(found: DataFrame, name: str) -> dict[str, float]:
    """The score of every span form in the column ``name``; forms and votes take few values, so few rows come."""
    rows = found.select(F.explode(name).alias("s")).groupBy("s.votes", "s.form").count().collect()
    numbers = lambda s: tuple(map(int, s.split(",")))
    counts = sorted((numbers(r["votes"]), numbers(r["form"]), r["count"]) for r in rows)
    return {",".join(map(str, x)): s for x, s in classifier(counts).items()}


def _settle(batches, scores: dict[str, float], certain: float) -> Iterator[pa.RecordBatch]:
    """All spans as text, and the base ones' digest and counts, of each row."""
    for batch in batches:
        out = []
        for spans in batch.column("__pii").to_pylist():
            base = [s for s in spans if s["votes"][0] == "1"]
            both = base + [s for s in spans if s["votes"][0] != "1" and scores.get(s["form"], 0.0) >= certain]
            write = lambda some: ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in sorted(some, key=lambda s: (s["start"], s["kind"], s["end"])))
            n = Counter(s["kind"] for s in base)
            out.append((*(n[k] for k in range(len(KINDS))), hashlib.sha256(write(base).encode()).hexdigest(), write(both), len(both) - len(base)))
        columns = list(zip(*out, strict=True)) if out else [[]] * (len(KINDS) + 3)
        names = [n for n in batch.schema.names if n != "__pii"]
        arrays = [pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *arrays], names=[*names, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])


def personal_data(docs: DataFrame, certain: float = CERTAIN) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of each row of ``docs``.

    Positions are code points, ends exclusive.  Counts (``n_email`` and so on) and ``base_sha256``
    are of base spans; ``spans`` has added ones too, ``n_added`` of them.  Null texts count as
    empty; repeated rows and rows without doc_id stay; an empty table gives no rows; other columns
    are ignored.
    """
    found = common.stage(find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "__pii"), "spans")
    scores = learn(found, "__pii")
    return common.map_batches(found, lambda b: _settle(b, scores, certain), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def _mask(batches, scores: dict[str, float], certain: float, names: list[str], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True):
            at, kept = 0, []
            for s in sorted(spans or [], key=lambda s: (s["start"], -s["end"])):
                if s["votes"][0] != "1" and scores.get(s["form"], 0.0) < certain:
                    continue
                if s["start"] >= at:
                    kept += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                at = max(at, s["end"])
            out.append(text if text is None else "".join([*kept, text[at:]]))
        yield common.with_texts(batch, names, out)


def masked(docs: DataFrame, certain: float = CERTAIN) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; ``n_chars`` is counted anew.

    Rows without text or doc_id stay as they are otherwise, repeated rows too; an empty table gives
    none; other columns are kept, whatever their names.
    """
    names, (name,) = docs.columns, common.unused(docs, "pii")
    found = common.stage(find(docs, names, name), "spans")
    scores = learn(found, name)
    return common.map_batches(found, lambda b: _mask(b, scores, certain, names, name), docs.schema)
