"""Spelling variants, chat formatting and resampling, against brute force on small hard tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from sparkeval.llm import automaton, chat, resampling, spelling

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n long, word string, shard int, rank long"
TURNS = "conv_id long, turn long, role string, text string, piece long, ids string"


def prose(seed: int, n: int, letters: str = "abcdeé") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(n))


def test_states_advance_as_the_standard_librarys():
    r = random.Random(1)
    data = np.frombuffer(r.randbytes(9000), np.uint8)
    for count in (0, 1, 5, 300):
        starts, lengths = (np.array([r.choice(x) for _ in range(count)], np.int64) for x in (range(1000), (0, 1, 2, 5, 9, 70, 7000)))
        got = automaton.advance(np.full(count, automaton.START), data, starts, lengths) ^ automaton.START
        assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]
    assert automaton.runs(np.zeros(0, bool), np.zeros(1, np.int64))[0].size == 0
    starts, ends = automaton.runs(np.array([1, 1, 0, 1, 1, 1], bool), np.array([0, 1, 1, 4, 6]))
    assert starts.tolist() == [0, 1, 3, 4] and ends.tolist() == [1, 2, 4, 6]


# --- spelling variants ---------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs: list[tuple], least: int, every: int) -> Counter:
    out = Counter()
    for key, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(SMALL)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += len(w) >= least
    return out


def test_automaton_finds_every_neighbour_once():
    r = random.Random(2)
    for _ in range(150):
        words = sorted({"".join(r.choices("abcé", k=r.randint(1, 6))) for _ in range(r.randint(1, 60))})
        root = spelling.trie(words, list(range(2, len(words) + 2)))
        borders = spelling.Borders(sorted(r.sample(words, min(len(words), r.randint(0, 8)))))
        for w in [*words, "aaaa", "bcb"]:
            assert sorted(spelling.neighbours_in(root, w)) == [(v, i + 2) for i, v in enumerate(words) if near(v, w)]
            assert {borders.shard(v) for v in words if v == w or near(v, w)} <= borders.reached(w)
        assert all(spelling.one_edit(a, b) == near(a, b) for a in words[:9] for b in words)


@pytest.mark.parametrize("shard_words", [20, 1 << 16])
def test_variants_by_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)  # many shards, or one
    docs = [(i, prose(i, 80, "abÀé×")) for i in range(30)] + [(90, "abab abab aba"), (90, "abab abab aba"), (None, "ABAB ABAb b×÷ " + "a" * 3000), (91, "a" * 3000 + " " + "a" * 2999 + "b"), (92, None), (93, ""), (94, "日本 ab̀a œabab")]
    docs += [(100 + i, "abab " * 40 + "ababa") for i in range(9)]
    df = spark.createDataFrame([(k, t, 1, "x", 0, 0) for k, t in docs], DOCS).repartition(5)
    got = {r.word: r for r in spelling.variants(df, least=3, every=5).collect()}
    n = {w: c for w, c in counted(docs, 3, 5).items() if c >= 2}
    forms = {}
    for w in n:
        best = min(((-n[v], v) for v in n if abs(len(v) - len(w)) < 2 and near(v, w)), default=None)
        forms[w] = best[1] if best and -best[0] >= 10 * n[w] else None
    assert got.keys() == n.keys() and any(forms.values())
    for w, r in got.items():
        root = w
        while forms[root]:
            root = forms[root]
        assert (r.n, r.form, r.root, r.form_n) == (n[w], forms[w], root, n.get(forms[w])) and r.n_near == sum(abs(len(v) - len(w)) < 2 and near(v, w) for v in n)
    assert spelling.variants(df.limit(0)).count() == 0 == spelling.variants(df.where("doc_id in (92, 93)")).count()


def test_forms_are_followed_to_the_last(spark):
    text = "aaaaaaa " * 2000 + "aaaaaab " * 200 + "aaaaabb " * 20 + "aaaabbb " * 2
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=1 << 31).collect()}
    assert got == {"aaaaaaa": (None, "aaaaaaa"), "aaaaaab": ("aaaaaaa", "aaaaaaa"), "aaaaabb": ("aaaaaab", "aaaaaaa"), "aaaabbb": ("aaaaabb", "aaaaaaa")}


# --- chat formatting -----------------------------------------------------------------------------

NASTY = ["", "<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|<|", "<", "|im_end|>", "<|endoftext|>", "\n\n a \n", " é😀日本 ́x", "a\\", "\\<\\|", "<|im_sep|><|im_sep|>", "x" * 3000, "\0 nul"]


def test_escapes_are_reversible_and_hide_control_strings():
    r = random.Random(3)
    for t in [*NASTY, *["".join(r.choices(["<", "|", "\\", "<|", "im_end", "|>", "a", " "], k=r.randint(0, 12))) for _ in range(3000)]]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def digests(turns: list[tuple]) -> tuple:
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("long_rows", [4096, 7])
def test_conversations_come_back(spark, monkeypatch, long_rows):
    monkeypatch.setattr(chat, "LONG_ROWS", long_rows)  # with 7, the longer ones come in pieces
    monkeypatch.setattr(chat, "SLICE_BYTES", 4000)
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "<|im_sep|>\n"]), r.choice(NASTY)) for c in range(20) for t in range(r.randint(1, 6))]
    rows += [(50, t // 2, "assistant" if t % 2 else "user", r.choice(NASTY) + str(t)) for t in range(300)]  # ties in turn
    rows += [(60, 1, "assistant", None), (60, None, None, "first"), (60, 1, "assistant", None), (None, 1, "user", "a"), (None, 2, "assistant", "b"), (61, 0, "assistant", "")]
    df = spark.createDataFrame([(*x, 9, "x") for x in rows], TURNS).repartition(4)
    parts = chat.format_parts(df, BYTES)
    assert len(parts) == (2 if long_rows == 7 else 1)
    got = {x.conv_id: x for x in chat.read_back(*parts).collect()}
    convs: dict = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        convs.setdefault(c, []).append((role, text))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == digests(turns)
        assert x.formatted_chars == sum(len(chat.START + chat.MIDDLE + chat.END + chat.escape(role or "") + chat.escape(text or "")) for role, text in turns)
    plain = Tokenizer.from_file(BYTES)
    plain.add_special_tokens([chat.START, chat.MIDDLE, chat.END])
    for x in chat.format_conversations(df, BYTES).collect():
        assert list(x.ids) == plain.encode(x.text, add_special_tokens=False).ids and len(x.ids) == len(x.loss) == len(x.starts) == len(x.ends)
    assert chat.read_back(*chat.format_parts(df.limit(0), BYTES)).count() == 0


def test_masks_by_brute_force():
    r = random.Random(5)
    for _ in range(300):
        cuts = sorted(r.choices(range(40), k=r.randint(1, 12)))
        tokens = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        spans = [(a, b) for a, b in zip(*[iter(sorted(r.sample(range(40), 6)))] * 2, strict=True)]
        loss, starts, ends = chat.mask(np.array([a for a, _ in tokens], np.int32), np.array([b for _, b in tokens], np.int32), [a for a, _ in spans], [b for _, b in spans])
        assert loss.tolist() == [any(a < y and x < b for x, y in spans) for a, b in tokens]
        for on, a, b, (c, d) in zip(loss, starts, ends, tokens, strict=True):
            met = [(max(c, x), min(d, y)) for x, y in spans if c < y and x < d]
            assert bool(met) == on and (len(met) > 1 or (a, b) == (met or [(c, d)])[0])  # control strings keep tokens from meeting two


# --- resampling ----------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_by_brute_force(spark, most):
    docs = [(i, prose(i, 12 + i % 20, "abcXYZ0é日.")) for i in range(80)]
    docs += [(3, docs[3][1]), (4, "Another text " * 12), (None, prose(7, 30)), (200, None), (201, ""), (202, "...!"), (203, "z" * 3000), (204, prose(9, 4000))]
    target = [prose(i, 30, "abé") for i in range(5)] + [None, ""]
    df = spark.createDataFrame([(k, t, 1, "x", 0, 0) for k, t in docs], DOCS).repartition(4)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=97).collect()

    def grams(text: str | None) -> list[int]:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(SMALL))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 97 for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in grams(x)) for texts in ([x for _, x in docs], target))
    of_s, of_t = s.total() + 97, t.total() + 97
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * of_s / ((s[b] + 1) * of_t))) for b in range(97)}
    want = []
    for k, x in docs:
        f = grams(x)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        want.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(SMALL)))])
    able = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is not None, w[0] or 0, w[1], w[2]))
    ranked = [(*w[:4], i + 1 if w[4] >= 20 and i < len(able) * 10 // 100 else None) for i, w in enumerate(able)] + [(*w[:4], None) for w in want if w[4] < 20]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(ranked, key=key)
    assert resampling.resample(df.limit(0), spark.createDataFrame([], "text string")).count() == 0
    assert resampling.resample(df, spark.createDataFrame([], "text string")).count() == len(docs)
