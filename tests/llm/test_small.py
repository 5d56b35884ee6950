"""The operators on small hard tables, against brute force or exact round trips."""

import cProfile
import hashlib
import itertools
import pstats
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkeval.llm import chunks, elias_fano, fingerprint, hyperminhash, labelled_pages, main_text, packing, pieces, pii, queries, toxicity, vptree
from sparkeval.llm.common import connected_components, stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, spans string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


HARD = [None, "", " ", "a", "one two three four", "A\tb\nc  d e f", words(1, 40), words(1, 40), words(2, 3000), "x" * 5000, "日本語 テキスト 😀 é é", "mail a.b@c.de now, +1 (017) 555-7713 or 10.0.0.256 10.0.0.1", "<s> </s> <|endoftext|> ▁ ▁▁a", "a  b \n c d  e", "don't it's 12.5%, (x)"]


@pytest.fixture(scope="module")
def hard(spark):
    """Null and empty texts, ties, a repeated row, a null id, and columns with clashing names."""
    rows = [(i, t, "en", "s", 0, 0.5, 1, "x") for i, t in enumerate(HARD)]
    rows += [rows[6], (None, words(3, 30), None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_elias_fano_sequences():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (1, 5), (10, 3), (700, 90_000), (3000, 100)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.of(v).to_bytes())
        assert (e.decode(0, n) == v).all() and all(e.select(i) == v[i] for i in range(n))
        for a, b in ((0, 0), (n // 3, n // 2), (n - n // 4, n), (min(n, 257), min(n, 600))):
            assert (e.decode(a, b) == v[a:b]).all()
        for x in (0, 7, *v[:: max(1, n // 9)].tolist(), top + 1):
            assert e.index(x) == (int(np.searchsorted(v, x)), int(np.searchsorted(v, x, "right")))
    v = np.sort(rng.integers(0, 1 << 40, 10_000))
    assert len(elias_fano.EliasFano.of(v).to_bytes()) * 8 < 10_000 * 32


@pytest.mark.parametrize("shard", [50, 1 << 21])
def test_token_files(spark, hard, empty, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(elias_fano, "SHARD_IDS", shard)
    monkeypatch.setattr(elias_fano, "BLOCK", 8)  # a multiple of 8, so that blocks end at bytes
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    elias_fano.write(hard, str(tmp_path / "f"), public_tokenizers.path("word_bpe_49k.json"), 2)
    got = sorted(elias_fano.read(spark, str(tmp_path / "f"), with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted([*range(len(HARD)), 6])]
    start = 0
    for r in got:
        text = words(3, 30) if r.doc_id is None else HARD[r.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        assert (r.ids, r.start, r.n_tokens) == (ids, start, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = elias_fano.read(spark, str(tmp_path / "f"), with_ids=True, chosen=[6, 9, 999]).collect()
    assert sorted((r.start, r.n_tokens, r.ids) for r in some) == sorted((r.start, r.n_tokens, r.ids) for r in got if r.doc_id in (6, 9)) and len(some) == 3
    elias_fano.write(empty, str(tmp_path / "e"), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert elias_fano.read(spark, str(tmp_path / "e")).count() == 0


def test_sentencepiece(hard, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = pieces.encode(hard, path, full=True).collect()
    assert len(rows) == len(HARD) + 2
    for r in rows:
        text = words(3, 30) if r.doc_id is None else HARD[r.doc_id] or ""
        ids = [*lib.encode(text), lib.eos_id()]
        assert r.ids == ids and r.decoded == lib.decode(ids) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert pieces.encode(empty, path).count() == 0


def test_sentencepiece_learns_new_parts_together(monkeypatch):
    """Words met first cost a few calls each, not some for each pair of signs; also over turns of the memory, and for odd parts."""
    monkeypatch.setattr(pieces, "REMEMBERED", 2000)
    path, r = public_tokenizers.path("piece_bpe_32k.model"), random.Random(7)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = [lib.id_to_piece(i) for i in range(300, len(lib))]
    texts = [" ".join("".join(r.choices("etaoinshrdlu", k=r.randint(4, 14))) for _ in range(400)) for _ in range(20)]
    odd = ["", "  ", "▁", "x" * 300, "\0 \n\n", "😀", "née.\nEt", "12.5%", "etaoin" * 12, "日本語テキスト", "<s>", "<0x41>", "\u0e01\U0010fffd"]
    texts += [" ".join(r.choices(odd, k=12) + r.choices(vocabulary, k=12)) for _ in range(40)] + ["", None, " a", "a ", "a  b"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x, pa.string())], ["doc_id", "text"]) for x in (texts[:10], texts[10:], texts)]
    pieces.pieces.cache_clear()
    pieces.pieces(path)
    with cProfile.Profile() as calls:
        got = list(pieces._encode(iter(batches), path, True))
    for batch, out in zip(batches, got, strict=True):
        want = [[*lib.encode(x or ""), lib.eos_id()] for x in batch["text"].to_pylist()]
        assert out["ids"].to_pylist() == want
        assert out["ids_sha256"].to_pylist() == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in want]
    pieces.pieces.cache_clear()
    assert pstats.Stats(calls).total_calls < 20 * 2 * 20 * 400


def test_sentencepiece_check_finds_a_difference():
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    p.id_of[p.symbol["a"]] += 1
    with pytest.raises(ValueError, match="'xa' otherwise"):
        p.encode(["one xa two"])


SPECIAL = ["one <|endoftext|> two", "<|endoftext|>", "A<|startoftext|>b <|endoftext|><|endoftext|>\n", " x <|ENDOFTEXT|> y", "plain words, as ever <|endoftext", words(4, 300) + "<|endoftext|> " + words(5, 1500)]


def test_special_tokens_in_texts(spark, tmp_path):
    texts = HARD + SPECIAL
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, rows in (("word_bpe_49k.json", queries.op2_token_files(spark, str(tmp_path))), ("byte_bpe_50k.json", queries.op4_best_fit_packing(spark, str(tmp_path))), ("byte_bpe_50k.json", corpus_pipeline.sequences_are_packed(spark, docs, ""))):
        t = Tokenizer.from_file(public_tokenizers.path(name))  # with its default setting
        ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for x in texts]
        got = rows.collect()
        if "piece" in rows.columns:
            assert {r.doc_id for r in got} == set(range(len(texts))) and sum(r.length for r in got) == sum(map(len, ids))
            assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got)
        else:
            starts = np.cumsum([0, *map(len, ids)])
            assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == [(k, starts[k], len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids)]


def test_local_search_empties_bins():
    lengths = [5, 4, 4, 3, 2, 2]
    first = packing.best_fit(lengths, 10)
    assert len(first) == 3 and len(packing.local_search(first, lengths, 10)) == 2
    r = random.Random(2)
    for _ in range(60):
        lengths = [r.randint(1, 99) for _ in range(r.randint(0, 120))]
        before = packing.best_fit(lengths, 100)
        after = packing.local_search(before, lengths, 100)
        assert sorted(i for b in after for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 100 for b in after)
        assert len(after) <= len(before)


def test_local_search_leaves_no_trade():
    """No single trade that raises the sum of squares is left, and few bins more than the fewest."""
    r = random.Random(6)
    over = 0
    for _ in range(80):
        capacity, lengths = 20, [r.randint(1, 12) for _ in range(r.randint(1, 9))]
        bins = packing.local_search(packing.best_fit(lengths, capacity), lengths, capacity)
        size = lambda some: sum(lengths[i] for i in some)
        some = lambda b, most: [c for k in range(most + 1) for c in itertools.combinations(b, k)]
        for a, b in itertools.permutations(bins, 2):
            if size(a) < size(b):
                for give, take in itertools.product(some(b, 2), some(a, 2)):
                    if 0 < len(take) and len(give) + len(take) < 4:
                        assert not 0 < size(take) - size(give) <= capacity - size(b)
        fewest = next(n for n in range(1, 10) if fits(sorted(lengths, reverse=True), [capacity] * n))
        over += len(bins) - fewest
    assert over <= 2


def fits(lengths, rooms):
    """Whether pieces fit in bins with such room, by trying all ways."""
    if not lengths:
        return True
    n, rest = lengths[0], lengths[1:]
    return any(fits(rest, rooms[:k] + [room - n] + rooms[k + 1 :]) for k, room in enumerate(rooms) if room >= n and room not in rooms[:k])


def test_packing(hard, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for capacity in (64, 1024):
        rows = packing.pack(hard, path, 2, capacity=capacity).collect()
        sequences, documents = defaultdict(list), defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
            documents[r.doc_id].append(r)
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= capacity
        for doc_id, parts in documents.items():
            ids = t.encode(words(3, 30) if doc_id is None else HARD[doc_id] or "", add_special_tokens=False).ids + [2]
            if doc_id == 6:
                continue  # twice there
            parts.sort(key=lambda r: r.piece)
            assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
            assert len(ids) > capacity or len(parts) == 1
            assert all(r.length == capacity for r in parts[1:])
            for r in parts:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(empty, path, 2).count() == 0


def shingle_set(text, lower=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, hard, empty):
    rows = fingerprint.edited_fingerprints(hard).collect()
    assert len(rows) == len(HARD) + 2
    ordered = [words(3, 30)] + [HARD[i] or "" for i in sorted([*range(len(HARD)), 6])]
    wanted = Counter()
    for k, text in enumerate(ordered):
        q = len(text) // 4
        wanted[hashlib.sha256((text[: len(text) - q] + ordered[(k + 1) % len(ordered)][:q]).encode()).hexdigest()] += 1
    assert Counter(r.edited_sha256 for r in rows) == wanted
    same = {r.fingerprint for r in rows if r.doc_id in (6, 7)}
    assert len(same) == 1 and len({r.fingerprint for r in rows}) >= 11
    assert fingerprint.edited_fingerprints(empty).count() == 0
    many = spark.createDataFrame([(None, words(i, 9)) for i in range(40)] + [(5, words(i, 9)) for i in range(40, 120)] + [(i, words(i, 9)) for i in range(120, 180)], "doc_id long, text string")
    chain = {r.doc: r.nxt for r in fingerprint.next_documents(many.select("doc_id", F.struct("text").alias("own")), 3).selectExpr("own.text as doc", "next.text as nxt").collect()}
    ids, at, seen = {r.text: r.doc_id for r in many.collect()}, words(0, 9), []
    while at not in seen:
        seen.append(at)
        at = chain[at]
    begin = next(k for k in range(len(seen)) if ids[seen[k]] is None and ids[seen[k - 1]] == 179)
    assert [ids[t] for t in seen[begin:] + seen[:begin]] == [None] * 40 + [5] * 80 + list(range(120, 180))
    one = fingerprint.edited_fingerprints(hard.where("doc_id = 8")).first()
    assert one.near_next == 1.0 and 0 < one.near_edited <= 1


def test_sketches_estimate(spark):
    a, b = words(10, 4000), words(11, 4000)
    rows = [(0, a, a), (1, a, b), (2, a, " ".join(a.split()[:3000] + b.split()[:1000])), (3, a, " ".join(a.split()[:500])), (4, "", ""), (5, "p q", "p q"), (6, "p q", "p r")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "x"), "b", "y")
    x, y = F.col("x"), F.col("y")
    got = {r.i: r for r in df.select("i", fingerprint.likeness(x, y).alias("j"), fingerprint.containment(y, x).alias("c"), (fingerprint.from_string(fingerprint.to_string(x)) == x).alias("back"), (fingerprint.merge(x, y) == fingerprint.merge(y, x)).alias("m")).collect()}
    assert all(r.back and r.m for r in got.values())
    assert [got[i].j for i in (0, 4, 5)] == [1, 1, 1] and got[1].j < 0.05 and got[6].j < 0.5
    assert got[2].j == pytest.approx(0.6, abs=0.08) and got[3].c > 0.95


def brute_components(texts, percent):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "GROUP_BLOCK", block)
    monkeypatch.setattr(hyperminhash, "FAMILY_BLOCK", block)
    r, texts = random.Random(5), {}
    for family in range(12):
        base = words(100 + family, r.choice([6, 30, 120, 400])).split()
        for _ in range(r.randint(1, 18)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = r.choice(["zz", "yy", "qq"])
            texts[len(texts) * 3 + 1] = " ".join(t)
    texts |= {1000: None, 1001: "", 1002: "a b", 1003: "A  b", 1004: "c"}
    want, sets = brute_components(texts, 85)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, component_id string, pos int").repartition(5)
    got = {x.doc_id: x for x in hyperminhash.near_duplicates(df, 85).collect()}
    assert {i: x.component_id for i, x in got.items()} == want
    assert all(x.n_shingles == len(sets[i]) and x.kept == (x.component_id == i) for i, x in got.items())


def test_short_slices(spark):
    """Slices of few words in all, down to none, and one row of three words as a table."""
    for n in range(7):
        for texts in (["abcdefg"[:n]], ["abcdefg"[:n], None], ["", "abcdefg"[:n], "a"]):
            texts = [t and " ".join(t) for t in texts]
            batch = pa.RecordBatch.from_pydict({"node": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
            signed = [r for b in hyperminhash._sign([batch]) for r in b.to_pylist()]
            assert [r["n_shingles"] for r in signed] == [len(shingle_set(t)) for t in texts]
            keyed = pa.RecordBatch.from_pydict({"doc_id": batch.column("node"), "tie": batch.column("node"), "text": batch.column("text")})
            chunked = [r for b in chunks._chunks([keyed], np.empty(0, np.int64), 1) for r in b.to_pylist()]
            assert {r["doc_id"] for r in chunked} == {k for k, t in enumerate(texts) if t}
    got = hyperminhash.near_duplicates(spark.createDataFrame([(1, "a b c")], "doc_id long, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [(1, 1, 1, True)]


def test_near_duplicates_of_hard_rows(spark, hard, empty):
    rows = hyperminhash.near_duplicates(hard).collect()
    assert len(rows) == len(HARD) + 2
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert of[7].component_id == 6 and not of[7].kept and of[6].kept and of[0].component_id == 0
    assert [r for r in rows if r.doc_id is None][0].kept
    assert hyperminhash.keep_one(hard).count() == len(HARD)  # one copy and one repeated row go
    unlike = spark.createDataFrame([(4, words(i, 30), i) for i in range(3)] + [(4, words(1, 30), 9), (3, words(2, 30), 8), (None, "x", 7)], "doc_id long, text string, `a.b` int")
    assert sorted(r["a.b"] for r in hyperminhash.keep_one(unlike).collect() if r["a.b"] in (0, 7, 8)) == [0, 7, 8] and hyperminhash.keep_one(unlike).count() == 4
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in hyperminhash.near_duplicates(unlike).collect()) == [(0, 0, True), (3, 3, True), (4, 3, False), (4, 4, True), (4, 4, True), (4, 4, True)]
    assert hyperminhash.near_duplicates(empty).count() == 0 and hyperminhash.keep_one(empty).columns == empty.columns


def test_estimates_are_corrected():
    rng = np.random.default_rng(3)
    near = []
    for _ in range(30):
        x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        y = np.concatenate([x[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
        near.append(hyperminhash.estimate((hyperminhash.registers(x) == hyperminhash.registers(y)).sum(), 1000, 1000))
    assert np.mean(near) == pytest.approx(900 / 1100, abs=0.03)
    assert hyperminhash.estimate(0, 10, 10) < 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 3), (7, 6), (6, 5), (5, 4), (4, 1), (None, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 8)}, 8: 8, 9: 8}
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {1}
    assert connected_components(chain.limit(0)).count() == 0


def test_repeated_passages(spark, hard, empty):
    r, docs = random.Random(4), {i: words(1000 + i, 150).split() for i in range(60)}
    planted = []
    for p in range(15):
        passage = words(5000 + p, r.randint(51, 70)).split()
        first, second = sorted(r.sample(range(60), 2))
        for i in (first, second):
            k = r.randint(0, len(docs[i]))
            docs[i] = docs[i][:k] + passage + docs[i][k:]
        planted.append((" ".join(passage), first, second))
    texts = {i: " ".join(t) for i, t in docs.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    spans = chunks.repeated_passages(df).collect()
    out = {x.doc_id: x for x in chunks.without_repeats(df.repartition(4)).collect()}
    for passage, first, second in planted:
        if passage not in texts[first] or passage not in texts[second]:
            continue  # another was put into it
        assert passage in out[first].text and passage not in out[second].text
        cut = [s for s in spans if s.doc_id == second and s.source_doc_id == first]
        assert max(len(texts[second][s.start : s.end].split()) for s in cut) >= 20
    touched = {second for *_, second in planted}
    assert all(out[i].text == texts[i] for i in texts if i not in touched) and all(len(x.text) == x.n_chars for x in out.values())
    rows = chunks.without_repeats(hard).collect()
    assert len(rows) == len(HARD) + 2 and {x.text for x in rows if x.doc_id == 7} == {""} and {x.text for x in rows if x.doc_id == 0} == {None}
    assert chunks.repeated_passages(empty).count() == 0 and chunks.without_repeats(empty).count() == 0


def test_every_copy_in_a_document_goes(spark):
    passage, a, b, c = words(7000, 60), words(7001, 80), words(7002, 80), words(7003, 80)
    texts = {1: f"{a} {passage}", 2: f"{passage} {b} {passage} {c} {passage}", 3: f"{words(7004, 40)} word", 4: "word " * 400 + b + " word" * 400}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = sorted((s for s in chunks.repeated_passages(df).collect() if s.doc_id == 2), key=lambda s: s.start)
    assert [s.source_doc_id for s in spans] == [1, 1, 1] and all(len(texts[2][s.start : s.end].split()) >= 50 for s in spans)
    out = {x.doc_id: x.text for x in chunks.without_repeats(df).collect()}
    p = passage.split()
    middle = " ".join(p[15:-15])
    assert middle in out[1] and middle not in out[2] and " ".join(b.split()[10:-10]) in out[2] and " ".join(c.split()[10:-10]) in out[2]
    assert out[1] == texts[1] and out[4].count("word") == 800  # a word that fills a page is no passage


def test_chunks_cover_texts_and_resist_insertions(spark):
    text = words(9, 500)
    rows = chunks.chunk_table(spark.createDataFrame([(1, text), (2, "in front of it " + text), (3, "é" * 3000)], "doc_id long, text string")).collect()
    for i, t in ((1, text), (2, "in front of it " + text), (3, "é" * 3000)):
        mine = sorted((r["at"] >> 32, r["at"] & 0xFFFFFFFF, r["size"] >> 32) for r in rows if r.doc_id == i)
        assert [k for k, _, _ in mine] == list(range(len(mine))) and mine[0][1] == 0
        assert all(a + n == b for (_, a, n), (_, b, _) in zip(mine, mine[1:])) and mine[-1][1] + mine[-1][2] == len(t)
    one, two = ({r.digest for r in rows if r.doc_id == i} for i in (1, 2))
    assert len(one - two) <= 2 and len(one) > 60


def test_main_text():
    w = main_text.learned()
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now and here</div><article><h1>Big &amp; small</h1><p>One\n two<b>three</b>&nbsp;four<p>Five<aside>Not this</aside><p>Six</article><section class=comments><p>I disagree with all</p></section><footer>&copy; x</footer>"
    assert main_text.extract(page, w) == "Big & small One twothree four Five Six"
    assert [main_text.extract(p, w) for p in (None, "", "<p>", "<nav>a b</nav>", "<script>if (a<b) '</p>'", "<!-- x")] == [""] * 6
    assert main_text.extract("<article><p>Line" + " word" * 50_000 + "</p></article>", w).count("word") == 50_000
    right = 0
    for made in labelled_pages.pages(77, 200):
        right += main_text.extract("".join(m for m, _, _ in made), w) == " ".join(" ".join(t for _, t, y in made if y == 1).split())
    assert right >= 170  # held-out pages that come out exactly


def test_main_text_drops_only_what_is_silent():
    w = main_text.learned()
    body = "<article><h1>Title here</h1><p>One two three four five</p>{}<p>Six seven eight nine ten</p></article>"
    whole = "Title here One two three four five Six seven eight nine ten"
    for start in ("<html><head><title>T</title><meta charset=utf-8><body>", "<html><head><title>T</title><style>p > a {}</style>", "<head><script>if (a<b) x = '</script></p><link rel=x>", "<head><noframes><p>no</p></noframes></head><body>", "<html><head>"):
        assert main_text.extract(start + body.format(""), w) == whole
    text = [v for kind, v, _ in main_text.tokens("<head> <title>T</title> Words <p>more</p>") if kind == "text"]
    assert text == [" Words ", "more"]
    for inner in (
        "<svg width='1' />", "<math/>", "<svg><svg/><path d='M0'/></svg>", "<svg><title>no</svg>", "<canvas id=x>", "<video src=x>", "<object><object>no</object>no</object>", "<svg/><svg><text>no</text></svg>",
        "<template><p>no</p></template>", "<noscript><img src=x>no</noscript>", "<select><option>no<select><option>no</select>", "<script>document.write('<svg>')</script>", "<iframe src=x>no</iframe >", "<svg viewBox='0'>", "<canvas>",
    ):
        got = main_text.extract(body.format(inner), w)
        assert got == whole if "select" not in inner else whole.split("Six")[0] in got and "Six" in got, inner
    assert main_text.extract(body.format("<canvas>" * 20_000), w) == whole


#: Classes that site builders put on a page's body.
BODIES = "comments-open|logged-in admin-bar has-ads|page-template header-fixed footer-dark|single-post sidebar-right|ads-enabled|cookie-notice|has-sidebar|nav-open menu-open|search-results|newsletter-popup-active|with-banner|social-share-on|no-js advert|layout-aside|modal-open|widget-page|sponsored-content|promo|related-posts-on|footer-sticky|header-sticky nav-down|subscribe-wall|login-form|archive tag|breadcrumbs-on"


def test_main_text_within_wrappers():
    w = main_text.learned()
    said = "<h1>Title here now</h1><p>One two three four five six seven eight</p><p>Nine ten eleven twelve thirteen fourteen</p>"
    want = "Title here now One two three four five six seven eight Nine ten eleven twelve thirteen fourteen"
    around = "<nav><a href=/>Home</a><a href=/b>News</a></nav>{}<section class='comments'><div class='comment-content'><p>No, I say</p></div></section><footer>Copyright nobody</footer>"
    for inner in (f"<article>{said}</article>", f'<div class="entry-content">{said}</div>'):
        for x in (inner, around.format(inner)):
            for c in BODIES.split("|"):
                for page in (f'<body class="{c}">{x}</body>', f'<html class="{c}"><body id="{c}">{x}</body></html>', f'<body><form id="aspnetForm" class="{c}">{x}</form></body>', f'<body><div id="wrapper" class="{c}">{x}</div></body>'):
                    assert main_text.extract(page, w) == want, page[:90]
    many = "<div class='comment-content'><p>No, I say to all of this, and again</p></div>" * 40  # comments may be most of a page
    assert main_text.extract(f"<body class='comments-open'><article>{said}</article><section class='comments'>{many}</section></body>", w) == want


def test_main_text_scan_finds_the_best_run():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 14))]
        a, b = main_text.best_run(scores)
        assert sum(scores[a:b]) == max(sum(scores[x:y]) for x in range(len(scores) + 1) for y in range(x, len(scores) + 1))
    w = main_text.learned()
    assert all(v < 0 for x in (w.named, w.plain) for v in x.tags.values())
    made = labelled_pages.pages(78, 150, plain=True)  # no names: only the run tells
    pages = [("".join(m for m, _, _ in p), main_text.wanted(p)) for p in made]
    assert sum(main_text.extract(p, w) == t for p, t in pages) > 2 * sum(main_text.extract(p, w, scan=False) == t for p, t in pages)


def test_main_text_of_hostile_markup():
    w = main_text.learned()
    article = "<article><h1>Title here</h1><p>One two three four five</p></article>"
    for before in ("""<script>for(i=0;i<n;i++){d='"'}</script><div class="x">""", """<script>if (a<b && c="x) {}</script><div>""", """<style>a<b[c='"']{}</style><div id='y'>""", """<p title="it's > 5">""", "<div class=x='\"'>", "< div><!-->", "<!doctype html>x < y</3>", "<a title=\"not closed>"):
        assert main_text.extract(before + article, w).endswith("Title here One two three four five"), before
    began = time.perf_counter()
    assert main_text.extract(article + "<a " + "\"'" * 100_000, w).startswith("Title here")
    assert main_text.extract(article + "<a x=" + "\"" * 200, w).startswith("Title here")
    assert main_text.extract(article + "<a x=\"'" * 20_000, w).startswith("Title here")
    assert main_text.extract("<div>" * 50_000 + article, w).endswith("five")
    assert main_text.extract("<b>" * 50_000 + "</i>" * 50_000 + "<div></div>" * 50_000 + article, w).endswith("five")
    assert main_text.extract(article + "<p>" + "<" * 100_000, w).startswith("Title here")
    assert time.perf_counter() - began < 10


def test_vantage_points_are_few_before_they_are_sorted(spark):
    rows = spark.range(60_000).select("id", (F.col("id") % 50 == 0).cast("int").alias("dim"), F.lit(b"x").alias("vector")).withColumnRenamed("id", "vec_id").unionAll(spark.range(500).select(F.lit(7).cast("long"), F.lit(1), F.lit(b"x"))).toDF("vec_id", "dim", "vector")
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.lit(20).alias("wanted"))
    few = {r.dim: r["count"] for r in vptree._few(rows, counts).groupBy("dim").count().collect()}
    assert few.keys() == {0, 1} and all(40 < n < 240 for n in few.values())
    got = vptree._lowest(rows, 3000, 1024).collect()
    assert {d: sorted(r.turn for r in got if r.dim == d) for d in (0, 1)} == {0: list(range(1, 21)), 1: [1]}
    assert "Window" in vptree._lowest(rows, 3000, 1024)._jdf.queryExecution().executedPlan().toString()


def test_main_text_rows(spark):
    rows = [(1, "u", "<article><p>Hello there</p></article>"), (1, "u", "<article><p>Hello there</p></article>"), (None, None, None)]
    got = main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "Hello there", 11), (1, "Hello there", 11)]


def test_exact_search_and_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 8))
    v[10] = v[20] = v[30]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [None] * 8), (5004, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    index = vptree.build_index(df, shard=300, pivots=7)
    queries = df.where("vec_id % 10 = 0 or vec_id = 5004")
    away = np.sqrt(((v[::10, None, :] - v[None]) ** 2).sum(2))
    want = {}
    for k, i in enumerate(range(0, 3000, 10)):
        away[k, i] = np.inf
        want[i] = [(int(j), float(away[k, j])) for j in np.lexsort((np.arange(3000), away[k]))[:10]]
    got = defaultdict(list)
    for r in sorted(vptree.nearest(index, queries, factor=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]] and [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=1e-12)
    near = defaultdict(set)
    for r in vptree.nearest(index, queries).collect():
        near[r.query_id].add(r.vec_id)
    assert np.mean([len(near[i] & {j for j, _ in want[i]}) / 10 for i in want]) >= 0.9
    assert vptree.nearest(vptree.build_index(df.limit(0)), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert vptree.nearest(vptree.build_index(few), few).count() == 6


def test_toxicity_learns_pairs():
    """A label that only a pair of terms tells: additive weights cannot, the products can."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (2000, 2))
    y = (x[:, 0] == x[:, 1]).astype(float)
    row, at = np.nonzero(x)
    row, at = np.concatenate([row, np.arange(2000)]), np.concatenate([at, np.full(2000, 2)])
    model = toxicity.fit(row, at, y, np.arange(3).astype(np.uint64))
    raw = model.raw(row, at, 2000)
    assert ((raw > 0) == (y > 0.5)).mean() > 0.99


def test_toxicity(spark, hard, empty):
    r, rows, labels = random.Random(8), [], []
    for i in range(600):
        bad = r.random() < 0.3
        rows.append((i, words(20_000 + i, 40) + (" you Insult! fool" if bad else "")))
        if i < 500:
            labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, marks).collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    assert all(x.predicted == int("Insult" in rows[i][1]) and 0 <= x.score <= 1 for i, x in got.items())
    clean = toxicity.without_toxic(docs, marks)
    assert clean.columns == docs.columns and clean.count() == sum("Insult" not in t for _, t in rows)
    assert toxicity.score(hard, marks).count() == len(HARD) + 2
    assert toxicity.score(empty, marks).count() == 0 and toxicity.score(docs, marks.limit(0)).where("predicted = 1").count() == 0


def test_personal_data(spark, hard, empty):
    rows = {
        1: "a.b@c.de x@y @z.w a@b.c@d.e", 2: "1.2.3.4.5 256.1.1.1 1.2.3.256 001.2.3.4", 3: "4111 1111 1111 1111 and 4111-1111-1111-1112", 4: "+1 (017) 555-7713. +12 34", 5: None, 6: "",
        7: "call phone: (017) 555-7713 now", 8: "é😀 q@w.er",
    }
    got = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}

    def brute(t):
        out = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda s: re.sub("[^0-9]", "", s)
        out += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        return sorted(out)

    for i, t in rows.items():
        base = brute(t or "")
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x == n for _, x, _ in base) for n in range(4)]
        assert set(written.split(",")) - {""} <= set(got[i].spans.split(","))
    masked = {x.doc_id: x for x in pii.masked(spark.createDataFrame([(i, t, 0) for i, t in rows.items()], "doc_id long, text string, n_chars long")).collect()}
    assert masked[8].text == "é😀 [EMAIL]" and masked[8].n_chars == 10 and masked[5].text is None
    assert pii.personal_data(hard).count() == len(HARD) + 2 and pii.masked(hard).count() == len(HARD) + 2
    assert pii.personal_data(empty).count() == 0 and pii.masked(empty).count() == 0


def test_personal_data_in_linear_time():
    """Ten megabytes of spans, candidates and near misses; brute force on a part of it."""
    line = "a.b@c.de x at y.org 1.2.3.4 4111 1111 1111 1111 +1 (017) 555-7713 call 0170 555 1234 a@b@c 1.2.3 "
    text = line * (10_000_000 // len(line)) + "1" * 500_000 + "." + "a" * 200_000 + "@" + "+1" * 100_000 + "1:" * 100_000
    began = time.perf_counter()
    base = pii.base_spans(text)
    more = pii.candidates(text, base)
    assert time.perf_counter() - began < 60
    per = len(pii.base_spans(line))
    assert len(base) >= per * (10_000_000 // len(line)) and len(more) > 100_000
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice(["1.2.3.4", "a at b.com", "a@b.de", " ", "12", "0170 555 1234", "4111-1111-1111-1111", ".", "+49 ", "(1)"]) for _ in range(r.randint(1, 14)))
        spans = pii.base_spans(t)
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in pii.IP_RUN.finditer(t)]
        kept = []
        for a, kind, b in sorted(((m.start(), k, m.end()) for k, n in enumerate(pii.KINDS) for m in pii.WIDE[n].finditer(t)), key=lambda s: s[:2]):
            if all(b <= x or a >= y for x, _, y in spans) and (not kept or a >= kept[-1][2]):
                kept.append((a, kind, b))
        assert pii.candidates(t, spans) == kept


def test_added_spans_are_personal_data(spark):
    """Planted spans that no fixed pattern matches are found; what only looks like them stays."""
    r, rows, planted = random.Random(12), [], {}
    say = lambda i, n: words(40_000 + i, n)
    for i in range(400):
        d = lambda n: "".join(r.choices("23456789", k=n))
        kind = i % 8
        real = {0: f"{say(i, 1)} [at] {say(i + 500, 1)} [dot] org", 1: f"0{d(3)} {d(3)} {d(4)}", 2: f"({d(3)}) {d(3)}-{d(4)}"}.get(kind)
        lead = {0: "contact me at: ", 1: "call phone ", 2: "tel. "}.get(kind, "")
        other = {3: f"a.{say(i, 1)}@{say(i + 9, 1)}.com", 4: f"version {d(3)} {d(3)} {d(3)}", 5: f"see section {d(2)}-{d(3)}-{d(3)}", 6: f"+49 {d(3)} {d(3)} {d(4)}", 7: "they met at noon. then"}.get(kind)
        before = say(i + 1000, 20) + " " + lead
        planted[i] = (len(before), len(before) + len(real)) if real else None
        rows.append((i, f"{before}{real or other} {say(i + 2000, 20)}"))
    got = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = {"email": 3, "phone": 6}
    found = {i: [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s] for i in got}
    hit = sum(planted[i] in found[i] for i in planted if planted[i])
    false = sum(got[i].n_added for i in planted if planted[i] is None)
    assert hit >= 0.9 * sum(x is not None for x in planted.values()) and false <= 10, (hit, false)
    assert all(got[i][f"n_{k}"] == 1 for k, kind in base.items() for i in planted if i % 8 == kind)


ODD = ["meta.k", "a`b", "__text", "__score", "__spans", "__pii", "tie", "salt", "digest", "node", "family", "bands", "row", "block"]


def test_long_texts_and_odd_columns(spark, tmp_path):
    """Texts longer than a slice, and columns whose names the operators use."""
    long = words(60_000, 200_000)
    assert len(long) > chunks.common.SLICE_BYTES
    texts = [long, long + " more", "short one", None, "", words(1, 60) + " " + long[: 1 << 19]]
    frame = spark.createDataFrame([(i, t, None if t is None else len(t), *["v"] * len(ODD)) for i, t in enumerate(texts)], f"doc_id long, text string, n_chars int, {', '.join('`' + n.replace('`', '``') + '` string' for n in ODD)}").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    kept = hyperminhash.keep_one(frame)
    cut = chunks.without_repeats(frame)
    for out, n in ((toxicity.without_toxic(frame, labels), 6), (kept, 5), (cut, 6), (pii.masked(frame), 6)):
        rows = out.collect()
        assert out.columns == frame.columns and len(rows) == n and all(r[c] == "v" for r in rows for c in ODD)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        assert out.schema["n_chars"].dataType == frame.schema["n_chars"].dataType
    got = {r.doc_id: r for r in cut.collect()}
    assert got[0].text == long and len(got[1].text) < 200 and 200 < len(got[5].text) < 1000
    path, lib = public_tokenizers.path("byte_bpe_50k.json"), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer.from_file(path)
    size = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}
    placed = Counter()
    for r in packing.pack(frame, path, 2).collect():
        placed[r.doc_id] += r.length
    assert placed == size
    elias_fano.write(frame, str(tmp_path / "f"), path, 2, blank="leads")
    assert {r.doc_id: r.n_tokens for r in elias_fano.read(spark, str(tmp_path / "f")).collect()} == size
    assert {r.doc_id: r.n_tokens for r in pieces.encode(frame, public_tokenizers.path("piece_bpe_32k.model")).collect()} == {i: len(lib.encode(x or "")) + 1 for i, x in enumerate(texts)}
    alike = {r.doc_id: r for r in fingerprint.edited_fingerprints(frame).collect()}
    assert alike[0].near_next > 0.99 and alike[2].near_next == 0
    assert toxicity.score(frame, labels).count() == 6 and pii.personal_data(frame).count() == 6


def test_votes_decide():
    good, bad = (1, 1, 1, 1, 0), (0, -1, -1, 0, -1)
    counts = [((3, *good), 50), ((3, *bad), 200), ((3, 0, 1, 1, 1, 0), 5)]
    chance, table = pii.reliabilities(counts)
    assert chance[0] > 0.95 and chance[1] < 0.05 and chance[2] > 0.9 and np.allclose(table.sum(2), 1, atol=0.2)


def test_hot_bands_go_out_hardly_more_than_twice(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "GROUP_BLOCK", 16)
    rng = np.random.default_rng(5)
    base = hyperminhash.registers(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    rows, like = [], []
    for node in range(200):  # all share the first band; three quarters are near copies, the others are alike in tens or not at all
        sig = base.copy() if node % 4 else hyperminhash.registers(np.random.default_rng(node // 20 if node % 8 else 10_000 + node).integers(0, 1 << 63, 500).astype(np.uint64))
        sig[:4] = base[:4]
        sig[rng.integers(4, 80, 3)] ^= 1
        like.append(sig)
        rows.append((node, 500, hyperminhash.bands_of(sig).tolist()))
    reps = spark.createDataFrame(rows, "node long, n_shingles long, bands array<long>").repartition(4)
    cut, sent = hyperminhash._loosened(85), []
    kept = hyperminhash._dealt
    monkeypatch.setattr(hyperminhash, "_dealt", lambda df, task: sent.append(stage(df, "sent")) or kept(sent[-1], task))
    links = [(r.a, r.b) for r in hyperminhash._loose(reps, cut).collect()]

    def groups(pairs):
        of = list(range(200))
        for _ in range(12):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of

    sig = np.stack(like)
    want = [(i, int(j)) for i in range(200) for j in np.flatnonzero(hyperminhash.estimate((sig == sig[i]).sum(1), 500, 500) >= cut) if j > i and ((sig[i].reshape(20, 4) == sig[j].reshape(20, 4)).all(1)).any()]
    assert groups(links) == groups(want) and set(links) <= {*want, *[(b, a) for a, b in want]}
    monkeypatch.setattr(hyperminhash, "GROUP_BLOCK", 32)
    copies = reps.where("node % 4 <> 0")  # one hot band of near copies: each goes out once, and hubs
    sent.clear()
    of = groups([(r.a, r.b) for r in hyperminhash._loose(copies, cut).collect()])
    assert len({of[i] for i in range(200) if i % 4}) == 1
    assert sum(df.where(f"pos = 0 and key = {rows[0][2][0]}").count() for df in sent) <= 3 * 150
