"""The pipeline on planted documents, stage by stage, and registered queries at the smallest scale."""

import random
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkeval.llm.queries import ORACLE_SQL, QUERIES


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklm", k=r.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean, toxic, copied, near-copied and repeating documents, some with personal data."""
    root, r, docs, labels = tmp_path_factory.mktemp("sf"), random.Random(1), {}, []
    for i in range(300):
        docs[i] = " ".join(words(i, 60))
    toxic = set(range(0, 300, 7))
    for i in toxic:
        docs[i] += " you fool! insult"
    for i in range(300):
        if i < 280:
            labels.append((i, int(i in toxic)))
    docs[400], docs[401] = docs[1], docs[1] + " more"  # copy and near copy
    passage = " ".join(words(9999, 60))
    docs[2], docs[402] = docs[2] + " " + passage, " ".join(words(5000, 40)) + " " + passage + " " + " ".join(words(5001, 30))
    docs[3] += " write to a.b@c.de"
    rows = [(i, t, "en", "src0", len(t)) for i, t in docs.items()] + [(500, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), docs, toxic, passage


def test_stages(spark, planted, tmp_path):
    root, docs, toxic, passage = planted
    frame = spark.read.parquet(f"{root}/documents.parquet")
    columns, kept = frame.columns, {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, frame, root).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert frame.columns == columns
            kept[name] = {x.doc_id: x for x in frame.collect()}
            assert all(x.n_chars == len(x.text) for x in kept[name].values() if x.text is not None)
    assert set(kept["toxicity"]) == {*docs, 500} - toxic
    assert set(kept["near_dedup"]) == set(kept["toxicity"]) - {400, 401}
    assert passage in kept["substring_dedup"][2].text and passage not in kept["substring_dedup"][402].text
    assert len(kept["substring_dedup"][402].text.split()) < 100
    assert all(x.text == docs[i] for i, x in kept["substring_dedup"].items() if i not in (402, 500))
    assert kept["pii"][3].text.endswith(" write to [EMAIL]") and kept["pii"][500].text is None
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {x.doc_id: x for x in frame.collect()}  # none is longer than a sequence
    assert set(pieces) == set(kept["pii"])
    for i, x in pieces.items():
        ids = t.encode(kept["pii"][i].text or "", add_special_tokens=False).ids + [2]
        assert x.length == len(ids) and x.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    run = {(x.doc_id, x.piece, x.ids_crc32) for x in corpus_pipeline.run(spark, root).collect()}
    assert run == {(x.doc_id, x.piece, x.ids_crc32) for x in pieces.values()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "conversations", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_packing_keeps_few_words_and_one_tokenizer(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparkeval.llm import packing, tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i * 37 + k}" for k in range(60)) + ("<|endoftext|> x" if i % 9 == 0 else "") for i in range(200)] + ["", " a", "b\n\nc "]
    few, library = tokens.Encoder(path, "leads", True, 100), Tokenizer.from_file(path)
    assert sum(isinstance(v, Tokenizer) for v in vars(few).values()) == 1
    for _ in range(2):  # special strings leave no setting behind
        for at in range(0, len(texts), 7):
            some = texts[at : at + 7]
            assert [x.tolist() for x in few.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
            assert len(few.known) + len(few.older) <= 2 * (100 + 7 * 70 * 2)
    plain = tokens.Encoder(path, "leads", False)
    assert plain.encode(["a<|endoftext|>b"])[0].tolist() == few.tokenizer.encode("a<|endoftext|>b", add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = (sorted(map(tuple, packing.pack(docs, path, 2, remembered=n).drop("sequence_id", "offset").collect())) for n in (5, tokens.REMEMBERED))
    assert one == two and corpus_pipeline.WORDS < tokens.REMEMBERED
