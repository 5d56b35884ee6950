"""Splits, sampling, prompts, generation, sources and whole runs."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkeval.functions.metrics import bleu_of_long, rouge_n_of_long, with_bleu, with_rouge_n
from sparkeval.functions.ngrams import batched_matches
from sparkeval.functions.text import space_tokens
from sparkeval.operators import fewshot, prompts
from sparkeval.operators.generate import Retry, api, failing, pipeline, replay, retrying_api, seq2seq
from sparkeval.operators.ordinals import split, with_ordinal, without
from sparkeval.operators.summary import render, summarise
from sparkeval.plans.tasks import TASKS, run_task
from sparkeval.sources.io import read_csv, read_tsv, run_path, write_csv
from sparkeval.streaming.scores import windowed_bleu


def test_ordinals_and_split_do_not_depend_on_partitions(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100 - 20).alias("k"))
    for n in (1, 4, 16):
        got = {r.k: r.instance_idx for r in with_ordinal(df.repartition(n), "k").collect()}
        assert got == {k: i for i, k in enumerate(range(-20, 80))}
    test, pool = split(df, 30, "k")
    assert (test.agg(F.min("k")).first()[0], test.count(), pool.count()) == (50, 30, 70)
    assert [x.count() for x in split(df, 1000, "k")] == [100, 0] and [x.count() for x in split(df, 0, "k")] == [0, 100]
    assert without(df, df.where("k > 0"), "k").count() == 21


def test_few_shot_examples_are_distinct_and_repeatable(spark):
    test = spark.range(40).withColumnRenamed("id", "instance_idx")
    for size in (0, 1, 2, 3, 4, 50):
        pool = spark.range(size).select(F.col("id").alias("k"), F.lit("x").alias("a"))
        one, two = (sorted(map(tuple, fewshot.sample(test, pool.repartition(n), ["k"]).select("instance_idx", "slot", "k").collect())) for n in (1, 5))
        assert one == two and len({(i, k) for i, _, k in one}) == len(one) == 40 * min(3, size)
    for k in (1, 2, 5):
        drawn = fewshot.sample(test, spark.range(4).toDF("k"), ["k"], k=k).collect()
        assert len({(r.instance_idx, r.k) for r in drawn}) == len(drawn) == 40 * min(k, 4)
    many = spark.range(3000).withColumnRenamed("id", "instance_idx")
    sets = {frozenset(r.s) for r in fewshot.sample(many, spark.range(6).toDF("k"), ["k"]).groupBy("instance_idx").agg(F.collect_list("k").alias("s")).collect()}
    assert len(sets) == 20  # every three of six
    blanks = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(10)], "k long, a string")
    assert fewshot.filter_then_sample(test, blanks, ["k"], ["a"]).count() == 120
    assert fewshot.sample_then_filter(test, blanks, ["k"], ["a"]).count() < 120


def test_exact_draws_are_the_standard_librarys(spark):
    test = spark.range(12).withColumnRenamed("id", "instance_idx")
    pool = spark.createDataFrame([(f"k{i:02}", "x" if i % 4 == 0 else " ") for i in range(40)] + [(None, "x")], "k string, a string").repartition(3)
    keys = [None, *[f"k{i:02}" for i in range(40)]]
    usable = {None, *[f"k{i:02}" for i in range(0, 40, 4)]}
    got = {(r.instance_idx, r.slot): r.k for r in fewshot.sample(test, pool, ["k"], 42, exact=True).collect()}
    assert got == {(i, s): keys[p] for i in range(12) for s, p in enumerate(random.Random(42 + i).sample(range(41), 3))}
    kept = fewshot.sample_then_filter(test, pool, ["k"], ["a"], 42, exact=True)
    assert sorted((r.instance_idx, r.slot) for r in kept.collect()) == sorted(x for x, k in got.items() if k in usable)
    want = {}
    for i in range(12):
        order = list(range(41))
        random.Random(42 + i).shuffle(order)
        want |= {(i, s): keys[p] for s, p in enumerate([p for p in order if keys[p] in usable][:3])}
    assert {(r.instance_idx, r.slot): r.k for r in fewshot.shuffled_then_filled(test, pool, ["k"], ["a"], 42).collect()} == want
    assert fewshot.shuffled_then_filled(test, pool.where("a = ' '"), ["k"], ["a"]).count() == 0 == fewshot.shuffled_then_filled(test, pool.limit(0), ["k"], ["a"]).count()
    picked = test.select("instance_idx", fewshot.exact_pick(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("instance_idx")).alias("p"), fewshot.exact_pick(F.array().cast("array<string>"), F.col("instance_idx")).alias("none")).collect()
    assert all(r.p == random.Random(r.instance_idx).choice("abc") and r.none is None for r in picked)


def test_ordinals_of_any_key(spark):
    rows = [(None, 2), ("b", 1), ("a", 3), ("a", 1), ("ä", 0), (None, 1)] + [("c", i) for i in range(300)]
    got = with_ordinal(spark.createDataFrame(rows, "s string, n int").repartition(4), "s", "n").orderBy("instance_idx").collect()
    assert [(r.s, r.n) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])) and [r.instance_idx for r in got] == list(range(len(rows)))
    assert with_ordinal(spark.createDataFrame([], "s string"), "s").count() == 0


def test_long_texts_score_as_short_ones_do(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices("abcd", k=r.randint(0, 40))), " ".join(r.choices("abcd", k=r.randint(0, 40)))) for i in range(60)] + [(100, None, "a"), (101, "a b", None), (102, "", ""), (103, "a b c d e", "a b c d e")]
    df = spark.createDataFrame(rows, "k long, r string, p string")
    for short, long in ((with_bleu(df, "r", "p"), bleu_of_long(df, ["k"], "r", "p")), (with_rouge_n(df, "r", "p"), rouge_n_of_long(df, ["k"], "r", "p"))):
        names = [c for c in long.columns if c != "k"]
        one, two = ({x.k: [x[c] for c in names] for x in d.collect()} for d in (short, long))
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
    brute = {k: sum((Counter((t or "").split()) & Counter((p or "").split())).values()) for k, t, p in rows}
    m = {x.k: x.m[0] for x in df.select("k", batched_matches((1,))(space_tokens("r"), space_tokens("p")).alias("m")).collect()}
    assert m == brute


def test_a_dead_run_goes_on_where_it_stopped(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def make(dies: bool):
        def model(prompts):
            for p in prompts:
                n = int(p[-1]["content"].rsplit("w", 1)[1])
                (asked / f"{n}-{dies}").touch()
                if dies and n >= 30:
                    raise RuntimeError("gone")
            return ["Translation: x"] * len(prompts)

        return lambda: model

    table = spark.createDataFrame([(i, f"w{i}", "x") for i in range(40)], "k long, english string, sinhala string")
    with pytest.raises(Exception, match="gone"):
        run_task(TASKS["en_si"], "zero-shot", table, None, "k", make(True), "m", str(tmp_path / "out"), parts=4, journal=False)
    summary = run_task(TASKS["en_si"], "zero-shot", table, None, "k", make(False), "m", str(tmp_path / "out"), parts=4, journal=False)
    assert {r.n for r in summary.collect()} == {40}
    again = {int(p.name.split("-")[0]) for p in asked.iterdir() if p.name.endswith("False")}
    assert again == set(range(30, 40))  # ranges that were committed are not asked again
    head = next((tmp_path / "out/en_si/m/zero-shot/predictions_csv").glob("part*.csv")).read_text(encoding="utf-8").splitlines()[0]
    assert head.startswith("k,english,sinhala")


def test_prompts(spark):
    with pytest.raises(ValueError):
        prompts.template("headline", "other")
    df = spark.createDataFrame([("t" * 501, [("in", "out"), ("i2", "o2")])], "s string, e array<struct<input:string,output:string>>")
    t = prompts.template("en_si", "few-shot")
    text = df.select(prompts.prompt("en_si", "few-shot", "s", "e")).first()[0]
    assert "\nExample 1:\nE: in\nTranslation: out\n\nExample 2:\n" in text and text.endswith(f"\n\n{t.closing}\nE: " + "t" * 501)
    assert [m["role"] for m in df.select(prompts.chat(F.col("s"), "sys")).first()[0]] == ["system", "user"]
    assert len(prompts.TEMPLATES) == 12


def test_generators():
    naps = []
    assert retrying_api(failing(2, lambda p: p + "!"), Retry(3, naps.append))(["a"]) == ["a!"] and naps == [1.0, 2.0]
    assert retrying_api(failing(3, lambda p: p), Retry(3, naps.append))(["a"]) == [""]
    assert api(lambda p, **_: [p, "x"])(["a"]) == ["a x"]
    assert pipeline(lambda ps, max_new_tokens: [f" {p} " for p in ps])(["a"]) == ["a"]
    assert seq2seq(str, lambda x, n: x[:n], lambda x: x)(["abc"]) == ["abc"] and seq2seq(str, lambda x, n: 1 / 0, str)(["abc"]) == [""]


def test_replay_and_summary(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    got = {r.k: r.responses for r in replay(df, spark.createDataFrame([(1, "r")], "k int, responses string"), "k").collect()}
    assert got == {1: "r", 2: ""}
    s = summarise(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "m double"), ["m"])
    r = s.first()
    assert (r.n, r["mean"], r["median"], round(r["std"], 2)) == (4, 4.0, 2.5, 3.54) and "4.0000" in render(s)
    rng = random.Random(4)
    rows = [(g, rng.choice([None, rng.randint(0, 9) / 2])) for g in ("a", "b", None) for _ in range(rng.randint(20, 41))] + [("none", None)]
    got = {r.g: r for r in summarise(spark.createDataFrame(rows, "g string, m double").repartition(5), ["m"], "g").collect()}
    for g in ("a", "b", None):
        v = [x for h, x in rows if h == g and x is not None]
        assert (got[g].n, got[g]["median"], got[g]["min"], got[g]["max"]) == (len(v), statistics.median(v), min(v), max(v)) and got[g]["std"] == pytest.approx(statistics.pstdev(v))
    assert got["none"].n == 0 and got["none"]["median"] is None
    assert summarise(spark.createDataFrame([], "m double"), ["m"]).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('Tamil\tSinhala\nx "y"\tNA\n"a\tb"\tz\n', encoding="utf-8")
    assert [tuple(r) for r in read_tsv(spark, str(tmp_path / "a.tsv"), "Tamil string, Sinhala string").collect()] == [('x "y"', None), ("a\tb", "z")]
    rows = [(1, 'q"u\\o\nte, x '), (2, None)]
    write_csv(spark.createDataFrame(rows, "k int, t string").withColumn("s", F.struct("k")), str(tmp_path / "c"))
    assert sorted((r.k, r.t) for r in read_csv(spark, str(tmp_path / "c"), "k int, t string, s string").collect()) == rows
    assert run_path("o", "t", "hub/m", "few-shot") == "o/t/m/few-shot"


@pytest.mark.parametrize("task,query_type", [("simplification", "few-shot"), ("headline", "zero-shot-si"), ("summarisation", "few-shot-si"), ("en_si", "zero-shot"), ("ta_si", "few-shot"), ("pi_si", "zero-shot")])
def test_run_task(spark, tmp_path, task, query_type):
    spec = TASKS[task]
    columns = [spec.source, *spec.references]
    rows = [(i, *[f"w{i} a b c d e {c}" for c in range(len(columns))]) for i in range(230)]
    table = spark.createDataFrame(rows, ["k", *columns])
    pool = None if spec.test_size else table.where("k >= 220")
    test = table if spec.test_size else table.where("k < 220")
    make = lambda: lambda prompts: [f"{spec.marker} w1 a b c d e" for _ in prompts]
    for _ in range(2):  # a rerun asks no model again
        summary = run_task(spec, query_type, test, pool, "k", make, "hub/m", str(tmp_path))
        n = {"simplification": 200, "ta_si": 230, "pi_si": 230}.get(task, 220)
        assert {r.n for r in summary.collect()} == {n} and all(r["max"] > 0 for r in summary.collect())


def test_run_all(spark, tmp_path):
    from sparkeval.operators.generate import seeded
    from sparkeval.plans.tasks import run_all

    tables = {"en_si": (spark.createDataFrame([(i, f"a{i} b c d", f"w{i} x y z") for i in range(8)], ["k", "english", "sinhala"]), spark.createDataFrame([(i, f"a{i}", f"w{i}") for i in range(20, 25)], ["k", "english", "sinhala"]), "k")}
    got = run_all(tables, seeded(lambda: lambda prompts: ["Translation: w1 x y z"] * len(prompts)), "m", str(tmp_path), ("zero-shot", "few-shot-si")).collect()
    assert {(r.query_type, r.metric) for r in got} == {(q, m) for q in ("zero-shot", "few-shot-si") for m in ("bleu_1", "bleu_2", "bleu_3", "bleu_4", "bleu_overall")}
    assert all(r["max"] == 100 for r in got)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a b c d", "a b c d"), ("2024-01-01 00:12:00", "a", "b")], "t string, r string, p string")
    rows.select(F.col("t").cast("timestamp").alias("t"), "r", "p").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, r string, p string").parquet(str(tmp_path / "in"))
    q = windowed_bleu(stream, "t", "r", "p").writeStream.outputMode("complete").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.bleu, r.n) for r in spark.table("scores").collect()) == [(0.0, 1), (100.0, 1)]
