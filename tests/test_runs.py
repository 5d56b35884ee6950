"""Splits by keys, selection, long texts, journals, calls in flight, exact picks and run tables."""

import hashlib
import random
import statistics
import subprocess
import sys
import time
from pathlib import Path

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkeval import queries
from sparkeval.functions import metrics
from sparkeval.functions.metrics import lcs_length, with_bleu, with_rouge_l, with_rouge_n, with_sari
from sparkeval.functions.ngrams import matches_of
from sparkeval.operators import fewshot, summary
from sparkeval.operators.generate import Pace, generate
from sparkeval.operators.journal import Journal
from sparkeval.operators.ordinals import split, with_ordinal
from sparkeval.operators.summary import summarise
from sparkeval.plans import tasks
from sparkeval.sources import staging
from sparkeval.sources.io import read_csv, read_runs, read_split, write_runs, write_splits


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_moves_no_rows_and_reaches_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    test, pool = split(docs, 50, "doc_id")
    for side, sign in ((test, "GreaterThanOrEqual(doc_id"), (pool, "LessThan(doc_id")):
        assert "Exchange" not in plan_of(side) and sign in plan_of(side).split("PushedFilters: [")[1]
    rows = [(None, 3), (None, 1), ("a", None), ("a", 2), ("b", 0), ("b", None)]
    df = spark.createDataFrame(rows, "s string, n int").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    for n in range(8):
        test, pool = ([tuple(r) for r in x.collect()] for x in split(df, n, "s", "n"))
        assert set(test) == set(order[max(0, 6 - n) :]) and set(pool) == set(order[: max(0, 6 - n)])
    tied = spark.createDataFrame([(1,), (2,), (2,), (2,), (3,)], "k int")
    assert sorted(r.k for r in split(tied, 2, "k")[0].collect()) == [2, 2, 2, 3]  # the two share no key


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """A shared folder of its own."""
    monkeypatch.setattr(staging, "shared_dir", lambda spark: str(tmp_path))
    return tmp_path


def test_few_shot_writes_keys_alone(spark, sf, shared):
    spark.sparkContext.setJobGroup("few-shot", "")
    got = queries.fewshot_sample3(spark, sf)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-shot"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() and jobs < 20, jobs  # every shuffle is a job
    tables = [p for p in shared.iterdir() if p.is_dir()]
    assert tables and all("content" not in spark.read.parquet(str(p)).columns for p in tables)
    assert sum(f.stat().st_size for f in shared.rglob("*.parquet")) < Path(f"{sf}/documents.parquet").stat().st_size / 4


def test_draws_beside_columns_of_their_names(spark):
    test = spark.range(5).toDF("instance_idx")
    pool = spark.createDataFrame([(i, "x", 9, 8, "k") for i in range(9)], "k long, a string, slot int, position int, __key0 string")
    got = fewshot.sample_then_filter(test, pool, ["k"], ["a"])
    assert got.select("slot", "__key0").count() == 15 and got.columns.count("slot") == 1


@pytest.mark.parametrize("values", [200_000, 3])
def test_medians_by_selection(spark, monkeypatch, values):
    monkeypatch.setattr(summary, "VALUES", values)  # with 3, bounds are narrowed first
    r = random.Random(5)
    rows = [("zeros", 0.0 if r.random() < 0.7 else r.random()) for _ in range(2001)] + [("wide", r.choice([-1, 1]) * 10.0 ** r.randint(-200, 200)) for _ in range(1500)]
    rows += [("even", float(i)) for i in range(40)] + [(None, 1.5), ("nulls", None), ("one", -0.0), ("few", 1.0), ("few", None), ("few", 2.0)] + [("same", 7.25)] * 900
    df = spark.createDataFrame(rows, "g string, m double").repartition(5)
    got = {x.g: x for x in summarise(df, ["m"], "g").collect()}
    assert got.keys() == {g for g, _ in rows}
    for g in got:
        v = [x for h, x in rows if h == g and x is not None]
        assert got[g].n == len(v) and got[g]["median"] == (pytest.approx(statistics.median(v)) if v else None)
        assert not v or (got[g]["min"], got[g]["max"]) == (min(v), max(v))


def test_summaries_sort_no_scores(spark):
    df = spark.range(100_000).select((F.col("id") % 10 > 6).cast("double").alias("m"))  # seven tenths are 0
    dealt = []
    frame = type(df)
    kept, frame.repartitionByRange = frame.repartitionByRange, lambda *a, **k: dealt.append(a)
    try:
        got = summarise(df, ["m"]).first()
    finally:
        frame.repartitionByRange = kept
    assert not dealt and (got.n, got["median"]) == (100_000, 0.0)


def test_bits_and_cells_agree(spark, monkeypatch):
    def cells(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    r = random.Random(6)
    for block in (3, 7, 4096):
        monkeypatch.setattr(metrics, "BLOCK", block)
        for _ in range(400):
            a, b = (r.choices("abcdef"[: r.randint(1, 6)], k=r.randint(0, 25)) for _ in range(2))
            assert lcs_length(a, b) == cells(a, b)
    whole = [r.randrange(3000) for _ in range(30_000)]
    begun = time.perf_counter()
    assert lcs_length(whole, whole[::2]) == 15_000 and time.perf_counter() - begun < 20
    df = spark.createDataFrame([(1, None, "None"), (2, "a b", None), (3, "", "x")], "k int, r string, p string")
    assert [x.rougeL for x in with_rouge_l(df, "r", "p").orderBy("k").collect()] == [1.0, 0.0, 0.0]


def test_long_forms_and_names(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choices("abc", k=r.randint(0, 60))), " ".join(r.choices("abcd", k=r.randint(0, 60)))) for i in range(50)] + [(90, None, "a"), (91, "a b c d e", ""), (92, "a " * 5000, "a " * 4000)]
    df = spark.createDataFrame(rows, "k int, r string, p string").withColumns({c: F.lit(c) for c in ("__r", "__p", "__s1", "__refs", "__matches", "__lcs", "__share1", "__one1")})
    for add in (lambda d, long: with_bleu(d, "r", "p", long), lambda d, long: with_rouge_n(d, "r", "p", (1, 2, 3), long)):
        short, long = (add(df, x) for x in (False, True))
        assert short.columns == long.columns and set(df.columns) < set(short.columns)
        names = [c for c in short.columns if c not in df.columns]
        one, two = ({x.k: [x[c] for c in names] for x in d.collect()} for d in (short, long))
        assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
        assert "Exchange" not in plan_of(long)
    assert set(df.columns) < set(with_sari(with_rouge_l(df, "r", "p"), "r", ["p"], "p").columns)
    assert tasks.has_long(df, F.col("r")) is False and tasks.has_long(df.withColumn("r", F.repeat("r", 3)), F.col("r"))
    import pyarrow as pa

    assert matches_of(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.string())), (1, 2)).shape == (0, 2)


# --- generation -----------------------------------------------------------------------------------


def test_calls_in_flight_keep_order_and_do_not_wait_for_each_other(spark):
    asked = spark.range(64).select("id", F.concat(F.lit("p"), "id").alias("chat"))

    def model():
        import time

        return lambda prompts: [time.sleep(0.1) or f"{p} in {time.time()}" for p in prompts]

    got = generate(asked, model, partitions=1, in_flight=64, batch=10).collect()
    ends = [float(r.responses.split(" in ")[1]) for r in got]
    assert all(r.responses.startswith(f"{r.chat} in ") for r in got) and max(ends) - min(ends) < 0.9  # one after another takes 6.4 s
    assert len({r.id for r in got}) == 64
    for n, batch in ((2, 64), (3, 1), (64, 7)):
        order = generate(asked, lambda: lambda prompts: list(prompts), partitions=1, in_flight=n, batch=batch).collect()
        assert all(r.responses == r.chat for r in order) and len(order) == 64
    with pytest.raises(Exception, match="gone"):
        generate(asked, lambda: lambda prompts: [][0] if prompts != ["p7"] else exec("raise RuntimeError('gone')"), partitions=1, in_flight=1, batch=1).where("id = 7").collect()


def test_pace():
    now, naps = [0.0], []
    pace = Pace(4, lambda: now[0], naps.append)
    for _ in range(3):
        pace.wait()
    now[0] = 10.0
    pace.wait()
    assert naps == [0.25, 0.5]


def test_a_journal_answers_the_next_run(spark, tmp_path):
    asked, told = spark.range(30).select("id", F.concat(F.lit("p"), "id").alias("chat")), tmp_path / "told"
    told.mkdir()

    def make(dies):
        def model(prompts):
            for p in prompts:
                if dies and p == "p20":
                    raise RuntimeError("gone")
                (told / f"{p}-{dies}").touch(exist_ok=False)
            return [f"a{p}" for p in prompts]

        return lambda: model

    book = Journal(str(tmp_path / "journal"), "id")
    for in_flight in (1, 4):
        with pytest.raises(Exception, match="gone"):
            generate(asked, make(True), journal=book, batch=1, partitions=2, in_flight=in_flight).collect()
    got = {r.id: r.responses for r in generate(asked, make(False), journal=book, partitions=3).collect()}
    assert got == {i: f"ap{i}" for i in range(30)}
    names = [p.name.split("-")[0] for p in told.iterdir()]
    assert len(names) == len(set(names)) == 30  # nobody was asked twice
    files = list((tmp_path / "journal").rglob("*.parquet"))
    assert len(files) < 30 and not list((tmp_path / "journal").rglob("_*"))
    assert book.read(spark, asked.schema["id"].dataType).count() == 30


KILLED = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from sparkeval.operators.generate import generate
from sparkeval.operators.journal import Journal
at = sys.argv[1]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", at).getOrCreate()
def make():
    def model(prompts):
        for p in prompts:
            if p == "p11" and not os.path.exists(f"{at}/killed"):
                open(f"{at}/killed", "w").close()
                os._exit(9)
            with open(f"{at}/asked", "a") as f:
                f.write(p + "\\n")
        return ["a" + p for p in prompts]
    return model
asked = spark.range(20).select("id", F.concat(F.lit("p"), "id").alias("chat"))
got = generate(asked, make, journal=Journal(f"{at}/journal", "id"), partitions=1, batch=1).collect()
assert sorted((r.id, r.responses) for r in got) == [(i, f"ap{i}") for i in range(20)]
"""


def test_a_killed_task_asks_nothing_twice(tmp_path):
    done = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], cwd=Path(__file__).parent.parent, env={**__import__("os").environ, "PYTHONPATH": str(Path(__file__).parent.parent)}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    asked = (tmp_path / "asked").read_text().split()
    assert (tmp_path / "killed").exists() and sorted(asked) == sorted(f"p{i}" for i in range(20))


# --- exact picks ----------------------------------------------------------------------------------


@pytest.mark.parametrize("fill", [False, True])
def test_picks_go_on_where_the_draw_stopped(spark, fill):
    r = random.Random(8)
    pool = [(i, *[r.choice([None, "", " ", f"{c}{i}"]) for c in "abc"]) for i in range(37)]
    df = spark.createDataFrame(pool, "k long, a string, b string, c string").repartition(3)
    test = spark.range(25).toDF("instance_idx")
    got = {(x.instance_idx, x.slot): (x.k, x.reference) for x in fewshot.sampled_and_picked(test, df, ["k"], ["a", "b", "c"], 42, fill=fill).collect()}
    want = {}
    for i in range(25):
        random.seed(42 + i)
        order = list(range(37))
        if fill:
            random.shuffle(order)
        else:
            order = random.sample(order, 3)
        n = 0
        for s, p in enumerate(order):
            refs = [x for x in pool[p][1:] if x and x.strip()]
            if refs and n < 3:
                want[i, n if fill else s] = (p, random.choice(refs))
                n += 1
    assert got == want


def test_exact_pick_queries(spark, sf):
    rows = sorted((x.doc_id, x.headline or "", x.pred or "") for x in queries.news(spark, sf).collect())
    n = min(queries.TEST, len(rows) // 4)
    pool = [(k, [x for x in (h if k % 3 else " ", h if k % 6 else None, p if k % 4 else "") if x and x.strip()]) for k, h, p in rows[: len(rows) - n]]
    for name, fill in (("fewshot_exact_pick3", False), ("fewshot_exact_fill_pick3", True)):
        want = set()
        for i in range(n):
            r, order = random.Random(queries.SEED + i), list(range(len(pool)))
            if fill:
                r.shuffle(order)
            else:
                order = r.sample(order, min(3, len(pool)))
            good = [(s, p) for s, p in enumerate(order) if pool[p][1]][:3]
            want |= {(i, m if fill else s, pool[p][0], r.choice(pool[p][1])) for m, (s, p) in enumerate(good)}
        got = {(x.instance_idx, x.slot, x.doc_id, x.reference) for x in queries.QUERIES[name](spark, sf).collect()}
        import hashlib

        assert got == {(i, s, k, hashlib.md5(t.encode()).hexdigest()) for i, s, k, t in want}


# --- tables of runs, splits -----------------------------------------------------------------------


def test_splits_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    write_splits(spark.range(10).select("id", F.when(F.col("id") < 7, "train").otherwise("test").alias("split")), path)
    got = read_split(spark, path, "id long", "test")
    assert sorted(r.id for r in got.collect()) == [7, 8, 9] and "PartitionFilters: [" in plan_of(got) and "split" in plan_of(got).split("PartitionFilters: [")[1].split("]")[0]
    assert read_split(spark, path, "id long", "train", "test").count() == 10
    write_splits(spark.range(2).select("id", F.lit("test").alias("split")), path)
    assert read_split(spark, path, "id long", "train", "test").count() == 9
    with pytest.raises(ValueError, match="dev"):
        read_split(spark, path, "id long", "dev")


def test_delimited_text_keeps_real_texts(spark, tmp_path):
    texts = ["", "NA", "\\NA", "\\\\null", "\\", "None ", '"\0"', "\0", "a\n\0\t\0", 'q"\0"', "\r\n", "\r", None, "plain"]
    rows = [(i, t, "" if i % 2 else "n/a") for i, t in enumerate(texts)] + [(None, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.Tamil, r.Sinhala) for r in queries.src_tsv(spark, str(tmp_path)).collect()}
    md5 = lambda t: t if t is None else hashlib.md5(t.encode()).hexdigest()
    assert got == {i: (None if i is not None and i % 5 == 0 else md5(t), lang if i is not None and i % 7 else None) for i, t, lang in rows}
    again = {r.doc_id: r.text for r in queries.roundtrip_csv(spark, str(tmp_path)).collect()}
    assert again == {i: md5(t or "") for i, t, _ in rows}


def test_a_rerun_replaces_its_run_alone(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([("t", m, q, float(i)) for i in range(4) for m in ("7", "hub/x") for q in ("a", "b")], "task string, model string, query_type string, m double")
    for form in ("parquet", "csv"):
        write_runs(rows, f"{path}-{form}", form)
        write_runs(rows.where("model = '7' and query_type = 'b' and m > 2"), f"{path}-{form}", form)
    got = read_runs(spark, f"{path}-parquet")
    assert dict(got.dtypes)["model"] == "string"
    assert {tuple(r[:3]): r[3] for r in got.groupBy("task", "model", "query_type").count().collect()} == {("t", "7", "a"): 4, ("t", "7", "b"): 1, ("t", "hub/x", "a"): 4, ("t", "hub/x", "b"): 4}
    assert "PartitionFilters: [isnotnull(model" in plan_of(got.where("model = '7'")) and sum(1 for _ in Path(f"{path}-csv").rglob("*.csv")) >= 4


def test_one_plan_for_all_runs(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def make():
        import uuid

        (made / uuid.uuid4().hex).touch()
        return lambda chats: ["Translation: a b c d\n\nx" if "Translation:" in c[-1]["content"] else "Summary: a b" for c in chats]

    rows = spark.createDataFrame([(i, "x y", "a b c d") for i in range(6)], "k long, s string, t string")
    tables = {"en_si": (rows.toDF("k", "english", "sinhala"), rows.toDF("k", "english", "sinhala").withColumn("k", F.col("k") + 50), "k"), "summarisation": (rows.toDF("k", "text", "summary"), None, "k")}
    out = str(tmp_path / "out")
    got = tasks.run_all(tables, make, "hub/m", out, ("zero-shot", "few-shot"), partitions=2)
    first = {(r.task, r.query_type, r.metric): (r.n, r["max"]) for r in got.collect()}
    assert len(first) == 2 * 5 + 2 * 3 and {n for n, _ in first.values()} == {6} and first["en_si", "few-shot", "bleu_overall"][1] == 100
    assert sum(1 for _ in made.iterdir()) == 2  # a generator for each task, whatever the runs
    refuse = lambda: lambda chats: 1 / 0
    again = tasks.run_all({"en_si": tables["en_si"]}, refuse, "hub/m", out, ("zero-shot",))  # all is in the journal
    assert {(r.task, r.query_type) for r in again.collect()} == {("en_si", "zero-shot")}
    assert tasks.compare(read_runs(spark, f"{out}/scored")).count() == len(first)


def test_runs_write_texts_once(spark, shared, tmp_path):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=90)), " ".join(r.choices(words, k=90))) for i in range(600)]
    table = spark.createDataFrame(rows, "k long, english string, sinhala string").repartition(2)
    pool = spark.createDataFrame([(900 + i, "in", "out") for i in range(9)], "k long, english string, sinhala string")
    make = lambda: lambda chats: [f"Translation: {c[-1]['content'].rsplit('E: ', 1)[1]}" for c in chats]
    out = str(tmp_path / "out")
    got = tasks.run_all({"en_si": (table, pool, "k")}, make, "m", out)
    assert {(x.query_type, x.n) for x in got.collect()} == {(q, 600) for q in tasks.prompts.QUERY_TYPES}
    size = lambda top: sum(f.stat().st_size for f in Path(top).rglob("*") if f.is_file())
    given = sum(len(a) + len(b) for _, a, b in rows)
    assert size(shared) < 14 * given, size(shared) / given  # two texts in four runs: source, references, prompts, answers twice
    assert size(f"{out}/scored") + size(f"{out}/scored_csv") < given / 2
    whole = tasks.scored_rows(spark, out)
    assert {"source", "refs", "chat", "responses", "preds", "bleu_overall"} < set(whole.columns) and whole.count() == 2400
    texts = {i: (a, [b], a) for i, a, b in rows}
    assert all((x.source, x.refs, x.preds) == texts[int(x.id.rsplit("/", 1)[1])] for x in whole.select("id", "source", "refs", "preds").collect())
    packed = [pd.read_csv(f, keep_default_na=False) for f in Path(f"{out}/predictions_csv").rglob("*.csv.gz")]
    assert sorted(x for f in packed for x in f["preds"]) == sorted(4 * [a for _, a, _ in rows])
    again = read_csv(spark, f"{out}/predictions_csv", "id string, instance_idx long, source string, refs string, chat string, responses string, preds string, task string, model string, query_type string")
    assert again.select("id", "source", "preds").exceptAll(whole.select("id", "source", "preds")).count() == 0 and again.count() == 2400


def test_rows_are_dealt_before_they_become_prompts(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("k"))
    twice = lambda df: df.select("k", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("q")).withColumn("chat", F.concat("q", "k"))
    got = generate(rows, lambda: lambda prompts: [p.upper() for p in prompts], partitions=3, by=("k",), then=twice)
    assert plan_of(got).index("explode") < plan_of(got).index("Exchange") and got.rdd.getNumPartitions() == 3
    assert {(x.k, x.q, x.responses) for x in got.collect()} == {(str(i), q, f"{q}{i}".upper()) for i in range(50) for q in "ab"}


def test_rouge_finds_tokens_once(spark):
    df = spark.createDataFrame([("a b c d", "a c d e"), (None, "none"), ("", ""), ("x", None)], "r string, p string")
    for long in (False, True):
        both = with_rouge_l(with_rouge_n(df, "r", "p", long=long), "r", "p")
        got = metrics.with_rouge(df, "r", "p", long=long)
        assert got.columns == both.columns and got.collect() == both.collect()
    assert plan_of(got).count("regexp_extract_all") < plan_of(both).count("regexp_extract_all")


def test_run_logs(spark, tmp_path, caplog):
    rows = spark.createDataFrame([(i, "x", "a b c d") for i in range(5)], "k long, english string, sinhala string")
    with caplog.at_level("INFO", logger="sparkeval.plans.tasks"):
        tasks.run_task(tasks.TASKS["en_si"], "few-shot", rows, rows.withColumn("k", F.col("k") + 9), "k", lambda: lambda p: [""] * len(p), "m", str(tmp_path), exact=True)
    assert "5 rows in all" in caplog.text and "5 without an answer" in caplog.text and "bleu_overall" in caplog.text


def test_ordinals_split_equal_keys(spark, shared):
    df = spark.range(20_000).select(F.lit("same").alias("k"), "id").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    rows = with_ordinal(df, "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows.agg(F.min("instance_idx"), F.max("instance_idx"), F.countDistinct("instance_idx")).first()[:3] == (0, 19_999, 20_000)
    sizes = [pq.read_metadata(f).num_rows for f in shared.rglob("*.parquet")]
    assert sum(sizes) == 20_000 and len(sizes) > 4 and max(sizes) < 6000


# --- costs that grow with the texts ----------------------------------------------------------------


def test_sari_of_long_texts_goes_in_batches(spark, monkeypatch):
    def f1(target, made):
        return 2 * len(target & made) / (len(target) + len(made)) if target & made else 0.0

    def score(s, y, refs):
        if not refs:
            return 0.0
        total = 0.0
        for n in (1, 2, 3, 4):
            S, Y, *R = ({tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in (s, y, *refs))
            R = set().union(*R)
            total += f1(S & R, S & Y) + f1(S - R, S - Y) + f1(R - S, Y - S)
        return 100 * total / 12

    r = random.Random(9)
    texts = [[[r.choices("abcdefg", k=r.choice([0, 1, 3, 9, 40])) for _ in range(2)], [r.choices("abcdefg", k=r.choice([0, 1, 9, 40])) for _ in range(r.randint(0, 3))]] for _ in range(80)]
    texts.append([[[f"w{i % 7000}" for i in range(30_000)], [f"w{i % 5000}" for i in range(30_000)]], [[f"w{i}" for i in range(9000)]]])
    rows = [(i, *map(" ".join, own), *[*map(" ".join, refs), None, None, None][:3]) for i, (own, refs) in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, s string, y string, r0 string, r1 string, r2 string").repartition(3)
    got = with_sari(df, "s", ["r0", "r1", "r2"], "y")
    assert "array_intersect" not in plan_of(got) and "array_except" not in plan_of(got)
    assert {x.i: x.sari for x in got.collect()} == {i: score(*own, [x for x in refs if x]) for i, (own, refs) in enumerate(texts)}
    from sparkeval.functions import ngrams

    import pyarrow as pa

    monkeypatch.setattr(ngrams, "TOKENS", 20)  # slices of few rows score alike
    columns = [pa.array([own[0] for own, _ in texts[:80]]), pa.array([own[1] for own, _ in texts[:80]]), pa.array([[x for x in refs if x] for _, refs in texts[:80]], pa.list_(pa.list_(pa.string())))]
    assert ngrams.in_slices(metrics.sari_of, *columns).tolist() == [score(*own, [x for x in refs if x]) for own, refs in texts[:80]]


def test_summaries_compute_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(i):
        seen.add(1)
        return float(i % 7)

    got = summarise(spark.range(1000).select(costly("id").alias("m"), (F.col("id") % 2).alias("g")), ["m"], "g")
    assert {x.g: x.n for x in got.collect()} == {0: 500, 1: 500} and seen.value == 1000


def test_blank_and_first_tokens_leave_the_rest_alone(spark):
    from sparkeval.functions import text

    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    rows = [(None, True), ("", True), (spaces, True), ("​", False), (f"{spaces}.", False), (f"x{spaces}", False), *[(c, True) for c in spaces]]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = df.select("i", text.is_blank("t").alias("b"))
    assert [x.b for x in got.orderBy("i").collect()] == [b for _, b in rows] and "regexp_replace" not in plan_of(df.where(text.is_blank("t")))
    texts = [None, "", " ", "a", " a", "a ", "a b c", " a b c ", "a\n\nb　c d e", " a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for n in (1, 2, 3, 12):
        got = df.select("i", text.first_tokens("t", n).alias("x"))
        assert [x.x for x in got.orderBy("i").collect()] == [" ".join((t or "").split()[:n]) for t in texts]
        assert f", {n + 2})" in plan_of(got)


def test_exact_picks_read_texts_once_and_shuffle_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(i):
        seen.add(1)
        return f"t{i}"

    pool = spark.range(400).select(F.col("id").alias("k"), costly("id").alias("a"))
    for fill in (False, True):
        before = seen.value
        got = fewshot.sampled_and_picked(spark.range(5).toDF("instance_idx"), pool, ["k"], ["a"], 42, fill=fill).collect()
        assert len(got) == 15 and seen.value - before <= 2 * 400  # to number the pool, and to fetch what is drawn
    import pandas as pd

    r, order = random.Random(42 + 3), list(range(1000))
    (table,) = fewshot._shuffled(1000, 42, 4)(iter([pd.DataFrame({"instance_idx": [3]})]))
    r.shuffle(order)
    assert table["position"].tolist() == [*order[:4], -1]
    begun = time.perf_counter()  # a state says where to go on, whatever was shuffled
    got = fewshot._choices(42).func(pd.Series([3]), pd.Series([10**12]), pd.Series([[5, 0, 7, 2]]), table["state"].tail(1).reset_index(drop=True))
    assert got[0] == [r.choice(range(5)), -1, r.choice(range(7)), r.choice(range(2))] and time.perf_counter() - begun < 5
