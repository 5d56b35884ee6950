"""The six evaluation tasks, and one driver for all of them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import with_bleu, with_rouge, with_sari
from ..functions.text import extract, is_blank, usable
from ..operators import fewshot, prompts
from ..operators.generate import Generator, generate
from ..operators.journal import Journal
from ..operators.ordinals import head, present, split, with_few_ordinals, with_ordinal, without
from ..operators.summary import render, summarise
from ..sources.io import RUN, read_runs, run_path, write_csv, write_runs, write_text
from ..sources.staging import staged, unused

log = logging.getLogger(__name__)

EXAMPLES = "array<struct<input:string,output:string>>"
METRICS = {"bleu": [*[f"bleu_{n}" for n in (1, 2, 3, 4)], "bleu_overall"], "rouge": ["rouge1", "rouge2", "rougeL"], "sari": ["sari"]}


@dataclass(frozen=True)
class TaskSpec:
    name: str
    source: str
    references: tuple[str, ...]
    metric: str
    marker: str
    mode: str = "paragraph"
    test_size: int | None = None  # of the end of one table; None: the test table is given
    head: int | None = None  # of the test table's start
    not_null: bool = False
    fill: bool = False  # draw examples from usable rows only


TASKS = {
    t.name: t
    for t in (
        TaskSpec("simplification", "Complex", ("Simplification 1", "Simplification 2", "Simplification 3"), "sari", "Simplified text:", test_size=200, fill=True),
        TaskSpec("headline", "News Content", ("Headline",), "rouge", "Headline:", "to_end", head=1000, not_null=True),
        TaskSpec("summarisation", "text", ("summary",), "rouge", "Summary:", "to_end"),
        TaskSpec("en_si", "english", ("sinhala",), "bleu", "Translation:"),
        TaskSpec("ta_si", "Tamil", ("Sinhala",), "bleu", "Translation:", test_size=1000),
        TaskSpec("pi_si", "pali_text", ("sinhala_text",), "bleu", "Translation:", test_size=1000),
    )
}


def test_and_pool(spec: TaskSpec, key: str, table: DataFrame, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Test rows with ``instance_idx``, and the pool; the two share no key.  Neither is written."""
    if spec.test_size is not None:
        test, pool = split(table, spec.test_size, key)
        return with_few_ordinals(test, spec.test_size, key), pool
    if spec.not_null:
        table, pool = (present(t, spec.source, *spec.references) if t is not None else None for t in (table, pool))
    test = with_ordinal(table, key) if spec.head is None else with_few_ordinals(head(table, spec.head, key), spec.head, key)
    return test, test.limit(0).drop("instance_idx") if pool is None else without(pool, test, key)


def examples_of(spec: TaskSpec, test: DataFrame, pool: DataFrame, key: str, base_seed: int = 42, exact: bool = False) -> DataFrame:
    """instance_idx and examples of each test row that has some; ``exact`` draws and picks as the
    standard library's generator does, and else by hashes."""
    source, refs, many = F.col(f"`{spec.source}`"), [F.col(f"`{r}`") for r in spec.references], len(spec.references) > 1
    if exact and many:
        drawn = fewshot.sampled_and_picked(test, pool.select(key, source.alias("__in"), *refs), [key], list(spec.references), base_seed, fill=spec.fill, name="__out")
    else:
        out = fewshot.pick(usable(*refs), F.col(key)) if many else F.get(usable(*refs), F.lit(0))
        draw = fewshot.filter_then_sample if spec.fill else fewshot.sample_then_filter
        if exact:
            draw = fewshot.shuffled_then_filled if spec.fill else partial(fewshot.sample_then_filter, exact=True)
        drawn = draw(test, pool.select(key, source.alias("__in"), out.alias("__out")), [key], ["__in", "__out"], base_seed)
    return fewshot.gathered(drawn, "__in", "__out")


def with_prompts(spec: TaskSpec, query_type: str, test: DataFrame, pool: DataFrame, key: str, base_seed: int = 42, system: bool = False, exact: bool = False, shots: DataFrame | None = None) -> DataFrame:
    """Add ``chat``, with examples for the few-shot types: ``shots``, or else those of :func:`examples_of`."""
    t = prompts.template(spec.name, query_type)
    examples = None
    if query_type.startswith("few"):
        shots = examples_of(spec, test, pool, key, base_seed, exact) if shots is None else shots
        test = test.join(shots, "instance_idx", "left").withColumn("examples", F.coalesce("examples", F.array().cast(EXAMPLES)))
        examples = "examples"
    content = prompts.prompt(spec.name, query_type, F.col(f"`{spec.source}`"), examples)
    return test.withColumn("chat", prompts.chat(content, t.system if system else None)).drop("examples")


#: Bytes of an answer or reference from which array expressions are no choice.
LONG_BYTES = 20_000


def has_long(df: DataFrame, *columns: Column) -> bool:
    """Whether a text of ``df``, a written table, is long."""
    most = df.agg(F.max(F.array_max(F.array(*[F.octet_length(c) for c in columns])))).first()[0]
    return (most or 0) > LONG_BYTES


def _scored(metric: str, df: DataFrame, source: Column, references: list[Column], long: bool | None) -> DataFrame:
    """Add a metric's scores of ``preds``.  Grams are counted in Arrow batches, which is faster for short
    texts too, unless ``long`` is False: then by array expressions, without Python."""
    own = unused(df, "source", *[f"ref{i}" for i in range(len(references))])
    df = df.withColumns(dict(zip(own, [source, *references], strict=True)))
    first, long = own[1], long is not False
    if metric == "bleu":
        df = with_bleu(df, first, "preds", long)
    elif metric == "rouge":
        df = with_rouge(df, first, "preds", long=long)
    else:
        df = with_sari(df, own[0], own[1:], "preds")
    return df.drop(*own)


def with_scores(spec: TaskSpec, df: DataFrame, long: bool | None = None) -> DataFrame:
    """Add the task's scores of ``preds``; ``long`` is as in :func:`_scored`."""
    refs = [F.col(f"`{r}`") for r in spec.references if r in df.columns]
    return _scored(spec.metric, df, F.col(f"`{spec.source}`"), refs, long)


def run_task(
    spec: TaskSpec, query_type: str, table: DataFrame, pool: DataFrame | None, key: str, make: Callable[[], Generator], model: str, out: str, base_seed: int = 42, system: bool = False,
    exact: bool = False, parts: int = 1, journal: bool = True, **calls,
) -> DataFrame:
    """Prompt, generate, extract, score, write and summarise one run; returns the summary.

    Predictions are written before scoring, and again as CSV: generation is costly and may differ
    between calls.  A ``journal`` by key holds every answer as it comes, so that nothing asks a model
    twice: neither a task that starts anew nor a rerun, which asks only for rows that have no answer.
    Without one (for stores that workers cannot write to) test rows can be asked in ``parts`` ranges
    of their ordinals, each committed before the next begins.  ``calls`` are those of :func:`generate`.
    """
    spark, path = table.sparkSession, run_path(out, spec.name, model, query_type)
    test, pool = test_and_pool(spec, key, table, pool)
    asked = with_prompts(spec, query_type, test, pool, key, base_seed, system, exact)
    done = f"{path}/predictions"
    try:
        before = spark.read.parquet(done)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = None
    if before is not None:
        asked = without(asked, before, key)
    asked = staged(asked, "asked")
    least, most, n = asked.agg(F.min("instance_idx"), F.max("instance_idx"), F.count("*")).first()
    book = Journal(f"{path}/journal", key) if journal else None
    for part in range(parts if n else 1):  # without rows one part, so that there is a table
        low, high = ((least or 0) + (part + i) * ((most or 0) - (least or 0) + 1) // parts for i in (0, 1))
        rows = asked.where((F.col("instance_idx") >= low) & (F.col("instance_idx") < high))
        got = generate(rows, make, journal=book, **calls)
        got.withColumn("preds", extract("responses", spec.marker, spec.mode)).write.mode("append").parquet(done)
        log.info("%s: part %d of %d generated, %d rows in all", path, part + 1, parts, n)
    predictions = spark.read.parquet(done)
    write_csv(predictions, f"{path}/predictions_csv")
    scored = with_scores(spec, predictions)
    scored.write.mode("overwrite").parquet(f"{path}/scored")
    scored = spark.read.parquet(f"{path}/scored")
    write_csv(scored, f"{path}/scored_csv")
    summary = summarise(scored.withColumns({"task": F.lit(spec.name), "model": F.lit(model), "query_type": F.lit(query_type)}), METRICS[spec.metric], *RUN)
    report = render(summary)
    write_text(report, spark, f"{path}/summary")
    log.info("%s: %d without an answer\n%s", path, blank_answers(scored).count(), report)
    return summary


Tables = dict[str, tuple[DataFrame, DataFrame | None, str]]


def matrix_rows(tables: Tables, few: bool = True, base_seed: int = 42, exact: bool = False) -> DataFrame:
    """The test rows of every task in ``tables`` (table, pool, key), each once whatever the runs: task,
    key, instance_idx, source, refs and, for the ``few``-shot types, examples."""
    rows = []
    for name, (table, pool, key) in tables.items():
        spec, examples = TASKS[name], F.lit(None).cast(EXAMPLES)
        test, rest = test_and_pool(spec, key, table, pool)
        if few:  # the same in either language
            test = test.join(examples_of(spec, test, rest, key, base_seed, exact).withColumnRenamed("examples", "__examples"), "instance_idx", "left")
            examples = F.col("__examples")
        refs = F.array(*[F.col(f"`{r}`") for r in spec.references])
        mine = {"task": F.lit(name), "key": F.col(key).cast("string"), "instance_idx": F.col("instance_idx").cast("long"), "source": F.col(f"`{spec.source}`"), "refs": refs, "examples": examples}
        rows.append(test.select(*[c.alias(n) for n, c in mine.items()]))
    return reduce(DataFrame.union, rows)


def prompted(rows: DataFrame, names: Iterable[str], model: str, query_types: tuple[str, ...] = prompts.QUERY_TYPES, system: bool = False) -> DataFrame:
    """A row for each of the :func:`matrix_rows` of tasks ``names`` and query type: task, model,
    query_type, id (unique), instance_idx, source, refs and chat."""
    examples, chat = F.coalesce("examples", F.array().cast(EXAMPLES)), F
    for name in names:
        for q in query_types:
            content = prompts.prompt(name, q, F.col("source"), examples)
            chat = chat.when((F.col("task") == name) & (F.col("query_type") == q), prompts.chat(content, prompts.template(name, q).system if system else None))
    rows = rows.select("*", F.lit(model).alias("model"), F.explode(F.array(*[F.lit(q) for q in query_types])).alias("query_type"))
    return rows.select(*RUN, F.concat_ws("/", *RUN, "key").alias("id"), "instance_idx", "source", "refs", chat.alias("chat"))


def matrix_prompts(tables: Tables, model: str, query_types: tuple[str, ...] = prompts.QUERY_TYPES, base_seed: int = 42, system: bool = False, exact: bool = False) -> DataFrame:
    """The prompts of every task in ``tables`` (table, pool, key) with every query type, in one table,
    as :func:`prompted` gives them."""
    return prompted(matrix_rows(tables, _few(query_types), base_seed, exact), tables, model, query_types, system)


def _few(query_types: tuple[str, ...]) -> bool:
    return any(q.startswith("few") for q in query_types)


def run_all(tables: Tables, make: Callable[[], Generator], model: str, out: str, query_types: tuple[str, ...] = prompts.QUERY_TYPES, base_seed: int = 42, system: bool = False, exact: bool = False, journal: bool = True, **calls) -> DataFrame:
    """Every task in ``tables`` (table, pool, key) with every query type, as one plan; their summaries.

    All prompts are one table, so each worker makes one generator for all runs, and no run waits for
    another.  Test rows are dealt to the workers once, and become prompts there.  Answers go to the
    journal, predictions and scores to tables of runs (``predictions``, ``scored``, and as packed CSV),
    where the runs asked for replace theirs and others stay.  Texts are in ``predictions`` alone, and
    :func:`scored_rows` has them beside their scores.  Each metric's runs are scored together.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    rows, to_prompts = matrix_rows(tables, _few(query_types), base_seed, exact), partial(prompted, names=list(tables), model=model, query_types=query_types, system=system)
    got = generate(rows, make, journal=Journal(f"{out}/journal", "id") if journal else None, by=("task", "key"), then=to_prompts, **calls)
    answer = reduce(lambda c, t: c.when(F.col("task") == t, extract("responses", TASKS[t].marker, TASKS[t].mode)), tables, F)
    write_runs(got.withColumn("preds", answer), f"{out}/predictions", compression="zstd")
    wanted = (F.col("model") == model) & F.col("task").isin(*tables) & F.col("query_type").isin(*query_types)
    predictions = read_runs(spark, f"{out}/predictions").where(wanted)
    write_runs(predictions, f"{out}/predictions_csv", "csv", compression="gzip")
    scored = []
    for metric in sorted({TASKS[t].metric for t in tables}):
        rows = predictions.where(F.col("task").isin(*[t for t in tables if TASKS[t].metric == metric]))
        refs = [F.get("refs", F.lit(i)) for i in range(max(len(TASKS[t].references) for t in tables if TASKS[t].metric == metric))]
        scored.append(_scored(metric, rows, F.col("source"), refs, None).select("id", "instance_idx", *METRICS[metric], *RUN))
    write_runs(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scored), f"{out}/scored", compression="zstd")
    rows = read_runs(spark, f"{out}/scored").where(wanted)
    write_runs(rows, f"{out}/scored_csv", "csv", compression="gzip")
    summary = compare(rows)
    report = render(summary)
    write_text(report, spark, f"{out}/summary")
    log.info("%s: %d without an answer\n%s", out, blank_answers(predictions).count(), report)
    return summary


def scored_rows(spark: SparkSession, out: str) -> DataFrame:
    """The predictions below ``out``, with all their columns, and their scores."""
    return read_runs(spark, f"{out}/predictions").join(read_runs(spark, f"{out}/scored"), [*RUN, "id", "instance_idx"])


def compare(runs: DataFrame) -> DataFrame:
    """The summary of each run in a table of scored runs, by task, model and query type: every metric
    that the run has scores of."""
    metrics = [m for group in METRICS.values() for m in group if m in runs.columns]
    of = {t.name: METRICS[t.metric] for t in TASKS.values()}
    own = [F.when(F.col("task").isin(*[t for t, ms in of.items() if m in ms]), F.col(m)).alias(m) for m in metrics]
    return summarise(runs.select(*RUN, *own), metrics, *RUN).where("n > 0")


def blank_answers(df: DataFrame) -> DataFrame:
    """Rows whose generation failed or gave nothing."""
    return df.where(is_blank("preds"))
