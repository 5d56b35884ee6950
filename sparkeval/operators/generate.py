"""Generation as a pluggable, Arrow-batched operator.

A generator is made once for each task on a worker and maps a batch of prompts to as many
responses.  Model clients are injected, so the adapters work with any service or local pipeline.
"""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import column, first_tokens, space_tokens
from ..sources.staging import parts
from .journal import ANSWER, Journal

Generator = Callable[[list], list]


class Pace:
    """At most ``per_second`` calls a second begin, over all threads of a task."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next, self.lock = 1 / per_second, clock, sleep, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


def generate(
    df: DataFrame, make: Callable[[], Generator], prompt: str = "chat", name: str = "responses", partitions: int | None = None, batch: int = 64,
    in_flight: int = 1, per_second: float | None = None, journal: Journal | None = None, by: tuple[str, ...] = (), then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``name``: the response to each row's ``prompt``.  Rows keep all their columns.

    With ``then``, which makes rows with prompts of those of ``df`` one by one, the rows of ``df`` are
    dealt ``by`` columns that tell them apart, and become prompts where they are asked.

    Rows are dealt to ``partitions`` tasks, by default as many as the session shuffles to or has
    cores.  A generator is given ``batch`` prompts at once.  With ``in_flight`` over 1 it is given
    one prompt a call, from so many threads: a task keeps that many calls waiting, over the borders
    of its batches, and gives rows on in their order.  ``per_second`` bounds the calls that a task
    begins.  With a ``journal``, rows are dealt by its key, answers are written as they come, and no
    key that has one is asked again, neither by a task that starts anew nor by a later run.  Of two
    copies of a task that run at the same time, each asks for itself, so keep speculation off.
    """
    n, done, dealt = partitions or parts(df.sparkSession), None, None
    if then is not None:
        df, dealt = then(df), then(df.repartition(n, *by))
    schema = StructType([*df.schema.fields, StructField(name, StringType())])
    before = journal.read(df.sparkSession, df.schema[journal.key].dataType) if journal else None
    if before is not None:
        done = df.join(before.withColumnRenamed(ANSWER, name), journal.key).select(*schema.names)
        df, dealt = df.join(before, journal.key, "left_anti"), None
    if dealt is None:
        dealt = df.repartition(n, *([journal.key] if journal else []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, pace = make(), Pace(per_second) if per_second else None
        book = journal.task(TaskContext.get().partitionId(), n) if journal else None
        some = (b.iloc[at : at + batch].copy() for b in batches for at in range(0, len(b), batch))

        def asked(keys: list, prompts: list) -> list[str]:
            new = [i for i, k in enumerate(keys) if book is None or k not in book.known]
            answers = [None if book is None else book.known.get(k) for k in keys]
            if new:
                if pace:
                    pace.wait()
                for i, answer in zip(new, got := model([prompts[i] for i in new]), strict=True):
                    answers[i] = answer
                if book:
                    book.put([keys[i] for i in new], got)
            return answers

        def calls(rows: pd.DataFrame) -> tuple[list, list]:
            prompts = rows[prompt].tolist()
            return (rows[journal.key].tolist() if journal else prompts), prompts

        if in_flight > 1:
            yield from _in_flight(some, calls, asked, name, in_flight)
        else:
            for rows in some:
                rows[name] = asked(*calls(rows))
                yield rows
        if book:
            book.close()

    out = dealt.mapInPandas(run, schema)
    return out if done is None else out.unionByName(done)


def _in_flight(some: Iterator[pd.DataFrame], calls: Callable, asked: Callable, name: str, n: int) -> Iterator[pd.DataFrame]:
    """Answers one call a row, ``n`` at a time; twice as many are begun before the oldest must be done,
    so that a slow one does not empty the window."""
    waiting: deque = deque()

    def oldest() -> pd.DataFrame:
        rows, answers = waiting.popleft()
        rows[name] = [a.result()[0] for a in answers]
        return rows

    pool = ThreadPoolExecutor(n)
    try:
        begun = 0
        for rows in some:
            answers: list = []
            waiting.append((rows, answers))
            for key, text in zip(*calls(rows), strict=True):
                answers.append(pool.submit(asked, [key], [text]))
                begun += 1
                while begun > 2 * n and len(waiting) > 1:
                    begun -= len(waiting[0][1])
                    yield oldest()
                if begun > 2 * n:  # one batch is larger than the window
                    answers[max(0, len(answers) - 2 * n)].result()
        while waiting:
            yield oldest()
    finally:
        pool.shutdown(cancel_futures=True)


@dataclass(frozen=True)
class Retry:
    """Up to ``attempts`` calls, sleeping 2 ** attempt seconds between; then the empty answer."""

    attempts: int = 3
    sleep: Callable[[float], None] = field(default=time.sleep)

    def call(self, f: Callable[[], str]) -> str:
        for attempt in range(self.attempts):
            try:
                return f()
            except Exception:  # noqa: BLE001  a service may raise anything
                if attempt + 1 < self.attempts:
                    self.sleep(2.0**attempt)
        return ""


def api(client: Callable[..., list[str]], temperature: float = 0.3, **options) -> Generator:
    """One request a row; the response's text parts joined by a space; an error gives ''."""
    return lambda prompts: [Retry(1).call(lambda p=p: " ".join(client(p, temperature=temperature, **options))) for p in prompts]


def retrying_api(client: Callable[..., str], retry: Retry = Retry(), temperature: float = 0.3, max_tokens: int = 500) -> Generator:
    """One request a row with retries."""
    return lambda prompts: [retry.call(lambda p=p: client(p, temperature=temperature, max_tokens=max_tokens)) for p in prompts]


def pipeline(run: Callable[..., list[str]], max_new_tokens: int = 200) -> Generator:
    """A local pipeline that takes the batch as a whole; errors end the job."""
    return lambda prompts: [r.strip() for r in run(prompts, max_new_tokens=max_new_tokens)]


def seq2seq(encode: Callable, model: Callable, decode: Callable, max_new_tokens: int = 200) -> Generator:
    """Encode, generate, decode, row by row; an error gives ''."""
    return lambda prompts: [Retry(1).call(lambda p=p: decode(model(encode(p), max_new_tokens))) for p in prompts]


def seeded(make: Callable[[], Generator], seed: int = 777) -> Callable[[], Generator]:
    """``make`` after seeding the worker's generators of random numbers."""

    def seeded_make() -> Generator:
        random.seed(seed)
        np.random.seed(seed)
        return make()

    return seeded_make


def failing(n: int, answer: Callable[[object], str]) -> Callable[..., str]:
    """A client whose first ``n`` calls for each prompt fail."""
    seen: dict[str, int] = {}

    def client(p, **_) -> str:
        seen[str(p)] = seen.get(str(p), 0) + 1
        if seen[str(p)] <= n:
            raise RuntimeError("not yet")
        return answer(p)

    return client


def replay(df: DataFrame, responses: DataFrame, *keys: str) -> DataFrame:
    """Responses recorded before, by key; '' where there is none."""
    return df.join(responses.select(*keys, "responses"), list(keys), "left").withColumn("responses", F.coalesce("responses", F.lit("")))


def lead(c: Column | str, k: int = 12) -> Column:
    """A deterministic stand-in for a model: the first ``k`` tokens."""
    return first_tokens(c, k)


def drop_every(c: Column | str, k: int = 5, at: int = 3) -> Column:
    """A deterministic stand-in for a model: all tokens but those at ``at`` modulo ``k``."""
    return F.array_join(F.filter(space_tokens(column(c)), lambda _, i: i % k != at), " ")
