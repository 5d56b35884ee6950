"""A journal of answers by key, so that no answer is paid for twice.

Each task writes the answers of its own keys as they come, one small Parquet file at a time, which
appears whole or not at all, and reads its own folder when it starts: a task that is run again asks
only what it had not been told.  A task that ends leaves one file.  The next run finds all keys with
Spark, whatever they were dealt by.  Files are written by the workers themselves, to any store that
pyarrow opens by its path.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StringType, StructField, StructType

from ..sources.staging import staged

ANSWER = "responses"


@dataclass(frozen=True)
class Journal:
    """Answers below ``path``; ``key`` is the column that tells prompts apart, not null."""

    path: str
    key: str

    def read(self, spark: SparkSession, kind: DataType) -> DataFrame | None:
        """key and responses of all answers so far, each key once, as a table of its own; None if there
        is no journal."""
        schema = StructType([StructField(self.key, kind), StructField(ANSWER, StringType())])
        try:
            rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return staged(rows.dropDuplicates([self.key]), "answers")

    def task(self, part: int, parts: int) -> TaskJournal:
        return TaskJournal(self.path, f"{parts}-{part}", self.key)


class TaskJournal:
    """The answers of one partition, for its task; threads may write at the same time."""

    def __init__(self, path: str, name: str, key: str):
        self.key = key
        self.files, root = pa.fs.FileSystem.from_uri(path)
        self.folder = f"{root}/{name}"
        self.files.create_dir(self.folder)
        self.known: dict = {}
        self.written: list[str] = []
        self.lock = threading.Lock()
        for f in self.files.get_file_info(pa.fs.FileSelector(self.folder)):
            if f.path.endswith(".parquet"):
                self.known.update(zip(*pq.read_table(f.path, filesystem=self.files).to_pydict().values(), strict=True))
                self.written.append(f.path)

    def _write(self, keys: list, answers: list) -> str:
        name = uuid.uuid4().hex
        hidden, shown = f"{self.folder}/_{name}", f"{self.folder}/{name}.parquet"  # readers skip the first
        pq.write_table(pa.table({self.key: pa.array(keys), ANSWER: pa.array(answers, pa.string())}), hidden, filesystem=self.files, compression="zstd")
        self.files.move(hidden, shown)
        return shown

    def put(self, keys: list, answers: list) -> None:
        shown = self._write(keys, answers)
        with self.lock:
            self.written.append(shown)
            self.known.update(zip(keys, answers, strict=True))

    def close(self) -> None:
        """One file for all; the small ones go after it is there, so that a death between loses nothing."""
        if len(self.written) > 1:
            self._write(list(self.known), list(self.known.values()))
            for path in self.written:
                self.files.delete_file(path)
