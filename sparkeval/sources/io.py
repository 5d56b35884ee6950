"""Sources and sinks: Parquet splits, tab-separated pairs, and CSV that other tools read alike."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import column, without_leading_number

#: Spellings that mean a missing value in delimited text.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CSV = {"header": True, "escape": '"', "quote": '"', "multiLine": True, "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_OUT = {k: v for k, v in CSV.items() if k != "multiLine"}
#: The reader's default escape of an escape is the sign 0, which it would drop from quoted text.
CSV["charToEscapeQuoteEscaping"] = '"'
#: The codec's fastest level: the next ones take three times the CPU seconds for a sixth less.
PACKED = {"zlib.compress.level": "BEST_SPEED"}


def read_splits(spark: SparkSession, path: str, *splits: str) -> list[DataFrame]:
    """Parquet splits below ``path``; a missing one raises."""
    return [spark.read.parquet(f"{path}/{s}") for s in splits]


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """One Parquet table whose splits are partitions; those that ``df`` has are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_split(spark: SparkSession, path: str, schema: str, *splits: str, column: str = "split") -> DataFrame:
    """The rows of ``splits`` of a table whose splits are partitions; the schema is declared, so no
    file is opened for it, and a scan lists and reads these partitions alone.  A missing one raises."""
    df = spark.read.schema(f"{schema}, {column} string").parquet(path)
    for s in splits:
        if df.where(F.col(column) == s).limit(1).isEmpty():
            raise ValueError(f"no split {s!r} below {path}")
    return df.where(F.col(column).isin(*splits))


def read_pairs(spark: SparkSession, path: str, source: str, target: str, to: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Two columns of a Parquet split, renamed."""
    return spark.read.parquet(path).select(F.col(source).alias(to[0]), F.col(target).alias(to[1]))


def _spells_missing(c: Column, mark: str) -> Column:
    """Whether ``c`` is a missing-value spelling behind as many marks as ``mark``, a part of a pattern, takes."""
    return F.rlike(c, F.lit(rf"\A{mark}({'|'.join(re.escape(m) for m in MISSING)})\z"))


def kept(c: Column | str) -> Column:
    """A text that :func:`read_tsv` with ``kept`` gives back as it is: one that spells a missing value, or
    is empty, goes behind a backslash, and so does one that looks so already."""
    c = column(c)
    return F.when(_spells_missing(c, r"\\*"), F.concat(F.lit("\\"), c)).otherwise(c)


def read_tsv(spark: SparkSession, path: str, schema: str, kept: bool = False) -> DataFrame:
    """Tab-separated text with a header; missing-value spellings become null.  With ``kept``, those that
    :func:`kept` has marked are texts."""
    df = spark.read.options(**{**CSV, "sep": "\t"}).schema(schema).csv(path)

    def value(c: Column) -> Column:
        text = F.when(~c.isin(MISSING), c)
        return F.when(_spells_missing(c, r"\\+"), F.substr(c, F.lit(2))).otherwise(text) if kept else text

    return df.select(*[value(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_numbered_pairs(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """A Parquet split of pairs whose texts may begin with a number, which goes."""
    df = spark.read.parquet(path)
    return df.withColumns({c: without_leading_number(c) for c in (source, target)})


def flat(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON."""
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header; structs and arrays as JSON."""
    flat(df).write.mode("overwrite").options(**CSV_OUT, sep=sep).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(**CSV).schema(schema).csv(path)


def write_text(text: str, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


RUN = ("task", "model", "query_type")


def write_runs(df: DataFrame, path: str, form: str = "parquet", compression: str | None = None) -> None:
    """A table of runs, partitioned by task, model and query type; the runs in ``df`` replace theirs, and
    all others stay.  ``form`` is parquet or csv, ``compression`` one that Spark knows for it."""
    out = (flat(df) if form == "csv" else df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN)
    packed = {"compression": compression, **PACKED} if compression else {}
    out.options(**CSV_OUT if form == "csv" else {}, **packed).format(form).save(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The table of runs; filters on task, model and query type prune it."""
    kept = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")  # a model may be named 7
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", kept)


def run_path(root: str, task: str, model: str, query_type: str) -> str:
    """``root/task/model/query_type``; a hub prefix of the model goes."""
    return f"{root}/{task}/{model.rsplit('/', 1)[-1]}/{query_type}"
