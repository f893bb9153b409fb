"""Score, case and log files: JSON lines by arm, tab-separated cases, whole texts, log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import between_markers

CASE_SCORES = "id STRING, kind STRING, values ARRAY<DOUBLE>"
SPAN_SCORES = "case_id STRING, p INT, h INT, m INT, n_batch INT, n_ubatch INT, seconds DOUBLE, nll ARRAY<DOUBLE>"


def unique(df: DataFrame, key: str) -> DataFrame:
    """df as it is; reading it fails where a key occurs twice."""
    failed = F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast(df.schema[key].dataType)
    # guarded by the count itself: the optimiser may move a filter behind what it guards
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") > 1, failed).alias(key))
    return df.join(twice, key, "left_anti")


def score_rows(spark: SparkSession, paths: str | list[str], schema: str = CASE_SCORES, key: str | None = None) -> DataFrame:
    """JSON lines of a fixed schema; with a key, repeated ids are refused."""
    rows = spark.read.schema(schema).json(paths)
    return unique(rows, key) if key else rows


def arms(spark: SparkSession, glob: str, schema: str, baseline: str) -> DataFrame:
    """Score files of all arms but the baseline, with the arm that the file's name gives."""
    rows = spark.read.schema(schema).json(glob).withColumn("arm", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.jsonl$", 1))
    return rows.where(F.col("arm") != baseline)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (id, kind, token ids, argument) without header; ids become an array."""
    raw = spark.read.schema("id STRING, kind STRING, ids STRING, arg STRING").csv(path, sep="\t", quote="")
    return raw.withColumn("ids", F.transform(F.filter(F.split(F.coalesce("ids", F.lit("")), " "), lambda x: x != ""), lambda x: x.cast("int")))


def write_cases(df: DataFrame, path: str) -> None:
    df.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).select("id", "kind", "ids", "arg").write.csv(path, sep="\t", quote="", emptyValue="")


def books(spark: SparkSession, path: str, start: str = r"\*\*\* START OF", end: str = r"\*\*\* END OF") -> DataFrame:
    """(path, text) of whole text files between two marker lines."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", between_markers(F.col("value"), start, end).alias("text"))


def log_values(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Numbers that a pattern's groups find in the lines of logs, by file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.col("value").rlike(pattern))
    return rows.select("file", *[F.regexp_extract("value", pattern, i + 1).cast("double").alias(n) for i, n in enumerate(names)])
