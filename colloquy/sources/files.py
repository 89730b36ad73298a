"""Readers and writers of line files: JSON lines strict and lenient, transcripts, delimited text, CSV and listings.

All readers are splittable scans but the ones that number lines, which read each file as a whole and say so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.speech import parse_transcript

BAD = "_bad_line"


def read_json_strict(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of JSON objects, one a line; blank lines are skipped and the first bad line fails the read."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_path, source_line, value): all lines with their 1-based numbers, blank ones counted. A file is one row
    until it is split: for files that fit a task."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")
    lines = F.split(F.regexp_replace("value", r"\r\n", "\n"), "\n", -1)
    split = whole.select("source_path", F.posexplode(lines).alias("_at", "value"), F.size(lines).alias("_n"))
    last_empty = (F.col("_at") + 1 == F.col("_n")) & (F.col("value") == "")
    return split.filter(~last_empty).select("source_path", (F.col("_at") + 1).cast("long").alias("source_line"), "value")


def read_json_lenient(spark: SparkSession, path: str | list[str], schema: T.StructType | str, *, numbered: bool = False) -> DataFrame:
    """Rows of the lines that are JSON objects of the schema; others are dropped. ``numbered`` adds source_path and
    source_line."""
    if not numbered:
        return spark.read.json(path, schema=schema, mode="DROPMALFORMED")
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*kind.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.withColumn("_o", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    good = parsed.filter(F.ltrim("value").startswith("{") & F.col(f"_o.{BAD}").isNull() & F.col("_o").isNotNull())
    return good.select("source_path", "source_line", *[F.col(f"_o.`{f.name}`") for f in kind.fields])


def read_json_counted(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts of kept and dropped lines)."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*kind.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("o"))
    fine = F.col("o").isNotNull() & F.col(f"o.{BAD}").isNull()
    counts = parsed.agg(F.count_if(fine).alias("kept"), F.count_if(~fine).alias("dropped"))
    return parsed.filter(fine).select(*[F.col(f"o.`{f.name}`") for f in kind.fields]), counts


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8, characters as they are."""
    df.write.mode(mode).json(path)


def read_transcript(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(utt, speaker, language, text, error) of lines with four fields."""
    return parse_transcript(spark.read.text(path))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = "|") -> DataFrame:
    """(fields): each line split at a separator, without quoting."""
    return spark.read.text(path).select(F.split("value", f"\\Q{sep}\\E", -1).alias("fields"))


def write_transcript(df: DataFrame, path: str, *fields: Column, sep: str = "|", mode: str = "errorifexists") -> None:
    df.select(F.concat_ws(sep, *fields).alias("value")).write.mode(mode).text(path)


def read_csv_required(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """A CSV with a header that has all columns of the schema, in any order; a missing one is an error."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.csv(path, header=True, inferSchema=False)
    if missing := [f.name for f in kind.fields if f.name not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind.fields])


def read_positional(spark: SparkSession, path: str | list[str], names: Sequence[str]) -> DataFrame:
    """A CSV without header or quotes, columns by position."""
    return spark.read.csv(path, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), header=False, quote="")


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """(path, stem, length) of files below a folder with one of the suffixes, in any case; contents are not read."""
    pattern = r"(?i)\.(" + "|".join(s.lstrip(".") for s in suffixes) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.filter(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), "length")


def pair_by_stem(texts: DataFrame, media: DataFrame) -> DataFrame:
    """Texts (stem, text) with their media (stem, path); a text without media, or an empty one, fails the job."""
    joined = texts.join(media.select("stem", "path"), "stem", "left")
    problem = F.when(F.col("path").isNull(), F.concat(F.lit("no media for "), F.col("stem"))).when(F.coalesce(F.trim("text"), F.lit("")) == "", F.concat(F.lit("empty text for "), F.col("stem")))
    return joined.withColumn("text", F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("text")))


def count_lines(spark: SparkSession, path: str | list[str]) -> int:
    """Lines that are not blank: where an interrupted writer goes on."""
    return spark.read.text(path).filter(F.trim("value") != "").count()


def not_done(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not among those already written."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def after_cursor(rows: DataFrame, order: str, n_done: int, group: str | None = None) -> DataFrame:
    """Rows behind the first n of each group (or of all) in an order."""
    frame = (W.partitionBy(group) if group else W.partitionBy(F.lit(0))).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(frame)).filter(F.col("_n") > n_done).drop("_n")


def read_vectors(spark: SparkSession, path: str | list[str], *, pattern: str = "*.npy") -> DataFrame:
    """(path, vec) of NumPy array files, flattened; decoded in Arrow batches."""
    import pandas as pd

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def decode(content: pd.Series) -> pd.Series:
        import io

        import numpy as np

        return content.map(lambda b: np.load(io.BytesIO(bytes(b)), allow_pickle=False).astype("float64").ravel().tolist())

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", decode("content").alias("vec"))
