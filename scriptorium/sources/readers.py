"""Readers: text corpora, reviews, separated files, cached lines and vectors, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as tx

SCHEMAS = {
    "canon": "file_name string, m3 double",
    "libraries": "file_name string, sum_libraries int, pub_year int, binary int, author_viaf string",
    "metadata": "id int, file_name string, pub_year int, author_viaf string",
    "review_scores": "sentiscore_average double, sentiment_Textblob double, textfile string, journal string, text_id int, file_name string",
    "review_classes": "sentiscore_average double, sentiment_Textblob double, textfile string, journal string, text_id int, file_name string, classified string, sentiment double",
    "testset": "textfile string, class int",
    "predictions": "fold int, row_id bigint, y_true double, y_pred double",
    "cv_results": "fold int, features string, combo_id string, model string, params string, split int, metric double, pvalue double",
}


def stem(path):
    """A file's name without folder and last suffix."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def texts(spark: SparkSession, folder: str, limit: int | None = None, strip: bool = True) -> DataFrame:
    """(file_name, text) of the ``*.txt`` files of a folder; with ``limit`` the first by name."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(stem(F.col("_metadata.file_path")).alias("file_name"), (tx.stripped(F.col("value")) if strip else F.col("value")).alias("text"))
    return df if limit is None else df.orderBy("file_name").limit(limit)


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """(textfile, text_id, pub_year, journal, text) of review files named ``NNNNN_YYYY_journal_rest.txt``."""
    df = texts(spark, folder).withColumnRenamed("file_name", "textfile")
    i, y, j = tx.review_key(F.col("textfile"))
    return df.select("textfile", i.alias("text_id"), y.alias("pub_year"), j.alias("journal"), "text")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files with a record per line, stripped; numbers from 0 within a file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "line")).withColumn("line", tx.stripped(F.col("line")))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Cached embeddings."""
    return spark.read.parquet(path)


def token_lists(spark: SparkSession, path: str) -> DataFrame:
    """(key, tokens) of cached reviews, tokens being an array of sentences' words: a JSON object per line."""
    return spark.read.schema("key string, tokens array<array<string>>").json(path)


def conll(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, words, tags, chunks) of files with a line per word, ``word tag chunk``, and blank lines between sentences. A file
    is read as one row; such training files are small."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("s"))
    rows = whole.withColumn("l", F.filter(F.transform(F.split("s", "\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda x: F.size(x) >= 3)).where(F.size("l") > 0)
    part = lambda i: F.transform("l", lambda x: x[i])
    return rows.select(F.xxhash64("file", "s").alias("sent_id"), part(0).alias("words"), part(1).alias("tags"), part(2).alias("chunks"))


def separated(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ";", null: str = "") -> DataFrame:
    """A separated file with header and a schema, or the name of one of SCHEMAS."""
    return spark.read.schema(SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema).csv(path, sep=sep, header=True, nullValue=null, nanValue="NaN")


def features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table in a comma-separated file: file_name first, all else doubles, NaN read as null."""
    names = spark.read.csv(path, header=True, enforceSchema=False).columns
    df = spark.read.schema(T.StructType([T.StructField(n, T.StringType() if n == "file_name" else T.DoubleType()) for n in names])).csv(path, header=True)
    return df.select(*(F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast("double")).alias(f.name) if f.dataType == T.DoubleType() else F.col(f"`{f.name}`") for f in df.schema))


def model(path: str):
    """A saved pipeline."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
