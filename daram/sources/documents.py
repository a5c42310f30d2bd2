"""Sources and sinks: files of text, mapping exports as CSV, overrides and results as JSON."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daram.functions.terms import code_of_file

# The header of a mapping export.
CSV_HEADER = "CODE,PRODUCT_NAME,PRODUCT_GROUP,TYPE_LABEL,MAIN_CODE,PERIOD_LABEL,PERIOD_VALUE,PERIOD_KIND,PAY_TERM,ENTRY_AGE_M,ENTRY_AGE_F,CLASS_TAG,SRC_FILE"
CSV_SCHEMA = ", ".join(f"{c.lower()} {'int' if c == 'PERIOD_VALUE' else 'string'}" for c in CSV_HEADER.split(","))


def list_files(spark: SparkSession, folder: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """(name, path, length, modified) of the files, by name; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", "modified").orderBy("name")


def _decoded(content: Column, encoding: str) -> Column:
    """Spark's own decoder for the charsets it takes, else Arrow batches; bytes that don't fit become replacement characters."""
    if encoding.lower() in ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-32"):
        return F.decode(content, encoding)

    @F.pandas_udf("string")
    def decoded(part: pd.Series) -> pd.Series:
        return part.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return decoded(content)


def read_texts(spark: SparkSession, folder: str, glob: str = "*.txt", encoding: str = "UTF-8") -> DataFrame:
    """(name, code, text) of whole text files; other encodings than Spark takes are decoded from the bytes. Spark leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    text = F.translate(F.regexp_replace(_decoded(F.col("content"), encoding), r"\r\n?", "\n"), "\u00a0", " ")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), code_of_file(F.regexp_replace(name, r"\.[^.]*$", "")).alias("code"), text.alias("text"))


def pages(texts: DataFrame, mark: str = "\f") -> DataFrame:
    """One row per page from 1."""
    return texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(F.split("text", mark)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def longer_text(plain: str, scanned: str, factor: float = 1.5):
    """The scanned text where it is clearly longer than the plain one."""
    return F.when(F.length(scanned) > F.length(plain) * factor, F.col(scanned)).otherwise(F.col(plain))


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """Mapping exports with quoting by RFC 4180; empty texts are null. A line that doesn't fit the columns keeps what does and stands whole in ``malformed``, which is null for the others."""
    return spark.read.schema(f"{CSV_SCHEMA}, malformed string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").option("quote", '"').option("escape", '"').csv(path)


def write_mapping_csv(df: DataFrame, path: str) -> None:
    df.select(*[F.col(c.lower()).alias(c) for c in CSV_HEADER.split(",")]).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """JSON object of code to fields, as one row per code; absent fields are null."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<insuTerm:string,payTerm:string,ageRange:string,renew:string,specialNotes:string>>")).alias("code", "o"))
    return raw.select("code", "o.*")


def write_results(df: DataFrame, path: str, code: str = "insu_cd") -> None:
    """Results as JSON lines, a folder per code."""
    df.write.mode("overwrite").partitionBy(code).json(path)


def write_statistics(rows: DataFrame, folder: str) -> None:
    """Statistics, as many rows as there are groups, as CSV with a header and as JSON lines, in subfolders of their own."""
    one = rows.coalesce(1)
    one.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    one.write.mode("overwrite").json(f"{folder}/json")
