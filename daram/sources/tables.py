"""Relational tables over JDBC and schemas of the tables, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The schemas of the tables.
SCHEMAS = {
    "uw_code_mapping": "map_id bigint, src_file string, code string, product_name string, main_code string, period_label string, period_value int, pay_term string, entry_age_m string, entry_age_f string, product_group string, type_label string, period_kind string, class_tag string, load_channel string, loaded_at timestamp_ntz",
    "learned_pattern": "pattern_id bigint, insu_cd string, field_name string, pattern_value string, confidence_score int, apply_count int, success_count int, learned_from_log_id bigint, learning_source string, created_at timestamp_ntz, updated_at timestamp_ntz, is_active boolean, priority int",
    "parse_result": "parse_id bigint, insu_cd string, file_name string, terms struct<insuTerm:string,payTerm:string,ageRange:string,renew:string,specialNotes:string>, codes map<string,string>, success boolean, method string, error string, parsed_at timestamp_ntz",
    "hybrid_result": "rec_id bigint, insu_cd string, file_name string, payload string, parsed_at timestamp_ntz",
}


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, fetch: int = 1000, **options) -> DataFrame:
    """A table over JDBC, read in ranges of a numeric column by several tasks where bounds are given; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch).options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def empty_as_null(df: DataFrame) -> DataFrame:
    """Empty texts as null, as the source system knows no empty text. Only top-level strings."""
    return df.select(*(F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes))
