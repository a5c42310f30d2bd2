"""Problem 2: the best representative of each duplicate group, field by field.

One aggregation takes for every attribute the greatest struct (non-blank, source priority, time, value); blanks are null structs,
which never count. Rows are written once with their keys, then shuffled once and whole, as groups are small and thirteen structs a row are
wider than the row; the groups that hold at least ``HEAVY_SHARE`` of the rows (1 / HEAVY_SHARE of them at most) are spread over salts and
aggregated twice. For the best rows alone (``best_rows``) few and narrow maxima do, which are combined on the map side. The same aggregation finds the row that no other row of its
group beats or equals: the greatest (fill, time, trust) must reach all three maxima and be held by one row.

Defined results:
* rows without a code, or whose period neither the label nor kind and value tell, form no group;
* an unknown or null channel has trust -1, a null time is earlier than any;
* in ties of an attribute the greatest value counts; exact copies of the best row leave a group without a best row;
* an attribute blank in all rows survives as null; further columns are ignored; an empty table gives no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daram.functions.text import is_blank, spelling
from daram.session import store

# The thirteen fields from src_file to class_tag.
FIELDS = ("src_file", "code", "product_name", "main_code", "period_label", "period_value", "pay_term", "entry_age_m", "entry_age_f", "product_group", "type_label", "period_kind", "class_tag")
WHOLE_LIFE = 999
HEAVY_SHARE = 0.001
SALTS = 64
KEY = ["code_key", "period_key"]


def period_key(label: Column, kind: Column, value: Column) -> Column:
    """Kind and value as one text, told by the label or, where that is blank, by kind and value; null if neither tells."""
    text, mark = spelling(label), F.upper(spelling(kind))
    number = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    read = (
        F.when(text.contains("갱신") & number.isNotNull(), F.concat(F.lit("R"), number.cast("string")))
        .when(text.rlike("종신|평생"), f"E{WHOLE_LIFE}")
        .when(text.rlike(r"\d세"), F.concat(F.lit("S"), number.cast("string")))
        .when(text.rlike(r"\d년"), F.concat(F.lit("N"), number.cast("string")))
        .otherwise(F.concat(F.lit("?"), text))
    )
    given = F.when((mark == "E") | (value == WHOLE_LIFE), f"E{WHOLE_LIFE}").when(~is_blank(kind) & value.isNotNull(), F.concat(mark, value.cast("string")))
    return F.when(~is_blank(label), read).otherwise(given)


def prepare(mapping: DataFrame, trust: DataFrame) -> DataFrame:
    """Rows that belong to a group, with its key, their fill and the trust of their channel. ``trust`` is one row per channel (a fixed list)."""
    ranks = F.broadcast(trust.groupBy("load_channel").agg(F.max("trust_rank").alias("trust_rank")))
    code = F.when(~is_blank(F.col("code")), spelling(F.col("code")))
    return (
        mapping.select("map_id", "load_channel", "loaded_at", *FIELDS).join(ranks, "load_channel", "left")
        .select(
            "map_id", "loaded_at", *FIELDS, F.coalesce("trust_rank", F.lit(-1)).alias("trust"), code.alias("code_key"),
            period_key(F.col("period_label"), F.col("period_kind"), F.col("period_value")).alias("period_key"),
            sum((~is_blank(F.col(c))).cast("int") for c in FIELDS).alias("filled"),
        )
        .filter(F.col("code_key").isNotNull() & (F.col("code_key") != "") & F.col("period_key").isNotNull())
    )


LEAD = ("filled", "loaded_at", "trust")


def _maxima(rows: DataFrame, keys: list[str], fields: tuple[str, ...]) -> DataFrame:
    value = lambda c: F.max(F.when(~is_blank(F.col(c)), F.struct("trust", "loaded_at", F.col(c).alias("value")))).alias(f"s_{c}")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("map_id").alias("group_id"),
        F.max(F.struct(*LEAD, "map_id")).alias("top"), F.max(F.struct(*LEAD, (-F.col("map_id")).alias("neg_id"))).alias("low"),
        F.max("filled").alias("max_filled"), F.max("loaded_at").alias("max_at"), F.max("trust").alias("max_trust"), *(value(c) for c in fields),
    )


def _combined(parts: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Maxima of the salts of a group put together."""
    most = ("top", "low", "max_filled", "max_at", "max_trust", *(f"s_{c}" for c in fields))
    return parts.groupBy(*KEY).agg(F.sum("n_rows").alias("n_rows"), F.min("group_id").alias("group_id"), *(F.max(c).alias(c) for c in most))


def _best() -> Column:
    """The row that reaches all three maxima of its group, if one alone does."""
    best = (
        (F.col("n_rows") > 1) & (F.col("top.filled") == F.col("max_filled")) & F.col("top.loaded_at").eqNullSafe(F.col("max_at"))
        & (F.col("top.trust") == F.col("max_trust")) & (F.col("top.map_id") == -F.col("low.neg_id"))
    )
    return F.when(best, F.col("top.map_id"))


def best_rows(rows: DataFrame) -> DataFrame:
    """(group_id, best_id) of the groups with a best row: the maxima of ``survive`` without those of the fields."""
    return _maxima(rows, KEY, ()).select("group_id", _best().alias("best_id")).filter(F.col("best_id").isNotNull())


def survive(rows: DataFrame, fields: tuple[str, ...] = FIELDS, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row per group: its surviving value of every field, its size, and ``best_id`` (null where no row is best)."""
    rows = store(rows)
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    heavy = store(sizes.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))), F.col("n") >= heavy_share * F.col("total")).select(*KEY, F.lit(True).alias("heavy")))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("map_id"), F.lit(SALTS))).otherwise(0).cast("int")
    spread = rows.join(F.broadcast(heavy), KEY, "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))).withColumn("salt", salt).repartition(*KEY, "salt")
    parts = _maxima(spread, [*KEY, "salt", "heavy"], fields)
    grouped = parts.filter("NOT heavy").drop("salt", "heavy").unionByName(_combined(parts.filter("heavy"), fields)) if heavy.head(1) else parts.drop("salt", "heavy")
    return grouped.select("group_id", "n_rows", *KEY, _best().alias("best_id"), *(F.col(f"s_{c}.value").alias(c) for c in fields))
