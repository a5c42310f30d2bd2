"""Relational operators with parameters for tables, keys and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order. Spark limits each task's rows per key before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def pick_per_key(df: DataFrame, keys: list[str], by: list[Column], columns: list[str], largest: bool = True) -> DataFrame:
    """Columns of the row with the largest (or smallest) ``by``; one aggregation with map-side combine, so hot keys don't matter."""
    pick = (F.max_by if largest else F.min_by)(F.struct(*columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)]))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def mode_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Commonest value per key, the smallest of equally common ones, and its count; nulls don't vote."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max("n").alias("n_votes"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def three_way_vote(a: Column, b: Column, c: Column, least: int = 5) -> Column:
    """Value two of three agree on; else the second if it is longer than ``least``, the third if it is, or the first."""
    good = lambda x: x.isNotNull() & (F.length(x) > least)
    return F.when(a == b, a).when(a == c, a).when(b == c, b).when(good(b), b).when(good(c), c).otherwise(a)


def cascade(df: DataFrame, keys: list[str], confidence: str, priority: str, name: str, enough: int, columns: list[str]) -> DataFrame:
    """First candidate by priority whose confidence is enough, else the most confident one; ties by priority, then name."""
    ok = F.col(confidence) >= enough
    order = [F.when(ok, 0).otherwise(1), F.when(ok, F.col(priority)).otherwise(-F.col(confidence)), F.col(priority), F.col(name)]
    return pick_per_key(df, keys, order, columns, largest=False)


def keep_flagged_or_all(df: DataFrame, keys: list[str], flag: Column, salts: int = 16) -> DataFrame:
    """Flagged rows of each key, or all its rows where none is flagged. What is known of a key is one row, which meets the key's rows under several salts, so that a hot key is several tasks' work."""
    flagged = df.groupBy(*keys).agg(F.max(flag.cast("int")).alias("_any")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l._salt") == F.col("r._salt")]
    joined = salted.alias("l").join(flagged.alias("r"), reduce(lambda a, b: a & b, same))
    return joined.filter(F.coalesce(flag, F.lit(False)) | (F.coalesce("_any", F.lit(0)) == 0)).select(*(f"l.{c}" for c in df.columns))


def availability(base: DataFrame, key: str, sides: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Y/N flags whether a key occurs in each side, and the names of those that lack it in the given order."""
    out = base
    for name, (side, side_key) in sides.items():
        known = side.select(F.col(side_key).alias(f"_{name}")).distinct()
        out = out.join(known, out[key] == known[f"_{name}"], "left")
    flag = lambda n: F.when(F.col(f"_{n}").isNotNull(), "Y").otherwise("N").alias(f"has_{n}")
    lacking = F.array_join(F.filter(F.array(*(F.when(F.col(f"_{n}").isNull(), n) for n in sides)), lambda x: x.isNotNull()), ",")
    return out.select(*base.columns, *(flag(n) for n in sides), lacking.alias("lacking"))


def page(df: DataFrame, order: list[Column], number: int, size: int, **equal) -> DataFrame:
    """Page ``number`` from 0; a filter whose value is None or '' does not apply."""
    for column, value in equal.items():
        if value not in (None, ""):
            df = df.filter(F.col(column) == value)
    return df.orderBy(*order).offset(number * size).limit(size)


def coverage(df: DataFrame, keys: list[str], filled: dict[str, Column]) -> DataFrame:
    """Rows and filled rows per field, with the share in percent to one decimal."""
    n = F.count(F.lit(1))
    counts = [F.count(F.when(c, 1)).alias(f"n_{k}") for k, c in filled.items()]
    shares = [F.round(F.count(F.when(c, 1)) * 100.0 / n, 1).alias(f"pct_{k}") for k, c in filled.items()]
    return df.groupBy(*keys).agg(n.alias("n_rows"), *counts, *shares)


def better_text(a: Column, b: Column, marks: tuple[str, ...] = ()) -> Column:
    """The second text if the first is missing, it is longer, or it alone bears a mark; else the first."""
    marked = reduce(lambda x, y: x | y, [b.contains(m) & ~a.contains(m) for m in marks], F.lit(False))
    return F.when(a.isNull(), b).when(b.isNull(), a).when((F.length(b) > F.length(a)) | marked, b).otherwise(a)


def insert_missing(table: DataFrame, incoming: DataFrame, key: str, id_column: str) -> DataFrame:
    """Rows to append: keys not yet in the table, once each, with ids that go on after the greatest.

    Numbers come from each task's count and the counts of the tasks before, so no task sees all rows.
    """
    new = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(c).alias(c) for c in incoming.columns if c != key)).join(table.select(key).distinct(), key, "left_anti")
    bucketed = new.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(1024)))
    before = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    start = table.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_start"))
    numbered = bucketed.join(F.broadcast(before), "_b").withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    first = start.withColumn("_one", F.lit(1))
    return numbered.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one").select((F.col("_start") + F.col("_before") + F.col("_i")).alias(id_column), *incoming.columns)
