"""State without a lakehouse: merges and folds that give the next version of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_CONFIDENCE, STEP, FULL = 80, 10, 100


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column], insert: dict[str, Column]) -> DataFrame:
    """MERGE as a full outer join; expressions name the sides ``t`` and ``s``. ``source`` needs one row per key (``one_per_key``).

    Columns without an update keep their value; columns without an insert are null in new rows.
    """
    t, s = target.alias("t").withColumn("_in_t", F.lit(True)), source.alias("s").withColumn("_in_s", F.lit(True))
    t, s = t.alias("t"), s.alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = t.join(s, on[0] if len(on) == 1 else on[0] & _all(on[1:]), "full_outer")
    out = []
    for c in target.columns:
        kept = F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")) if c in keys else F.col(f"t.{c}")
        changed = update.get(c, kept)
        added = insert.get(c, F.col(f"s.{c}") if c in keys else F.lit(None))
        out.append(F.when(F.col("t._in_t").isNull(), added).when(F.col("s._in_s").isNull(), kept).otherwise(changed).cast(target.schema[c].dataType).alias(c))
    return joined.select(*out)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def one_per_key(source: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Latest row per key, so that a merge never meets a key twice."""
    rest = [c for c in source.columns if c not in keys]
    return source.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def fold_patterns(corrections: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """Replay of corrections in order, in closed form: the last value, a confidence that grows to its cap, and how often it was applied again."""
    n = F.count(F.lit(1))
    return corrections.groupBy(*keys).agg(
        F.max_by(value, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("pattern_value"),
        F.least(F.lit(FIRST_CONFIDENCE) + (n - 1) * STEP, F.lit(FULL)).cast("int").alias("confidence_score"), (n - 1).alias("apply_count"),
    )


def merge_fold(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Next version of a folded state after a further batch of it (both as ``fold_patterns`` gives them)."""
    return merge(
        state, batch, keys,
        update={
            "pattern_value": F.col("s.pattern_value"),
            "confidence_score": F.least(F.col("t.confidence_score") + (F.col("s.apply_count") + 1) * STEP, F.lit(FULL)),
            "apply_count": F.col("t.apply_count") + F.col("s.apply_count") + 1,
        },
        insert={c: F.col(f"s.{c}") for c in ("pattern_value", "confidence_score", "apply_count")},
    )


def delete(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Next version of a table without the rows whose key is listed; null keys are never listed."""
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def truncate(target: DataFrame) -> DataFrame:
    """Next version of a table without rows, of the same schema."""
    return target.limit(0)


def update(target: DataFrame, source: DataFrame, on: list[str], put: dict[str, Column]) -> DataFrame:
    """Next version of a table in which rows with a key in ``source`` (one row per key) get new values; expressions name the sides ``t`` and ``s``."""
    t, s = target.alias("t"), source.withColumn("_hit", F.lit(True)).alias("s")
    joined = t.join(s, _all([F.col(f"t.{k}") == F.col(f"s.{k}") for k in on]), "left")
    return joined.select(*(F.when(F.col("s._hit"), put[c]).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) if c in put else F.col(f"t.{c}").alias(c) for c in target.columns))


def violations(table: DataFrame, unique: list[list[str]] = (), required: list[str] = ()) -> DataFrame:
    """(rule, key, n) of every broken constraint: keys that occur more than once (nulls aside), columns that hold nulls."""
    parts = [
        table.dropna(subset=k).groupBy(F.to_json(F.struct(*k)).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(f"unique {','.join(k)}").alias("rule"), "key", "n") for k in unique
    ] + [table.filter(F.col(c).isNull()).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(f"required {c}").alias("rule"), F.lit(None).cast("string").alias("key"), "n") for c in required]
    return reduce(DataFrame.unionByName, parts)


def full_batches(rows: DataFrame, keys: list[str], part: Column, order: list[Column], size: int) -> DataFrame:
    """Rows that fill whole batches of ``size`` per key in the given order, with their ``batch_no`` from 0; what doesn't fill a batch waits.

    ``part`` cuts the order into stretches (such as days): numbers are given within these and go on from the counts of those before, so that no task sees all rows of a hot key.
    """
    cut = rows.withColumn("_part", part)
    counts = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*keys)
    before = counts.withColumn("_before", F.coalesce(F.sum("_k").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_k").over(w))
    before = before.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate([*keys, "_part"])), "_before", "_all")
    numbered = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    met = numbered.join(before, _all([F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*keys, "_part"])]))
    place = F.col("_before") + F.col("_n")
    out = met.withColumn("batch_no", F.floor(place / size).cast("int")).filter((F.col("batch_no") + 1) * size <= F.col("_all"))
    return out.select(*rows.columns, "batch_no")
