"""Problem 4: references to records that are absent, deleted or created only later.

References are counted per key and period first. Keys that hold at least ``HEAVY_SHARE`` of all references, of which there can
be no more than 1 / HEAVY_SHARE, are settled on a small table of their own that is broadcast; the counts of all other
keys are shuffled and anti-joined with the keys that exist. Both together give the verdict on every key, and their
counts united the report. Single rows meet the verdicts, which name bad keys only, in the same two ways.

A period in which a key was created counts row by row, as some of its references are late and some aren't.

Defined results:
* null references are no references; null keys of targets name nothing;
* a row sent twice counts once (by table, row id and field; of differing copies the earliest counts);
* a target kept several times exists since its earliest ``created_at``; without any time it is never late, nor is a reference without a time;
* a key that came back after its deletion exists; tables may be empty; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daram.session import store

HEAVY_SHARE = 0.001
KEY = ["target", "ref_key"]


def references(table: DataFrame, table_name: str, row_id: str, field: str, target: str, at: str = "created_at", resent: bool = True) -> DataFrame:
    """The non-null references of one field, once each."""
    rows = table.filter(F.col(field).isNotNull()).select(
        F.lit(table_name).alias("table_name"), F.col(row_id).cast("bigint").alias("row_id"), F.lit(field).alias("field_name"), F.lit(target).alias("target"), F.col(field).cast("bigint").alias("ref_key"), F.col(at).alias("ref_at")
    )
    if not resent:
        return rows
    same = ["table_name", "row_id", "field_name", "target"]
    return rows.groupBy(*same).agg(F.min(F.struct("ref_at", "ref_key")).alias("r")).select(*same, "r.ref_key", "r.ref_at")


def existing(named: dict[str, tuple[DataFrame, str]], at: str = "created_at") -> DataFrame:
    """One row per target key that exists: (target, ref_key, since)."""
    rows = [t.filter(F.col(k).isNotNull()).select(F.lit(n).alias("target"), F.col(k).cast("bigint").alias("ref_key"), F.col(at).alias("since")) for n, (t, k) in named.items()]
    return reduce(DataFrame.unionByName, rows).groupBy(*KEY).agg(F.min("since").alias("since"))


def removed(deleted: DataFrame) -> DataFrame:
    """One row per target key recorded as deleted: (target, ref_key)."""
    return deleted.filter(F.col("key_id").isNotNull()).select(F.col("table_name").alias("target"), F.col("key_id").cast("bigint").alias("ref_key")).distinct()


def counts(refs: DataFrame) -> DataFrame:
    """References per key and period (month of the referring row): (table_name, field_name, target, ref_key, period, n, first_at, last_at)."""
    return refs.groupBy("table_name", "field_name", *KEY, F.date_format("ref_at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.min("ref_at").alias("first_at"), F.max("ref_at").alias("last_at"))


@dataclass(frozen=True)
class Verdicts:
    """What the counts say: the heavy keys, and the bad keys (target, ref_key, kind, since) among these and among the rest."""

    counted: DataFrame
    heavy: DataFrame
    of_heavy: DataFrame
    of_rest: DataFrame


def settle(refs: DataFrame, alive: DataFrame, gone: DataFrame, heavy_share: float = HEAVY_SHARE) -> Verdicts:
    """Verdict on every key that is referred to. Counts are written once; the heavy keys are at most 1 / heavy_share."""
    counted = store(counts(refs))
    per_key = counted.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"))
    total = counted.agg(F.sum("n").alias("total"))
    heavy = store(per_key.join(F.broadcast(total), F.col("n") >= heavy_share * F.col("total")).select(*KEY, "first_at"))

    def bad(keys: DataFrame, alive: DataFrame, gone: DataFrame) -> DataFrame:
        absent = keys.join(alive, KEY, "left_anti")
        why = absent.join(gone.withColumn("kind", F.lit("deleted")), KEY, "left").select(*KEY, F.coalesce("kind", F.lit("missing")).alias("kind"), F.lit(None).cast(alive.schema["since"].dataType).alias("since"))
        late = keys.join(alive, KEY).filter(F.col("since") > F.col("first_at")).select(*KEY, F.lit("late").alias("kind"), "since")
        return why.unionByName(late)

    known = F.broadcast(heavy.select(*KEY))
    of_heavy = bad(heavy, F.broadcast(alive.join(known, KEY, "left_semi")), F.broadcast(gone.join(known, KEY, "left_semi")))  # as many rows as heavy keys at most
    of_rest = bad(per_key.join(known, KEY, "left_anti").select(*KEY, "first_at"), alive, gone)
    return Verdicts(counted, heavy, store(of_heavy), store(of_rest))


def _met(rows: DataFrame, v: Verdicts) -> DataFrame:
    """Rows whose key is bad, with kind and since: those of heavy keys by broadcast, the others shuffled; together every such row."""
    rest = rows.join(F.broadcast(v.heavy.select(*KEY)), KEY, "left_anti").join(v.of_rest, KEY)
    return rows.join(F.broadcast(v.of_heavy), KEY).unionByName(rest)


def judge(refs: DataFrame, v: Verdicts) -> DataFrame:
    """Every orphan reference with ``orphan_kind``: late, deleted or missing."""
    return _met(refs, v).filter((F.col("kind") != "late") | (F.col("since") > F.col("ref_at"))).withColumnRenamed("kind", "orphan_kind")


def report(refs: DataFrame, v: Verdicts) -> DataFrame:
    """References and orphans per table, field and period: the counts of heavy and other keys united; only periods that a key's creation cuts through are counted by rows."""
    of = ["table_name", "field_name", "period"]
    met = _met(v.counted, v)
    whole = met.filter((F.col("kind") != "late") | (F.col("since") > F.col("last_at"))).select(*of, "kind", "n")
    cut = met.filter((F.col("kind") == "late") & (F.col("since") > F.col("first_at")) & (F.col("since") <= F.col("last_at"))).select("table_name", "field_name", *KEY, "period", "since")
    some = refs.withColumn("period", F.date_format("ref_at", "yyyy-MM")).join(cut, ["table_name", "field_name", *KEY, "period"]).filter(F.col("since") > F.col("ref_at")).select(*of, F.lit("late").alias("kind"), F.lit(1).cast("bigint").alias("n"))
    every = v.counted.select(*of, F.lit("").alias("kind"), "n")
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return every.unionByName(whole).unionByName(some).groupBy(*of).agg(n("").alias("n_references"), *(n(k).alias(f"n_{k}") for k in ("missing", "deleted", "late")))
