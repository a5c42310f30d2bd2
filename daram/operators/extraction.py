"""Extraction operators: strategies, layout lines, weighted rules, resolution by provenance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daram.operators.relational import cascade


@dataclass(frozen=True)
class Strategy:
    """A way to parse documents: a function from documents to (key, fields, confidence), with a name and a priority."""

    name: str
    priority: int
    parse: Callable[[DataFrame], DataFrame]
    available: bool = True


def run_strategies(documents: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """Results of all available strategies as rows; every one is evaluated, as columns are cheap and branches are not."""
    parts = [s.parse(documents).withColumn("strategy", F.lit(s.name)).withColumn("priority", F.lit(s.priority)) for s in strategies if s.available]
    return reduce(DataFrame.unionByName, parts)


def best_result(results: DataFrame, key: str, fields: list[str], enough: int = 85) -> DataFrame:
    """First sufficient result by priority, else the most confident."""
    return cascade(results, [key], "confidence", "priority", "strategy", enough, ["strategy", "confidence", *fields])


def layout_lines(glyphs: DataFrame, keys: list[str], order: str, y: str, char: str, tolerance: float = 1.0) -> DataFrame:
    """Lines of a page from its glyphs: a new line starts where the rounded height differs by more than the tolerance. One page is one group."""
    w = Window.partitionBy(*keys).orderBy(order)
    breaks = F.when(F.abs(F.round(y) - F.lag(F.round(y)).over(w)) > tolerance, 1).otherwise(0)
    placed = glyphs.withColumn("_break", breaks).withColumn("line_no", F.sum("_break").over(w))
    return placed.groupBy(*keys, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(char).alias("c")))), lambda g: g["c"]), "").alias("text"), F.count(F.lit(1)).alias("n_glyphs"))


def rule_score(rules: dict[str, tuple[Column, int]], full: int = 100) -> tuple[Column, Column]:
    """(score, reasons): from ``full`` the weight of every rule that is broken is taken, to 0 at least; an unknown rule is broken."""
    ok = {n: F.coalesce(c, F.lit(False)) for n, (c, _) in rules.items()}
    lost = reduce(lambda a, b: a + b, [F.when(ok[n], 0).otherwise(w) for n, (_, w) in rules.items()])
    return F.greatest(F.lit(full) - lost, F.lit(0)), F.concat_ws(",", *(F.when(~ok[n], n) for n in rules))


def resolve(candidates: list[tuple[str, Column]]) -> Column:
    """First usable value with where it came from: struct(value, source)."""
    usable = [F.when(c.isNotNull() & ~c.isin("", "—"), F.struct(c.alias("value"), F.lit(n).alias("source"))) for n, c in candidates]
    return F.coalesce(*usable, F.struct(F.lit(None).cast("string").alias("value"), F.lit("none").alias("source")))


def layered_score(layers: dict[str, dict[str, tuple[Column, int]]], enough: int, passable: int) -> Column:
    """Rules in layers: struct(score, status, reasons, and the score of each layer).

    A rule that holds gives its weight; one that is broken or unknown gives nothing and is a reason, as layer.rule. The status is PASS from ``enough`` on, WARNING from ``passable`` on, else FAIL.
    """
    ok = {f"{n}.{r}": (F.coalesce(c, F.lit(False)), w) for n, rules in layers.items() for r, (c, w) in rules.items()}
    points = {n: reduce(lambda a, b: a + b, [F.when(ok[f"{n}.{r}"][0], w).otherwise(0) for r, (_, w) in rules.items()]) for n, rules in layers.items()}
    total = reduce(lambda a, b: a + b, points.values())
    status = F.when(total >= enough, "PASS").when(total >= passable, "WARNING").otherwise("FAIL")
    return F.struct(total.alias("score"), status.alias("status"), F.concat_ws(",", *(F.when(~c, n) for n, (c, _) in ok.items())).alias("reasons"), *(p.alias(n) for n, p in points.items()))


def steps(value: Column, bands: list[tuple[float, int]], below: int = 0) -> Column:
    """Points of the first band whose lower bound the value reaches; a null value gets what values below all bands get."""
    points = F.lit(below)
    for bound, n in sorted(bands):
        points = F.when(value >= bound, n).otherwise(points)
    return points


def grade(score: Column, bands: list[tuple[float, str]], lowest: str) -> Column:
    """Name of the highest band the score reaches."""
    name = F.lit(lowest)
    for bound, n in sorted(bands):
        name = F.when(score >= bound, n).otherwise(name)
    return name


def ages_in_order(c: Column, oldest: int = 120) -> Column:
    """Whether every range a~b of a text holds a < b up to ``oldest``; a text without any is in order, a null one isn't."""
    pairs = F.transform(F.regexp_extract_all(c, F.lit(r"(\d{1,9}~\d{1,9})"), F.lit(1)), lambda x: F.transform(F.split(x, "~"), lambda n: n.cast("int")))
    return F.coalesce(F.forall(pairs, lambda p: (p[0] < p[1]) & (p[1] <= oldest)), F.lit(False))


def share_found(fields: list[Column], text: Column, least: float = 0.5) -> Column:
    """Whether so large a share of the fields that are given has an entry of its comma list in the text; an empty text proves nothing against them."""
    given = [F.coalesce(~F.trim(c).isin("", "—", "-"), F.lit(False)) for c in fields]
    found = [F.exists(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.contains(text, x)) for c in fields]
    n, hits = (reduce(lambda a, b: a + b, [F.when(g & f, 1).otherwise(0) for g, f in zip(given, fs)]) for fs in ([F.lit(True)] * len(fields), found))
    return text.isNull() | (text == "") | (n == 0) | (hits >= least * n)
