"""Line-wise text operators: sections by headings, lines with their neighbours. Lines stay arrays inside their row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(c: Column) -> Column:
    """Lines of a text whatever the line ends; non-breaking spaces as spaces."""
    return F.split(F.translate(F.regexp_replace(c, r"\r\n?", "\n"), "\u00a0", " "), "\n")


def sections(df: DataFrame, text: str, heading: str, keys: list[str]) -> DataFrame:
    """One row per line below a heading: (keys, section, line_no, line). The last heading before a line names its section;
    heading lines and lines before the first heading are left out. The lines between two headings are cut out as one slice, so time is in proportion to the text.
    """
    head = F.transform("_lines", lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, heading, 1).alias("section")))
    parts = df.select(*keys, lines(F.col(text)).alias("_lines")).withColumn("_heads", F.filter(head, lambda h: h["section"] != ""))
    end = lambda i: F.coalesce(F.get("_heads", i + 1)["at"], F.size("_lines"))
    cut = F.transform("_heads", lambda h, i: F.struct(h["section"].alias("section"), h["at"].alias("at"), F.slice(F.col("_lines"), h["at"] + 2, end(i) - h["at"] - 1).alias("below")))
    below = parts.select(*keys, F.explode(cut).alias("s")).select(*keys, "s.section", "s.at", F.posexplode("s.below").alias("n", "line"))
    return below.select(*keys, "section", (F.col("at") + F.col("n") + 1).alias("line_no"), "line")


def with_neighbours(c: Column, before: int, after: int) -> Column:
    """Each line as a struct with the lines around it: (line, line_no, around)."""
    around = lambda whole, i: F.slice(whole, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)) + 1 + after)
    per_line = lambda whole: F.transform(whole, lambda x, i: F.struct(x.alias("line"), i.alias("line_no"), around(whole, i).alias("around")))
    return F.transform(F.array(lines(c)), per_line)[0]  # bound as a variable, so the text is split once and not for each line


def combine(df: DataFrame, text: str, keys: list[str], done: str, ahead: int = 2) -> DataFrame:
    """(keys, part_no, part): lines without what ``done`` matches take up to ``ahead`` following lines until one has it; every line is used once, empty ones are left out.

    What ``done`` matches must stand in one line. The lines behind one such line, to the next, are a run; runs are cut into slices of
    ``ahead`` + 1 lines, so time is in proportion to the text.
    """
    rows = df.select(*keys, F.filter(lines(F.col(text)), lambda x: F.trim(x) != "").alias("_lines"))
    hits = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(done), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("_ends", F.array_distinct(F.concat(hits, F.array(F.size("_lines"))))).filter(F.size("_lines") > 0)
    run = lambda end, i: F.struct(F.coalesce(F.when(i > 0, F.get("_ends", i - 1)), F.lit(0)).alias("start"), end.alias("end"))
    slices = lambda r: F.transform(F.sequence(r["start"], r["end"] - 1, F.lit(ahead + 1)), lambda at: F.array_join(F.slice(F.col("_lines"), at + 1, F.least(F.lit(ahead + 1), r["end"] - at)), " "))
    return rows.select(*keys, F.posexplode(F.flatten(F.transform(F.transform("_ends", run), slices))).alias("part_no", "part"))
