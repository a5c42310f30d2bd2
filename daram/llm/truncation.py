"""Problem 3: text cut off by field limits or on the way.

1. Endings. Every text is split into units (list entries, or words of prose) with numbers as ``0``. How
   often a unit stops (ends a value or a sentence) and how often it goes on (as the beginning of a longer unit, or followed by
   another word) is counted over all rows, and so is how often texts stop, or go on, inside a bracket or behind a
   delimiter. An ending is incomplete if it goes on more often than it stops, or bears a mark of a cut (replacement
   character, ellipsis); it is suspicious if a finished sentence is followed by a mere blank.
2. Limits. Per source file the discrete hazard of incomplete or suspicious endings is taken at every length, in
   characters and in bytes, and tested against the hazards of the neighbouring lengths (Chernoff's bound
   of the binomial tail); Benjamini and Hochberg's rule over all tests keeps the false-discovery rate.
3. At a length that is significant for its file (or for the field in other files, while its file has nothing longer)
   every incomplete or suspicious ending is a case.
4. On the way, at any other length, the length says nothing, so the ending itself is tested: its hazard of stopping must be small (``RARELY_STOPS``) and lie
   significantly below that of units of neighbouring lengths, under the same rule of false discoveries; a mark of a
   cut needs no test.

Neither rule knows a least count: rates decide, and the tests say whether the rows suffice. With few rows an ending may be
a case at a limit only.

Defined results: null, empty and blank texts and lone dashes are no cases; a null source file is a file of
its own; a row sent twice counts once
(only the vocabulary counts it as sent); texts are used whole, whatever their length; ties don't matter, as no
row is ranked; tables may be empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daram.functions.text import ASCII_BLANKS, ASCII_SIGNS, FULL_WIDTH, INVISIBLE, UNICODE_BLANKS, is_blank
from daram.session import store

# Delimiters of list fields, quotes and list brackets around entries, and signs of a broken end.
DELIMITERS = ",;/|、·+\n\t"
AROUND = "\"'“”‘’[]"
BROKEN = ("�", "…", "...")
NEIGHBOURS = 10
FALSE_DISCOVERIES = 0.01
RARELY_STOPS = 0.1
COMMON_ENDINGS = 1_000
OPEN, DANGLING = "\0open", "\0dangling"  # ways of ending that are counted like units
KEY = ["field"]


def texts(table: DataFrame, table_name: str, row_id: str, fields: dict[str, str], resent: bool = False) -> DataFrame:
    """(field as table:name, row_id, src_file, kind, resent, text); ``fields`` maps a field to list or prose."""
    each = F.explode(F.array(*(F.struct(F.lit(f"{table_name}:{f}").alias("field"), F.lit(kind).alias("kind"), F.col(f).alias("text")) for f, kind in fields.items())))
    rows = table.select(F.col(row_id).cast("bigint").alias("row_id"), "src_file", each.alias("t"))
    return rows.select("t.field", "row_id", "src_file", "t.kind", F.lit(resent).alias("resent"), "t.text").filter(~is_blank(F.col("text")))


def _mapped(pairs: dict[str, str], dropped: str) -> tuple[str, str]:
    return "".join(pairs) + dropped, "".join(pairs.values())


def plain(text: Column, kind: Column) -> Column:
    """Lists with commas only and no quotes, prose with single kinds of blanks and stops; numbers as 0. Translations and plain replacements, one pattern."""
    wide = dict(zip(FULL_WIDTH, ASCII_SIGNS))
    a_list = wide | {w: "," for w, c in wide.items() if c in DELIMITERS} | dict.fromkeys(DELIMITERS, ",") | dict.fromkeys(UNICODE_BLANKS, " ")
    prose = wide | {"。": "."} | dict.fromkeys(ASCII_BLANKS[1:] + UNICODE_BLANKS, " ")
    entries = F.rtrim(F.translate(text, *_mapped(a_list, AROUND + INVISIBLE)))
    for old, new in ((" 및 ", ","), ("납 ", "납,"), (") ", "),")):  # blanks behind a finished entry separate, too
        entries = F.replace(entries, F.lit(old), F.lit(new))
    return F.regexp_replace(F.when(kind == "list", entries).otherwise(F.translate(text, *_mapped(prose, INVISIBLE))), "[0-9]+", "0")


def seen(rows: DataFrame) -> DataFrame:
    """Every distinct unit: how often it stops, and how often another word follows it."""
    a_list = F.col("kind") == "list"
    bare = rows.select(*KEY, "kind", F.rtrim(plain(F.col("text"), F.col("kind"))).alias("bare"))
    each = bare.select(*KEY, "kind", F.explode(F.split(F.when(a_list, F.col("bare")).otherwise(F.concat("bare", F.lit("."))), F.when(a_list, ",").otherwise(" "))).alias("u"))
    stops = a_list | F.endswith("u", F.lit("."))
    unit = F.when(a_list, F.trim("u")).otherwise(F.rtrim("u", F.lit(".")))
    return each.groupBy(*KEY, unit.alias("unit")).agg(F.count(F.when(stops, 1)).alias("stops"), F.count(F.when(~stops, 1)).alias("goes")).filter(F.length("unit") > 0)


def longer(asked: DataFrame, units: DataFrame) -> DataFrame:
    """For each unit asked for how often longer units begin with it: (field, unit, n).

    Units that begin with u are a range of the sorted units, so two marks per unit asked for, and the difference of a running sum
    between them, count them; each unit is read once, however long. The sort is by the first two characters apart;
    what is one character long is counted by that character alone.
    """
    units = units.select(*KEY, "unit", (F.col("stops") + F.col("goes")).alias("n"))
    key = F.col("unit").cast("binary")
    head = F.substring("unit", 1, 2).alias("head")
    wide = asked.filter(F.length("unit") > 1)
    none = F.lit(None)
    marks = wide.select(*KEY, head, key.alias("at"), F.lit(1).alias("place"), F.lit(0).cast("bigint").alias("n"), "unit").unionByName(
        wide.select(*KEY, head, F.concat(key, F.unhex(F.lit("FF"))).alias("at"), F.lit(2).alias("place"), F.lit(0).cast("bigint").alias("n"), "unit")
    )
    line = units.filter(F.length("unit") > 1).select(*KEY, head, key.alias("at"), F.lit(0).alias("place"), "n", none.cast("string").alias("unit")).unionByName(marks)
    so_far = F.sum("n").over(Window.partitionBy(*KEY, "head").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    of_wide = line.withColumn("so_far", so_far).filter("place > 0").groupBy(*KEY, "unit").agg(F.sum(F.when(F.col("place") == 2, F.col("so_far")).otherwise(-F.col("so_far"))).alias("n"))
    first = units.filter(F.length("unit") > 1).groupBy(*KEY, F.substring("unit", 1, 1).alias("unit")).agg(F.sum("n").alias("n"))
    return of_wide.unionByName(asked.filter(F.length("unit") == 1).join(first, [*KEY, "unit"]))


def vocabulary(rows: DataFrame, once: DataFrame) -> DataFrame:
    """Of every last unit: how often it stops and how often it goes on, and the hazard h0 of units of neighbouring lengths (its own occurrences left out)."""
    units = store(seen(rows))
    asked = once.filter(F.col("last").isNotNull()).select(*KEY, F.col("last").alias("unit")).distinct()
    size = F.length("unit").alias("size")
    words = asked.filter(~F.col("unit").startswith("\0")).join(units, [*KEY, "unit"], "left").join(longer(asked, units).withColumnRenamed("n", "more"), [*KEY, "unit"], "left")
    own = [F.coalesce(c, F.lit(0)).alias(c) for c in ("stops", "goes", "more")]
    near = Window.partitionBy(*KEY).orderBy("size").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    by_size = units.groupBy(*KEY, size).agg(F.sum("stops").alias("stops"), F.sum(F.col("stops") + F.col("goes")).alias("n"))  # one row per field and length
    around = by_size.unionByName(asked.select(*KEY, size, F.lit(0).cast("bigint").alias("stops"), F.lit(0).cast("bigint").alias("n")).distinct()).groupBy(*KEY, "size").agg(F.sum("stops").alias("stops"), F.sum("n").alias("n"))
    around = around.select(*KEY, "size", F.sum("stops").over(near).alias("near_stops"), F.sum("n").over(near).alias("near_n"))
    h0 = (F.col("near_stops") - F.col("stops") + 0.5) / (F.col("near_n") - F.col("stops") - F.col("goes") + 1.0)
    of_words = words.select(*KEY, "unit", size, *own).join(around, [*KEY, "size"]).select(*KEY, "unit", "stops", (F.col("goes") + F.col("more")).alias("goes"), h0.alias("h0"))
    ways = once.groupBy(*KEY).agg(*(F.sum(f"{c}_{w}").alias(f"{c}_{w}") for c in ("stops", "goes") for w in ("open", "dangling")))
    whole = units.groupBy(*KEY).agg(((F.sum("stops") + 0.5) / (F.sum(F.col("stops") + F.col("goes")) + 1.0)).alias("h0"))
    way = lambda unit, w: F.struct(F.lit(unit).alias("unit"), F.col(f"stops_{w}").alias("stops"), F.col(f"goes_{w}").alias("goes"))
    of_ways = ways.join(whole, KEY).select(*KEY, F.explode(F.array(way(OPEN, "open"), way(DANGLING, "dangling"))).alias("w"), "h0").select(*KEY, "w.*", "h0").filter("stops > 0")
    return of_words.unionByName(of_ways)


def discoveries(tested: DataFrame, q: float) -> DataFrame:
    """Tests whose ``log_p`` Benjamini and Hochberg's rule keeps at rate q. Their order is taken on a histogram of log p, so that no task sorts all tests."""
    step = F.floor(-F.col("log_p") * 10)  # bigint: log p grows with the rows, over 32 bits at 1 GB
    bins = tested.groupBy(*KEY, step.alias("step")).agg(F.count(F.lit(1)).alias("tests"))
    down = Window.partitionBy(*KEY).orderBy(F.desc("step"))
    passed = bins.withColumn("rank", F.sum("tests").over(down)).withColumn("m", F.sum("tests").over(Window.partitionBy(*KEY)))
    cut = passed.filter(-F.col("step") / 10 <= F.log(F.lit(q) * F.col("rank") / F.col("m"))).groupBy(*KEY).agg(F.min("step").alias("least"))
    return tested.withColumn("step", step).join(F.broadcast(cut), KEY).filter(F.col("step") >= F.col("least")).drop("step", "least")  # one row per field


def _log_p(n: Column, h: Column, h0: Column) -> Column:
    """Chernoff's bound of the binomial tail beyond h, where h0 is expected."""
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    return -n * (part(h, h0) + part(1 - h, 1 - h0))


def unfinished(words: DataFrame, q: float = FALSE_DISCOVERIES) -> DataFrame:
    """Last units that go on more often than they stop, and whether that is ``sure``: their hazard is small, and significantly below h0."""
    n, h = F.col("stops") + F.col("goes"), F.col("stops") / (F.col("stops") + F.col("goes"))
    tested = words.withColumn("log_p", F.when(h < F.col("h0"), _log_p(n, h, F.col("h0"))).otherwise(0.0))
    sure = discoveries(tested, q).filter(h < RARELY_STOPS).select(*KEY, "unit", F.lit(True).alias("sure"))
    return words.filter("stops < goes").join(sure, [*KEY, "unit"], "left").select(*KEY, F.col("unit").alias("last"), F.coalesce("sure", F.lit(False)).alias("sure"))


def ends(rows: DataFrame) -> DataFrame:
    """Every text, once: its last unit (or way of ending), the mark of a cut it ends with, what it adds to the counts of the ways, and its lengths."""
    count = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    is_open = (count("(（") > count(")）")) | (count("[［") > count("]］"))
    a_list, bare = F.col("kind") == "list", F.col("bare")
    final = lambda x: F.substring(x, -1, 1)
    dangling, stopped = a_list & (final(bare) == ","), ~a_list & (final(bare) == ".")
    word = F.nullif(F.when(~stopped, F.when(a_list, F.trim(F.substring_index(bare, ",", -1))).otherwise(F.substring_index(bare, " ", -1))), F.lit(""))
    marked = reduce(lambda a, b: a | b, [F.endswith("end", F.lit(x)) for x in BROKEN])
    last = F.when(marked, None).when(is_open, OPEN).when(dangling, DANGLING).otherwise(word)
    one = lambda c: c.cast("int")
    looked = rows.withColumn("bare", F.rtrim(plain(F.col("text"), F.col("kind")))).withColumn("end", F.rtrim("text")).select(
        *KEY, "row_id", "src_file", "resent", last.alias("last"), F.when(marked, "broken").alias("why"), (~a_list & (F.length("end") < F.length("text"))).alias("suspicious"),
        one(is_open).alias("stops_open"), one(~is_open & (count("(（[［") > 0)).alias("goes_open"), one(dangling).alias("stops_dangling"), one(~dangling & a_list & F.contains(bare, F.lit(","))).alias("goes_dangling"),
        F.length("text").alias("chars"), F.octet_length(F.rtrim("text", F.lit("�"))).alias("bytes"),
    )
    return looked.filter("NOT resent").unionByName(looked.filter("resent").dropDuplicates([*KEY, "row_id"])).drop("resent")


def endings(once: DataFrame, words: DataFrame) -> DataFrame:
    """Every text with ``incomplete`` (why, or null), whether that is ``sure`` without regard to its length, ``suspicious`` and its lengths.

    The commonest last units (a bounded list) are settled by broadcast, so that no hot unit meets one task; the others are shuffled.
    """
    rare = unfinished(words)
    key = [*KEY, "last"]
    common = once.filter(F.col("last").isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *key).limit(COMMON_ENDINGS).select(*key)
    settled = F.broadcast(F.broadcast(common).join(rare, key, "left").withColumn("common", F.lit(True)))
    first = once.join(settled, key, "left")
    is_settled = F.col("last").isNull() | F.col("common").isNotNull()
    done, rest = first.filter(is_settled).drop("common"), first.filter(~is_settled).drop("common", "sure").join(rare, key, "left")
    way = F.when(F.col("sure").isNotNull(), F.when(F.col("last").startswith("\0"), F.substring("last", 2, 99)).otherwise("unfinished"))
    return done.unionByName(rest).select(*KEY, "row_id", "src_file", F.coalesce("why", way).alias("incomplete"), (F.col("why").isNotNull() | F.coalesce("sure", F.lit(False))).alias("sure"), "suspicious", "chars", "bytes")


def lengths(ended: DataFrame) -> DataFrame:
    """One row per text and measure (characters, or bytes without a broken last character) with its ``bin``.

    A cut by bytes may fall up to two bytes short of the limit, so bytes are taken in steps of three.
    """
    measure = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("length"), F.col("chars").alias("bin")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("length"), F.floor((F.col("bytes") + 2) / 3).cast("int").alias("bin"))))
    return ended.withColumn("m", measure).select(*KEY, "row_id", "src_file", "incomplete", "sure", "suspicious", "m.measure", "m.length", "m.bin")


def limits(measured: DataFrame, q: float = FALSE_DISCOVERIES) -> DataFrame:
    """Significant lengths of each file: (field, src_file, measure, bin, length, k bad endings among risk texts, log_p)."""
    bad = F.col("incomplete").isNotNull() | F.col("suspicious")
    hist = measured.groupBy(*KEY, "src_file", "measure", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("int")).alias("k"), F.max("length").alias("length"))
    by = Window.partitionBy(*KEY, "src_file", "measure").orderBy("bin")
    risk = hist.withColumn("risk", F.sum("n").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    near = by.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    hazard = (
        risk.withColumn("k0", F.sum("k").over(near) - F.col("k")).withColumn("n0", F.sum("risk").over(near) - F.col("risk"))
        .withColumn("h", F.col("k") / F.col("risk")).withColumn("h0", (F.col("k0") + 0.5) / (F.col("n0") + F.lit(20.0)))
    )
    tested = hazard.withColumn("log_p", F.when(F.col("h") > F.col("h0"), _log_p(F.col("risk"), F.col("h"), F.col("h0"))).otherwise(0.0))
    return discoveries(tested, q).select(*KEY, "src_file", "measure", "bin", "length", "k", "risk", "log_p")


def judged(rows: DataFrame) -> DataFrame:
    """Every text with its ending. What several steps read is written to the shared folder: ids, last units, numbers, and the vocabulary."""
    once = store(ends(rows))
    return store(endings(once, store(vocabulary(rows, once))))


def cases(ended: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The cases: (field, row_id, src_file, reason, at_limit). ``found``: the significant lengths, those of ``limits`` unless given."""
    measured = lengths(ended)
    found = limits(measured) if found is None else found
    longest = measured.groupBy(*KEY, "src_file", "measure").agg(F.max("bin").alias("bin"))
    general = found.select(*KEY, "measure", "bin").distinct()
    shared = longest.join(general, [*KEY, "measure", "bin"]).select(*KEY, "src_file", "measure", "bin")
    at = found.select(*KEY, "src_file", "measure", "bin").unionByName(shared).distinct().select(*(F.col(c).alias(f"at_{c}") for c in (*KEY, "src_file", "measure", "bin")), F.lit(True).alias("hit"))
    maybe = measured.filter(F.col("suspicious") | F.col("incomplete").isNotNull())
    same = [F.col(c) == F.col(f"at_{c}") for c in (*KEY, "measure", "bin")] + [F.col("src_file").eqNullSafe(F.col("at_src_file"))]
    placed = maybe.join(at, reduce(lambda a, b: a & b, same), "left")
    one = placed.groupBy(*KEY, "row_id", "src_file").agg(F.max("incomplete").alias("incomplete"), F.max("sure").alias("sure"), F.coalesce(F.max("hit"), F.lit(False)).alias("at_limit"))
    return one.filter(F.col("at_limit") | F.col("sure")).select(*KEY, "row_id", "src_file", F.coalesce("incomplete", F.lit("blank")).alias("reason"), "at_limit")


def named(df: DataFrame) -> DataFrame:
    """``field`` taken apart into table_name and field_name."""
    parts = F.split("field", ":")
    return df.select(parts[0].alias("table_name"), parts[1].alias("field_name"), *[c for c in df.columns if c != "field"])


def cut_texts(rows: DataFrame) -> DataFrame:
    """(table_name, field_name, row_id, src_file, reason, at_limit) of every text that lacks its end."""
    return named(cases(judged(rows)))


def report(rows: DataFrame) -> DataFrame:
    """Texts, cut texts and their share per source file, and the file's significant lengths in characters and bytes."""
    ended = judged(rows)
    found = store(limits(lengths(ended)))
    whole = ended.groupBy(*KEY, "src_file").agg(F.count(F.lit(1)).alias("n_texts"))
    bad = cases(ended, found).groupBy(*KEY, "src_file").agg(F.count(F.lit(1)).alias("n_cut"), F.count(F.when(F.col("at_limit"), 1)).alias("n_at_limit"))
    sizes = lambda m: F.array_sort(F.collect_set(F.when(F.col("measure") == m, F.col("length"))))
    length = found.groupBy(*KEY, "src_file").agg(sizes("chars").alias("limits_chars"), sizes("bytes").alias("limits_bytes"))
    side = lambda df, c: df.withColumnsRenamed({"field": f"field_{c}", "src_file": f"src_{c}"})
    same = lambda c: (F.col("field") == F.col(f"field_{c}")) & F.col("src_file").eqNullSafe(F.col(f"src_{c}"))
    joined = whole.join(side(bad, "b"), same("b"), "left").join(side(length, "l"), same("l"), "left")
    n, none = F.coalesce("n_cut", F.lit(0)), F.array().cast("array<int>")
    return named(joined.select("field", "src_file", "n_texts", n.alias("n_cut"), F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"), F.round(n / F.col("n_texts"), 4).alias("share_cut"), F.coalesce("limits_chars", none).alias("limits_chars"), F.coalesce("limits_bytes", none).alias("limits_bytes")))
