"""Problem 1, second half: one consistent table of all records, with casts from an alias table.

Renames chain a feed's fields: a field keeps the name it had first, whatever it is called later. The alias
table maps these first names (whole paths, for every feed or for one) to one name and type each, so that
producers meet; a path it doesn't name keeps its whole path in snake case. Identifiers are typed string there, so that
leading zeros stay. A name without a type in the table is a number or boolean if JSON never held anything else.

Defined results:
* two fields of one file under one name are a conflict: the first by path keeps the name, the others get their
  whole path as name (and a number while that is taken), and ``names`` marks them;
* a value its cast can't read is null in its column and stands as text in ``unread``;
* what lies under ``codes`` stands in the map ``codes``, by its whole path;
* every line but headers gives one record, also unreadable ones and CSV lines without a header (no field then); a line
  loaded twice is one; lines without a number are told apart by their payload;
* more than MAX_COLUMNS names are an error; an empty table gives no records.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daram.operators import drift
from daram.session import ship, store

MAX_COLUMNS = 5_000
OWN = ("feed", "run_no", "line_no", "rec_id", "codes", "unread")
CHAIN = "feed string, run_no int, path string, canonical string, conflict boolean"
RECORD = "feed string, run_no int, line_no int, rec_id string, fields map<string,string>, codes map<string,string>"


def snake(path: str) -> str:
    """Whole path in snake case: ``python.terms.insuTerm`` is python_terms_insu_term, ``PAY_TERM`` is pay_term."""
    name = re.sub(r"\W+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", path)).lower().strip("_") or "field"
    return f"field_{name}" if name in OWN else name


def _own_name(path: str, taken: set[str]) -> str:
    name, n = snake(path), 2
    while name in taken:
        name, n = f"{snake(path)}_{n}", n + 1
    return name


def _chain(footers: pd.DataFrame) -> pd.DataFrame:
    """Names of one feed's fields (its footers only: fields times runs) through their renames, in order of the runs."""
    name: dict[str, str] = {}
    rows = []
    for run, part in footers.sort_values(["run_no", "path"], kind="stable").groupby("run_no", sort=True):
        was, taken = dict(name), set()
        for path, old, agreed in zip(part["path"], part["old_path"], part["agreed"]):
            known = was.get(old) if isinstance(old, str) else was.get(path)
            wanted = known or (agreed if isinstance(agreed, str) else snake(path))
            conflict = wanted in taken
            name[path] = _own_name(path, taken) if conflict else wanted
            taken.add(name[path])
            rows.append((part["feed"].iloc[0], int(run), path, name[path], conflict))
    return pd.DataFrame(rows, columns=["feed", "run_no", "path", "canonical", "conflict"])


def names(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """(feed, run_no, path, canonical, cast, type, conflict) of every field of every file. ``aliases``: (feed, path, canonical, cast), a null feed for all; one row per name and feed."""
    return _names(lines, drift.history(lines), aliases)


def _names(lines: DataFrame, history: tuple, aliases: DataFrame) -> DataFrame:
    raw, _, footers, happened = history
    ship(lines.sparkSession)
    pairs = drift.renames(lines, raw, happened).select("feed", "run_no", F.col("new_path").alias("path"), "old_path")
    general = aliases.filter("feed IS NULL").groupBy("path").agg(F.min("canonical").alias("general"))
    special = aliases.filter("feed IS NOT NULL").groupBy("feed", "path").agg(F.min("canonical").alias("special"))
    agreed = footers.join(pairs, ["feed", "run_no", "path"], "left").join(general, "path", "left").join(special, ["feed", "path"], "left")
    chained = agreed.select("feed", "run_no", "path", "old_path", F.coalesce("special", "general").alias("agreed")).groupBy("feed").applyInPandas(_chain, CHAIN)
    named = chained.join(footers, ["feed", "run_no", "path"])
    kinds = named.groupBy("canonical").agg(F.collect_set(F.when(F.col("fmt") == "csv", "string").otherwise(F.col("type"))).alias("kinds"))  # four types at most
    only = lambda k: (F.size("kinds") == 1) & F.array_contains("kinds", k)
    given = aliases.filter("cast IS NOT NULL").groupBy("canonical").agg(F.min("cast").alias("given"))
    cast = F.coalesce("given", F.when(only("number"), "double").when(only("boolean"), "boolean").otherwise("string"))
    return named.join(kinds, "canonical").join(given, "canonical", "left").select("feed", "run_no", "path", "canonical", cast.alias("cast"), "type", "conflict")


def _codes(node: dict):
    """(path, text) of every entry of objects named codes, wherever they stand under objects."""
    stack = [("", node)]
    while stack:
        prefix, here = stack.pop()
        for key, value in here.items():
            if isinstance(value, dict):
                if key == "codes":
                    yield from ((f"{prefix}{key}.{k}", v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in value.items())
                else:
                    stack.append((f"{prefix}{key}.", value))


def read_records(batches):
    """Arrow batches (feed, run_no, line_no, payload, fmt, header, named) to one record per line, fields by their consistent names."""
    schema = drift._arrow(RECORD)
    for batch in batches:
        rows = []
        for feed, run, line, payload, fmt, header, named in zip(*(batch.column(i).to_pylist() for i in range(7))):
            rec, values, codes = None, {}, []
            if payload is not None and fmt == "csv":
                record = dict(zip(drift._cells(header), drift._cells(payload))) if header is not None else {}
                rec, values = record.get("CODE"), {k: v for k, v in record.items() if v != ""}
            elif payload is not None and (record := drift._record(payload)) is not None:
                rec, values, codes = drift._rec_id(record, "insuCd"), {path: v for path, _, v in drift._leaves(record)}, list(_codes(record))
            fields = [(n["canonical"], v) for n in named or () if (v := values.get(n["path"])) is not None]
            rows.append((feed, run, line, rec, fields, codes))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


# Words for yes and no, amounts of Korean numbers, and units behind a number.
YES, NO = ("예", "네", "참"), ("아니오", "아니요", "거짓")
AMOUNTS = {"억": 100_000_000, "천만": 10_000_000, "백만": 1_000_000, "만": 10_000, "천": 1_000}
UNITS = "원|세|년|회|개|건|쪽|%"


def _read(text: Column, cast: str) -> Column:
    """What a text says in the type of its column: Spark's own cast, then words for yes and no, and whole numbers with commas, an amount and a unit."""
    if cast == "string":
        return text
    plain = text.try_cast(cast)
    if cast == "boolean":
        return F.coalesce(plain, F.when(F.trim(text).isin(*YES), True).when(F.trim(text).isin(*NO), False))
    if cast == "bigint":
        part = lambda i: F.regexp_extract(text, rf"^\s*(-?\d[\d,]*)\s*({'|'.join(AMOUNTS)})?\s*(?:{UNITS})?\s*$", i)
        times = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in AMOUNTS.items() for x in kv)), F.nullif(part(2), F.lit(""))), F.lit(1))
        return F.coalesce(plain, F.replace(part(1), F.lit(","), F.lit("")).try_cast("bigint") * times)
    return plain


def records(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per record: feed, run_no, line_no, rec_id, a typed column per consistent name in order of the names, codes and unread."""
    history = drift.history(lines)
    agreed = store(_names(lines, history, aliases))
    casts = agreed.groupBy("canonical").agg(F.min("cast").alias("cast")).orderBy("canonical").limit(MAX_COLUMNS + 1).collect()  # a row per column
    if len(casts) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} names of fields")
    one = F.when(F.col("line_no").isNull(), F.col("payload"))
    once = drift.placed(lines).groupBy("feed", "run_no", "line_no", one.alias("_of")).agg(F.max("payload").alias("payload"), F.max("fmt").alias("fmt")).filter(~drift.is_header()).drop("_of")
    of_file = agreed.groupBy("feed", "run_no").agg(F.collect_list(F.struct("path", "canonical")).alias("named")).join(drift.headers(history[0]), ["feed", "run_no"], "left")
    rows = drift.with_files(once, of_file, how="left").select("feed", "run_no", "line_no", "payload", "fmt", "header", "named").mapInArrow(read_records, RECORD)
    text = lambda n: F.try_element_at("fields", F.lit(n))
    typed = [_read(text(r["canonical"]), r["cast"]).alias(r["canonical"]) for r in casts]
    bad = [F.when(text(r["canonical"]).isNotNull() & _read(text(r["canonical"]), r["cast"]).isNull(), F.struct(F.lit(r["canonical"]), text(r["canonical"]))) for r in casts if r["cast"] != "string"]
    unread = F.map_from_entries(F.filter(F.array(*bad), lambda x: x.isNotNull())) if bad else F.create_map().cast("map<string,string>")
    return rows.select("feed", "run_no", "line_no", "rec_id", *typed, "codes", unread.alias("unread"))
