"""Problem 1: schemas that drift between the files of a feed.

A catalogue of column lifespans is kept: the fields of every file (its footer: JSON paths or the
CSV header, with types) become rows, runs of consecutive files with the same field and type become
islands, and the starts and ends of the islands are the events. A field whose end meets the
start of another that holds the same values is renamed. Casts of the consistent table come from the
alias table the renames give.

Footers come first: they are counted inside the Arrow batches, CSV columns by their place, so that no value and no
line leaves its task. Only lines of files in which a field went and another came are read a second time, for
the values of just these fields.

Defined results:
* null, empty or unparsable payloads give no field but still count as a line of their file;
* lines without a feed or run belong to no file and give nothing; a CSV line without a number is a record, not a header;
* lines loaded twice change nothing (presence and types are sets, values are taken once a product);
* CSV cells beyond the header have no field; CSV lines of a file without a header line give none;
* ties between rename candidates go to the larger share, then to equal last path segments, then by name;
* an empty table gives an empty report; further columns are ignored.
"""

from __future__ import annotations

import csv
import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daram.session import ship, store

FOOTER = "feed string, run_no int, fmt string, path string, pos int, type string, n bigint"
VALUE = "feed string, at_run int, rec_id string, path string, event string, value string"
SALTS = 16


def _arrow(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL text."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def _leaves(node: dict):
    """(path, type, text) of every value below an object that isn't an object itself; what is named codes stays shut."""
    stack = [("", node)]
    while stack:
        prefix, here = stack.pop()
        for key, value in here.items():
            path = f"{prefix}.{key}" if prefix else key
            if isinstance(value, dict):
                if key != "codes":
                    stack.append((path, value))
            elif value is None:
                continue
            elif isinstance(value, bool):
                yield path, "boolean", "true" if value else "false"
            elif isinstance(value, (int, float)):
                yield path, "number", json.dumps(value)
            elif isinstance(value, list):
                yield path, "array", json.dumps(value, ensure_ascii=False)
            else:
                yield path, "string", value


def _digits(text: str) -> bool:
    return text.isascii() and text.isdigit()


def _record(payload: str) -> dict | None:
    try:
        record = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _cells(payload: str) -> list[str]:
    return next(csv.reader([payload]), [])


def _rec_id(record: dict, key: str) -> str | None:
    rec = record.get(key)
    return rec if rec is None or isinstance(rec, str) else json.dumps(rec)


def _kinds(node: dict):
    """(path, type) of every value, as ``_leaves`` names them."""
    stack = [("", node)]
    while stack:
        prefix, here = stack.pop()
        for key, value in here.items():
            if value is None:
                continue
            kind = type(value)
            if kind is dict:
                if key != "codes":
                    stack.append((f"{prefix}{key}.", value))
            else:
                yield prefix + key, "string" if kind is str else "boolean" if kind is bool else "array" if kind is list else "number"


def read_footers(batches):
    """Arrow batches (feed, run_no, line_no, payload, fmt) to counts per file, field (of CSV: place) and type; a CSV header comes whole, as type header."""
    schema = _arrow(FOOTER)
    for batch in batches:
        counts: Counter = Counter()
        for feed, run, line, payload, fmt in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if payload is None:
                continue
            if fmt == "csv":
                if line == 0:
                    counts[feed, run, fmt, payload, None, "header"] += 1
                else:
                    counts.update((feed, run, fmt, None, i, "number" if _digits(v) else "string") for i, v in enumerate(_cells(payload)) if v != "")
            elif (record := _record(payload)) is not None:
                counts.update((feed, run, fmt, path, None, kind) for path, kind in _kinds(record))
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def header_names(batches):
    """Arrow batches (feed, run_no, header) to the names by place."""
    schema = _arrow("feed string, run_no int, pos int, path string")
    for batch in batches:
        rows = [(f, r, i, name) for f, r, h in zip(*(batch.column(i).to_pylist() for i in range(3))) for i, name in enumerate(_cells(h))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def wanted_values(batches):
    """Arrow batches (feed, payload, fmt, header, wanted) to the values of the fields wanted: (path, at_run, event)."""
    schema = _arrow(VALUE)
    for batch in batches:
        rows = []
        for feed, payload, fmt, header, wanted in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if fmt == "csv":
                if header is None:
                    continue
                record = dict(zip(_cells(header), _cells(payload)))
                rec, values = record.get("CODE"), {k: v for k, v in record.items() if v != ""}
            elif (record := _record(payload)) is not None:
                rec, values = _rec_id(record, "insuCd"), {path: v for path, _, v in _leaves(record)}
            else:
                continue
            if rec is not None:
                rows += [(feed, w["at_run"], rec, w["path"], w["event"], v) for w in wanted if (v := values.get(w["path"])) is not None]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def placed(lines: DataFrame) -> DataFrame:
    """Lines that belong to a file: (feed, run_no, line_no, payload, fmt)."""
    fmt = F.when(F.col("file_name").endswith(".csv") | F.col("feed").endswith("_mapping"), "csv").otherwise("json").alias("fmt")
    return lines.filter("feed IS NOT NULL AND run_no IS NOT NULL").select("feed", F.col("run_no").cast("int").alias("run_no"), F.col("line_no").cast("int").alias("line_no"), "payload", fmt)


def is_header(fmt: str = "fmt", line_no: str = "line_no") -> Column:
    return (F.col(fmt) == "csv") & F.col(line_no).eqNullSafe(F.lit(0))


def with_files(rows: DataFrame, files: DataFrame, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Lines with what is known of their file (one row per file), salted against hot files; small sides are broadcast at run time, by their size."""
    wide = files.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("line_no", "payload"), F.lit(salts)).cast("int")).join(wide, ["feed", "run_no", "salt"], how).drop("salt")


def counted(lines: DataFrame) -> DataFrame:
    """Raw footers of all files, written once: fields and types with their counts, places for CSV, and the headers."""
    ship(lines.sparkSession)
    return store(placed(lines).mapInArrow(read_footers, FOOTER).groupBy("feed", "run_no", "fmt", "path", "pos", "type").agg(F.sum("n").alias("n")))


def headers(raw: DataFrame) -> DataFrame:
    """(feed, run_no, header) of every CSV file; of differing headers the greatest counts."""
    return raw.filter("type = 'header'").groupBy("feed", "run_no").agg(F.max("path").alias("header"))


def runs(lines: DataFrame) -> DataFrame:
    """Every file of a feed with its place ``ix`` among the runs present, the run before and the feed's last place."""
    w = Window.partitionBy("feed")
    return (
        lines.filter("feed IS NOT NULL AND run_no IS NOT NULL").select("feed", F.col("run_no").cast("int").alias("run_no")).distinct()
        .withColumn("ix", F.row_number().over(w.orderBy("run_no"))).withColumn("prev_run", F.lag("run_no").over(w.orderBy("run_no"))).withColumn("last_ix", F.max("ix").over(w))
    )


def catalogue(raw: DataFrame) -> DataFrame:
    """The footer of each file: (feed, run_no, path, type, n). A CSV column is a number if all its values are digits; of mixed JSON types the commonest counts."""
    names = headers(raw).select("feed", "run_no", "header").mapInArrow(header_names, "feed string, run_no int, pos int, path string")
    tables = raw.filter("fmt = 'csv' AND type <> 'header'").drop("path").join(names, ["feed", "run_no", "pos"])
    kinds = raw.filter("fmt = 'json'").select("feed", "run_no", "fmt", "path", "type", "n").unionByName(tables.select("feed", "run_no", "fmt", "path", "type", "n"))
    kinds = kinds.groupBy("feed", "run_no", "fmt", "path", "type").agg(F.sum("n").alias("n"))
    commonest = F.max_by("type", F.struct("n", "type"))
    return kinds.groupBy("feed", "run_no", "path").agg(
        F.when(F.max("fmt") == "csv", F.max("type")).otherwise(commonest).alias("type"),  # 'string' sorts after 'number'
        F.sum("n").alias("n"), F.max("fmt").alias("fmt"),
    )


def lifespans(footers: DataFrame, files: DataFrame) -> DataFrame:
    """Islands of consecutive runs in which a field keeps its type, per feed, path and type."""
    w = Window.partitionBy("feed", "path", "type").orderBy("ix")
    in_order = footers.join(files, ["feed", "run_no"])
    gap = F.when(F.col("ix") - F.lag("ix").over(w) == 1, 0).otherwise(1)
    return (
        in_order.withColumn("starts", gap).withColumn("island", F.sum("starts").over(w))
        .groupBy("feed", "path", "type", "island")
        .agg(F.min("ix").alias("start_ix"), F.max("ix").alias("end_ix"), F.min("run_no").alias("first_run"), F.max("run_no").alias("last_run"), F.max("last_ix").alias("last_ix"), F.sum("n").alias("n_values"))
    )


def events(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Starts after the first file and ends before the last, as new, gone or retyped fields of a run."""
    starts = spans.filter(F.col("start_ix") > 1).select("feed", F.col("start_ix").alias("ix"), "path", F.col("type").alias("new_type"), F.lit(None).cast("string").alias("old_type"))
    ends = spans.filter(F.col("end_ix") < F.col("last_ix")).select("feed", (F.col("end_ix") + 1).alias("ix"), "path", F.lit(None).cast("string").alias("new_type"), F.col("type").alias("old_type"))
    both = starts.unionByName(ends).groupBy("feed", "ix", "path").agg(F.max("new_type").alias("new_type"), F.max("old_type").alias("old_type"))
    event = F.when(F.col("new_type").isNull(), "gone").when(F.col("old_type").isNull(), "new").otherwise("retyped")
    return both.withColumn("event", event).join(files.select("feed", "ix", "run_no", "prev_run"), ["feed", "ix"])


def renames(lines: DataFrame, raw: DataFrame, happened: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Pairs of a gone and a new field that hold the same values for more than ``min_share`` of the products with both."""
    one_sided = happened.filter(F.col("event") != "retyped")
    both = one_sided.groupBy("feed", F.col("run_no").alias("at_run")).agg(F.countDistinct("event").alias("sides")).filter("sides = 2").drop("sides")
    changed = one_sided.select(
        "feed", F.col("run_no").alias("at_run"), F.when(F.col("event") == "gone", F.col("prev_run")).otherwise(F.col("run_no")).alias("run_no"), "path", "event"
    ).join(both, ["feed", "at_run"])
    wanted = changed.groupBy("feed", "run_no").agg(F.collect_list(F.struct("path", "at_run", "event")).alias("wanted"))  # as many as fields changed in one file
    of_file = wanted.join(headers(raw), ["feed", "run_no"], "left")
    rows = with_files(placed(lines).filter(F.col("payload").isNotNull() & ~is_header()), of_file)
    once = rows.select("feed", "payload", "fmt", "header", "wanted").mapInArrow(wanted_values, VALUE).withColumn("value", F.xxhash64("value"))  # only equality counts: long texts needn't be shuffled
    once = once.groupBy("feed", "at_run", "rec_id", "path", "event").agg(F.max("value").alias("value"))
    fields = once.groupBy("feed", "at_run", "rec_id").agg(  # as many entries as fields changed in one file, whatever the rows
        F.collect_list(F.when(F.col("event") == "gone", F.struct("path", "value"))).alias("olds"),
        F.collect_list(F.when(F.col("event") == "new", F.struct("path", "value"))).alias("news"),
    )
    pairs = (
        fields.filter((F.size("olds") > 0) & (F.size("news") > 0))
        .withColumn("o", F.explode("olds")).withColumn("n", F.explode("news"))
        .groupBy("feed", "at_run", F.col("o.path").alias("old_path"), F.col("n.path").alias("new_path"))
        .agg(F.count(F.lit(1)).alias("both"), F.sum((F.col("o.value") == F.col("n.value")).cast("int")).alias("equal"))
    )
    leaf = F.element_at(F.split("old_path", r"\."), -1) == F.element_at(F.split("new_path", r"\."), -1)
    fit = pairs.filter(F.col("equal") > min_share * F.col("both")).withColumn("rank", F.struct(F.col("equal") / F.col("both"), leaf.cast("int"), "equal"))
    of = lambda side, tie: Window.partitionBy("feed", "at_run", side).orderBy(F.desc("rank"), tie)
    return (
        fit.withColumn("a", F.row_number().over(of("old_path", "new_path"))).withColumn("b", F.row_number().over(of("new_path", "old_path")))
        .filter((F.col("a") == 1) & (F.col("b") == 1)).select("feed", F.col("at_run").alias("run_no"), "old_path", "new_path", "both", "equal")
    )


def history(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(raw footers, files, footers, events) of all feeds: metadata only."""
    raw, files = counted(lines), store(runs(lines))
    footers = store(catalogue(raw))
    return raw, files, footers, store(events(lifespans(footers, files), files))


def changes(lines: DataFrame) -> DataFrame:
    """Report of every change of a field between a run and the feed's next lower run present."""
    raw, _, _, happened = history(lines)
    pairs = store(renames(lines, raw, happened))
    roles = pairs.select("feed", "run_no", F.explode(F.array("old_path", "new_path")).alias("path"))
    rest = happened.join(roles, ["feed", "run_no", "path"], "left_anti")
    kind = F.when(F.col("event") == "gone", "removed").when(F.col("event") == "new", "added").otherwise("retyped")
    return pairs.select("feed", "run_no", F.lit("renamed").alias("change_kind"), "old_path", "new_path").unionByName(
        rest.select(
            "feed", "run_no", kind.alias("change_kind"),
            F.when(F.col("event") == "new", "").otherwise(F.col("path")).alias("old_path"), F.when(F.col("event") == "gone", "").otherwise(F.col("path")).alias("new_path"),
        )
    )
