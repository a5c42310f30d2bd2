"""Problem 6: deeply nested records to flat node tables with parent-child links.

Every value of a record gets interval labels by one depth-first walk: ``pre`` when it is entered and
``post`` when it is left, so that a node lies inside another exactly if its interval does. The
node tables are cut out by type and linked by containment of the intervals; no path is compared.

Defined results:
* null payloads and payloads that aren't JSON objects give no nodes (``errors`` names the latter);
* an empty object gives only the record's own row; equal keys in an object: the last counts;
* depth isn't bounded: what the JSON reader's own recursion can't take, a loop reads;
* every row is a record of its own (``doc``, given when the row is read), also with a repeated or null rec_id; nodes are linked
  within ``doc`` only, so a tree that several steps read must be written once (``store``).
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daram.session import ship

BATCH_CHARS = 16_000_000
_NODE = pa.schema([
    ("rec_id", pa.int64()), ("doc", pa.int64()), ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("node_key", pa.string()),
    ("node_path", pa.string()), ("parent_pre", pa.int32()), ("parent_path", pa.string()), ("is_node", pa.bool_()), ("value", pa.string()), ("shape", pa.string()),
])
NODE = "rec_id bigint, doc bigint, pre int, post int, depth int, kind string, node_key string, node_path string, parent_pre int, parent_path string, is_node boolean, value string, shape string"


def _kind(v) -> str:
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    if v is None:
        return "null"
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"


_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_SPACE = re.compile(r"[ \t\n\r]*")


def read_json(text: str):
    """The value of a JSON text. Nesting deeper than the reader's recursion is read by ``_read_deep``."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str):
    """JSON by a loop: a stack of open containers, each with the key that waits for a value."""
    at = _SPACE.match(text).end()
    stack: list = []

    def fail():
        raise ValueError(f"no JSON at character {at}")

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def key_at(i: int) -> tuple[str, int]:
        nonlocal at
        at = i
        if text[i : i + 1] != '"':
            fail()
        key, i = scanstring(text, i + 1, True)
        at = i = skip(i)
        if text[i : i + 1] != ":":
            fail()
        return key, skip(i + 1)

    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            value = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            elif c == "{":
                key, at = key_at(at)
                stack.append((value, key))
                continue
            else:
                stack.append((value, None))
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _SCALAR.match(text, at):
            value, at = json.loads(m.group()), m.end()
        else:
            fail()
        while True:  # the value is whole: give it to what holds it, close what ends here
            at = skip(at)
            if not stack:
                if at != len(text):
                    fail()
                return value
            holder, key = stack.pop()
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if key is not None:
                    key, at = key_at(at)
                stack.append((holder, key))
                break
            if c != ("]" if key is None else "}"):
                fail()
            at += 1
            value = holder


def label(record: dict) -> list[list]:
    """[pre, post, depth, kind, key, path, is_node, value, shape] of every value, in pre-order. A loop, so depth is no matter.

    ``shape`` is the path without array places and with the keys of ``codes`` as ``*``: the type of the node.
    """
    out: list[list] = []
    clock = 0
    stack: list = [("", "", "", record, 0, False)]
    while stack:
        top = stack.pop()
        if len(top) == 1:
            out[top[0]][1] = clock
            clock += 1
            continue
        key, path, shape, value, depth, entry = top
        kind = _kind(value)
        place = len(out)
        text = None if kind in ("object", "array", "null") else value if kind == "string" else json.dumps(value)
        out.append([clock, clock, depth, kind, key, path, depth > 0 and (kind == "object" or entry), text, shape])
        clock += 1
        stack.append((place,))
        if kind == "object":
            codes = key == "codes" and depth > 0
            kids = [(k, f"{path}.{k}" if path else k, (f"{shape}." if shape else "") + ("*" if codes else k), v, depth + 1, codes) for k, v in value.items()]
        elif kind == "array":
            kids = [(f"[{i}]", f"{path}[{i}]", f"{shape}[]", v, depth + 1, False) for i, v in enumerate(value)]
        else:
            continue
        stack.extend(reversed(kids))
    return out


def enclosing(labels: list[list]) -> list[int]:
    """For each label the place of the nearest object whose interval contains it, -1 for the record, by one sweep over the intervals."""
    holders: list[int] = []
    out = []
    for i, (pre, post, _, kind, *_rest) in enumerate(labels):
        while holders and labels[holders[-1]][1] < pre:
            holders.pop()
        out.append(holders[-1] if holders else -1)
        if kind == "object":
            holders.append(i)
    return out


def walk(batches, only_nodes: bool = False, keep: str | None = None, only_errors: bool = False):
    """Arrow batches (rec_id, doc, payload) to labelled values; ``only_nodes`` leaves out values that are no nodes, ``keep`` those whose shape the pattern doesn't match as a whole."""
    wanted: dict[str, bool] = {}
    pattern = re.compile(keep) if keep else None

    def flush(rows: list) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [()] * len(_NODE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODE)], schema=_NODE)

    def is_wanted(shape: str) -> bool:
        if (known := wanted.get(shape)) is None:
            if len(wanted) > 100_000:
                wanted.clear()
            known = wanted[shape] = pattern is None or pattern.fullmatch(shape) is not None
        return known

    for batch in batches:
        rows: list[tuple] = []
        chars = 0
        for rec, doc, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if payload is None:
                continue
            try:
                record = read_json(payload)
                if not isinstance(record, dict):
                    raise ValueError("no object")
            except ValueError as e:
                rows.append((rec, doc, -1, -1, 0, "error", "", "", None, "", False, f"{type(e).__name__}: {e}"[:200], ""))
                continue
            if only_errors:
                continue
            labels = label(record)
            for (pre, post, depth, kind, key, path, node, value, shape), up in zip(labels, enclosing(labels)):
                if (node or not only_nodes) and is_wanted(shape):
                    rows.append((rec, doc, pre, post, depth, kind, key, path, labels[up][0] if up >= 0 else None, labels[up][5] if up >= 0 else "", node, value, shape))
                    chars += 2 * len(path) + len(value or "")
                    if chars > BATCH_CHARS:
                        yield flush(rows)
                        rows, chars = [], 0
        yield flush(rows)


def _walked(records: DataFrame, **options) -> DataFrame:
    ship(records.sparkSession)
    return records.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.monotonically_increasing_id().alias("doc"), "payload").mapInArrow(lambda batches: walk(batches, **options), NODE)


def nodes(records: DataFrame, only_nodes: bool = False, keep: str | None = None) -> DataFrame:
    """(rec_id, payload) to one row per JSON value (or node) with interval labels and its nearest enclosing object; ``keep``: only values whose shape matches."""
    return _walked(records, only_nodes=only_nodes, keep=keep).filter(F.col("kind") != "error")


def errors(records: DataFrame) -> DataFrame:
    """Payloads that could not be read."""
    return _walked(records, only_errors=True).filter(F.col("kind") == "error").select("rec_id", F.col("value").alias("error"))


def flat(tree: DataFrame, shape: str, fields: dict[str, str]) -> DataFrame:
    """Flat table of the objects whose ``shape`` matches the pattern, their scalar ``fields`` as columns.

    A field belongs to the object that directly encloses it, so one grouping by the object's label makes the row.
    """
    own = F.coalesce(F.when(F.col("kind") == "object", F.col("pre")), F.col("parent_pre"))
    holder = F.col("shape").rlike(f"^{shape}$") & (F.col("kind") == "object")
    child = F.col("shape").rlike(rf"^{shape}\.({'|'.join(fields)})$") & ~F.col("kind").isin("object", "array")
    found = tree.filter(holder | child).withColumn("own", F.when(holder, F.col("pre")).otherwise(own)).withColumn("leaf", F.when(child, F.element_at(F.split("shape", r"\."), -1)))
    picked = [F.max(F.when(F.col("leaf") == k, F.col("value"))).try_cast(t).alias(k) for k, t in fields.items()]
    of = lambda c: F.max(F.when(holder, F.col(c))).alias(c)
    return found.groupBy("doc", "own").agg(F.max("rec_id").alias("rec_id"), *(of(c) for c in ("pre", "post", "depth", "node_key", "node_path", "parent_pre", "parent_path")), *picked).drop("own").filter(F.col("pre").isNotNull())


def contained(parents: DataFrame, children: DataFrame, keep: list[str], levels: int | None = None, how: str = "inner") -> DataFrame:
    """Children with the parents whose interval contains theirs; the equality on ``doc`` bounds each comparison to one record."""
    p = parents.select(F.col("doc").alias("p_doc"), *[F.col(c).alias(f"p_{c}") for c in dict.fromkeys(["pre", "post", "depth", *keep])])
    inside = (children["doc"] == p["p_doc"]) & (children["pre"] > p["p_pre"]) & (children["post"] < p["p_post"])
    if levels is not None:
        inside &= children["depth"] == p["p_depth"] + levels
    return children.join(p, inside, how).select(children["*"], *[p[f"p_{c}"] for c in keep])
