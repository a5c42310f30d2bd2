"""Queries of the general problems (1, 4, 5, 6) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daram.operators import drift, nested, orphans, packed, unify
from daram.session import read, store


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(read(spark, d, "batch_export"))


def p1_lifespans(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "batch_export")
    return drift.lifespans(drift.catalogue(drift.counted(lines)), drift.runs(lines)).select("feed", "path", "type", "first_run", "last_run", "n_values")


# The alias table: names that producers give a field first, the one name it has in the consistent table, and its type. Identifiers are strings.
_TERM_NAMES = {"insuTerm": "insu_term", "payTerm": "pay_term", "ageRange": "age_range", "renew": "renew", "specialNotes": "special_notes", "validationSource": "validation_source"}
ALIASES = [
    ("insuCd", "code", "string"), ("CODE", "code", "string"), ("MAIN_CODE", "main_code", "string"), ("PERIOD_VALUE", "period_value", "bigint"), ("LIMIT_AMT", "limit_amt", "bigint"),
    ("PAY_TERM", "pay_term", "string"), ("PERIOD_LABEL", "insu_term", "string"), ("filename", "file_name", "string"), ("SRC_FILE", "file_name", "string"), ("traceNo", "trace_no", "string"), ("traceId", "trace_no", "string"),
    ("success", "success", "boolean"), ("python.success", "success", "boolean"), ("ocr.success", "ocr_success", "boolean"), ("method", "method", "string"), ("ocr.method", "ocr_method", "string"), ("confidence", "confidence", "double"),
    ("pageCount", "page_count", "bigint"), ("analysis.pageCount", "page_count", "bigint"), ("best.codesCount", "codes_count", "bigint"), ("isRenewable", "is_renewable", "boolean"),
    *((f"{branch}terms.{f}", prefix + name, "string") for branch, prefix in (("", ""), ("python.", ""), ("ocr.", "ocr_")) for f, name in _TERM_NAMES.items()),
]


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(None, *a) for a in ALIASES], "feed string, path string, canonical string, cast string")


def p1_aliases(spark: SparkSession, d: str) -> DataFrame:
    return unify.names(read(spark, d, "batch_export"), _aliases(spark))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of all records, with typed columns."""
    return unify.records(read(spark, d, "batch_export"), _aliases(spark))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the consistent table holds per file: records, values (read or not) and entries of codes. Nothing of the lines may be missing."""
    rows = p1_records(spark, d)
    fields = [c for c in rows.columns if c not in unify.OWN]
    given = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in fields), F.lit(0)) + F.size("unread")
    return rows.groupBy("feed", "run_no").agg(F.count(F.lit(1)).alias("n_records"), F.sum(given).alias("n_values"), F.sum(F.size("codes")).alias("n_codes"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, orphans.Verdicts]:
    log, pattern, example = (read(spark, d, t) for t in ("correction_log", "learned_pattern", "few_shot_example"))
    refs = (
        orphans.references(pattern, "learned_pattern", "pattern_id", "learned_from_log_id", "correction_log", resent=False)  # pattern_id is unique
        .unionByName(orphans.references(example, "few_shot_example", "example_id", "source_log_id", "correction_log"))
        .unionByName(orphans.references(example, "few_shot_example", "example_id", "related_pattern_id", "learned_pattern"))
    )
    alive = orphans.existing({"correction_log": (log, "log_id"), "learned_pattern": (pattern, "pattern_id")})
    return refs, orphans.settle(refs, alive, orphans.removed(read(spark, d, "deleted_key")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.judge(*_references(spark, d)).select("table_name", "row_id", "field_name", "orphan_kind")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(*_references(spark, d))


def _packed_texts(spark: SparkSession, d: str) -> DataFrame:
    uw, parsed = read(spark, d, "uw_code_mapping"), read(spark, d, "parse_result")
    return (
        uw.select(F.col("map_id").alias("row_id"), F.explode(F.array(*(F.struct(F.lit(c).alias("source"), F.col(c).alias("text")) for c in ("pay_term", "entry_age_m")))).alias("t"))
        .select("row_id", "t.source", "t.text")
        .unionByName(parsed.select(F.col("parse_id").alias("row_id"), F.lit("terms.payTerm").alias("source"), F.col("terms.payTerm").alias("text")))
    )


def _unpacked(spark: SparkSession, d: str, at_least: int = 1) -> DataFrame:
    table = F.when(F.col("source") == "terms.payTerm", "parse_result").otherwise("uw_code_mapping")
    return packed.unpack(_packed_texts(spark, d), ("pay_term", "terms.payTerm"), at_least).select(table.alias("table_name"), "row_id", F.col("source").alias("field_name"), "pos", "item_value", "flags")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return _unpacked(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts with two or more values; the operator sees all values of a text at once, so nothing is shuffled."""
    return _unpacked(spark, d, at_least=2).drop("flags")


def _tree(spark: SparkSession, d: str, keep: str) -> DataFrame:
    """The values a table needs, labelled and written once: links compare labels of one reading."""
    return store(nested.nodes(read(spark, d, "hybrid_result"), keep=keep))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes(read(spark, d, "hybrid_result"), only_nodes=True).select("rec_id", "node_path", "parent_path")


def p6_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that are no JSON objects, with the reason."""
    return nested.errors(read(spark, d, "hybrid_result"))


_ENTRY = r"codes(\.\*|\[\])"


def p6_riders(spark: SparkSession, d: str) -> DataFrame:
    """Riders with the code entry whose interval contains theirs."""
    tree = _tree(spark, d, rf".*{_ENTRY}(\.riders\[\](\.(code|name))?)?")
    riders = nested.flat(tree, rf".*{_ENTRY}\.riders\[\]", {"code": "string", "name": "string"})
    entries = tree.filter(F.col("is_node") & F.col("shape").rlike(rf"{_ENTRY}$"))
    return nested.contained(entries, riders, ["node_path"]).select("rec_id", "node_path", F.col("p_node_path").alias("entry_path"), "code", "name")


def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants with the rider whose interval contains theirs, and the limit theirs contains."""
    tree = _tree(spark, d, r".*\.riders\[\](\..*)?")
    variants = nested.flat(tree, r".*\.variants\[\]", {"type": "string", "code": "string"})
    limits = nested.flat(tree, r".*\.variants\[\]\.limit", {"max": "bigint", "unit": "string"})
    riders = tree.filter((F.col("kind") == "object") & F.col("shape").rlike(r"\.riders\[\]$"))
    limit = nested.contained(variants, limits, ["pre"], levels=1).select("doc", F.col("p_pre").alias("pre"), F.col("max").alias("limit_max"), F.col("unit").alias("limit_unit"))
    held = nested.contained(riders, variants, ["node_path"], how="left")
    return held.join(limit, ["doc", "pre"], "left").select("rec_id", "pre", "post", "node_path", F.col("p_node_path").alias("rider_path"), "type", "code", "limit_max", "limit_unit")


def p6_attempts(spark: SparkSession, d: str) -> DataFrame:
    tree = nested.nodes(read(spark, d, "hybrid_result"), keep=r"attempts\[\](\.(no|method))?")
    return nested.flat(tree, r"attempts\[\]", {"no": "int", "method": "string"}).select("rec_id", "pre", "post", "node_path", "parent_path", "no", "method")


def p6_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors with the attempt whose interval contains them."""
    tree = _tree(spark, d, r"attempts\[\](\.errors\[\](\.(page|msg))?)?")
    errors = nested.flat(tree, r"attempts\[\]\.errors\[\]", {"page": "string", "msg": "string"})
    attempts = tree.filter(F.col("is_node") & (F.col("shape") == "attempts[]"))
    return nested.contained(attempts, errors, ["pre", "node_path"], levels=2).select("rec_id", "pre", "post", "node_path", F.col("p_pre").alias("attempt_pre"), F.col("p_node_path").alias("attempt_path"), F.col("page").try_cast("int").alias("page"), "msg")


def p6_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of code entries, one row each with its position, from 1, and the entry that holds it."""
    pages = nested.nodes(read(spark, d, "hybrid_result"), keep=rf".*{_ENTRY}\.pages(\[\])?").filter(F.col("value").isNotNull())
    pos = F.coalesce(F.regexp_extract("node_key", r"^\[(\d+)\]$", 1).try_cast("int") + 1, F.lit(1))
    return pages.select("rec_id", "pre", "node_path", F.col("parent_pre").alias("entry_pre"), F.col("parent_path").alias("entry_path"), pos.alias("pos"), F.col("value").try_cast("int").alias("page"))


def p6_branches(spark: SparkSession, d: str) -> DataFrame:
    """Branches of each record with what they say of themselves; the flags of terms are those of the analysis, whose interval contains theirs."""
    own, flags = ("success", "method", "insuCd", "codes_count"), ("insuTerm", "payTerm", "ageRange", "renew")
    tree = _tree(spark, d, rf"[^.\[\]]+(\.({'|'.join(own)}))?|analysis\.terms(\.({'|'.join(flags)}))?")
    branches = nested.flat(tree, r"[^.\[\]]+", {"success": "boolean", "method": "string", "insuCd": "string", "codes_count": "bigint"})
    terms = nested.contained(branches, nested.flat(tree, r"analysis\.terms", dict.fromkeys(flags, "boolean")), ["pre"], levels=1).select("doc", F.col("p_pre").alias("pre"), *(F.col(c).alias(f"has_{c}") for c in flags))
    return branches.join(terms, ["doc", "pre"], "left").select("rec_id", "pre", "post", F.col("node_path").alias("branch"), "success", "method", "insuCd", "codes_count", *(f"has_{c}" for c in flags))


def p6_ages(spark: SparkSession, d: str) -> DataFrame:
    """Age ranges in their three shapes (``form``): lists, objects of payment terms and sexes, and whole texts, which are kept as they are. Each has the entry that holds it: that of the list, the payment term's object, or the terms.

    ``text`` is the value of an object or a text; one of an object that isn't two numbers with ~ between has no ``age_from`` and ``age_to``.
    """
    tree = _tree(spark, d, r".*\.ageRange([.\[].*)?")
    listed = nested.flat(tree, r".*\.ageRange\[\]\.ages\[\]", {"sex": "string", "from": "int", "to": "int"})
    entries = nested.flat(tree, r".*\.ageRange\[\]", {"pay": "string"})
    lists = nested.contained(entries, listed, ["pay", "node_path"], levels=2).select("rec_id", "node_path", F.col("p_node_path").alias("entry_path"), F.lit("list").alias("form"), F.col("p_pay").alias("pay"), "sex", F.col("from").alias("age_from"), F.col("to").alias("age_to"), F.lit(None).cast("string").alias("text"))
    ranges = tree.filter(F.col("shape").rlike(r"\.ageRange$") & (F.col("kind") == "object"))
    pays = nested.contained(ranges, tree.filter("kind = 'object'"), [], levels=1)
    sexes = nested.contained(pays, tree.filter("value IS NOT NULL"), ["node_key", "node_path"], levels=1)
    number = lambda i: F.regexp_extract("value", r"^\D*(\d+)\D*~\D*(\d+)\D*$", i).try_cast("int")
    objects = sexes.select("rec_id", "node_path", F.col("p_node_path").alias("entry_path"), F.lit("object").alias("form"), F.col("p_node_key").alias("pay"), F.col("node_key").alias("sex"), number(1).alias("age_from"), number(2).alias("age_to"), F.col("value").alias("text"))
    nothing = F.lit(None)
    texts = tree.filter(F.col("shape").rlike(r"\.ageRange$") & (F.col("kind") == "string")).select("rec_id", "node_path", F.col("parent_path").alias("entry_path"), F.lit("text").alias("form"), nothing.cast("string").alias("pay"), nothing.cast("string").alias("sex"), nothing.cast("int").alias("age_from"), nothing.cast("int").alias("age_to"), F.col("value").alias("text"))
    return lists.unionByName(objects).unionByName(texts)


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of code lists in either shape, with the branch whose interval contains them; a bare text is the name."""
    tree = _tree(spark, d, rf"[^.\[\]]+|.*{_ENTRY}(\.(code|name))?")
    named = nested.flat(tree, r".*codes(?:\.\*|\[\])", {"code": "string", "name": "string"}).select("doc", "pre", F.col("code").alias("own_code"), "name")
    entries = tree.filter(F.col("is_node") & F.col("shape").rlike(rf"{_ENTRY}$")).select("rec_id", "doc", "pre", "post", "depth", "node_path", "kind", "node_key", "value")
    branches = tree.filter("is_node AND depth = 1").select("doc", "pre", "post", "depth", F.col("node_key").alias("branch"))
    held = nested.contained(branches, entries, ["branch"])
    code = F.coalesce("own_code", F.when(~F.col("node_key").startswith("["), F.col("node_key")))
    return held.join(named, ["doc", "pre"], "left").select("rec_id", "node_path", F.col("p_branch").alias("branch"), "kind", code.alias("code"), F.coalesce("name", "value").alias("name"))


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each branch as one flat row; ``ageRange`` where it is a text, its other shapes are in p6_ages."""
    fields = ("insuTerm", "payTerm", "ageRange", "renew", "specialNotes")
    tree = nested.nodes(read(spark, d, "hybrid_result"), keep=rf"(python|ocr|best)\.terms(\.({'|'.join(fields)}))?")
    return nested.flat(tree, r"(?:python|ocr|best)\.terms", dict.fromkeys(fields, "string")).select("rec_id", "node_path", F.col("parent_path").alias("branch"), *fields)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_lifespans, p1_aliases, p1_records, p1_totals, p4_found, p4_report, p5_found, p5_values, p6_found, p6_unreadable, p6_entries, p6_terms, p6_riders, p6_variants, p6_attempts, p6_errors, p6_pages, p6_branches, p6_ages)}


# Fields of every file: JSON values that are no objects, outside of arrays and of what is named codes; CSV cells by the place of their name in the header.
_FIELDS = """
WITH b AS (SELECT feed, run_no, line_no, payload, file_name LIKE '%.csv' OR feed LIKE '%_mapping' AS csv FROM batch_export WHERE feed IS NOT NULL AND run_no IS NOT NULL),
files AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY run_no) AS ix FROM (SELECT DISTINCT feed, run_no FROM b)),
cells AS (SELECT feed, run_no, line_no, list_transform(regexp_extract_all(',' || payload, ',("(?:[^"]|"")*"|[^,]*)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS c FROM b WHERE csv AND payload IS NOT NULL),
heads AS (SELECT feed, run_no, max(c) AS h FROM cells WHERE line_no = 0 GROUP BY 1, 2),
csv_values AS (SELECT feed, run_no, h[i] AS path, c[i] AS v FROM (SELECT feed, run_no, h, c, unnest(range(1, len(h) + 1)) AS i FROM cells JOIN heads USING (feed, run_no) WHERE line_no IS DISTINCT FROM 0) WHERE c[i] <> ''),
json_values AS (SELECT feed, run_no, substr(replace(j.fullkey, '"', ''), 3) AS path, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type
    FROM (SELECT * FROM b WHERE NOT csv AND json_valid(payload) AND json_type(payload) = 'OBJECT') b, json_tree(payload) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.fullkey, '[') AND NOT contains(replace(j.fullkey, '"', '') || '.', '.codes.')),
footers AS (SELECT feed, run_no, path, CASE WHEN bool_and(regexp_full_match(v, '[0-9]+')) THEN 'number' ELSE 'string' END AS type, count(*) AS n FROM csv_values GROUP BY 1, 2, 3
    UNION ALL SELECT feed, run_no, path, arg_max(type, {'n': k, 't': type}), CAST(sum(k) AS BIGINT) FROM (SELECT feed, run_no, path, type, count(*) AS k FROM json_values GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
islands AS (SELECT *, ix - row_number() OVER (PARTITION BY feed, path, type ORDER BY ix) AS island FROM footers JOIN files USING (feed, run_no))
"""


# Every JSON value with its parent; the keys of nodes by their places, without quotes.
_JSON = """
WITH t AS (SELECT rec_id, j.id, j.parent, j.key, j.type AS kind, json_extract_string(j.value, '$') AS text, j.value AS value, substr(replace(j.fullkey, '"', ''), 3) AS f
    FROM (SELECT * FROM hybrid_result WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'), json_tree(payload) j)
"""
# The same with interval labels: of a value that is the i-th of its record, from 0, at a depth, pre is 2 i - depth; post follows from the number of values below.
_LABELS = """
WITH RECURSIVE j AS (SELECT rec_id, j.id, j.parent, j.key, j.type AS kind, json_extract_string(j.value, '$') AS text, j.value AS value, substr(replace(j.fullkey, '"', ''), 3) AS f, row_number() OVER (PARTITION BY rec_id ORDER BY j.id) - 1 AS i
    FROM (SELECT * FROM hybrid_result WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'), json_tree(payload) j),
up AS (SELECT rec_id, id, id AS above, 0 AS steps FROM j UNION ALL SELECT u.rec_id, u.id, p.parent, u.steps + 1 FROM up u JOIN j p ON p.rec_id = u.rec_id AND p.id = u.above WHERE p.parent IS NOT NULL),
d AS (SELECT rec_id, id, max(steps) AS depth FROM up GROUP BY 1, 2), n AS (SELECT rec_id, above AS id, count(*) AS n FROM up GROUP BY 1, 2),
t AS (SELECT j.*, depth, CAST(2 * i - depth AS INT) AS pre, CAST(2 * i - depth + 2 * n - 1 AS INT) AS post FROM j JOIN d USING (rec_id, id) JOIN n USING (rec_id, id))
"""
_KIND = "CASE {0} WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"


_REFS = """
WITH log AS (SELECT log_id AS k, min(created_at) AS since FROM correction_log WHERE log_id IS NOT NULL GROUP BY 1),
pat AS (SELECT pattern_id AS k, min(created_at) AS since FROM learned_pattern WHERE pattern_id IS NOT NULL GROUP BY 1),
gone AS (SELECT DISTINCT table_name AS t, key_id AS k FROM deleted_key),
known AS (SELECT 'correction_log' AS t, * FROM log UNION ALL SELECT 'learned_pattern', * FROM pat),
refs AS (
  SELECT 'learned_pattern' AS table_name, pattern_id AS row_id, 'learned_from_log_id' AS field_name, 'correction_log' AS t, min(learned_from_log_id) AS k, min(created_at) AS ref_at FROM learned_pattern WHERE learned_from_log_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'few_shot_example', example_id, 'source_log_id', 'correction_log', min(source_log_id), min(created_at) FROM few_shot_example WHERE source_log_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'few_shot_example', example_id, 'related_pattern_id', 'learned_pattern', min(related_pattern_id), min(created_at) FROM few_shot_example WHERE related_pattern_id IS NOT NULL GROUP BY 2),
judged AS (
  SELECT table_name, row_id, field_name, ref_at,
    CASE WHEN known.k IS NOT NULL THEN CASE WHEN known.since > ref_at THEN 'late' END WHEN gone.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind
  FROM refs LEFT JOIN known ON known.t = refs.t AND known.k = refs.k LEFT JOIN gone ON gone.t = refs.t AND gone.k = refs.k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_terms": " UNION ALL ".join(f"""SELECT rec_id, '{b}.terms' AS node_path, '{b}' AS branch, json_extract_string(t, '$.insuTerm') AS "insuTerm", json_extract_string(t, '$.payTerm') AS "payTerm", CASE WHEN json_type(t, '$.ageRange') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN json_extract_string(t, '$.ageRange') END AS "ageRange", json_extract_string(t, '$.renew') AS renew, json_extract_string(t, '$.specialNotes') AS "specialNotes"
            FROM (SELECT rec_id, json_extract(payload, '$.{b}.terms') AS t FROM hybrid_result) WHERE json_type(t) = 'OBJECT'""" for b in ("python", "ocr", "best")),
        "p1_lifespans": _FIELDS + "SELECT feed, path, type, min(run_no) AS first_run, max(run_no) AS last_run, CAST(sum(n) AS BIGINT) AS n_values FROM islands GROUP BY feed, path, type, island",
        "p1_totals": _FIELDS.replace("FROM batch_export WHERE", "FROM (SELECT feed, run_no, line_no, max(file_name) AS file_name, max(payload) AS payload FROM batch_export GROUP BY 1, 2, 3) WHERE") + """,
            n AS (SELECT feed, run_no, count(*) AS n_records FROM b WHERE NOT (csv AND line_no = 0) GROUP BY 1, 2), v AS (SELECT feed, run_no, sum(n) AS n FROM footers GROUP BY 1, 2),
            k AS (SELECT feed, run_no, count(*) AS n FROM (SELECT * FROM b WHERE NOT csv AND json_valid(payload) AND json_type(payload) = 'OBJECT') b, json_tree(payload) j WHERE regexp_matches(replace(j.path, '"', ''), '\\.codes$') AND NOT contains(j.fullkey, '[') AND length(replace(j.path, '"', '')) - length(replace(replace(j.path, '"', ''), '.codes', '')) = 6 GROUP BY 1, 2)
            SELECT feed, run_no, n_records, CAST(coalesce(v.n, 0) AS BIGINT) AS n_values, CAST(coalesce(k.n, 0) AS BIGINT) AS n_codes FROM n LEFT JOIN v USING (feed, run_no) LEFT JOIN k USING (feed, run_no)""",
        "p6_attempts": _LABELS + """SELECT t.rec_id, t.pre, t.post, t.f AS node_path, '' AS parent_path, try_cast(json_extract_string(t.value, '$.no') AS INT) AS no, json_extract_string(t.value, '$.method') AS method
            FROM t JOIN t a ON a.rec_id = t.rec_id AND a.id = t.parent WHERE a.f = 'attempts' AND a.kind = 'ARRAY' AND t.kind = 'OBJECT'""",
        "p6_errors": _LABELS + """SELECT e.rec_id, e.pre, e.post, e.f AS node_path, t.pre AS attempt_pre, t.f AS attempt_path, try_cast(json_extract_string(e.value, '$.page') AS INT) AS page, json_extract_string(e.value, '$.msg') AS msg
            FROM t e JOIN t l ON l.rec_id = e.rec_id AND l.id = e.parent JOIN t ON t.rec_id = e.rec_id AND t.id = l.parent JOIN t a ON a.rec_id = e.rec_id AND a.id = t.parent WHERE e.kind = 'OBJECT' AND l.key = 'errors' AND a.f = 'attempts' AND t.kind = 'OBJECT'""",
        "p6_pages": _LABELS + """SELECT p.rec_id, p.pre, p.f AS node_path, e.pre AS entry_pre, e.f AS entry_path, CAST(regexp_extract(p.f, '([0-9]+)\\]$', 1) AS INT) + 1 AS pos, try_cast(p.text AS INT) AS page
            FROM t p JOIN t l ON l.rec_id = p.rec_id AND l.id = p.parent JOIN t e ON e.rec_id = p.rec_id AND e.id = l.parent JOIN t c ON c.rec_id = p.rec_id AND c.id = e.parent WHERE l.key = 'pages' AND l.kind = 'ARRAY' AND c.key = 'codes' AND p.kind NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
        "p6_variants": _LABELS + """SELECT v.rec_id, v.pre, v.post, v.f AS node_path, r.f AS rider_path, json_extract_string(v.value, '$.type') AS type, json_extract_string(v.value, '$.code') AS code, try_cast(json_extract_string(v.value, '$.limit.max') AS BIGINT) AS limit_max, json_extract_string(v.value, '$.limit.unit') AS limit_unit
            FROM t v JOIN t l ON l.rec_id = v.rec_id AND l.id = v.parent JOIN t r ON r.rec_id = v.rec_id AND r.id = l.parent JOIN t a ON a.rec_id = v.rec_id AND a.id = r.parent WHERE v.kind = 'OBJECT' AND l.key = 'variants' AND a.key = 'riders'""",
        "p6_branches": _LABELS + """SELECT rec_id, pre, post, f AS branch, try_cast(json_extract_string(value, '$.success') AS BOOLEAN) AS success, json_extract_string(value, '$.method') AS method, json_extract_string(value, '$.insuCd') AS "insuCd", try_cast(json_extract_string(value, '$.codes_count') AS BIGINT) AS codes_count, """
        + ", ".join(f"""CASE WHEN f = 'analysis' THEN try_cast(json_extract_string(value, '$.terms.{x}') AS BOOLEAN) END AS "has_{x}\"""" for x in ("insuTerm", "payTerm", "ageRange", "renew")) + " FROM t WHERE depth = 1 AND kind = 'OBJECT'",
        "p6_riders": _JSON + """SELECT r.rec_id, r.f AS node_path, e.f AS entry_path, json_extract_string(r.value, '$.code') AS code, json_extract_string(r.value, '$.name') AS name
            FROM t r JOIN t a ON a.rec_id = r.rec_id AND a.id = r.parent JOIN t e ON e.rec_id = r.rec_id AND e.id = a.parent JOIN t c ON c.rec_id = r.rec_id AND c.id = e.parent
            WHERE r.kind = 'OBJECT' AND a.kind = 'ARRAY' AND a.key = 'riders' AND e.kind = 'OBJECT' AND c.key = 'codes'""",
        "p6_entries": _JSON + f"""SELECT e.rec_id, e.f AS node_path, b.key AS branch, {_KIND.format('e.kind')} AS kind, coalesce(CASE WHEN e.kind = 'OBJECT' THEN json_extract_string(e.value, '$.code') END, CASE WHEN c.kind = 'OBJECT' THEN e.key END) AS code,
            CASE WHEN e.kind = 'OBJECT' THEN json_extract_string(e.value, '$.name') WHEN e.kind NOT IN ('ARRAY', 'NULL') THEN e.text END AS name
            FROM t e JOIN t c ON c.rec_id = e.rec_id AND c.id = e.parent JOIN t b ON b.rec_id = e.rec_id AND b.kind = 'OBJECT' AND b.f NOT LIKE '%.%' AND starts_with(e.f, b.f || '.') AND b.f <> ''
            WHERE c.key = 'codes' AND (c.kind = 'OBJECT' OR c.kind = 'ARRAY' AND e.kind = 'OBJECT')""",
        "p6_ages": _JSON + """, range AS (SELECT * FROM t WHERE key = 'ageRange' AND f LIKE '%.ageRange')
            SELECT s.rec_id, s.f AS node_path, e.f AS entry_path, 'list' AS form, json_extract_string(e.value, '$.pay') AS pay, json_extract_string(s.value, '$.sex') AS sex, try_cast(json_extract_string(s.value, '$.from') AS INT) AS age_from, try_cast(json_extract_string(s.value, '$.to') AS INT) AS age_to, NULL AS text
            FROM t s JOIN t l ON l.rec_id = s.rec_id AND l.id = s.parent JOIN t e ON e.rec_id = s.rec_id AND e.id = l.parent JOIN range r ON r.rec_id = s.rec_id AND r.id = e.parent
            WHERE s.kind = 'OBJECT' AND l.key = 'ages' AND l.kind = 'ARRAY' AND e.kind = 'OBJECT' AND r.kind = 'ARRAY'
            UNION ALL SELECT s.rec_id, s.f, e.f, 'object', e.key, s.key, try_cast(nullif(regexp_extract(s.text, '^[^0-9]*([0-9]+)[^0-9]*~[^0-9]*([0-9]+)[^0-9]*$', 1), '') AS INT), try_cast(nullif(regexp_extract(s.text, '^[^0-9]*([0-9]+)[^0-9]*~[^0-9]*([0-9]+)[^0-9]*$', 2), '') AS INT), s.text
            FROM t s JOIN t e ON e.rec_id = s.rec_id AND e.id = s.parent JOIN range r ON r.rec_id = s.rec_id AND r.id = e.parent WHERE s.kind NOT IN ('OBJECT', 'ARRAY', 'NULL') AND e.kind = 'OBJECT' AND r.kind = 'OBJECT'
            UNION ALL SELECT r.rec_id, r.f, p.f, 'text', NULL, NULL, NULL, NULL, r.text FROM range r JOIN t p ON p.rec_id = r.rec_id AND p.id = r.parent WHERE r.kind = 'VARCHAR'""",
        "p6_found": """WITH t AS (SELECT rec_id, j.type AS kind, replace(j.fullkey, '"', '') AS f, replace(j.path, '"', '') AS up FROM (SELECT * FROM hybrid_result WHERE payload IS NOT NULL), json_tree(payload) j)
            SELECT rec_id, substr(f, 3) AS node_path, coalesce(nullif(substr(regexp_replace(f, '\\.[^.]*$', ''), 3), ''), '') AS parent_path
            FROM t WHERE f <> '$' AND (kind = 'OBJECT' OR (regexp_matches(up, '[.]codes$') AND NOT regexp_matches(f, '\\]$')))""",
        "p4_found": _REFS + "SELECT table_name, row_id, field_name, orphan_kind FROM judged WHERE orphan_kind IS NOT NULL",
        "p4_report": _REFS + """SELECT table_name, field_name, strftime(ref_at, '%Y-%m') AS period, count(*) AS n_references,
            count(*) FILTER (orphan_kind = 'missing') AS n_missing, count(*) FILTER (orphan_kind = 'deleted') AS n_deleted, count(*) FILTER (orphan_kind = 'late') AS n_late
            FROM judged GROUP BY 1, 2, 3""",
    }
