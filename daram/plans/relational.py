"""Queries of lookups, joins, aggregations, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daram.functions import numbers
from daram.operators import relational as R
from daram.plans.registry import query
from daram.session import read

BIG = "bigint"
_TERMS = ("insuTerm", "payTerm", "ageRange", "renew")


def _logs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Correction logs, each once."""
    return read(spark, d, "correction_log").dropDuplicates(["log_id"])


_LOG = "(SELECT DISTINCT ON (log_id) * FROM correction_log)"


@query("""SELECT l_orderkey, l_linenumber, CAST((2 * c * q * 10000 + s * 1000000) // (2 * s * 1000000) AS BIGINT) AS amount FROM (
    SELECT l_orderkey, l_linenumber, CAST(round(p_retailprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q, CAST(p_size AS BIGINT) AS s FROM lineitem JOIN part ON p_partkey = l_partkey)""")
def exact_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Rate times amount over a base, rounded half up in integers."""
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    n = numbers.cents(F.col("p_retailprice")) * F.col("l_quantity").cast(BIG) * 10000
    return line.join(part, line.l_partkey == part.p_partkey).select("l_orderkey", "l_linenumber", numbers.half_up(n, F.col("p_size").cast(BIG) * 1_000_000).alias("amount"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_found, max(l_partkey) AS l_partkey, CASE WHEN count(l_orderkey) = 0 THEN 'NO_ROW' WHEN count(l_orderkey) > 1 THEN 'SEVERAL' END AS error
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY 1""")
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lookup by a composite key that must give one row; misses and ambiguous keys become error rows."""
    line = read(spark, d, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_partkey").alias("l_partkey"))
    n = F.coalesce("n", F.lit(0))
    return read(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.sum(n).alias("n_found"), F.max("l_partkey").alias("l_partkey")).withColumn(
        "error", F.when(F.col("n_found") == 0, "NO_ROW").when(F.col("n_found") > 1, "SEVERAL")
    )


@query("""SELECT l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem ORDER BY 1, 2, 3, 4""")
def rates_of_key(spark: SparkSession, d: str) -> DataFrame:
    """Alias projection with a sort by its keys; Spark sorts by ranges of them, over all tasks."""
    return read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("""SELECT log_id, insu_cd, CASE WHEN m.code IS NULL THEN 'NO_MAPPING' END AS error FROM """ + _LOG + """ c LEFT JOIN (SELECT DISTINCT code FROM uw_code_mapping) m ON m.code = c.insu_cd""")
def unmatched_rows(spark: SparkSession, d: str) -> DataFrame:
    """Left join that keeps misses as error rows."""
    known = read(spark, d, "uw_code_mapping").select(F.col("code")).distinct()
    return _logs(spark, d).select("log_id", "insu_cd").join(known, F.col("insu_cd") == F.col("code"), "left").select("log_id", "insu_cd", F.when(F.col("code").isNull(), "NO_MAPPING").alias("error"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'Y' ELSE 'N' END AS has_orders, CASE WHEN EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) THEN 'Y' ELSE 'N' END AS has_events,
    CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) THEN 'Y' ELSE 'N' END AS has_supplier,
    concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'orders' END, CASE WHEN NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) THEN 'events' END, CASE WHEN NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) THEN 'supplier' END) AS lacking FROM customer""")
def availability_flags(spark: SparkSession, d: str) -> DataFrame:
    """Three semi-join flags and the list of what is lacking."""
    return R.availability(read(spark, d, "customer").select("c_custkey"), "c_custkey", {"orders": (read(spark, d, "orders"), "o_custkey"), "events": (read(spark, d, "events"), "user_id"), "supplier": (read(spark, d, "supplier"), "s_suppkey")})


@query("""SELECT p_partkey, t AS word, s AS size_word FROM part, unnest(string_split(p_type, ' ')) AS a(t), unnest(CASE WHEN p_name IS NULL OR p_name = '' THEN ['—'] ELSE string_split(p_name, ' ') END) AS b(s)""")
def value_cross_product(spark: SparkSession, d: str) -> DataFrame:
    """Cross product of two value lists within a row; an empty list stands as a dash."""
    second = F.when(F.col("p_name").isNull() | (F.col("p_name") == ""), F.array(F.lit("—"))).otherwise(F.split("p_name", " "))
    return read(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"), second.alias("s")).select("p_partkey", "word", F.explode("s").alias("size_word"))


@query("""WITH m AS (SELECT DISTINCT code, pay_term FROM uw_code_mapping WHERE code IS NOT NULL AND pay_term IS NOT NULL),
    j AS (SELECT parse_id, terms.payTerm AS p, m.pay_term AS q FROM parse_result LEFT JOIN m ON m.code = insu_cd)
    SELECT parse_id, count(q) AS n_rows, count(*) FILTER (p = q OR contains(p, q)) AS n_match, CASE WHEN count(q) = 0 THEN 'NO_MAPPING_DATA' WHEN count(*) FILTER (p = q OR contains(p, q)) > 0 AND count(*) FILTER (p = q OR contains(p, q)) * 100 // count(q) >= 70 THEN 'VALID' ELSE 'INVALID' END AS status FROM j GROUP BY parse_id""")
def containment_validation(spark: SparkSession, d: str) -> DataFrame:
    """Share of a code's mapping terms that a parsed text equals or contains.

    No pairs are compared: a text gives its parts of the lengths that the code's terms have, once each, and the parts meet the terms
    by an equi-join. Results are made per distinct text and go back to the rows.
    """
    m = read(spark, d, "uw_code_mapping").select("code", "pay_term").filter(F.col("code").isNotNull() & F.col("pay_term").isNotNull()).distinct()
    rows = read(spark, d, "parse_result").select("parse_id", "insu_cd", F.col("terms.payTerm").alias("p"))
    of_code = m.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"), F.collect_set(F.length("pay_term")).alias("sizes"))
    once = rows.filter("insu_cd IS NOT NULL").select("insu_cd", "p").distinct().join(of_code, F.col("code") == F.col("insu_cd")).drop("code")
    fits = once.select("insu_cd", "p", F.explode(F.filter("sizes", lambda k: k <= F.length("p"))).alias("k"))
    at = F.sequence(F.lit(1), F.length("p") - F.col("k") + 1)
    parts = fits.select("insu_cd", "p", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("p"), i, F.col("k"))))).alias("part"))
    hits = parts.join(m, (F.col("code") == F.col("insu_cd")) & (F.col("pay_term") == F.col("part"))).groupBy(F.col("insu_cd").alias("hc"), F.col("p").alias("hp")).agg(F.count(F.lit(1)).alias("n_match"))
    judged = once.join(hits, (F.col("hc") == F.col("insu_cd")) & (F.col("hp") == F.col("p")), "left").select(F.col("insu_cd").alias("c"), F.col("p").alias("q"), "n_rows", F.coalesce("n_match", F.lit(0)).alias("n_match"))
    out = rows.join(judged, (F.col("c") == F.col("insu_cd")) & F.col("p").eqNullSafe(F.col("q")), "left").select("parse_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_match", F.lit(0)).alias("n_match"))
    confidence = numbers.int_percent(F.col("n_match"), F.col("n_rows"))
    return out.withColumn("status", F.when(F.col("n_rows") == 0, "NO_MAPPING_DATA").when((F.col("n_match") > 0) & (confidence >= 70), "VALID").otherwise("INVALID"))


@query("""WITH a AS (SELECT code, max(product_name) AS x FROM uw_code_mapping WHERE code IS NOT NULL GROUP BY 1), b AS (SELECT insu_cd, max(product_name) AS y FROM correction_log WHERE insu_cd IS NOT NULL GROUP BY 1)
    SELECT coalesce(code, insu_cd) AS code, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x WHEN length(y) > length(x) OR (contains(y, '특약') AND NOT contains(x, '특약')) THEN y ELSE x END AS product_name FROM a FULL JOIN b ON code = insu_cd""")
def full_outer_better_name(spark: SparkSession, d: str) -> DataFrame:
    """Full outer join of two name tables; the better name counts."""
    a = read(spark, d, "uw_code_mapping").filter("code IS NOT NULL").groupBy("code").agg(F.max("product_name").alias("x"))
    b = read(spark, d, "correction_log").filter("insu_cd IS NOT NULL").groupBy("insu_cd").agg(F.max("product_name").alias("y"))
    return a.join(b, F.col("code") == F.col("insu_cd"), "full_outer").select(F.coalesce("code", "insu_cd").alias("code"), R.better_text(F.col("x"), F.col("y"), ("특약",)).alias("product_name"))


@query("""WITH o AS (SELECT insu_cd, arg_min(output_insu_term, example_id) AS t, arg_min(output_pay_term, example_id) AS p FROM (SELECT * FROM few_shot_example WHERE output_insu_term IS NOT NULL AND output_pay_term IS NOT NULL) WHERE insu_cd IS NOT NULL GROUP BY 1)
    SELECT parse_id, coalesce(nullif(terms.insuTerm, ''), o.t) AS insu_term, coalesce(nullif(terms.payTerm, ''), o.p) AS pay_term, coalesce(nullif(terms.renew, ''), '비갱신형') AS renew FROM parse_result r LEFT JOIN o ON o.insu_cd = r.insu_cd""")
def override_fill_blank(spark: SparkSession, d: str) -> DataFrame:
    """Blank fields are filled from an override table, a default comes last."""
    e = read(spark, d, "few_shot_example").filter("insu_cd IS NOT NULL AND output_insu_term IS NOT NULL AND output_pay_term IS NOT NULL")
    o = R.pick_per_key(e, ["insu_cd"], [F.col("example_id")], ["output_insu_term", "output_pay_term"], largest=False)
    filled = lambda c: F.nullif(F.col(f"terms.{c}"), F.lit(""))
    return read(spark, d, "parse_result").join(o, "insu_cd", "left").select(
        "parse_id", F.coalesce(filled("insuTerm"), "output_insu_term").alias("insu_term"), F.coalesce(filled("payTerm"), "output_pay_term").alias("pay_term"), F.coalesce(filled("renew"), F.lit("비갱신형")).alias("renew")
    )


@query("""WITH p AS (SELECT insu_cd, max(pattern_value) FILTER (field_name = 'insuTerm') AS t, max(pattern_value) FILTER (field_name = 'payTerm') AS y, max(pattern_value) FILTER (field_name = 'ageRange') AS a, max(pattern_value) FILTER (field_name = 'renew') AS r FROM learned_pattern WHERE is_active GROUP BY 1)
    SELECT parse_id, coalesce(p.t, terms.insuTerm) AS insu_term, coalesce(p.y, terms.payTerm) AS pay_term, coalesce(p.a, terms.ageRange) AS age_range, coalesce(p.r, terms.renew) AS renew, p.insu_cd IS NOT NULL AS learned FROM parse_result x LEFT JOIN p ON p.insu_cd = x.insu_cd""")
def pattern_apply(spark: SparkSession, d: str) -> DataFrame:
    """Learned patterns pivoted to one row per code overwrite the parsed fields."""
    p = read(spark, d, "learned_pattern").filter("is_active").groupBy("insu_cd").agg(*(F.max(F.when(F.col("field_name") == f, F.col("pattern_value"))).alias(f"p_{f}") for f in _TERMS)).withColumn("learned", F.lit(True))
    names = {"insuTerm": "insu_term", "payTerm": "pay_term", "ageRange": "age_range", "renew": "renew"}
    return read(spark, d, "parse_result").join(p, "insu_cd", "left").select("parse_id", *(F.coalesce(f"p_{f}", f"terms.{f}").alias(n) for f, n in names.items()), F.coalesce("learned", F.lit(False)).alias("learned"))


@query("""SELECT main_code, code, period_label, pay_term FROM uw_code_mapping WHERE main_code IS NOT NULL ORDER BY main_code, period_label NULLS FIRST, pay_term NULLS FIRST, code NULLS FIRST""")
def mapping_by_main_code(spark: SparkSession, d: str) -> DataFrame:
    """Mapping rows by main code, label and payment term in binary order."""
    return read(spark, d, "uw_code_mapping").filter("main_code IS NOT NULL").select("main_code", "code", "period_label", "pay_term").orderBy("main_code", "period_label", "pay_term", "code")


@query("SELECT log_id, insu_cd, created_at FROM " + _LOG + " ORDER BY created_at DESC, log_id DESC LIMIT 20 OFFSET 40")
def paged_browse(spark: SparkSession, d: str) -> DataFrame:
    """Third page of twenty, newest first; an empty filter doesn't apply."""
    return R.page(_logs(spark, d).select("log_id", "insu_cd", "created_at"), [F.desc("created_at"), F.desc("log_id")], 2, 20, insu_cd="")


@query("SELECT log_id, created_at FROM " + _LOG + " WHERE NOT is_learned ORDER BY created_at, log_id LIMIT 100")
def unlearned_batch(spark: SparkSession, d: str) -> DataFrame:
    """Oldest hundred logs not yet learned."""
    return _logs(spark, d).filter("NOT is_learned").select("log_id", "created_at").orderBy("created_at", "log_id").limit(100)


@query("""SELECT insu_cd, field_name, pattern_id, pattern_value, confidence_score FROM learned_pattern WHERE is_active QUALIFY row_number() OVER (PARTITION BY insu_cd, field_name ORDER BY priority DESC, confidence_score DESC, pattern_id) = 1""")
def best_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Active pattern of the highest priority and confidence per code and field."""
    order = [F.coalesce("priority", F.lit(-1)), F.coalesce("confidence_score", F.lit(-1)), -F.col("pattern_id")]
    return R.pick_per_key(read(spark, d, "learned_pattern").filter("is_active"), ["insu_cd", "field_name"], order, ["pattern_id", "pattern_value", "confidence_score"])


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01') AS n_half_open, count(*) FILTER (o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01') AS n_closed, count(*) FILTER (CAST(o_orderdate AS DATE) >= DATE '1998-01-01' - 30) AS n_trailing FROM orders GROUP BY 1""")
def date_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Half-open, closed and trailing date ranges."""
    at, a, b = F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return read(spark, d, "orders").groupBy("o_orderstatus").agg(n((at >= a) & (at < b), "n_half_open"), n(at.between(a, b), "n_closed"), n(at.cast("date") >= F.date_sub(F.lit("1998-01-01").cast("date"), 30), "n_trailing"))


@query("""SELECT CASE WHEN regexp_matches(code, '^[12]') THEN 'main' WHEN regexp_matches(code, '^8') THEN 'renewable' WHEN regexp_matches(code, '^[0-9]{5}$') THEN 'rider' ELSE 'other' END AS code_class, count(*) AS n FROM uw_code_mapping GROUP BY 1""")
def code_classes(spark: SparkSession, d: str) -> DataFrame:
    """Prefix and range predicates on codes."""
    c = F.col("code")
    kind = F.when(c.rlike("^[12]"), "main").when(c.startswith("8"), "renewable").when(c.rlike("^[0-9]{5}$"), "rider").otherwise("other")
    return read(spark, d, "uw_code_mapping").groupBy(kind.alias("code_class")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT main_code, max(CASE WHEN type_label = '최초계약' THEN 1 ELSE 0 END) AS a FROM uw_code_mapping GROUP BY 1)
    SELECT map_id FROM uw_code_mapping u JOIN f ON f.main_code IS NOT DISTINCT FROM u.main_code WHERE type_label = '최초계약' OR a = 0""")
def first_contract_or_all(spark: SparkSession, d: str) -> DataFrame:
    """Rows marked as first contracts, or all rows of a main code that has none."""
    return R.keep_flagged_or_all(read(spark, d, "uw_code_mapping").select("map_id", "main_code", "type_label"), ["main_code"], F.col("type_label") == "최초계약").select("map_id")


@query("""SELECT l.insu_cd, count(*) AS n, count(*) FILTER (is_learned) AS n_learned FROM """ + _LOG + """ l WHERE EXISTS (SELECT 1 FROM learned_pattern p WHERE p.insu_cd = l.insu_cd) GROUP BY 1""")
def exists_filter(spark: SparkSession, d: str) -> DataFrame:
    """Existence as a left semi join."""
    return _logs(spark, d).join(read(spark, d, "learned_pattern").select("insu_cd"), "insu_cd", "left_semi").groupBy("insu_cd").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_learned"), 1)).alias("n_learned"))


@query("SELECT insu_cd, count(*) AS n FROM " + _LOG + " WHERE insu_cd IS NOT NULL GROUP BY 1 ORDER BY n DESC, insu_cd LIMIT 5")
def topn_products(spark: SparkSession, d: str) -> DataFrame:
    """Five products with the most corrections."""
    return _logs(spark, d).filter("insu_cd IS NOT NULL").groupBy("insu_cd").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "insu_cd").limit(5)


@query("""SELECT CAST(created_date AS VARCHAR) AS created_date, count(*) AS n, count(*) FILTER (is_learned) AS n_learned, count(*) FILTER (is_verified) AS n_verified, round(avg(validation_score), 4) AS avg_score FROM """ + _LOG + """ GROUP BY 1""")
def conditional_count_avg(spark: SparkSession, d: str) -> DataFrame:
    return _logs(spark, d).groupBy(F.col("created_date").cast("string").alias("created_date")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_learned"), 1)).alias("n_learned"), F.count(F.when(F.col("is_verified"), 1)).alias("n_verified"), F.round(F.avg("validation_score"), 4).alias("avg_score"))


@query("""SELECT CASE WHEN count(quality_score) = 0 THEN 'N/A' ELSE printf('%.1f%%', round(avg(quality_score), 1)) END AS quality, example_type FROM (SELECT DISTINCT ON (example_id) * FROM few_shot_example) GROUP BY 2""")
def formatted_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean with one decimal as a text, N/A where there is none."""
    e = read(spark, d, "few_shot_example").dropDuplicates(["example_id"])
    mean = F.when(F.count("quality_score") == 0, "N/A").otherwise(F.format_string("%.1f%%", F.round(F.avg("quality_score"), 1)))
    return e.groupBy("example_type").agg(mean.alias("quality"))


@query("SELECT code, period_label, pay_term, count(*) AS n FROM uw_code_mapping GROUP BY 1, 2, 3 HAVING count(*) > 1")
def having_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "uw_code_mapping").groupBy("code", "period_label", "pay_term").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT insu_cd, count(DISTINCT field_name) AS n_fields FROM learned_pattern GROUP BY 1 HAVING count(DISTINCT field_name) < 4")
def having_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "learned_pattern").groupBy("insu_cd").agg(F.countDistinct("field_name").alias("n_fields")).filter("n_fields < 4")


@query("SELECT insu_cd, string_agg(DISTINCT field_name, ', ' ORDER BY field_name) AS fields, count(*) AS n FROM learned_pattern GROUP BY 1")
def distinct_listagg(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "learned_pattern").groupBy("insu_cd").agg(F.array_join(F.array_sort(F.collect_set("field_name")), ", ").alias("fields"), F.count(F.lit(1)).alias("n"))


@query("SELECT code, count(*) AS n, max(period_value) AS max_period, max(loaded_at) AS last_load FROM uw_code_mapping GROUP BY 1")
def count_max_max(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "uw_code_mapping").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("period_value").alias("max_period"), F.max("loaded_at").alias("last_load"))


@query("""SELECT product_group, type_label, period_kind, class_tag, concat(coalesce(period_kind, '-'), '/', coalesce(class_tag, '-')) AS label, count(*) AS n FROM uw_code_mapping GROUP BY 1, 2, 3, 4, 5""")
def five_key_groups(spark: SparkSession, d: str) -> DataFrame:
    """Grouping by several keys and by an expression."""
    label = F.concat(F.coalesce("period_kind", F.lit("-")), F.lit("/"), F.coalesce("class_tag", F.lit("-")))
    return read(spark, d, "uw_code_mapping").groupBy("product_group", "type_label", "period_kind", "class_tag", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT n_regionkey, n_name || '(' || string_agg(c_mktsegment || ':' || k, ', ' ORDER BY c_mktsegment) || ')' AS t, n_name FROM (SELECT n_regionkey, n_name, c_mktsegment, count(*) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3) GROUP BY 1, n_name)
    SELECT r_name, string_agg(t, '; ' ORDER BY n_name) AS listed FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def grouped_nested_string(spark: SparkSession, d: str) -> DataFrame:
    """Two-level string aggregation after counts have bounded the lists."""
    n, c, r = read(spark, d, "nation"), read(spark, d, "customer"), read(spark, d, "region")
    k = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("k")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    inner = k.groupBy("n_regionkey", "n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "k"))), lambda x: F.concat(x["c_mktsegment"], F.lit(":"), x["k"].cast("string"))), ", ").alias("t"))
    outer = inner.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "t"))), lambda x: F.concat(x["n_name"], F.lit("("), x["t"], F.lit(")"))), "; ").alias("listed"))
    return outer.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "listed")


@query("""SELECT main_code, period_label, n FROM (SELECT main_code, period_label, count(*) AS n FROM uw_code_mapping WHERE period_label IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY main_code ORDER BY n DESC, period_label) = 1""")
def mode_value(spark: SparkSession, d: str) -> DataFrame:
    """Commonest label per main code, the smallest of equals."""
    return R.mode_value(read(spark, d, "uw_code_mapping"), ["main_code"], "period_label").select("main_code", "period_label", F.col("n_votes").alias("n"))


_VOTES = """SELECT rec_id, f AS field, v AS vote FROM (SELECT rec_id, unnest(['insuTerm', 'payTerm', 'renew']) AS f, payload FROM hybrid_result), unnest([json_extract_string(payload, '$.python.terms.' || f), json_extract_string(payload, '$.ocr.terms.' || f), json_extract_string(payload, '$.best.terms.' || f)]) AS a(v)"""


@query(f"""WITH c AS (SELECT rec_id, field, vote, count(*) AS n FROM ({_VOTES}) WHERE vote IS NOT NULL AND vote NOT IN ('', '—') GROUP BY ALL)
    SELECT rec_id, field, vote, n FROM c QUALIFY row_number() OVER (PARTITION BY rec_id, field ORDER BY n DESC, vote) = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Plurality of the parsers' values per record and field; missing values don't vote, the smallest of equals wins."""
    votes = [F.struct(F.lit(f).alias("field"), F.get_json_object("payload", f"$.{b}.terms.{f}").alias("vote")) for f in ("insuTerm", "payTerm", "renew") for b in ("python", "ocr", "best")]
    v = read(spark, d, "hybrid_result").select("rec_id", F.explode(F.array(*votes)).alias("v")).select("rec_id", "v.field", "v.vote").filter("vote NOT IN ('', '—')")
    return R.mode_value(v, ["rec_id", "field"], "vote").select("rec_id", "field", "vote", F.col("n_votes").alias("n"))


@query("""WITH t AS (SELECT rec_id, json_extract_string(payload, '$.python.terms.payTerm') AS a, json_extract_string(payload, '$.ocr.terms.payTerm') AS b, json_extract_string(payload, '$.best.terms.payTerm') AS c FROM hybrid_result)
    SELECT rec_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b WHEN length(b) > 5 THEN b WHEN length(c) > 5 THEN c ELSE a END AS pay_term FROM t""")
def three_way_vote(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = (F.get_json_object("payload", f"$.{x}.terms.payTerm") for x in ("python", "ocr", "best"))
    return read(spark, d, "hybrid_result").select("rec_id", R.three_way_vote(a, b, c).alias("pay_term"))


@query("""WITH c AS (SELECT rec_id, b AS strategy, p AS priority, 25 * (CAST(coalesce(json_extract_string(payload, '$.' || b || '.terms.insuTerm'), '') <> '' AS INT) + CAST(coalesce(json_extract_string(payload, '$.' || b || '.terms.payTerm'), '') <> '' AS INT) + CAST(coalesce(json_extract_string(payload, '$.' || b || '.terms.ageRange'), '') <> '' AS INT) + CAST(coalesce(json_extract_string(payload, '$.' || b || '.terms.renew'), '') <> '' AS INT)) AS confidence
      FROM hybrid_result, (VALUES ('python', 1), ('ocr', 2), ('best', 3)) s(b, p))
    SELECT rec_id, strategy, confidence FROM c QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY CASE WHEN confidence >= 85 THEN 0 ELSE 1 END, CASE WHEN confidence >= 85 THEN priority ELSE -confidence END, priority, strategy) = 1""")
def strategy_cascade(spark: SparkSession, d: str) -> DataFrame:
    """First sufficient strategy by priority, else the best."""
    def one(b: str, p: int):
        filled = sum((F.coalesce(F.get_json_object("payload", f"$.{b}.terms.{f}"), F.lit("")) != "").cast("int") for f in _TERMS)
        return F.struct(F.lit(b).alias("strategy"), F.lit(p).alias("priority"), (filled * 25).alias("confidence"))

    c = read(spark, d, "hybrid_result").select("rec_id", F.explode(F.array(one("python", 1), one("ocr", 2), one("best", 3))).alias("s")).select("rec_id", "s.*")
    return R.cascade(c, ["rec_id"], "confidence", "priority", "strategy", 85, ["strategy", "confidence"])


@query("""SELECT method, count(*) AS n_rows, count(*) FILTER (coalesce(terms.insuTerm, '') <> '') AS n_term, count(*) FILTER (coalesce(terms.payTerm, '') <> '') AS n_pay, count(*) FILTER (success OR coalesce(terms.insuTerm, '') <> '' OR coalesce(terms.payTerm, '') <> '' OR coalesce(terms.ageRange, '') <> '') AS n_success,
    round(count(*) FILTER (coalesce(terms.insuTerm, '') <> '') * 100.0 / count(*), 1) AS pct_term, round(count(*) FILTER (coalesce(terms.payTerm, '') <> '') * 100.0 / count(*), 1) AS pct_pay, round(count(*) FILTER (success OR coalesce(terms.insuTerm, '') <> '' OR coalesce(terms.payTerm, '') <> '' OR coalesce(terms.ageRange, '') <> '') * 100.0 / count(*), 1) AS pct_success FROM parse_result GROUP BY 1""")
def coverage_tally(spark: SparkSession, d: str) -> DataFrame:
    """Filled fields per method with shares."""
    has = lambda f: F.coalesce(F.col(f"terms.{f}"), F.lit("")) != ""
    return R.coverage(read(spark, d, "parse_result"), ["method"], {"term": has("insuTerm"), "pay": has("payTerm"), "success": F.coalesce("success", F.lit(False)) | has("insuTerm") | has("payTerm") | has("ageRange")})


@query("""WITH m AS (SELECT strftime(parsed_at, '%Y-%m') AS period, count(*) AS n, count(*) FILTER (success) AS ok FROM parse_result WHERE parsed_at IS NOT NULL GROUP BY 1)
    SELECT period, n, ok * 100 // n AS pct, ok * 100 // n - lag(ok * 100 // n) OVER (ORDER BY period) AS delta FROM m""")
def run_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change of the success rate against the month before; the window runs over months, not rows."""
    m = read(spark, d, "parse_result").filter("parsed_at IS NOT NULL").groupBy(F.date_format("parsed_at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("success"), 1)).alias("ok"))
    pct = numbers.int_percent(F.col("ok"), F.col("n"))
    return m.withColumn("pct", pct).withColumn("delta", F.col("pct") - F.lag("pct").over(Window.orderBy("period"))).drop("ok")


@query("""SELECT count(*) AS n, count(DISTINCT code) AS n_codes, count(DISTINCT src_file) AS n_files, count(*) FILTER (code = main_code) AS n_main, count(*) FILTER (code <> main_code) AS n_riders FROM uw_code_mapping""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "uw_code_mapping").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("n_codes"), F.countDistinct("src_file").alias("n_files"), F.count(F.when(F.col("code") == F.col("main_code"), 1)).alias("n_main"), F.count(F.when(F.col("code") != F.col("main_code"), 1)).alias("n_riders"))


@query("""SELECT period_kind, class_tag, CAST(grouping(period_kind) AS INT) AS all_kinds, CAST(grouping(class_tag) AS INT) AS all_tags, count(*) AS n FROM uw_code_mapping GROUP BY GROUPING SETS ((period_kind), (class_tag), ())""")
def mapping_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind, by tag and in total in one pass."""
    k, t = F.col("period_kind"), F.col("class_tag")
    return read(spark, d, "uw_code_mapping").groupingSets([[k], [t], []], k, t).agg(F.grouping("period_kind").cast("int").alias("all_kinds"), F.grouping("class_tag").cast("int").alias("all_tags"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS attempts, count(*) FILTER (value > 50) AS successes, count(*) FILTER (value <= 50) AS failures, count(*) FILTER (value > 50) * 100 // count(*) AS pct FROM events GROUP BY 1""")
def strategy_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Attempts, successes, failures and the truncated percentage."""
    m = read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("attempts"), F.count(F.when(F.col("value") > 50, 1)).alias("successes"), F.count(F.when(F.col("value") <= 50, 1)).alias("failures"))
    return m.withColumn("pct", numbers.int_percent(F.col("successes"), F.col("attempts")))


@query("""SELECT code, period_label, map_id FROM uw_code_mapping WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE WHEN period_label = '종신' THEN 0 ELSE 1 END, coalesce(period_label, ''), map_id) = 1""")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    """First row per code in a custom order."""
    order = [F.when(F.col("period_label") == "종신", 0).otherwise(1), F.coalesce("period_label", F.lit("")), F.col("map_id")]
    return R.pick_per_key(read(spark, d, "uw_code_mapping").filter("code IS NOT NULL"), ["code"], order, ["period_label", "map_id"], largest=False)


@query("""SELECT source, doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3""")
def longest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Three longest documents per source."""
    return R.top_per_key(read(spark, d, "documents").filter("n_chars IS NOT NULL").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)


@query("SELECT code, min(pay_term) AS pay_term FROM uw_code_mapping WHERE code IS NOT NULL AND pay_term <> '' GROUP BY 1")
def smallest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "uw_code_mapping").filter("code IS NOT NULL AND pay_term <> ''").groupBy("code").agg(F.min("pay_term").alias("pay_term"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def dedup_composite(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT * FROM (SELECT CAST(created_date AS VARCHAR) AS created_date, count(*) AS n, count(DISTINCT insu_cd) AS n_codes FROM " + _LOG + " GROUP BY 1) ORDER BY created_date DESC LIMIT 1")
def latest_row(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the latest day."""
    return _logs(spark, d).groupBy(F.col("created_date").cast("string").alias("created_date")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("insu_cd").alias("n_codes")).orderBy(F.desc("created_date")).limit(1)


@query("SELECT 'corrections' AS label, count(*) AS n FROM correction_log UNION ALL SELECT 'patterns', count(*) FROM learned_pattern UNION ALL SELECT 'examples', count(*) FROM few_shot_example UNION ALL SELECT 'mappings', count(*) FROM uw_code_mapping")
def union_labelled_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n") for label, t in (("corrections", "correction_log"), ("patterns", "learned_pattern"), ("examples", "few_shot_example"), ("mappings", "uw_code_mapping"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""WITH u AS (SELECT insu_cd AS code, product_name AS name, 1 AS place, log_id AS id FROM correction_log UNION ALL SELECT code, product_name, 2, map_id FROM uw_code_mapping)
    SELECT code, arg_max(name, place * 1000000000000 + id) AS name FROM u WHERE code IS NOT NULL AND name IS NOT NULL GROUP BY 1""")
def last_wins_union(spark: SparkSession, d: str) -> DataFrame:
    """Two name maps put together; the later entry counts."""
    a = read(spark, d, "correction_log").select(F.col("insu_cd").alias("code"), F.col("product_name").alias("name"), F.lit(1).alias("place"), F.col("log_id").alias("id"))
    b = read(spark, d, "uw_code_mapping").select("code", F.col("product_name").alias("name"), F.lit(2).alias("place"), F.col("map_id").alias("id"))
    return R.pick_per_key(a.unionByName(b).filter("code IS NOT NULL AND name IS NOT NULL"), ["code"], [F.col("place"), F.col("id")], ["name"])


@query("SELECT example_id, md5('7:' || example_id) AS h FROM (SELECT DISTINCT example_id FROM few_shot_example) ORDER BY h LIMIT 50")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Reproducible sample of fifty by a seeded hash."""
    return read(spark, d, "few_shot_example").select("example_id").distinct().withColumn("h", F.md5(F.concat(F.lit("7:"), F.col("example_id").cast("string")))).orderBy("h").limit(50)


@query("SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events")
def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_custkey").intersect(read(spark, d, "events").select(F.col("user_id").alias("o_custkey")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey").subtract(read(spark, d, "events").select(F.col("user_id").alias("c_custkey")))


@query("""SELECT log_id, CAST(original.insuTerm IS DISTINCT FROM corrected.insuTerm AS INT) + CAST(original.payTerm IS DISTINCT FROM corrected.payTerm AS INT) + CAST(original.ageRange IS DISTINCT FROM corrected.ageRange AS INT) + CAST(original.renew IS DISTINCT FROM corrected.renew AS INT) AS n_changed,
    concat_ws(',', CASE WHEN original.insuTerm IS DISTINCT FROM corrected.insuTerm THEN 'insuTerm' END, CASE WHEN original.payTerm IS DISTINCT FROM corrected.payTerm THEN 'payTerm' END, CASE WHEN original.ageRange IS DISTINCT FROM corrected.ageRange THEN 'ageRange' END, CASE WHEN original.renew IS DISTINCT FROM corrected.renew THEN 'renew' END) AS changed FROM """ + _LOG)
def changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Null-safe difference of the original and the corrected record."""
    differs = {f: ~F.col(f"original.{f}").eqNullSafe(F.col(f"corrected.{f}")) for f in _TERMS}
    return _logs(spark, d).select("log_id", sum(c.cast("int") for c in differs.values()).alias("n_changed"), F.concat_ws(",", *(F.when(c, f) for f, c in differs.items())).alias("changed"))
