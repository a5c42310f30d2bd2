"""Queries of extraction: names and codes, sections, strategies, scores, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daram.functions import terms
from daram.operators import extraction as X
from daram.operators import relational as R
from daram.plans.registry import query
from daram.session import read

_CODES = "list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 5)"


@query(f"""SELECT c AS code, min(doc_id) AS doc_id, count(*) AS n_docs FROM (SELECT doc_id, unnest(list_distinct({_CODES})) AS c FROM documents WHERE text IS NOT NULL) WHERE c IN (SELECT code FROM uw_code_mapping) GROUP BY 1""")
def first_document_of_code(spark: SparkSession, d: str) -> DataFrame:
    """First document, by id, that names a known code."""
    named = read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(terms.codes(F.col("text"))).alias("code"))
    return named.join(read(spark, d, "uw_code_mapping").select("code").distinct(), "code", "left_semi").groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"))


@query("""SELECT code, max(name) AS product_name, count(*) AS n FROM (SELECT regexp_extract(m, '\\(([0-9]{5})\\)$', 1) AS code, regexp_extract(m, '^(.*[^ ]) ?\\([0-9]{5}\\)$', 1) AS name FROM (SELECT unnest(regexp_extract_all(text, '\\(무\\)[가-힣A-Za-zⅡ]+(?:\\([가-힣0-9]+\\))? ?\\([0-9]{5}\\)')) AS m FROM documents WHERE text IS NOT NULL)) GROUP BY 1""")
def name_of_code(spark: SparkSession, d: str) -> DataFrame:
    """Product names written in front of a code in brackets."""
    m = read(spark, d, "documents").filter("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\(무\)[가-힣A-Za-zⅡ]+(?:\([가-힣0-9]+\))? ?\([0-9]{5}\))"), F.lit(1))).alias("m"))
    return m.select(F.regexp_extract("m", r"\(([0-9]{5})\)$", 1).alias("code"), F.regexp_extract("m", r"^(.*[^ ]) ?\([0-9]{5}\)$", 1).alias("name")).groupBy("code").agg(F.max("name").alias("product_name"), F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN length(regexp_extract(text, '보험기간은 ([^.]*)\\.', 1)) > 5 THEN regexp_extract(text, '보험기간은 ([^.]*)\\.', 1) WHEN length(regexp_extract(text, '가입나이는 ([^.]*)\\.', 1)) > 5 THEN regexp_extract(text, '가입나이는 ([^.]*)\\.', 1) ELSE text END AS part FROM documents WHERE text IS NOT NULL""")
def section_cascade(spark: SparkSession, d: str) -> DataFrame:
    """First of several patterns that yields enough text, else the whole text."""
    found = [F.regexp_extract("text", p, 1) for p in (r"보험기간은 ([^.]*)\.", r"가입나이는 ([^.]*)\.")]
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.coalesce(*(F.when(F.length(f) > 5, f) for f in found), F.col("text")).alias("part"))


# Labels that policy documents give their terms.
LABELS = ("보험기간", "납입기간", "가입나이", "갱신", "한도")


@query(f"""SELECT label, count(*) AS n_docs FROM documents, (VALUES {', '.join(f"('{x}')" for x in LABELS)}) l(label) WHERE contains(text, label) GROUP BY 1""")
def label_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents per label they name; a fixed list of labels within each row."""
    labels = F.filter(F.array(*(F.when(F.contains("text", F.lit(x)), x) for x in LABELS)), lambda x: x.isNotNull())
    return read(spark, d, "documents").select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))


@query("""WITH m AS (SELECT DISTINCT ON (main_code) main_code, product_name FROM uw_code_mapping WHERE code = main_code ORDER BY main_code, map_id DESC)
    SELECT code, u.main_code, m.product_name AS main_name, count(*) AS n FROM uw_code_mapping u JOIN m ON m.main_code = u.main_code WHERE code <> u.main_code GROUP BY 1, 2, 3""")
def main_rider_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Riders with their main contract; the later main row counts, riders without one are left out. Both sides are reduced before they meet."""
    u = read(spark, d, "uw_code_mapping")
    main = R.pick_per_key(u.filter("code = main_code"), ["main_code"], [F.col("map_id")], ["product_name"]).withColumnRenamed("product_name", "main_name")
    riders = u.filter("code <> main_code").groupBy("code", "main_code").agg(F.count(F.lit(1)).alias("n"))
    return riders.join(main, "main_code").select("code", "main_code", "main_name", "n")


@query("""SELECT parse_id, CAST(coalesce(terms.insuTerm NOT IN ('', '—'), false) AS INT) + CAST(coalesce(terms.payTerm NOT IN ('', '—'), false) AS INT) + CAST(coalesce(terms.ageRange NOT IN ('', '—'), false) AS INT) AS n_valid,
    NOT (coalesce(terms.insuTerm NOT IN ('', '—'), false) AND coalesce(terms.payTerm NOT IN ('', '—'), false) AND coalesce(terms.ageRange NOT IN ('', '—'), false)) AS any_missing FROM parse_result""")
def valid_fields(spark: SparkSession, d: str) -> DataFrame:
    """Number of usable fields and whether one of three is missing."""
    ok = [F.coalesce(~F.col(f"terms.{f}").isin("", "—"), F.lit(False)) for f in ("insuTerm", "payTerm", "ageRange")]
    return read(spark, d, "parse_result").select("parse_id", sum(c.cast("int") for c in ok).alias("n_valid"), (~(ok[0] & ok[1] & ok[2])).alias("any_missing"))


@query("""SELECT map_id, greatest(100 - CASE WHEN coalesce(regexp_matches(code, '^[0-9]{5}$'), false) THEN 0 ELSE 30 END - CASE WHEN coalesce(length(product_name) >= 5, false) THEN 0 ELSE 20 END - CASE WHEN coalesce(period_value > 0, false) THEN 0 ELSE 15 END - CASE WHEN coalesce(contains(pay_term, '납'), false) THEN 0 ELSE 15 END - CASE WHEN coalesce(contains(entry_age_m, '~'), false) THEN 0 ELSE 15 END - CASE WHEN coalesce(period_kind IN ('E', 'S', 'N', 'R'), false) THEN 0 ELSE 5 END, 0) AS score,
    concat_ws(',', CASE WHEN NOT coalesce(regexp_matches(code, '^[0-9]{5}$'), false) THEN 'code' END, CASE WHEN NOT coalesce(length(product_name) >= 5, false) THEN 'name' END, CASE WHEN NOT coalesce(period_value > 0, false) THEN 'period' END, CASE WHEN NOT coalesce(contains(pay_term, '납'), false) THEN 'pay' END, CASE WHEN NOT coalesce(contains(entry_age_m, '~'), false) THEN 'age' END, CASE WHEN NOT coalesce(period_kind IN ('E', 'S', 'N', 'R'), false) THEN 'kind' END) AS reasons FROM uw_code_mapping""")
def row_quality(spark: SparkSession, d: str) -> DataFrame:
    """Weighted rules with the reasons of what was lost."""
    rules = {"code": (F.col("code").rlike(r"^\d{5}$"), 30), "name": (F.length("product_name") >= 5, 20), "period": (F.col("period_value") > 0, 15), "pay": (F.col("pay_term").contains("납"), 15), "age": (F.col("entry_age_m").contains("~"), 15), "kind": (F.col("period_kind").isin("E", "S", "N", "R"), 5)}
    score, reasons = X.rule_score(rules)
    return read(spark, d, "uw_code_mapping").select("map_id", score.alias("score"), reasons.alias("reasons"))


@query("""WITH m AS (SELECT code, min(pay_term) FILTER (pay_term NOT IN ('', '—')) AS p FROM uw_code_mapping WHERE load_channel = 'manual_mapping' GROUP BY 1), l AS (SELECT insu_cd, max(pattern_value) AS p FROM learned_pattern WHERE field_name = 'payTerm' AND is_active GROUP BY 1)
    SELECT parse_id, CASE WHEN m.p IS NOT NULL THEN m.p WHEN l.p NOT IN ('', '—') THEN l.p WHEN terms.payTerm NOT IN ('', '—') THEN terms.payTerm END AS pay_term,
      CASE WHEN m.p IS NOT NULL THEN 'mapping' WHEN l.p NOT IN ('', '—') THEN 'learned' WHEN terms.payTerm NOT IN ('', '—') THEN 'parsed' ELSE 'none' END AS source FROM parse_result r LEFT JOIN m ON m.code = r.insu_cd LEFT JOIN l ON l.insu_cd = r.insu_cd""")
def resolve_terms(spark: SparkSession, d: str) -> DataFrame:
    """First usable value among mapping, learned pattern and parser, with its provenance."""
    m = read(spark, d, "uw_code_mapping").filter("load_channel = 'manual_mapping' AND code IS NOT NULL").groupBy(F.col("code").alias("insu_cd")).agg(F.min(F.when(~F.col("pay_term").isin("", "—"), F.col("pay_term"))).alias("m"))
    pat = read(spark, d, "learned_pattern").filter("field_name = 'payTerm' AND is_active").groupBy("insu_cd").agg(F.max("pattern_value").alias("l"))
    r = X.resolve([("mapping", F.col("m")), ("learned", F.col("l")), ("parsed", F.col("terms.payTerm"))])
    return read(spark, d, "parse_result").join(m, "insu_cd", "left").join(pat, "insu_cd", "left").select("parse_id", r.alias("r")).select("parse_id", F.col("r.value").alias("pay_term"), F.col("r.source").alias("source"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey, l_quantity, CASE WHEN abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey)) > 1 THEN 1 ELSE 0 END AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS o FROM lineitem),
    p AS (SELECT *, sum(b) OVER (PARTITION BY l_orderkey ORDER BY o) AS line_no FROM g)
    SELECT l_orderkey, CAST(line_no AS BIGINT) AS line_no, string_agg(l_returnflag, '' ORDER BY o) AS text, count(*) AS n_glyphs FROM p GROUP BY 1, 2""")
def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines from glyphs by their heights; here an order is a page and its items are the glyphs."""
    from pyspark.sql import Window

    o = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    return X.layout_lines(read(spark, d, "lineitem").withColumn("o", o), ["l_orderkey"], "o", "l_quantity", "l_returnflag")


@query("""SELECT doc_id, CASE WHEN p <> '' THEN 'pattern' ELSE 'whole' END AS strategy, CASE WHEN p <> '' THEN 90 ELSE 40 END AS confidence, CASE WHEN p <> '' THEN p ELSE substr(text, 1, 50) END AS pay FROM (SELECT doc_id, text, regexp_extract(text, '[0-9]+[년세]납', 0) AS p FROM documents WHERE text IS NOT NULL AND text <> '')""")
def strategy_registry(spark: SparkSession, d: str) -> DataFrame:
    """Strategies registered by name and priority, their results put together and the best taken."""
    docs = read(spark, d, "documents").filter("text IS NOT NULL AND text <> ''")
    pattern = F.regexp_extract("text", r"([0-9]+[년세]납)", 1)
    ways = [
        X.Strategy("pattern", 1, lambda df: df.select("doc_id", pattern.alias("pay"), F.when(pattern != "", 90).otherwise(0).alias("confidence"))),
        X.Strategy("whole", 2, lambda df: df.select("doc_id", F.substring("text", 1, 50).alias("pay"), F.lit(40).alias("confidence"))),
        X.Strategy("absent", 3, lambda df: df, available=False),
    ]
    return X.best_result(X.run_strategies(docs, ways), "doc_id", ["pay"])
