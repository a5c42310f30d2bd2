"""Queries of validation and scores, of results put together from several sources, and of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daram.functions import numbers, terms
from daram.operators import extraction as X
from daram.operators import relational as R
from daram.operators import state
from daram.plans.parsing import labelled_terms
from daram.plans.registry import SQL, query
from daram.plans.relational import containment_validation
from daram.session import read

_LOG = "(SELECT DISTINCT ON (log_id) * FROM correction_log)"
_USABLE = "coalesce(trim({0}, ' ') NOT IN ('', '—', '-'), false)"

_SHARE = "(pdf_text IS NULL OR pdf_text = '' OR {n} = 0 OR {h} >= 0.5 * {n})".format(
    n="(" + " + ".join(f"CAST({_USABLE.format(f'corrected.{f}')} AS INT)" for f in ("insuTerm", "payTerm")) + ")",
    h="(" + " + ".join(f"CAST({_USABLE.format(f'corrected.{f}')} AND len(list_filter(string_split(corrected.{f}, ','), lambda x: trim(x, ' ') <> '' AND contains(pdf_text, trim(x, ' ')))) > 0 AS INT)" for f in ("insuTerm", "payTerm")) + ")",
)


@query(f"""WITH l AS (SELECT log_id, regexp_matches(corrected.insuTerm, '종신|[0-9]+세만기|[0-9]+년만기') AS a, regexp_matches(corrected.payTerm, '전기납|[0-9]+년납') AS b, regexp_matches(corrected.ageRange, '[0-9]+~[0-9]+') AS c,
        CASE WHEN regexp_matches(corrected.insuTerm, '종신|평생') THEN 999 ELSE try_cast(regexp_extract(corrected.insuTerm, '[0-9]+') AS INT) END AS i, CASE WHEN contains(corrected.payTerm, '일시납') THEN 1 WHEN contains(corrected.payTerm, '전기납') THEN 0 WHEN contains(corrected.payTerm, '월납') AND NOT regexp_matches(corrected.payTerm, '[0-9]') THEN 0 ELSE try_cast(regexp_extract(corrected.payTerm, '[0-9]+') AS INT) END AS p,
        corrected.ageRange IS NOT NULL AND len(list_filter(regexp_extract_all(corrected.ageRange, '[0-9]{{1,9}}~[0-9]{{1,9}}'), lambda x: NOT (CAST(string_split(x, '~')[1] AS INT) < CAST(string_split(x, '~')[2] AS INT) AND CAST(string_split(x, '~')[2] AS INT) <= 120))) = 0 AS g,
        {_SHARE} AS s FROM {_LOG}),
    v AS (SELECT log_id, coalesce(a, false) AS a, coalesce(b, false) AS b, coalesce(c, false) AS c, coalesce(i >= p, false) AS d, coalesce(g, false) AS g, coalesce(s, false) AS s FROM l),
    t AS (SELECT *, 10 * CAST(a AS INT) + 10 * CAST(b AS INT) + 10 * CAST(c AS INT) AS form, 20 * CAST(d AS INT) + 20 * CAST(g AS INT) AS meaning, 30 * CAST(s AS INT) AS source FROM v)
    SELECT log_id, form + meaning + source AS score, CASE WHEN form + meaning + source >= 90 THEN 'PASS' WHEN form + meaning + source >= 60 THEN 'WARNING' ELSE 'FAIL' END AS status,
      concat_ws(',', CASE WHEN NOT a THEN 'form.insu_term' END, CASE WHEN NOT b THEN 'form.pay_term' END, CASE WHEN NOT c THEN 'form.age_range' END, CASE WHEN NOT d THEN 'meaning.longer' END, CASE WHEN NOT g THEN 'meaning.ages' END, CASE WHEN NOT s THEN 'source.found' END) AS reasons, form, meaning, source FROM t""")
def layered_validation(spark: SparkSession, d: str) -> DataFrame:
    """Corrected terms judged in layers: their form, their meaning, and whether the source text has them."""
    insu, pay, ages = (F.col(f"corrected.{f}") for f in ("insuTerm", "payTerm", "ageRange"))
    layers = {
        "form": {"insu_term": (insu.rlike(r"종신|\d+세만기|\d+년만기"), 10), "pay_term": (pay.rlike(r"전기납|\d+년납"), 10), "age_range": (ages.rlike(r"\d+~\d+"), 10)},
        "meaning": {"longer": (terms.term_to_int(insu) >= terms.pay_term_to_int(pay, F.lit(0)), 20), "ages": (X.ages_in_order(ages), 20)},
        "source": {"found": (X.share_found([insu, pay], F.col("pdf_text")), 30)},
    }
    return read(spark, d, "correction_log").dropDuplicates(["log_id"]).select("log_id", X.layered_score(layers, 90, 60).alias("r")).select("log_id", "r.*")


# Bands of the scores, as (lower bound, points): examples, not figures to match.
RECENT, USED, URGENT = [(-60, 2), (-14, 4), (-1, 6)], [(5, 1), (15, 2), (40, 4)], [(30, 1), (70, 3)]
LONG, SIGNS, GRADES = [(81, 2), (161, 4)], [(16, 3)], [(85, "A"), (65, "B"), (45, "C")]


def _banded(value: str, bands: list, lowest: str = "0") -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {bound} THEN {points!r}" for bound, points in sorted(bands, reverse=True)) + f" ELSE {lowest} END"


@query(f"""WITH p AS (SELECT *, CASE WHEN coalesce(apply_count, 0) > 0 THEN CAST(coalesce(success_count, 0) * 15 // apply_count AS INT) ELSE 0 END AS success, -date_diff('day', CAST(updated_at AS DATE), DATE '2025-01-01') AS age, length(regexp_replace(pattern_value, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) AS signs FROM learned_pattern),
    s AS (SELECT pattern_id, CAST(least(greatest(coalesce(confidence_score, 0) + success + {_banded('age', RECENT)} + {_banded('apply_count', USED)} + {_banded('priority', URGENT)} - {_banded('length(pattern_value)', LONG)} - {_banded('signs', SIGNS)}, 0), 100) AS INT) AS score FROM p)
    SELECT pattern_id, score, {_banded('score', GRADES, "'D'")} AS grade FROM s""")
def pattern_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of a pattern: its confidence, points for success, recency, use and priority in bands, less points for long and intricate values; as of a given day."""
    applied = F.coalesce("apply_count", F.lit(0))
    success = F.when(applied > 0, F.call_function("div", F.coalesce("success_count", F.lit(0)).cast("bigint") * 15, F.nullif(applied.cast("bigint"), F.lit(0)))).otherwise(0)
    age = -F.datediff(F.lit("2025-01-01").cast("date"), F.col("updated_at").cast("date"))
    signs = F.length(F.regexp_replace("pattern_value", r"[\p{L}\p{N}\s]", ""))
    score = F.coalesce("confidence_score", F.lit(0)) + success + X.steps(age, RECENT) + X.steps(F.col("apply_count"), USED) + X.steps(F.col("priority"), URGENT) - X.steps(F.length("pattern_value"), LONG) - X.steps(signs, SIGNS)
    rows = read(spark, d, "learned_pattern").select("pattern_id", F.least(F.greatest(score, F.lit(0)), F.lit(100)).cast("int").alias("score"))
    return rows.withColumn("grade", X.grade(F.col("score"), GRADES, "D"))


@query(f"""SELECT log_id, CAST(least(50 + 15 * (CAST({_USABLE.format('corrected.insuTerm')} AS INT) + CAST({_USABLE.format('corrected.payTerm')} AS INT)) + CASE WHEN length(pdf_text) > 300 THEN 15 ELSE 0 END + CASE WHEN coalesce(correction_reason, '') <> '' THEN 5 ELSE 0 END, 100) AS INT) AS quality FROM {_LOG}""")
def example_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of a log as an example: a base, points per usable field, for a long text and for a reason, up to a hundred."""
    usable = lambda f: F.coalesce(~F.trim(F.col(f"corrected.{f}")).isin("", "—", "-"), F.lit(False)).cast("int")
    score = F.lit(50) + 15 * (usable("insuTerm") + usable("payTerm")) + X.steps(F.length("pdf_text"), [(301, 15)]) + F.when(F.coalesce("correction_reason", F.lit("")) != "", 5).otherwise(0)
    return read(spark, d, "correction_log").dropDuplicates(["log_id"]).select("log_id", F.least(score, F.lit(100)).cast("int").alias("quality"))


@query("""WITH m AS (SELECT DISTINCT code, pay_term FROM uw_code_mapping WHERE code IS NOT NULL AND pay_term IS NOT NULL), l AS (SELECT code, min(pay_term) AS pay FROM m GROUP BY 1),
    j AS (SELECT parse_id, insu_cd, any_value(terms.payTerm) AS p, count(q) AS n, count(*) FILTER (p = q OR contains(p, q)) AS k FROM (SELECT parse_id, insu_cd, terms, terms.payTerm AS p, m.pay_term AS q FROM parse_result LEFT JOIN m ON m.code = insu_cd) GROUP BY 1, 2)
    SELECT parse_id, CASE WHEN k > 0 AND k * 100 // n >= 80 THEN p ELSE pay END AS pay_term, CASE WHEN k > 0 AND k * 100 // n >= 80 THEN 'parsed' WHEN pay IS NOT NULL THEN 'mapping' ELSE 'empty' END AS source FROM j LEFT JOIN l ON l.code = insu_cd""")
def validated_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Parsed payment terms where the mapping confirms them to four fifths, else the mapping's own, else nothing."""
    mapped = read(spark, d, "uw_code_mapping").filter(F.col("code").isNotNull() & F.col("pay_term").isNotNull()).groupBy(F.col("code").alias("insu_cd")).agg(F.min("pay_term").alias("pay"))
    rows = read(spark, d, "parse_result").select("parse_id", "insu_cd", F.col("terms.payTerm").alias("p")).join(containment_validation(spark, d), "parse_id").join(mapped, "insu_cd", "left")
    sure = (F.col("n_match") > 0) & (numbers.int_percent(F.col("n_match"), F.col("n_rows")) >= 80)
    return rows.select("parse_id", F.when(sure, F.col("p")).otherwise(F.col("pay")).alias("pay_term"), F.when(sure, "parsed").when(F.col("pay").isNotNull(), "mapping").otherwise("empty").alias("source"))


@query("""WITH t AS (SELECT rec_id, f, json_extract_string(payload, '$.python.terms.' || f) AS a, json_extract_string(payload, '$.ocr.terms.' || f) AS b FROM hybrid_result, (VALUES ('insuTerm'), ('payTerm'), ('renew')) v(f))
    SELECT rec_id, f AS field, CASE WHEN a NOT IN ('', '—') THEN a WHEN b NOT IN ('', '—') THEN b END AS value, CASE WHEN a NOT IN ('', '—') THEN 'python' WHEN b NOT IN ('', '—') THEN 'ocr' ELSE 'none' END AS source FROM t""")
def two_parsers(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the first parser, filled from the second where it has none."""
    one = lambda f: F.struct(F.lit(f).alias("field"), X.resolve([(b, F.get_json_object("payload", f"$.{b}.terms.{f}")) for b in ("python", "ocr")]).alias("r"))
    rows = read(spark, d, "hybrid_result").select("rec_id", F.explode(F.array(*(one(f) for f in ("insuTerm", "payTerm", "renew")))).alias("x"))
    return rows.select("rec_id", "x.field", "x.r.value", "x.r.source")


@query("""WITH c AS (SELECT code, entry_age_m AS m, count(*) AS n FROM uw_code_mapping WHERE code IS NOT NULL AND regexp_matches(entry_age_m, '^[0-9]+~[0-9]+$') GROUP BY 1, 2), m AS (SELECT code, m FROM c QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, m) = 1)
    SELECT parse_id, CASE WHEN coalesce(regexp_matches(terms.ageRange, '^[0-9]+~[0-9]+$'), false) THEN terms.ageRange ELSE coalesce(m, terms.ageRange) END AS age_range, NOT coalesce(regexp_matches(terms.ageRange, '^[0-9]+~[0-9]+$'), false) AND m IS NOT NULL AS corrected FROM parse_result LEFT JOIN m ON code = insu_cd""")
def age_correction(spark: SparkSession, d: str) -> DataFrame:
    """Age ranges that aren't plainly written become the commonest plain range of their code in the mapping."""
    plain = r"^[0-9]+~[0-9]+$"
    usual = R.mode_value(read(spark, d, "uw_code_mapping").filter(F.col("code").isNotNull() & F.col("entry_age_m").rlike(plain)), ["code"], "entry_age_m").select(F.col("code").alias("insu_cd"), F.col("entry_age_m").alias("m"))
    ok = F.coalesce(F.col("a").rlike(plain), F.lit(False))
    rows = read(spark, d, "parse_result").select("parse_id", "insu_cd", F.col("terms.ageRange").alias("a")).join(usual, "insu_cd", "left")
    return rows.select("parse_id", F.when(ok, F.col("a")).otherwise(F.coalesce("m", "a")).alias("age_range"), (~ok & F.col("m").isNotNull()).alias("corrected"))


_WANTED = "(SELECT parse_id, insu_cd, trim(t, ' ') AS term, trim(p, ' ') AS pay, terms.ageRange AS age FROM parse_result, unnest(CASE WHEN terms.insuTerm IS NULL THEN ['—'] ELSE string_split(terms.insuTerm, ',') END) a(t), unnest(CASE WHEN terms.payTerm IS NULL THEN ['—'] ELSE string_split(terms.payTerm, ',') END) b(p))"


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    each = lambda c: F.explode(F.when(F.col(c).isNull(), F.array(F.lit("—"))).otherwise(F.split(c, ",")))
    rows = read(spark, d, "parse_result").select("parse_id", "insu_cd", F.col("terms.ageRange").alias("age"), F.col("terms.payTerm").alias("_p"), each("terms.insuTerm").alias("t"))
    return rows.select("parse_id", "insu_cd", "age", F.trim("t").alias("term"), each("_p").alias("p")).select("parse_id", "insu_cd", "term", F.trim("p").alias("pay"), "age")


@query(f"""WITH m AS (SELECT code, period_label, pay_term, entry_age_m, max(map_id) AS map_id FROM uw_code_mapping WHERE code IS NOT NULL AND period_label IS NOT NULL AND pay_term IS NOT NULL AND entry_age_m IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT parse_id, term, pay, map_id, CASE WHEN map_id IS NULL THEN 'NO_ROW' END AS error FROM {_WANTED} w LEFT JOIN m ON m.code = w.insu_cd AND m.period_label = w.term AND m.pay_term = w.pay AND m.entry_age_m = w.age""")
def four_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Join on code, term, payment term and age; misses stay as error rows."""
    m = read(spark, d, "uw_code_mapping").dropna(subset=["code", "period_label", "pay_term", "entry_age_m"]).groupBy("code", "period_label", "pay_term", "entry_age_m").agg(F.max("map_id").alias("map_id"))
    on = (F.col("code") == F.col("insu_cd")) & (F.col("period_label") == F.col("term")) & (F.col("pay_term") == F.col("pay")) & (F.col("entry_age_m") == F.col("age"))
    return _wanted(spark, d).join(m, on, "left").select("parse_id", "term", "pay", "map_id", F.when(F.col("map_id").isNull(), "NO_ROW").alias("error"))


@query(f"""WITH m AS (SELECT code, period_label, pay_term, count(*) AS n FROM uw_code_mapping WHERE code IS NOT NULL AND period_label IS NOT NULL AND pay_term IS NOT NULL GROUP BY 1, 2, 3)
    SELECT parse_id, term, pay, coalesce(n, 0) AS n FROM {_WANTED} w LEFT JOIN m ON m.code = w.insu_cd AND m.period_label = w.term AND m.pay_term = w.pay""")
def join_back(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the mapping joined back to the expanded rows on code, term and payment term."""
    m = read(spark, d, "uw_code_mapping").dropna(subset=["code", "period_label", "pay_term"]).groupBy("code", "period_label", "pay_term").agg(F.count(F.lit(1)).alias("n"))
    on = (F.col("code") == F.col("insu_cd")) & (F.col("period_label") == F.col("term")) & (F.col("pay_term") == F.col("pay"))
    return _wanted(spark, d).join(m, on, "left").select("parse_id", "term", "pay", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH a AS (SELECT insu_cd AS code, count(*) AS n_limits FROM documents WHERE contains(text, '한도') AND insu_cd IS NOT NULL GROUP BY 1), b AS (SELECT code, min(product_name) AS name FROM uw_code_mapping WHERE code IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.code, b.code) AS code, coalesce(name, '특약') AS name, coalesce(n_limits, 0) AS n_limits, CASE WHEN b.code IS NULL THEN 'limit' WHEN a.code IS NULL THEN 'code' ELSE 'both' END AS side FROM a FULL JOIN b ON a.code = b.code""")
def limits_and_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes with the documents that limit them; those of one side only stay, with a name by default."""
    a = read(spark, d, "documents").filter(F.contains("text", F.lit("한도")) & F.col("insu_cd").isNotNull()).groupBy(F.col("insu_cd").alias("ac")).agg(F.count(F.lit(1)).alias("n_limits"))
    b = read(spark, d, "uw_code_mapping").filter("code IS NOT NULL").groupBy("code").agg(F.min("product_name").alias("name"))
    side = F.when(F.col("code").isNull(), "limit").when(F.col("ac").isNull(), "code").otherwise("both")
    return a.join(b, F.col("ac") == F.col("code"), "full_outer").select(F.coalesce("ac", "code").alias("code"), F.coalesce("name", F.lit("특약")).alias("name"), F.coalesce("n_limits", F.lit(0)).alias("n_limits"), side.alias("side"))


@query("""SELECT main_code, type_label, code AS rider, min(product_name) AS name FROM uw_code_mapping u WHERE code <> main_code AND EXISTS (SELECT 1 FROM uw_code_mapping m WHERE m.code = m.main_code AND m.main_code = u.main_code AND m.type_label = u.type_label) GROUP BY 1, 2, 3""")
def riders_of_main(spark: SparkSession, d: str) -> DataFrame:
    """Riders of each main contract of the same type, one row each; both sides are reduced before they meet."""
    u = read(spark, d, "uw_code_mapping")
    main = u.filter("code = main_code").select("main_code", "type_label").dropna().distinct()
    return u.filter("code <> main_code").groupBy("main_code", "type_label", F.col("code").alias("rider")).agg(F.min("product_name").alias("name")).join(main, ["main_code", "type_label"], "left_semi")


_TOP_CODE = "(SELECT insu_cd FROM learned_pattern WHERE insu_cd IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, insu_cd LIMIT 1)"


@query(f"SELECT pattern_id, insu_cd, field_name, pattern_value, confidence_score, priority FROM learned_pattern WHERE is_active AND insu_cd = {_TOP_CODE}")
def patterns_of_code(spark: SparkSession, d: str) -> DataFrame:
    """Active patterns of one code, here the one with most patterns."""
    p = read(spark, d, "learned_pattern")
    top = p.filter("insu_cd IS NOT NULL").groupBy("insu_cd").count().orderBy(F.desc("count"), "insu_cd").limit(1).select("insu_cd")
    return p.filter("is_active").join(F.broadcast(top), "insu_cd").select("pattern_id", "insu_cd", "field_name", "pattern_value", "confidence_score", "priority")


@query("""SELECT 'code' AS filter, code AS key, count(*) AS n FROM uw_code_mapping GROUP BY 2 UNION ALL SELECT 'code_period', code || '/' || period_label, count(*) FROM uw_code_mapping GROUP BY 2 UNION ALL SELECT 'code_pay', code || '/' || pay_term, count(*) FROM uw_code_mapping GROUP BY 2
    UNION ALL SELECT 'group', product_group, count(*) FROM uw_code_mapping GROUP BY 2 UNION ALL SELECT 'kind', period_kind, count(*) FROM uw_code_mapping GROUP BY 2""")
def mapping_filters(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each filter of the mapping would give for each of its keys; one pass over the table."""
    both = lambda b: F.concat("code", F.lit("/"), b)
    keys = {"code": F.col("code"), "code_period": both("period_label"), "code_pay": both("pay_term"), "group": F.col("product_group"), "kind": F.col("period_kind")}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), c.alias("key")) for n, c in keys.items())))
    return read(spark, d, "uw_code_mapping").select(each.alias("k")).groupBy("k.filter", "k.key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT insu_cd, log_id, created_at FROM {_LOG} WHERE insu_cd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY insu_cd ORDER BY created_at DESC, log_id DESC) <= 2""")
def latest_corrections_of_codes(spark: SparkSession, d: str) -> DataFrame:
    """The two latest corrections of every code."""
    log = read(spark, d, "correction_log").filter("insu_cd IS NOT NULL").select("insu_cd", "log_id", "created_at").dropDuplicates(["log_id"])
    return R.top_per_key(log, ["insu_cd"], [F.desc("created_at"), F.desc("log_id")], 2)


@query("""SELECT pattern_id, insu_cd, field_name FROM learned_pattern WHERE field_name = 'payTerm' ORDER BY pattern_id DESC LIMIT 20 OFFSET 20""")
def paged_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Second page of the patterns of a field; of two optional filters one applies."""
    return R.page(read(spark, d, "learned_pattern").select("pattern_id", "insu_cd", "field_name"), [F.desc("pattern_id")], 1, 20, field_name="payTerm", insu_cd=None)


@query("""SELECT code, count(*) AS n FROM uw_code_mapping WHERE regexp_matches(code, '^(3[0-4][0-9]{3}|35[0-4][0-9]{2}|35500)$') GROUP BY 1""")
def code_range(spark: SparkSession, d: str) -> DataFrame:
    """Codes from 30000 to 35500, by number; other spellings than five digits are in no range."""
    number = F.when(F.col("code").rlike(r"^\d{5}$"), F.col("code").cast("int"))
    return read(spark, d, "uw_code_mapping").filter(number.between(30_000, 35_500)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT map_id FROM uw_code_mapping QUALIFY row_number() OVER (PARTITION BY code, period_label, pay_term ORDER BY loaded_at DESC NULLS LAST, map_id DESC) = 1""")
def dedup_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    """One row per code, label and payment term: the one loaded last."""
    rows = read(spark, d, "uw_code_mapping").select("code", "period_label", "pay_term", "loaded_at", "map_id")
    return R.pick_per_key(rows, ["code", "period_label", "pay_term"], [F.col("loaded_at"), F.col("map_id")], ["map_id"]).select("map_id")


@query("""SELECT pattern_id FROM learned_pattern WHERE pattern_id NOT IN (SELECT key_id FROM deleted_key WHERE table_name = 'learned_pattern' AND key_id IS NOT NULL)""")
def delete_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Patterns without those recorded as deleted, as the next version of the table."""
    gone = read(spark, d, "deleted_key").filter("table_name = 'learned_pattern'").select(F.col("key_id").alias("pattern_id"))
    return state.delete(read(spark, d, "learned_pattern"), gone, ["pattern_id"]).select("pattern_id")


@query(f"""SELECT log_id, is_learned OR p IS NOT NULL AS is_learned, CASE WHEN p IS NOT NULL THEN p ELSE learning_pattern_id END AS learning_pattern_id FROM {_LOG} LEFT JOIN (SELECT learned_from_log_id AS k, max(pattern_id) AS p FROM learned_pattern WHERE learned_from_log_id IS NOT NULL GROUP BY 1) ON k = log_id""")
def mark_learned(spark: SparkSession, d: str) -> DataFrame:
    """Logs that patterns were learned from marked so, as the next version of the table."""
    log = read(spark, d, "correction_log").dropDuplicates(["log_id"]).select("log_id", "is_learned", "learning_pattern_id")
    p = read(spark, d, "learned_pattern").filter("learned_from_log_id IS NOT NULL").groupBy(F.col("learned_from_log_id").alias("log_id")).agg(F.max("pattern_id").alias("p"))
    return state.update(log, p, ["log_id"], {"is_learned": F.lit(True), "learning_pattern_id": F.col("s.p")})


@query("""WITH r AS (SELECT example_id, insu_cd, row_number() OVER (PARTITION BY insu_cd ORDER BY created_at, example_id) - 1 AS n, count(*) OVER (PARTITION BY insu_cd) AS k FROM (SELECT DISTINCT example_id, insu_cd, created_at FROM few_shot_example WHERE insu_cd IS NOT NULL))
    SELECT example_id, insu_cd, CAST(n // 10 AS INT) AS batch_no FROM r WHERE (n // 10 + 1) * 10 <= k""")
def count_triggered(spark: SparkSession, d: str) -> DataFrame:
    """Examples that fill whole batches of ten per code; the rest waits."""
    e = read(spark, d, "few_shot_example").filter("insu_cd IS NOT NULL").select("example_id", "insu_cd", "created_at").distinct()
    return state.full_batches(e, ["insu_cd"], F.to_date("created_at"), [F.col("created_at"), F.col("example_id")], 10).select("example_id", "insu_cd", "batch_no")


@query(f"""SELECT strftime(created_at - INTERVAL 2 HOUR, '%Y-%m-%d') AS run_day, count(*) AS n, count(DISTINCT insu_cd) AS n_codes FROM {_LOG} WHERE created_at IS NOT NULL GROUP BY 1""")
def nightly_runs(spark: SparkSession, d: str) -> DataFrame:
    """What each run at two in the night finds: corrections since the run before."""
    log = read(spark, d, "correction_log").filter("created_at IS NOT NULL").dropDuplicates(["log_id"])
    return log.groupBy(F.date_format(F.col("created_at") - F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd").alias("run_day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("insu_cd").alias("n_codes"))


@query(f"""WITH live AS (SELECT strftime(created_at, '%Y-%m') AS period, count(*) AS n FROM {_LOG} WHERE created_at IS NOT NULL GROUP BY 1), stored AS (SELECT strftime(created_at, '%Y-%m') AS period, count(*) AS n FROM learned_pattern WHERE created_at IS NOT NULL GROUP BY 1)
    SELECT coalesce(l.period, s.period) AS period, coalesce(l.n, 0) AS n_live, s.n AS n_stored, coalesce(l.n, 0) - coalesce(s.n, 0) AS ahead FROM live l FULL JOIN stored s ON l.period = s.period""")
def stats_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Live counts over stored ones per month; here patterns stand for what was stored."""
    by = lambda df, n: df.filter("created_at IS NOT NULL").groupBy(F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias(n))
    live, stored = by(read(spark, d, "correction_log").dropDuplicates(["log_id"]), "n_live"), by(read(spark, d, "learned_pattern"), "n_stored")
    rows = live.join(stored, "period", "full_outer").withColumn("n_live", F.coalesce("n_live", F.lit(0)))
    return rows.select("period", "n_live", "n_stored", (F.col("n_live") - F.coalesce("n_stored", F.lit(0))).alias("ahead"))


@query(f"""SELECT l.user_id, count(*) AS n_logs, count(*) FILTER (is_verified) AS n_verified, count(e.k) AS n_examples, min(created_at) AS first_at, max(created_at) AS last_at FROM {_LOG} l LEFT JOIN (SELECT DISTINCT source_log_id AS k FROM few_shot_example) e ON e.k = l.log_id GROUP BY 1""")
def detail_report(spark: SparkSession, d: str) -> DataFrame:
    """Corrections per user with what became of them."""
    used = read(spark, d, "few_shot_example").select(F.col("source_log_id").alias("log_id"), F.lit(1).alias("e")).dropna().distinct()
    log = read(spark, d, "correction_log").dropDuplicates(["log_id"]).join(used, "log_id", "left")
    return log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_logs"), F.count(F.when(F.col("is_verified"), 1)).alias("n_verified"), F.count("e").alias("n_examples"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("""SELECT 'unique pattern_id' AS rule, count(*) AS n FROM (SELECT pattern_id FROM learned_pattern WHERE pattern_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 'unique log_id', count(*) FROM (SELECT log_id FROM correction_log WHERE log_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'required insu_cd', 1 FROM (SELECT count(*) AS c FROM correction_log WHERE insu_cd IS NULL) WHERE c > 0
    UNION ALL SELECT 'required learned_from_log_id', 1 FROM (SELECT count(*) AS c FROM learned_pattern WHERE learned_from_log_id IS NULL) WHERE c > 0""")
def constraint_check(spark: SparkSession, d: str) -> DataFrame:
    """Constraints of two tables with the number of keys (or columns) that break them."""
    found = state.violations(read(spark, d, "learned_pattern"), [["pattern_id"]], ["learned_from_log_id"]).unionByName(state.violations(read(spark, d, "correction_log"), [["log_id"]], ["insu_cd"]))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_BLANK_TERMS = " AND ".join(f"coalesce(terms.{f}, '') IN ('', '—')" for f in ("insuTerm", "payTerm", "ageRange"))


@query(f"""WITH t AS ({SQL['labelled_terms']}), f AS (SELECT insu_cd, min(doc_id) AS doc_id FROM documents WHERE insu_cd IS NOT NULL AND text IS NOT NULL GROUP BY 1)
    SELECT parse_id, t.insu_term, t.pay_term, t.age_range, CASE WHEN t.doc_id IS NULL THEN 'none' WHEN t.insu_term <> '—' OR t.pay_term <> '—' OR t.age_range <> '—' THEN 'partial' ELSE 'empty' END AS recovered FROM (SELECT * FROM parse_result WHERE {_BLANK_TERMS}) p LEFT JOIN f ON f.insu_cd = p.insu_cd LEFT JOIN t ON t.doc_id = f.doc_id""")
def partial_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Records without any terms get what the first document of their code gives."""
    empty = F.lit(True)
    for f in ("insuTerm", "payTerm", "ageRange"):
        empty = empty & F.coalesce(F.col(f"terms.{f}"), F.lit("")).isin("", "—")
    docs = read(spark, d, "documents").filter("insu_cd IS NOT NULL AND text IS NOT NULL").groupBy("insu_cd").agg(F.min("doc_id").alias("doc_id"))
    found = docs.join(labelled_terms(spark, d).drop("renew"), "doc_id")
    rows = read(spark, d, "parse_result").filter(empty).select("parse_id", "insu_cd").join(found, "insu_cd", "left")
    some = (F.col("insu_term") != "—") | (F.col("pay_term") != "—") | (F.col("age_range") != "—")
    return rows.select("parse_id", "insu_term", "pay_term", "age_range", F.when(F.col("doc_id").isNull(), "none").when(some, "partial").otherwise("empty").alias("recovered"))


@query(f"""WITH m AS (SELECT code, min(pay_term) FILTER (pay_term NOT IN ('', '—')) AS p FROM uw_code_mapping WHERE load_channel = 'manual_mapping' AND code IS NOT NULL GROUP BY 1), v AS ({SQL['validated_hybrid']}), l AS (SELECT insu_cd, max(pattern_value) AS p FROM learned_pattern WHERE field_name = 'payTerm' AND is_active GROUP BY 1),
    h AS (SELECT insu_cd, arg_min(value, t.rec_id) AS p FROM ({SQL['two_parsers']}) t JOIN hybrid_result r ON r.rec_id = t.rec_id WHERE field = 'payTerm' AND value IS NOT NULL AND insu_cd IS NOT NULL GROUP BY 1),
    c AS (SELECT parse_id, [m.p, CASE WHEN v.source = 'parsed' THEN v.pay_term END, l.p, h.p, terms.payTerm] AS ways FROM parse_result r LEFT JOIN m ON m.code = r.insu_cd LEFT JOIN v USING (parse_id) LEFT JOIN l ON l.insu_cd = r.insu_cd LEFT JOIN h ON h.insu_cd = r.insu_cd),
    i AS (SELECT parse_id, ways, list_position(list_transform(ways, lambda x: coalesce(x NOT IN ('', '—'), false)), true) AS i FROM c)
    SELECT parse_id, coalesce(ways[i], '—') AS pay_term, coalesce(['mapping', 'validated', 'learned', 'hybrid', 'parsed'][i], 'default') AS source FROM i""")
def five_steps(spark: SparkSession, d: str) -> DataFrame:
    """Payment terms by the first of five sources that has any, with that source; a dash where none has."""
    m = read(spark, d, "uw_code_mapping").filter("load_channel = 'manual_mapping' AND code IS NOT NULL").groupBy(F.col("code").alias("insu_cd")).agg(F.min(F.when(~F.col("pay_term").isin("", "—"), F.col("pay_term"))).alias("m"))
    v = validated_hybrid(spark, d).filter("source = 'parsed'").select("parse_id", F.col("pay_term").alias("v"))
    learned = read(spark, d, "learned_pattern").filter("field_name = 'payTerm' AND is_active").groupBy("insu_cd").agg(F.max("pattern_value").alias("l"))
    records = read(spark, d, "hybrid_result").filter("insu_cd IS NOT NULL").select("rec_id", "insu_cd")
    h = two_parsers(spark, d).filter("field = 'payTerm' AND value IS NOT NULL").join(records, "rec_id").groupBy("insu_cd").agg(F.min_by("value", "rec_id").alias("h"))
    rows = read(spark, d, "parse_result").select("parse_id", "insu_cd", F.col("terms.payTerm").alias("p")).join(m, "insu_cd", "left").join(v, "parse_id", "left").join(learned, "insu_cd", "left").join(h, "insu_cd", "left")
    r = X.resolve([("mapping", F.col("m")), ("validated", F.col("v")), ("learned", F.col("l")), ("hybrid", F.col("h")), ("parsed", F.col("p"))])
    return rows.select("parse_id", r.alias("r")).select("parse_id", F.coalesce("r.value", F.lit("—")).alias("pay_term"), F.when(F.col("r.source") == "none", "default").otherwise(F.col("r.source")).alias("source"))
